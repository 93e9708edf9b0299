"""Manifests of training samples: volumes and their point lists, matched by stem."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """Last part of a path without its extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)/*$", 1), r"\.[^.]*$", "")


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files of a folder that match; their contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def build(volumes: DataFrame, lists: DataFrame, species: list[str] | None = None) -> DataFrame:
    """(path, stem, species, has_points) of the volumes that have both point lists.

    volumes has path; lists has path ({stem}_pre.csv, {stem}_post.csv) and n, its number of lines; a list of one line or
    none counts as empty. Stems without an underscore and other species than the wanted ones are left out.
    """
    kind = F.regexp_extract("path", r"_(pre|post)\.csv$", 1)
    per = lists.select(F.regexp_replace(stem(F.col("path")), r"_(pre|post)$", "").alias("stem"), kind.alias("kind"), "n").where("kind <> ''")
    both = per.groupBy("stem").agg(F.max(F.when(F.col("kind") == "pre", F.col("n"))).alias("pre"), F.max(F.when(F.col("kind") == "post", F.col("n"))).alias("post"))
    own = volumes.select("path", stem(F.col("path")).alias("stem")).where(F.col("stem").contains("_")).withColumn("species", F.split("stem", "_")[0])
    if species is not None:
        own = own.where(F.col("species").isin(species))
    found = own.join(both.where("pre is not null and post is not null"), "stem")
    return found.select("path", "stem", "species", ((F.col("pre") > 1) & (F.col("post") > 1)).alias("has_points"))


def counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count("*").alias("total"), F.count_if("has_points").alias("with_points"))


def fitting(volumes: DataFrame, want: tuple[int, int, int], context: tuple[int, int, int]) -> DataFrame:
    """volumes (sz, sy, sx) that hold a crop, with ``context`` told: whether it fits with its context too."""
    fits, wide = F.lit(True), F.lit(True)
    for a, n, c in zip("zyx", want, context, strict=True):
        fits, wide = fits & (F.col(f"s{a}") >= n), wide & (F.col(f"s{a}") >= n + 2 * c)
    return volumes.where(fits).withColumn("context", wide)


def checkpoint_at(files: DataFrame, iteration: int) -> DataFrame:
    """The checkpoint files (path) of one iteration; an error if there is none."""
    found = files.where(F.regexp_extract("path", r"_(\d+)\.pt$", 1) == str(iteration))
    if found.isEmpty():
        raise FileNotFoundError(f"no checkpoint of iteration {iteration}")
    return found


def stale_checkpoints(files: DataFrame, keep: int = 1) -> DataFrame:
    """(path) of all but the ``keep`` latest checkpoints of each model."""
    from pyspark.sql import Window

    n = F.regexp_extract("path", r"_(\d+)\.pt$", 1).cast("long")
    model = F.regexp_extract("path", r"^(.*)_checkpoint_\d+\.pt$", 1)
    w = Window.partitionBy("model").orderBy(F.desc("n"))
    return files.select("path", model.alias("model"), n.alias("n")).withColumn("k", F.row_number().over(w)).where(F.col("k") > keep).select("path")
