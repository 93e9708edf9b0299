"""Volumes and point sets derived from the driver's tables, the same in Spark and in the oracles' SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edge of the voxel grid in y and x, and its layers for each SLAB_ORDERS order keys: it grows in z with the tables.
GRID, LAYERS, SLAB_ORDERS = 96, 7, 37_500
THRESHOLD = 225


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def volume_shape(spark: SparkSession, sf_dir: str) -> tuple[int, int, int]:
    last = table(spark, sf_dir, "lineitem").agg(F.max("l_orderkey").alias("k")).first()["k"]  # one row
    return LAYERS * ((last or 0) // SLAB_ORDERS + 1), GRID, GRID


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("l_linenumber") - 1 + LAYERS * F.floor(F.col("l_orderkey") / SLAB_ORDERS)
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(z.cast("int").alias("z"), (F.col("l_partkey") % GRID).cast("int").alias("y"), (F.col("l_orderkey") % GRID).cast("int").alias("x"))
        .agg(F.max(F.col("l_quantity").cast("int") * 5).cast("int").alias("v"))
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    cols = [(e[i].cast("double") * s).alias(n) for i, (n, s) in enumerate((("post_z", 100.0), ("post_y", 100.0), ("post_x", 100.0), ("vz", 10.0), ("vy", 10.0), ("vx", 10.0)))]
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *cols, e[6].cast("double").alias("score"), "label")


def pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pre and post point lists with the row numbers of their sources."""
    li = table(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 8 + F.col("l_linenumber"))).alias("row_id"),
        *[F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_partkey", "l_suppkey", "l_linenumber")],
    )
    post = li.select("row_id", F.col("l_linenumber").alias("z"), (F.col("l_partkey") % GRID).alias("y"), F.col("l_suppkey").alias("x"))
    pre = li.select("row_id", (F.col("l_linenumber") + 1).alias("z"), (F.col("l_quantity")).alias("y"), (F.col("l_suppkey") + 2).alias("x"))
    return pre, post


def u(key: Column) -> Column:
    """Portable uniform number of a key."""
    return F.pmod(key * 48271, F.lit(2147483647)) / F.lit(2147483647.0)


#: The depth of the grid, as a scalar.
DEPTH = f"(SELECT {LAYERS} * (max(l_orderkey) // {SLAB_ORDERS} + 1) FROM lineitem)"
VOX = f"""SELECT CAST(l_linenumber - 1 + {LAYERS} * (l_orderkey // {SLAB_ORDERS}) AS INTEGER) AS z, CAST(l_partkey % {GRID} AS INTEGER) AS y, CAST(l_orderkey % {GRID} AS INTEGER) AS x,
 CAST(max(CAST(l_quantity AS INTEGER) * 5) AS INTEGER) AS v FROM lineitem GROUP BY 1, 2, 3"""
FG = f"SELECT *, (CAST(z AS BIGINT) * {GRID} + y) * {GRID} + x AS id FROM ({VOX}) WHERE v >= {THRESHOLD}"
DET = """SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100 AS post_z, CAST(embedding[2] AS DOUBLE) * 100 AS post_y, CAST(embedding[3] AS DOUBLE) * 100 AS post_x,
 CAST(embedding[4] AS DOUBLE) * 10 AS vz, CAST(embedding[5] AS DOUBLE) * 10 AS vy, CAST(embedding[6] AS DOUBLE) * 10 AS vx, CAST(embedding[7] AS DOUBLE) AS score, label FROM embeddings"""
EDGES = """SELECT a.id AS a, b.id AS b FROM fg a JOIN fg b ON (b.z = a.z + 1 AND b.y = a.y AND b.x = a.x)
 UNION ALL SELECT a.id, b.id FROM fg a JOIN fg b ON (b.z = a.z AND b.y = a.y + 1 AND b.x = a.x)
 UNION ALL SELECT a.id, b.id FROM fg a JOIN fg b ON (b.z = a.z AND b.y = a.y AND b.x = a.x + 1)"""
COMPONENTS = f"""WITH RECURSIVE fg AS ({FG}), e1 AS ({EDGES}), e AS (SELECT a, b FROM e1 UNION ALL SELECT b, a FROM e1),
 cc(id, comp) USING KEY (id) AS (SELECT id, id FROM fg UNION
  SELECT e.b, min(c.comp) FROM cc c JOIN e ON c.id = e.a JOIN recurring.cc r ON r.id = e.b WHERE c.comp < r.comp GROUP BY e.b),
 lab AS MATERIALIZED (SELECT fg.*, cc.comp FROM fg JOIN cc ON fg.id = cc.id)"""


def sql_u(key: str) -> str:
    return f"(((({key}) * 48271) % 2147483647) / 2147483647.0::DOUBLE)"
