"""A study of parameters kept in a table of trials, with proposals by tree-structured Parzen estimators.

Trials (number, params as JSON, value) lie in a Parquet folder, one file a trial. A proposal depends on the table and its number only: the
best share of the trials tells a density of good parameters, the others one of bad ones; candidates are drawn about the
good ones, and the one with the largest ratio of the densities is tried next. So a study that is broken off and taken
up again gives the trials that it would have given in one go.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from voxframe.operators import grid
from voxframe.plans.extract import ExtractParams, extract
from voxframe.plans.search import sample

TRIALS = "number int, params string, value double"
#: Most trials that count as good; so the good ones are few, however many trials there are.
MOST_GOOD = 25


def coordinate(value: Column, span: tuple | list) -> Column:
    """A numeric parameter on the scale that its density is told on."""
    return F.log(value) if len(span) == 3 else value.cast("double")


def split(trials: DataFrame, share: float = 0.1) -> DataFrame:
    """trials with ``good``: the best ``share`` of those with a value, 25 at most, ties to the lesser number."""
    told = trials.where(F.col("value").isNotNull() & ~F.isnan("value"))
    k = min(MOST_GOOD, math.ceil(share * told.count()))
    best = told.orderBy(F.desc("value"), "number").limit(k).select("number", F.lit(True).alias("good"))
    return told.join(F.broadcast(best), "number", "left").withColumn("good", F.coalesce("good", F.lit(False)))


def density_ratios(trials: DataFrame, candidates: DataFrame, widths: dict[str, float]) -> DataFrame:
    """(candidate, ratio): log of the density of good trials over that of bad ones, at each candidate.

    trials: (good, one column a parameter); candidates: (candidate, the same columns), a bounded set that goes to all tasks.
    A density is the mean of product kernels: normal ones whose deviation is that of the side's trials times
    n ** -0.2, a hundredth of the parameter's width at least; for a text parameter (width 0), its share with one
    trial more for all.
    """
    numeric = [k for k, w in widths.items() if w > 0]
    spread = trials.groupBy("good").agg(F.count("*").alias("_n"), *[F.stddev_pop(k).alias(f"_s_{k}") for k in numeric])
    each = trials.join(F.broadcast(spread), "good")  # two rows
    both = each.join(F.broadcast(candidates.select("candidate", *[F.col(k).alias(f"_c_{k}") for k in widths])))
    weight = F.lit(1.0)
    for k in widths:
        if k in numeric:
            h = F.greatest(F.col(f"_s_{k}") * F.pow(F.col("_n"), F.lit(-0.2)), F.lit(widths[k] / 100.0))
            d = (F.col(k) - F.col(f"_c_{k}")) / h
            weight = weight * F.exp(-0.5 * d * d) / h
        else:
            weight = weight * F.when(F.col(k) == F.col(f"_c_{k}"), 1.0 + 1.0 / F.col("_n")).otherwise(1.0 / F.col("_n"))
    side = lambda good: F.sum(F.when(F.col("good") == good, weight / F.col("_n")).otherwise(0.0))
    out = both.groupBy("candidate").agg(side(True).alias("l"), side(False).alias("g"))
    return out.select("candidate", (F.log(F.col("l") + 1e-300) - F.log(F.col("g") + 1e-300)).alias("ratio"))


@dataclass(frozen=True)
class Study:
    """space: as for ``search.sample``; path: the folder of trials; start: trials drawn at random before there are densities."""

    spark: SparkSession
    path: str
    space: dict
    seed: int = 42
    start: int = 10
    drawn: int = 24

    def trials(self) -> DataFrame:
        try:
            return self.spark.read.schema(TRIALS).parquet(f"{self.path}/trial=*")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], TRIALS)

    def propose(self, number: int) -> dict:
        """The parameters of a trial, from those before it."""
        rng = random.Random(f"{self.seed}:{number}")
        before = self.trials().where(F.col("number") < number)
        if number < self.start or before.where(F.col("value").isNotNull()).count() < 2:
            return sample(self.space, rng)
        params = F.from_json("params", ", ".join(f"{k} {'string' if isinstance(v, list) else 'double'}" for k, v in self.space.items()))
        held = before.withColumn("p", params).select("number", "value", *[(F.col(f"p.{k}") if isinstance(v, list) else coordinate(F.col(f"p.{k}"), v)).alias(k) for k, v in self.space.items()])
        told = split(held)
        good = told.where("good").orderBy("number").collect()  # MOST_GOOD rows at most
        widths = {k: 0.0 if isinstance(v, list) else math.log(v[1] / v[0]) if len(v) == 3 else v[1] - v[0] for k, v in self.space.items()}
        rows = []
        for i in range(self.drawn):
            about, own = rng.choice(good), []
            for k, v in self.space.items():
                if isinstance(v, list):
                    own.append(about[k] if rng.random() < 0.8 else str(rng.choice(v)))
                else:
                    lo, hi = (math.log(v[0]), math.log(v[1])) if len(v) == 3 else v[:2]
                    own.append(min(max(rng.gauss(about[k], widths[k] / 10), lo), hi))
            rows.append((i, *own))
        schema = "candidate int, " + ", ".join(f"{k} {'string' if isinstance(v, list) else 'double'}" for k, v in self.space.items())
        best = density_ratios(told, self.spark.createDataFrame(rows, schema), widths).orderBy(F.desc("ratio"), "candidate").first()
        out = {}
        for k, x in zip(self.space, rows[best["candidate"]][1:], strict=True):
            v = self.space[k]
            out[k] = next(c for c in v if str(c) == x) if isinstance(v, list) else math.exp(x) if len(v) == 3 else x
        if "score_thr" in out and "cc_threshold" in out:
            out["score_thr"] = max(out["score_thr"], out["cc_threshold"])
        return out

    def run(self, objective: Callable[[dict], float | None], until: int) -> DataFrame:
        """Go on to trial ``until``; the table of all trials. A trial's file is replaced if it comes again."""
        last = self.trials().agg(F.max("number").alias("n")).first()["n"]  # one row
        for number in range(0 if last is None else last + 1, until):
            params = self.propose(number)
            value = objective(params)
            row = self.spark.createDataFrame([(number, json.dumps(params, sort_keys=True), None if value is None else float(value))], TRIALS)
            row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/trial={number}")
        return self.trials()


def detection_score(det: DataFrame, truth: DataFrame, radius: float) -> float:
    """F1 of detections (id, post_*) against true places (id, post_*), matched one to one within the radius."""
    hits, found, wanted = grid.matched_one_to_one(det, truth, radius).count(), det.count(), truth.count()
    return 2.0 * hits / (found + wanted) if found + wanted else 0.0


def extraction_objective(vox: DataFrame, truth: DataFrame, height: int, width: int, radius: float, base: dict | None = None) -> Callable[[dict], float]:
    """The score of the detection plan with a trial's parameters over ``base``."""
    return lambda params: detection_score(extract(vox, height, width, ExtractParams.of({**(base or {}), **params})).select("id", *grid.POST), truth, radius)
