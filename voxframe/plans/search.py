"""Random search over configurations with early stopping and a leaderboard."""

from __future__ import annotations

import json
import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxframe.operators.series import leaderboard


def sample(space: dict[str, tuple], rng: random.Random) -> dict:
    """A configuration: (low, high) uniform, (low, high, "log") log-uniform, a list is a choice. score_thr is never below cc_threshold."""
    out = {}
    for k, v in space.items():
        if isinstance(v, list):
            out[k] = rng.choice(v)
        elif len(v) == 3:
            out[k] = v[0] * (v[1] / v[0]) ** rng.random()
        else:
            out[k] = v[0] + (v[1] - v[0]) * rng.random()
    if "score_thr" in out and "cc_threshold" in out:
        out["score_thr"] = max(out["score_thr"], out["cc_threshold"])
    return out


def run_trials(spark: SparkSession, space: dict[str, tuple], score: Callable[[dict, int], float | None], n: int, checks: int = 1, seed: int = 42) -> DataFrame:
    """(number, params, value): each trial is scored up to ``checks`` times and stops at its first drop; its best counts."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        params, best, last = sample(space, rng), None, None
        for c in range(checks):
            f = score(params, c)
            if f is None or (last is not None and f < last):
                break
            last, best = f, f if best is None else max(best, f)
        rows.append((i, json.dumps(params, sort_keys=True), best))
    return spark.createDataFrame(rows, "number int, params string, value double")


def summary(trials: DataFrame, n: int = 20) -> DataFrame:
    return leaderboard(trials, "value", "number", n)
