"""Losses, schedules and detection metrics as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of balanced weights, as halves of inverse shares.
CLIP_LO, CLIP_HI = 1 / (2 * 0.9993), 1 / (2 * 7e-4)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def focal_bce(df: DataFrame, gamma: float = 2.0, pos_weight: float | None = None, balance: bool = False, balance_scale: float = 1.0) -> DataFrame:
    """Mean focal binary cross entropy of (logit, target): one row, ``loss``. Balanced weights come from a first, one-row count."""
    x = F.greatest(F.least(F.col("logit"), F.lit(15.0)), F.lit(-15.0))
    t = F.col("target")
    ce = F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))
    w = F.lit(1.0)
    if pos_weight is not None:
        w = F.when(t > 0.5, F.lit(float(pos_weight))).otherwise(1.0)
    elif balance:
        r = df.agg(F.sum(t).alias("p"), F.count("*").alias("n")).first()
        pos, n = r["p"] or 0.0, r["n"]
        if pos >= 1:
            clip = lambda v: min(max(v, CLIP_LO), CLIP_HI)
            w = F.when(t > 0.5, F.lit(clip(n / (2 * pos) * balance_scale))).otherwise(F.lit(clip(n / (2 * max(n - pos, 1.0)))))
    p = sigmoid(x)
    pt = p * t + (1 - p) * (1 - t)
    return df.agg(F.avg(F.pow(1 - pt, F.lit(float(gamma))) * ce * w).alias("loss"))


def direction_loss(df: DataFrame, channel_weights: tuple[float, float, float] = (1.0, 1.0, 1.0), by_magnitude: bool = False) -> DataFrame:
    """Masked squared error of p{z,y,x} against t{z,y,x} with weight w: one row, ``loss``."""
    norm = F.sqrt(sum((F.col(f"t{a}") * F.col(f"t{a}") for a in "zyx"), F.lit(0.0))) + 1 if by_magnitude else F.lit(1.0)
    err = sum((F.pow(F.col(f"p{a}") - F.col(f"t{a}"), 2) * c for a, c in zip("zyx", channel_weights, strict=True)), F.lit(0.0))
    return df.agg((F.sum(err * F.col("w") / norm) / (F.sum(F.col("w")) * 3 + 1e-7)).alias("loss"))


def combine(mask: Column, direction: Column, m_scale: float, d_scale: float, how: str = "sum") -> Column:
    if how == "sum":
        return mask * m_scale + direction * d_scale
    if how == "mean":
        return (mask * m_scale + direction * d_scale) / 2
    raise ValueError(f"unknown loss combination {how!r}")


def lr_factor(step: Column, warmup: int = 8000, period: int = 2_000_000, final_div: float = 100.0) -> Column:
    """Linear warm-up from 1e-6, then a cosine from 1 to 1 / final_div."""
    ratio = F.least((step - warmup) / float(max(1, period - warmup)), F.lit(1.0))
    cosine = 0.5 * (1 + F.cos(F.lit(math.pi) * ratio))
    return F.when(step < warmup, F.greatest(step / float(max(1, warmup)), F.lit(1e-6))).otherwise(1 / final_div + (1 - 1 / final_div) * cosine)


def gamma_at(step: Column, start: float, at: int, then: float) -> Column:
    return F.when(step >= at, F.lit(then)).otherwise(F.lit(start))


def separation_cosine(df: DataFrame) -> DataFrame:
    """Mean p in foreground minus background (0 without foreground), and mean cosine of p* and t* where gt > 0.5."""
    fg = F.col("gt") > 0.5
    dot = sum((F.col(f"p{a}") * F.col(f"t{a}") for a in "zyx"), F.lit(0.0))
    n = lambda k: F.sqrt(sum((F.col(f"{k}{a}") * F.col(f"{k}{a}") for a in "zyx"), F.lit(0.0))) + 1e-8
    return df.agg(
        F.coalesce(F.avg(F.when(fg, F.col("p"))) - F.avg(F.when(~fg, F.col("p"))), F.lit(0.0)).alias("separation"),
        F.avg(F.when(fg, dot / (n("p") * n("t")))).alias("cosine"),
    )


def pr_f1(hits: DataFrame, n_pred: int, n_gt: int) -> DataFrame:
    """Precision, recall and F1 of ``hits``, one row per prediction near a ground-truth point (many to one)."""
    tp = F.count("*").cast("double")
    p, r = tp / max(n_pred, 1), tp / max(n_gt, 1)
    return hits.agg(F.count("*").alias("tp"), p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + 1e-8)).alias("f1"))


def pr_curve(df: DataFrame, bins: int = 127) -> DataFrame:
    """Threshold, tp, fp, precision and recall from one count per score bin, summed from the top."""
    from pyspark.sql import Window

    b = F.least(F.floor(F.col("p") * (bins - 1)), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(b.alias("bin")).agg(F.sum(F.when(F.col("target") > 0.5, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("target") > 0.5, 0).otherwise(1)).alias("neg"))
    w = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per bin
    total = df.agg(F.sum(F.when(F.col("target") > 0.5, 1).otherwise(0)).alias("n")).first()["n"] or 0
    tp, fp = F.sum("pos").over(w), F.sum("neg").over(w)
    return counts.select("bin", (F.col("bin") / float(bins - 1)).alias("threshold"), tp.alias("tp"), fp.alias("fp")).withColumns(
        {"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), "recall": F.col("tp") / float(max(total, 1))}
    )
