"""Which words count as beside a span."""

import random
import re

import pytest
from pyspark.sql import functions as F

from voxframe.llm.pii import PiiParams, _near


def beside(text, start, end, p):
    words = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]+", text)]
    fits = [w for w in words if w[1] - w[0] >= 3]
    left = [w for a, b, w in fits if b <= start and a >= start - p.context_chars]
    right = [w for a, b, w in fits if a >= end and b <= end + p.context_chars]
    return left[-p.context_words :] + right[: p.context_words]


@pytest.mark.parametrize("chars", [12, 20, 80])
def test_words_beside_are_whole(spark, chars):
    rng, p, rows = random.Random(chars), PiiParams(context_chars=chars), []
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 12)))
    for i in range(120):
        left, right = (" ".join(word() for _ in range(rng.randint(0, 9))) for _ in range(2))
        if rng.random() < 0.5:
            left, right = left + " ", " " + right
        rows.append((i, f"{left}@1@{right}", len(left), len(left) + 3))
    df = spark.createDataFrame(rows, "i int, t string, a int, b int").withColumn("s", F.struct(F.col("a").alias("start"), F.col("b").alias("end")))
    got = {r["i"]: r["w"] for r in df.select("i", _near(F.col("t"), F.col("s"), p).alias("w")).collect()}
    assert got == {i: beside(t, a, b, p) for i, t, a, b in rows}
