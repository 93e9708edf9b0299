"""Secret scans: exact patterns, and tokens that a character Markov model takes for random strings.

Two first-order models, of random strings and of ordinary identifiers and words, are counted from labelled samples;
a token's score is its mean log-likelihood ratio per character pair. The table of ratios has one entry per pair of
``ALPHABET``, so it is a literal of fixed size. Everything is column expressions.

Defined cases: null text counts as empty; repeated rows each get their own result; an empty table gives an empty
result; with no samples every pair scores 0 and the model adds nothing; other columns pass through (inner columns
are prefixed ``_sec_``), but for columns that have the name of a result column, which are replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm.spans import located, matches, outside, pieces, replaced, tagged

ASSIGN = r"((?i)password|passwd|secret|token|api_?key(?-i))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
KINDS = tuple(PATTERNS)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_IN = r"A-Za-z0-9+/_=\-"
#: Runs of the alphabet; without a digit, not those that are or hold a ruled line (four equal separators on end).
TOKEN = rf"(?<![{_IN}])(?=[{_IN}]{{16}})(?=[A-Za-z+/_=\-]*+[0-9]|(?![{_IN}]*?([+/_=\-])\1{{3}}))[{_IN}]{{16,}}+"
#: Parts of ordinary identifiers.
PARTS = (
    "get set is has user name id config path file index count value key list map data node item type size buffer error "
    "code time date start end first last next prev read write open close load save parse format string number array "
    "object class module import export test debug info warn default option param result return status update delete "
    "create insert select table column row cache queue task thread lock event handler request response server client"
).split()


@dataclass(frozen=True)
class SecretParams:
    #: Mean log-likelihood ratio (nats per pair) from which a token is a secret.
    min_ratio: float = 0.8
    #: Bounds of the labelled sample.
    random_samples: int = 4000
    identifier_samples: int = 4000
    word_documents: int = 500
    smoothing: float = 0.5


def random_samples(spark: SparkSession, n: int) -> DataFrame:
    """n labelled random strings (base64, mixed and hexadecimal) from a hash of their number."""
    d = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    b = F.substr(F.base64(F.unhex(d)), F.lit(1), F.lit(40))
    kinds = F.when(F.col("id") % 3 == 0, F.substr(d, F.lit(1), F.lit(40))).when(F.col("id") % 3 == 1, F.regexp_replace(b, r"\s", "")).otherwise(F.regexp_replace(b, r"[+/=\s]", ""))
    return spark.range(n).select(kinds.alias("sample"), F.lit(True).alias("random"))


def identifier_samples(spark: SparkSession, n: int) -> DataFrame:
    """n labelled ordinary identifiers: two to four parts in snake, kebab, camel or path form, some with a number."""
    parts = F.split(F.lit(",".join(PARTS)), ",")

    def part(k: int) -> Column:
        return F.get(parts, F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(len(PARTS))).cast("int"))

    some = F.slice(F.array(*[part(k) for k in range(4)]), F.lit(1), (F.pmod(F.xxhash64(F.col("id"), F.lit(9)), F.lit(3)) + 2).cast("int"))
    number = F.when(F.col("id") % 2 == 0, F.pmod(F.xxhash64(F.col("id"), F.lit(8)), F.lit(100)).cast("string")).otherwise("")
    camel = F.array_join(F.transform(some, F.initcap), "")
    form = F.col("id") % 5
    name = (
        F.when(form == 0, F.array_join(some, "_")).when(form == 1, F.array_join(some, "-")).when(form == 2, camel).when(form == 3, F.array_join(some, "/")).otherwise(F.upper(F.array_join(some, "_")))
    )
    return spark.range(n).select(F.concat(name, number).alias("sample"), F.lit(False).alias("random"))


def word_samples(docs: DataFrame, labels: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """Words of the first ``word_documents`` documents labelled as good."""
    chosen = labels.where(F.col("quality") == 1).select("doc_id").distinct().orderBy("doc_id").limit(p.word_documents)
    return (
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")
        .select(F.explode(F.regexp_extract_all(F.col("text"), F.lit(r"(?<![\p{L}\p{N}])[A-Za-z]{3,}(?![\p{L}\p{N}])"), F.lit(0))).alias("sample"))
        .select("sample", F.lit(False).alias("random"))
    )


def train(samples: DataFrame, p: SecretParams = SecretParams()) -> list[float]:
    """Log-likelihood ratio of each pair of ALPHABET, row by row; the counts brought back are one per pair and label."""
    n = len(ALPHABET)
    pairs = samples.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("sample") - 1, F.lit(1))), lambda i: F.substr(F.col("sample"), i, F.lit(2)))).alias("pair"))
    rows = pairs.where(F.col("pair").rlike(rf"^[{_IN}]{{2}}$")).groupBy("random", "pair").agg(F.count("*").alias("n")).collect()
    counts = {True: [p.smoothing] * (n * n), False: [p.smoothing] * (n * n)}
    for r in rows:
        counts[r["random"]][ALPHABET.index(r["pair"][0]) * n + ALPHABET.index(r["pair"][1])] += r["n"]
    out = []
    for a in range(n):
        one, two = (counts[k][a * n : a * n + n] for k in (True, False))
        s, t = sum(one), sum(two)
        out += [math.log(x / s) - math.log(y / t) for x, y in zip(one, two, strict=True)]
    return out


def ratio(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a token of ALPHABET."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in model)), ",").cast("array<double>")
    n = len(ALPHABET)

    def at(i: Column) -> Column:
        return F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1))) - 1

    each = F.transform(F.sequence(F.lit(1), F.length(token) - 1), lambda i: F.get(table, (at(i) * n + at(i + 1)).cast("int")))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / (F.length(token) - 1)


def find_secrets(docs: DataFrame, model: list[float], p: SecretParams = SecretParams(), text: str = "text") -> DataFrame:
    """docs plus n_assign, n_access, n_hex, n_markov, base_spans, spans (arrays of kind:start:end by start, then kind
    as listed) and ``redacted``, the text with every span replaced."""
    df = docs.withColumn("_sec_text", F.coalesce(F.col(text), F.lit("")))
    t = F.col("_sec_text")
    none = F.array().cast("array<string>")
    patterns = PATTERNS | {"markov": TOKEN}
    need = F.when(t.rlike(r"(?i)passw|secret|token|key"), matches(t, ASSIGN)).otherwise(none)
    df = df.select(
        *df.columns,
        need.alias("_sec_m_assign"),
        F.when(t.contains("AKIA"), matches(t, ACCESS)).otherwise(none).alias("_sec_m_access"),
        matches(t, HEX).alias("_sec_m_hex"),
        matches(t, TOKEN).alias("_sec_m_markov"),
    )
    df = df.select(
        *docs.columns,
        "_sec_text",
        *[located(F.col(f"_sec_m_{k}"), F.when(F.size(f"_sec_m_{k}") > 0, pieces(t, x)).otherwise(none)).alias(f"_sec_{k}") for k, x in patterns.items()],
    )
    df = df.withColumn("_sec_assign", F.filter("_sec_assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6))
    base = F.concat(*[F.col(f"_sec_{k}") for k in KINDS])
    df = df.withColumn("_sec_base", base)
    df = df.withColumn("_sec_markov", F.filter(outside(F.col("_sec_markov"), F.col("_sec_base")), lambda s: ratio(s["value"], model) >= p.min_ratio))

    def ordered(kinds: tuple[str, ...]) -> Column:
        def said(i: int, k: str) -> Column:
            return F.transform(
                F.col(f"_sec_{k}"),
                lambda s: F.struct(
                    s["start"].alias("start"),
                    F.lit(i).alias("k"),
                    F.concat(F.lit(k + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")).alias("said"),
                ),
            )

        each = [said(i, k) for i, k in enumerate(kinds)]
        return F.transform(F.array_sort(F.concat(*each)), lambda s: s["said"])

    every = (*KINDS, "markov")
    results = ("n_assign", "n_access", "n_hex", "n_markov", "base_spans", "spans", "redacted")
    return df.select(
        *[c for c in docs.columns if c.lower() not in results],
        *[F.size(f"_sec_{k}").cast("long").alias(f"n_{k}") for k in every],
        ordered(KINDS).alias("base_spans"),
        ordered(every).alias("spans"),
        replaced(t, F.concat(*[tagged(k, F.col(f"_sec_{k}")) for k in every])).alias("redacted"),
    )
