"""Quality rules: exact text statistics and a distribution-divergence verdict, in column expressions only.

A document's character-class and common-word histograms are compared, by Jensen-Shannon divergence, with
references of its language that are gathered over all documents. Languages beyond ``max_languages`` (the most
frequent are kept, so the broadcast reference has a fixed bound) and null languages use the pooled reference, which
counts all documents, those of null language too.

Defined cases: null text counts as empty (no words, base_failed, not kept); documents below ``min_words`` are
outside the guard and pass the divergence rule, as do those whose reference has nothing to compare with; ties and repeated rows are each judged on their own; an empty table
gives an empty result; other columns pass through untouched by name (inner columns are prefixed with ``_qr_``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.columns import computed_once
from voxframe.storage import written

GAP = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
#: Character classes of the histogram; all other characters (small letters and spaces, mostly) are the last class.
CLASSES = {"upper": r"\p{Lu}", "digit": r"0-9", "symbol": r"#*$%&|<>", "mark": r".,;:!?'\"()\-"}
POOLED = "*"
#: A language's words are ranked in so many parts first, so that its last ranking has a fixed number of rows.
RANK_PARTS = 64
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_divergence", "word_divergence", "kept")


@dataclass(frozen=True)
class QualityParams:
    min_base_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    #: Common words: the most frequent ones of at most this many characters.
    common_words: int = 32
    common_word_chars: int = 5
    #: Guard: shorter documents have histograms too coarse to compare.
    min_words: int = 80
    max_char_divergence: float = 0.08
    max_word_divergence: float = 0.60
    max_languages: int = 512


def _count(text: Column, chars: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _windowed(df: DataFrame, w: int) -> DataFrame:
    """Hashes of w neighbours from ``_qr_h``, the hashes of one: each step joins two shorter windows, so a word is
    visited log2(w) times."""
    have = 1
    while have < w:
        step = min(have, w - have)
        h = F.col("_qr_h")
        df = df.withColumn("_qr_h", F.zip_with(h, F.slice(h, F.lit(step + 1), F.greatest(F.size(h), F.lit(0))), lambda a, b: F.xxhash64(a, b)))
        have += step
    h = F.col("_qr_h")
    return df.withColumn("_qr_h", F.slice(h, F.lit(1), F.greatest(F.size(h) - (w - 1), F.lit(0))))


def features(docs: DataFrame, p: QualityParams = QualityParams(), text: str = "text") -> DataFrame:
    """docs plus the exact base columns, ``_qr_chars`` (class counts) and ``_qr_words``."""
    w = p.window
    df = docs.withColumn("_qr_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_qr_words", F.array_remove(F.split("_qr_text", GAP), ""))
    words, t = F.col("_qr_words"), F.col("_qr_text")
    n = F.size(words)
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(HAS_WORD))
    df = df.select(
        *[c for c in df.columns],
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(t).cast("long").alias("_qr_all"),
        *[_count(t, c).alias(f"_qr_{k}") for k, c in CLASSES.items()],
        lines.alias("_qr_lines"),
        F.transform(words, lambda x: F.xxhash64(x)).alias("_qr_h"),
    )
    df = _windowed(df, w)
    h = F.col("_qr_h")
    df = df.withColumn(
        "_qr_sorted",
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    )
    s = F.col("_qr_sorted")
    again = F.filter(
        s,
        lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | ((k < F.size(s) - 1) & (F.get(s, k + 1)["h"] == x["h"])),
    )
    df = df.withColumn("_qr_starts", F.sort_array(F.transform(again, lambda x: x["i"])))
    st = F.col("_qr_starts")
    covered = F.aggregate(
        F.zip_with(st, F.slice(st, F.lit(2), F.greatest(F.size(st), F.lit(1))), lambda a, b: F.least(F.lit(w), F.coalesce(b - a, F.lit(w)))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    known = sum((F.col(f"_qr_{k}") for k in CLASSES), F.lit(0))
    df = df.select(
        *docs.columns,
        "_qr_words",
        "n_words",
        "word_chars",
        F.col("_qr_symbol").alias("n_symbols"),
        (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(st) > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.array(*[F.col(f"_qr_{k}").cast("double") for k in CLASSES], (F.col("_qr_all") - known).cast("double")).alias("_qr_chars"),
    )
    return df.withColumn(
        "base_failed",
        (F.col("n_words") < p.min_base_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(p.max_repeat_percent) * F.col("n_words")),
    )


def _short_words(text: Column, p: QualityParams) -> Column:
    return F.filter(F.split(text, GAP), lambda x: F.length(x).between(1, p.common_word_chars))


def fit_references(docs: DataFrame, p: QualityParams = QualityParams(), text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per language (at most ``max_languages``) and one pooled row: lang, words, word_hist, char_hist.

    Counts cover all documents; partial aggregation leaves one row per language and word from each task.
    """
    d = docs.select(F.col(lang).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    own = (
        d.groupBy("lang")
        .agg(F.count("*").alias("docs"), *[F.sum(_count(F.col("t"), c)).alias(k) for k, c in CLASSES.items()], F.sum(F.length("t")).alias("chars"))
    )
    own = written(own, "class-counts")
    pooled = own.agg(F.lit(POOLED).alias("lang"), *[F.sum(c).alias(c) for c in ("docs", *CLASSES, "chars")])
    kept = own.where(F.col("lang").isNotNull()).orderBy(F.desc("docs"), "lang").limit(p.max_languages)
    chars = kept.unionByName(pooled.where(F.col("docs").isNotNull()))
    known = sum((F.col(k) for k in CLASSES), F.lit(0))
    chars = chars.select("lang", F.array(*[F.col(k).cast("double") for k in CLASSES], (F.col("chars") - known).cast("double")).alias("char_hist"))
    counts = (
        d.select("lang", F.explode(_short_words(F.col("t"), p)).alias("w"))
        .groupBy("lang", "w")
        .agg(F.count("*").alias("n"))
    )
    counts = written(counts, "word-counts")
    everywhere = counts.groupBy("w").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("lang"), "w", "n")
    counts = counts.where(F.col("lang").isNotNull()).unionByName(everywhere)
    top = (
        counts.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(RANK_PARTS)))
        .withColumn("rk", F.row_number().over(Window.partitionBy("lang", "part").orderBy(F.desc("n"), "w")))
        .where(F.col("rk") <= p.common_words)
        .withColumn("rk", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w")))
        .where(F.col("rk") <= p.common_words)
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("rk", "w", "n"))).alias("top"))
    )
    out = chars.join(top, "lang", "left").select(
        "lang",
        "char_hist",
        F.coalesce(F.transform("top", lambda x: x["w"]), F.array().cast("array<string>")).alias("words"),
        F.coalesce(F.transform("top", lambda x: x["n"].cast("double")), F.array().cast("array<double>")).alias("word_hist"),
    )
    return out.select("lang", "words", *[F.transform(c, _part_of(_total(F.col(c)))).alias(c) for c in ("char_hist", "word_hist")])


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda x, y: x + y)


def _part_of(total: Column):
    return lambda x: x / F.nullif(total, F.lit(0.0))


def js_divergence(p: Column, total: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of a count array with this total and an array of shares; null for total 0.

    total is a column of its own: as an expression it would be worked out again for every element.
    """

    def half(x, y):
        return F.when(x > 0, x * (1 - F.log2(1 + y / x))).otherwise(0.0)

    return F.when(
        total > 0, F.aggregate(F.zip_with(p, q, lambda x, y: half(x / total, y) + half(y, x / total)), F.lit(0.0), lambda a, x: a + x) / 2
    )


def quality_rules(docs: DataFrame, p: QualityParams = QualityParams(), text: str = "text", lang: str = "lang", references: DataFrame | None = None) -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_divergence,
    word_divergence and kept. The reference table has at most ``max_languages`` + 1 short rows."""
    spark, docs = docs.sparkSession, docs.drop(*RESULTS)
    fitted = references if references is not None else fit_references(docs, p, text, lang)
    rows = fitted.collect()  # at most max_languages + 1 rows of fixed size
    pooled = next((r for r in rows if r["lang"] == POOLED), None)
    rows = [r for r in rows if r["lang"] != POOLED]
    schema = "_qr_lang string, _qr_ref_chars array<double>, _qr_ref_words array<string>, _qr_ref_hist array<double>"
    ref = spark.createDataFrame([(r["lang"], r["char_hist"], r["words"], r["word_hist"]) for r in rows], schema)
    df = features(docs, p, text).join(F.broadcast(ref), F.col(lang) == F.col("_qr_lang"), "left")

    def or_pooled(column: str, field: str, kind: str) -> Column:
        value = pooled[field] if pooled else []
        return F.coalesce(F.col(column), F.array(*[F.lit(x) for x in value]).cast(kind)).alias(column)

    df = df.select(
        *[c for c in df.columns if not c.startswith("_qr_ref") and c != "_qr_lang"],
        or_pooled("_qr_ref_chars", "char_hist", "array<double>"),
        or_pooled("_qr_ref_words", "words", "array<string>"),
        or_pooled("_qr_ref_hist", "word_hist", "array<double>"),
    )
    common = F.col("_qr_ref_words")
    df = df.withColumn("_qr_hits", F.filter("_qr_words", lambda x: (F.length(x) <= p.common_word_chars) & F.array_contains(common, x)))
    hits = F.col("_qr_hits")
    df = df.withColumn("_qr_hist", F.transform(common, lambda w: (F.size(hits) - F.size(F.array_remove(hits, w))).cast("double")))
    df = df.withColumn("_qr_chars_n", _total(F.col("_qr_chars"))).withColumn("_qr_hist_n", F.size(hits).cast("double"))
    df = df.withColumn("char_divergence", js_divergence(F.col("_qr_chars"), F.col("_qr_chars_n"), F.col("_qr_ref_chars")))
    df = df.withColumn("word_divergence", js_divergence(F.col("_qr_hist"), F.col("_qr_hist_n"), F.col("_qr_ref_hist")))
    guarded = F.col("n_words") < p.min_words
    fine = (F.coalesce(F.col("char_divergence"), F.lit(0.0)) <= p.max_char_divergence) & (
        (F.size(common) == 0) | (F.coalesce(F.col("word_divergence"), F.lit(1.0)) <= p.max_word_divergence)
    )
    df = df.withColumn("kept", computed_once(~F.col("base_failed") & (guarded | fine)))
    return df.select(
        *docs.columns, *RESULTS
    )
