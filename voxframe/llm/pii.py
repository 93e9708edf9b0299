"""Personal data: exact patterns, and terms that disclose the entities they stand beside.

Protected entities are the values found by the patterns. Over the whole corpus, n(t) counts the documents with term
t, n(e) those with entity e, and n(t, e) those in which t stands within ``context_words`` words of e (copies count in
all three; a word that is not whole within ``context_chars`` characters of e is no neighbour). A term discloses e if it stands beside e in ``min_support`` documents and
its pointwise mutual information with e reaches ``disclosure`` of e's information content; in documents that hold e,
all its occurrences are then spans of kind ``term``. Everything is column expressions and joins on keys.

Defined cases: null text counts as empty; repeated rows each get their own result; a null doc_id is kept; an empty
table gives an empty result; other columns pass through (inner columns are prefixed ``_pii_``), but for
columns that have the name of a result column, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.columns import computed_once
from voxframe.llm.spans import located, matches, outside, pieces, rendered, replaced, tagged

_LOCAL = r"A-Za-z0-9._%+\-"
#: The looser forms match alike from the first character of a run, so a run is scanned once, not from each character.
EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
WORD = r"\p{L}{3,}"


@dataclass(frozen=True)
class PiiParams:
    context_words: int = 5
    context_chars: int = 80
    min_support: int = 3
    disclosure: float = 0.9


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    weighted = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(weighted, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, spans: Column) -> Column:
    if kind == "ip":
        return F.filter(spans, lambda s: s["value"].rlike(r"^(?:0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|)(?:\.|$)){4}$"))
    if kind == "card":
        return F.filter(spans, lambda s: F.length(_digits(s["value"])).between(13, 19) & luhn(_digits(s["value"])))
    if kind == "phone":
        return F.filter(spans, lambda s: F.length(_digits(s["value"])).between(9, 15))
    return spans


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus ``_pii_text`` and, per kind, ``_pii_{kind}``: array of (start, end, value)."""
    df = docs.withColumn("_pii_text", F.coalesce(F.col(text), F.lit("")))
    t = F.col("_pii_text")
    need = {"email": t.contains("@"), "phone": t.contains("+"), "ip": F.lit(True), "card": F.lit(True)}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    none = F.array().cast("array<string>")
    df = df.select(*df.columns, *[F.when(need[k], matches(t, patterns[k])).otherwise(none).alias(f"_pii_m_{k}") for k in KINDS])
    return df.select(
        *docs.columns,
        "_pii_text",
        *[
            _valid(k, located(F.col(f"_pii_m_{k}"), F.when(F.size(f"_pii_m_{k}") > 0, pieces(t, patterns[k])).otherwise(none))).alias(f"_pii_{k}")
            for k in KINDS
        ],
    )


def _near(t: Column, s: Column, p: PiiParams) -> Column:
    """The words beside a span that lie whole within context_chars of it; one character more tells whether the last is cut."""
    lo = F.greatest(s["start"] - p.context_chars - 1, F.lit(0))
    left, right = F.substr(t, lo + 1, s["start"] - lo), F.substr(t, s["end"] + 1, F.lit(p.context_chars + 1))
    left = F.when(s["start"] > p.context_chars, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
    right = F.when(F.length(right) > p.context_chars, F.regexp_replace(right, r"\p{L}+$", "")).otherwise(right)
    before, after = (F.regexp_extract_all(x, F.lit(WORD), F.lit(0)) for x in (left, right))
    k = p.context_words
    return F.transform(
        F.concat(F.slice(before, F.greatest(F.size(before) - (k - 1), F.lit(1)), k), F.slice(after, F.lit(1), k)), F.lower
    )


def disclosing_terms(found: DataFrame, p: PiiParams = PiiParams()) -> DataFrame:
    """(entity, term, disclosure) from base_spans' result; counts cover the whole corpus."""
    t = F.col("_pii_text")
    spans = F.concat(*[F.col(f"_pii_{k}") for k in KINDS])
    # neither an entity nor a term has a line feed, and strings are told apart by hash where structs are not
    beside = F.flatten(F.transform(spans, lambda s: F.transform(_near(t, s, p), lambda w: F.concat(s["value"], F.lit("\n"), w))))
    mentions = found.select(F.explode(F.array_distinct(beside)).alias("both")).select(
        F.substring_index("both", "\n", 1).alias("entity"), F.substring_index("both", "\n", -1).alias("term")
    )
    joint = mentions.groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= p.min_support)
    held = (
        found.select(F.explode(F.array_distinct(F.transform(spans, lambda s: s["value"]))).alias("entity"))
        .groupBy("entity")
        .agg(F.count("*").alias("n_e"))
        .where(F.col("n_e") >= p.min_support)
    )
    frequency = (
        found.select(F.explode(F.array_distinct(F.split(F.lower(t), r"[^\p{L}]+"))).alias("term"))
        .where(F.length("term") >= 3)
        .groupBy("term")
        .agg(F.count("*").alias("n_t"))
    )
    total = found.agg(F.count("*").alias("n")).collect()[0]["n"]  # one row
    bits = F.log2(F.lit(float(max(total, 2))) / F.col("n_e"))
    pmi = F.log2(F.col("n_te") * float(max(total, 2)) / (F.greatest(F.col("n_t"), F.col("n_te")) * F.col("n_e")))
    return (
        joint.join(held, "entity")
        .join(frequency, "term")
        .select("entity", "term", F.when(bits > 0, pmi / bits).otherwise(0.0).alias("disclosure"))
        .where(F.col("disclosure") >= p.disclosure)
    )


def sanitise(docs: DataFrame, p: PiiParams = PiiParams(), text: str = "text") -> DataFrame:
    """docs plus n_email, n_ip, n_card, n_phone, base_spans (array of kind:start:end), term_spans, spans and
    ``sanitised``, the text with every span generalised to its kind."""
    found = base_spans(docs, text)
    all_base = F.concat(*[F.col(f"_pii_{k}") for k in KINDS])
    found = found.withColumn("_pii_key", F.md5("_pii_text")).withColumn("_pii_any", computed_once(F.size(all_base) > 0))
    flagged = disclosing_terms(found, p)
    values = found.where("_pii_any").select(
        F.col("_pii_key").alias("_pii_k"), F.explode(F.array_distinct(F.transform(all_base, lambda s: s["value"]))).alias("entity")
    ).distinct()
    terms = values.join(flagged, "entity").groupBy("_pii_k").agg(F.sort_array(F.collect_set("term")).alias("_pii_terms"))
    df = found.withColumn("_pii_own", F.when(F.col("_pii_any"), F.col("_pii_text")))
    df = df.join(terms, F.col("_pii_key") == F.col("_pii_k"), "left")
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("_pii_terms", "|"), F.lit(r")(?!\p{L})"))
    own = F.col("_pii_own")
    hit = F.col("_pii_terms").isNotNull() & own.isNotNull()
    df = df.withColumn("_pii_pattern", F.when(hit, pattern))
    df = df.withColumn("_pii_hits", F.when(hit, F.regexp_extract_all(own, F.col("_pii_pattern"), F.lit(0))))
    df = df.withColumn("_pii_term", outside(located(F.col("_pii_hits"), F.split(own, F.col("_pii_pattern"), -1)), all_base))
    everything = F.concat(*[tagged(k, F.col(f"_pii_{k}")) for k in (*KINDS, "term")])
    base = F.concat(*[rendered(k, F.col(f"_pii_{k}")) for k in KINDS])
    results = ("n_email", "n_ip", "n_card", "n_phone", "n_term", "base_spans", "spans", "sanitised")
    return df.select(
        *[c for c in docs.columns if c.lower() not in results],
        *[F.size(f"_pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.size("_pii_term").cast("long").alias("n_term"),
        base.alias("base_spans"),
        F.concat(base, rendered("term", F.col("_pii_term"))).alias("spans"),
        replaced(F.col("_pii_text"), everything).alias("sanitised"),
    )
