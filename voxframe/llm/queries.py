"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.llm.decontaminate import find_leaks
from voxframe.llm.hard_negatives import hard_negatives
from voxframe.llm.html_extract import extract
from voxframe.llm.license_scan import scan_licenses
from voxframe.llm.near_dedup import near_duplicates
from voxframe.llm.packing import pack
from voxframe.llm.pii import sanitise
from voxframe.llm.quality_rules import quality_rules
from voxframe.llm.relative_lz import remove_repeated_passages
from voxframe.llm.repeats import remove_repeats
from voxframe.llm.secrets import SecretParams, find_secrets, identifier_samples, random_samples, train, word_samples
from voxframe.llm.spelling import spelling_variants
from voxframe.llm.token_store import read_store, write_store
from voxframe.storage import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def oracle(sql: str) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        ORACLES[f.__name__] = sql
        return query(f)

    return keep


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.array_join("base_spans", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"), "n_term"
    )


def secret_model(docs: DataFrame, labels: DataFrame, p: SecretParams = SecretParams()) -> list[float]:
    """Trained from generated labelled strings and the words of a bounded sample of labelled documents."""
    spark, words = docs.sparkSession, word_samples(docs, labels, p)
    return train(random_samples(spark, p.random_samples).unionByName(identifier_samples(spark, p.identifier_samples)).unionByName(words), p)


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_secrets(docs, secret_model(docs, table(spark, sf_dir, "labels")))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.array_join("base_spans", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"), "n_markov"
    )


@query
def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


@query
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_store(table(spark, sf_dir, "documents"), new_path(spark, "token-store"), tokenizer_path())
    return read_store(spark, manifest)


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_class")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "item_id", F.round("lcs_share", 6).alias("lcs_share"), "answer_found")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return scan_licenses(docs).select("doc_id", "license", F.round("cosine", 6).alias("cosine"), "origin", "licensed_by")


@oracle(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, w, unnest(range(len(w) - 34)) + 1 AS p FROM d WHERE len(w) >= 35),
 h AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 34], ' ')) AS k FROM s),
 r AS (SELECT doc_id, p FROM (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM h) WHERE c > 1),
 g AS (SELECT doc_id, list(DISTINCT q) AS gone FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM r) GROUP BY doc_id),
 k AS (SELECT d.doc_id, w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(coalesce(gone, []), i)) AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(list_select(w, kept), ' ')) AS kept_sha256 FROM k
""")
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@oracle(r"""
WITH crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, x) ORDER BY x) AS t FROM range(256) r(x)),
 runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
 own AS (SELECT doc_id, r, count(*) AS n, hex(encode(doc_id || ':' || r)) AS b FROM runs WHERE length(r) >= 7 GROUP BY 1, 2),
 hashed AS (SELECT r, n, xor(list_reduce(list_transform(range(length(b) // 2), lambda i: ('0x' || b[2 * i + 1:2 * i + 2])::BIGINT),
   lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) AS h FROM own, crc),
 slipped AS (SELECT CASE WHEN h % 31 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, n FROM hashed),
 words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
 places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
 rests AS MATERIALIZED (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM places),
 links AS (SELECT DISTINCT a, b, bn FROM (
   SELECT x.word AS a, y.word AS b, y.n AS bn FROM rests x JOIN rests y USING (rest, i) WHERE x.word <> y.word
   UNION ALL SELECT x.word, y.word, y.n FROM rests x JOIN words y ON y.word = x.rest
   UNION ALL SELECT y.word, x.word, x.n FROM rests x JOIN words y ON y.word = x.rest)),
 best AS (SELECT a, count(*) AS c, max(bn) AS bn, arg_min(b, (-bn, b)) AS b FROM links GROUP BY a),
 forms AS MATERIALIZED (SELECT word, n, coalesce(c, 0)::BIGINT AS n_near, CASE WHEN bn >= 10 * n THEN b END AS form, CASE WHEN bn >= 10 * n THEN bn END AS form_n FROM words LEFT JOIN best ON word = a)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (
 WITH RECURSIVE f AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT f.word, g.form, k + 1 FROM f JOIN forms g ON g.word = f.root WHERE g.form IS NOT NULL)
 SELECT word, arg_max(root, k) AS root FROM f GROUP BY word) USING (word)
""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@oracle(r"""
WITH q AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
 p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS k FROM s WHERE alike) WHERE k <= 5),
 n AS (SELECT p.anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
   row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY s.score DESC, s.other) AS rank
   FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))
