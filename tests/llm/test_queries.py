"""Every registered query and the pipeline, end to end on a small table, against brute force where that is to be had."""

import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F
from test_corpus_operators import brute_classes, brute_repeats, expected
from test_regex_operators import brute_pii, brute_quality, brute_secrets

import __spark_entry__
import corpus_pipeline
from voxframe.llm import near_dedup
from voxframe.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, SF, "documents").collect()}


def result(spark, name, by="doc_id"):
    return {r[by]: r for r in QUERIES[name](spark, SF).collect()}


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert {q.split("_")[0] for q in QUERIES} == {f"op{i}" for i in range(1, 14)}


def digest(spans):
    return hashlib.sha256(",".join(spans).encode()).hexdigest()


@pytest.mark.parametrize("name,brute", [("op3_pii", brute_pii), ("op6_secrets", brute_secrets)])
def test_spans(spark, docs, name, brute):
    got = result(spark, name)
    assert set(got) == set(docs)
    for i, t in docs.items():
        want = brute(t)
        assert got[i]["base_sha256"] == digest(want)
        spans = got[i]["spans"].split(",") if got[i]["spans"] else []
        assert set(want) <= set(spans)


def test_quality(spark, docs):
    got = result(spark, "op9_quality_rules")
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == brute_quality(t)


def test_repeats(spark, docs):
    got = result(spark, "op4_repeats")
    ids = sorted(docs)
    assert [tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in ids] == brute_repeats([docs[i] for i in ids], 200)


def test_near_dedup(spark, docs):
    got, ids = result(spark, "op2_near_dedup"), sorted(docs)
    worded = [i for i in ids if re.search(r"[^\W_]", docs[i])]
    texts = [docs[i] for i in worded]
    p = near_dedup.NearParams()
    assert [got[i]["class_id"] for i in worded] == [worded[k] for k in brute_classes(texts, p, len(ids))]
    assert all(got[i]["class_id"] == i for i in set(ids) - set(worded))


def test_tokens(spark, docs):
    ids = sorted(docs)
    at, got = 0, result(spark, "op8_token_store")
    for i, x in zip(ids, expected([docs[i] for i in ids], 2)):
        assert tuple(got[i])[:4] == (i, at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    pieces = {}
    for r in QUERIES["op7_packing"](spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for i, x in zip(ids, expected([docs[i] for i in ids], 1)):
        end = 0
        for start, n, crc, total in sorted(pieces[i]):
            assert start == end and total == len(x) and crc == zlib.crc32(x[start : start + n].tobytes())
            end += n
        assert end == len(x)


def test_pages(spark):
    got = result(spark, "op10_html_extract", "page_id")
    for r in table(spark, SF, "pages").collect():
        mine = got[r["page_id"]]
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert mine["n_chars"] == len(mine["text"]) and mine["url"] == r["url"]
        words = re.sub(r"<[^>]*>", " ", article).replace("&amp;", "&").split()
        assert mine["text"].split() == words


def test_licences(spark, docs):
    got = result(spark, "op1_license_scan")
    assert set(got) == set(docs)
    for i, t in docs.items():
        said = re.search(r"(?i)licensed? under|MIT License", t)
        assert (got[i]["origin"] == "own") == bool(said) or said is None


def plain(t):
    return " ".join(re.findall(r"[^\W_]+", t.lower()))


def test_decontamination(spark, docs):
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontamination"](spark, SF).collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x and f" {plain(x)} " in f" {plain(t)} "}
    assert want <= got and want


def test_pipeline_stage_by_stage(spark, docs):
    source = table(spark, SF, "documents")
    now, kept = source, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        rows = out.collect()
        kept.append((name, rows))
        if name != "packing":
            assert out.columns == source.columns
            now = spark.createDataFrame(rows, source.schema) if rows else source.limit(0)
    by = {name: {r["doc_id"]: r["text"] for r in rows} for name, rows in kept[:-1]}
    verdict = {r["doc_id"] for r in QUERIES["op9_quality_rules"](spark, SF).where("kept").collect()}
    assert set(by["quality_rules"]) == verdict
    ids = sorted(verdict)
    classes = brute_classes([docs[i] for i in ids], near_dedup.NearParams())
    assert set(by["near_dedup"]) == {ids[k] for k in classes}
    items = [plain(r["text"]) for r in table(spark, SF, "benchmark").collect() if r["text"]]
    gone = set(by["near_dedup"]) - set(by["decontamination"])
    leaks = {i for i in by["near_dedup"] if any(f" {x} " in f" {plain(docs[i])} " for x in items)}
    assert leaks <= gone and set(by["decontamination"]) == set(by["near_dedup"]) - gone
    assert set(by["secret_scan"]) == set(by["decontamination"]) and not any(brute_secrets(t or "") for t in by["secret_scan"].values())
    final = [(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in kept[-1][1]]
    left = by["secret_scan"]
    for i, x in zip(left, expected(list(left.values()), 1)):
        mine = sorted(r[1:] for r in final if r[0] == i)
        assert sum(n for _, n, _ in mine) == len(x) and all(crc == zlib.crc32(x[a : a + n].tobytes()) for a, n, crc in mine)
    assert {r[0] for r in final} == set(left)
    whole = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in whole} == set(left)
