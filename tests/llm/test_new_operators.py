"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.llm import hard_negatives, relative_lz, spelling
from voxframe.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"


def brute_passages(texts, length):
    docs = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in docs for i in range(len(w) - length + 1))
    out = []
    for w in docs:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def texts_with_passages(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    shared = [[word() for _ in range(rng.randint(8, 40))] for _ in range(5)]
    out = []
    for _ in range(n):
        w = [word() for _ in range(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 2)):
            s, at = rng.choice(shared), rng.randint(0, len(w))
            w[at:at] = s[rng.randrange(4) : len(s) - rng.randrange(4)]
        out.append("".join(x + rng.choice([" ", "\n", "  ", "\t", "\x0b"]) for x in w))
    return out + [out[0], out[0], "", None, " \n ", "x", "ab " * 60, "one two " * 40, "    \x1c " * 30]


@pytest.mark.parametrize("seed,block_runs,block_words", [(1, 20_000, 1 << 19), (2, 1, 1 << 19), (3, 20_000, 50)])
def test_passages_match_brute_force(spark, monkeypatch, seed, block_runs, block_words):
    monkeypatch.setattr(relative_lz, "BLOCK_RUNS", block_runs)
    monkeypatch.setattr(relative_lz, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(relative_lz, "PIECE", 64)  # so that texts are hashed and cut in pieces
    texts = texts_with_passages(seed)
    names = "doc_id long, text string, anchor long, n_words string, lo int, key long"
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in enumerate(texts)], names).repartition(4)
    out = relative_lz.remove_repeated_passages(df, length=9, gram=4)
    assert out.columns == ["doc_id", "anchor", "lo", "key", "n_words", "n_removed", "kept_sha256", "kept_text"]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute_passages(texts, 9)


def test_passages_in_many_contexts(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(100_000)}"
    common = [word() for _ in range(50)]
    texts = [" ".join([word() for _ in range(5)] + common[rng.randrange(3) :] + [word() for _ in range(30)]) for _ in range(300)]
    texts += [" ".join(word() for _ in range(40)) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in relative_lz.remove_repeated_passages(df, with_text=False).collect()}
    assert [got[i] for i in range(len(texts))] == [r[:3] for r in brute_passages(texts, 35)]


def test_a_very_long_text(spark):
    rng = random.Random(6)
    words = [f"{rng.randrange(10**9)}" for _ in range(150_000)]
    words[140_000:140_040] = words[10:50]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "y" * 3_000_000 + " z")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in relative_lz.remove_repeated_passages(df, with_text=False).collect()}
    assert got == {1: (150_000, 80), 2: (2, 0)}


def test_nothing_to_remove(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert relative_lz.remove_repeated_passages(df).count() == 0
    with pytest.raises(ValueError):
        relative_lz.remove_repeated_passages(df, length=3, gram=4)


@pytest.mark.parametrize("seed", range(6))
def test_index_and_factors(seed):
    rng = np.random.default_rng(seed)
    n, depth = 120, 20
    symbols = rng.integers(0, 3, n)
    symbols[rng.choice(n, 6, replace=False)] = 100 + np.arange(6)
    want = [max(next((k for k in range(depth) if max(i, j) + k >= n or symbols[i + k] != symbols[j + k]), depth) for j in range(n) if j != i) for i in range(n)]
    match = relative_lz.longest_matches(symbols, depth)
    assert match.tolist() == want
    place, size = relative_lz.factors(match, np.array([0, 50]), np.array([50, 120]))
    parts = sorted(zip(place.tolist(), size.tolist()))
    assert sum(s for _, s in parts) == n and all(a + s == b for (a, s), (b, _) in zip(parts, parts[1:]))
    assert all(s == max(1, min(want[a], (50 if a < 50 else 120) - a)) for a, s in parts)


def slipped(doc, run, slip=31):
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % slip == 0 else run


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_spelling(docs, letters, least, ratio, slip):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = Counter(slipped(d, m.translate(lower), slip) for d, t in docs for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
    n = {w: c for w, c in runs.items() if len(w) >= letters and c >= least}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


@pytest.mark.parametrize("letters,ratio,slip", [(3, 2, 5), (7, 10, 31)])
def test_spelling_matches_brute_force(spark, letters, ratio, slip):
    rng = random.Random(letters)
    base = ["".join(rng.choice("abÀéÉ×z") for _ in range(rng.randint(3, 11))) for _ in range(12)] + ["aaaaaaaa", "aaaabaaaa", "Straße", "naïveté"]
    docs = [(i, " ".join(rng.choice(base) if rng.random() < 0.97 else rng.choice(base).upper() + "x" for _ in range(rng.randint(0, 200)))) for i in range(80)]
    docs += [(3, docs[3][1]), (None, docs[5][1]), (90, None), (91, ""), (92, "Ab-cd_ef,gh1ij Āā ¿"), (93, "é" * 30 + " " + "e" * 30)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, word string, n int").repartition(3)
    out = spelling.spelling_variants(df, letters=letters, ratio=ratio, slip=slip)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = {r["word"]: tuple(r)[1:] for r in out.collect()}
    assert got == brute_spelling(docs, letters, 2, ratio, slip)


def test_roots_follow_long_chains(spark):
    words = ["a" * k for k in range(8, 13)]
    text = " ".join(w for k, w in enumerate(words) for _ in range(2 * 3**k))
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), ratio=3, slip=2**33).collect()}
    assert got == {w: (words[k + 1] if k < 4 else None, words[4]) for k, w in enumerate(words)}


def test_very_long_runs(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh") for _ in range(300_000))
    other = long[:1000] + "z" + long[1001:]
    df = spark.createDataFrame([(1, f"{long} {long} {other} {other} {other[:-1]} {other[:-1]}")], "doc_id long, text string")
    got = sorted((len(r["word"]), r["n"], r["n_near"]) for r in spelling.spelling_variants(df, slip=2**33).collect())
    assert got == [(299_999, 2, 1), (300_000, 2, 1), (300_000, 2, 2)]
    assert spelling.spelling_variants(df.where("doc_id > 1")).count() == 0


def test_deletion_keys_are_those_of_the_rests():
    words = [b"abcab", b"aab", b"ab", b"b\xe9c", b"x"]
    word, place, key = spelling.deletion_keys(words)
    rests = [words[w] if p < 0 else words[w][:p] + words[w][p + 1 :] for w, p in zip(word, place)]
    whole = {r: k for r, k in zip(*(lambda w: (w, spelling.deletion_keys(w)[2][spelling.deletion_keys(w)[1] < 0]))(sorted(set(rests) - {b""})), strict=True)}
    assert len(rests) == sum(len(w) + 1 for w in words) and all(whole[r] == k for r, k in zip(rests, key) if r)
    assert len(set(whole.values())) == len(whole)


def brute_negatives(rows, every=50, positives=5, negatives=3, low=50, high=95):
    rows = [(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    rows = sorted(set(rows))
    out = set()
    for a in rows:
        if a[0] % every:
            continue
        s = {b: sum(x * y for x, y in zip(a[2], b[2])) for b in rows if b != a}
        first = lambda of: sorted(of, key=lambda b: (-s[b], b[0]))
        for p in first(b for b in s if b[1] == a[1])[:positives]:
            fits = first(b for b in s if b[1] != a[1] and low * s[p] <= 100 * s[b] <= high * s[p])
            out |= {(a[0], p[0], k, b[0], s[p], s[b]) for k, b in enumerate(fits[:negatives], 1)}
    return out


def vectors(seed, n, dims, labels, scale=1.0):
    rng = random.Random(seed)
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    return [(i, rng.randrange(labels), [scale * (c + rng.gauss(0, 0.7)) for c in centre[rng.randrange(labels)]]) for i in range(n)]


def mined(spark, rows, **k):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, uid string, slot int").repartition(3)
    out = hard_negatives.hard_negatives(df, **k)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed,dims,scale,cell", [(1, 8, 1.0, 4096), (2, 3, 0.01, 40), (3, 16, 300.0, 64), (4, 2, 1e6, 100)])
def test_negatives_match_brute_force(spark, monkeypatch, seed, dims, scale, cell):
    monkeypatch.setattr(hard_negatives, "CELL", cell)
    rows = vectors(seed, 700, dims, 4, scale)
    nan, inf = float("nan"), float("inf")
    rows += [(1000, 1, None), (1001, None, [1.0] * dims), (1050, 1, [nan] * dims), (1100, 1, [inf] + [1.0] * (dims - 1)), (1150, 1, [None] * dims), (None, 1, [1.0] * dims)]
    rows += [(1200, 1, []), (1201, 1, []), (1300, 2, [0.5 * scale]), (1301, 3, [0.5 * scale] * (dims - 1))]
    rows += [rows[0]] * 3 + [(2000 + i, i % 2, rows[7][2]) for i in range(200)]  # alike rows, and many with one vector
    assert mined(spark, rows, anchor_every=20) == brute_negatives(rows, 20)


def test_scores_of_any_size(spark):
    rows = [(0, 1, [1e6, 1.0]), (1, 1, [1e6, 0.0]), (2, 2, [0.8e6, 0.0]), (3, 2, [0.6e6, 5.0]), (4, 2, [1e300, 0.0]), (5, 3, [-1e6, 0.0])]
    got = mined(spark, rows)
    assert got == brute_negatives(rows)


def test_no_anchors_and_other_counts(spark):
    rows = vectors(9, 120, 4, 3)
    assert mined(spark, [r for r in rows if r[0] % 50]) == set() and mined(spark, rows[:0]) == set()
    assert mined(spark, rows, positives=2, negatives=7, low=10, high=120) == brute_negatives(rows, 50, 2, 7, 10, 120)


def test_planes_drop_what_cannot_qualify(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 40, (4000, 24)).round().astype(np.int64)
    a = x[:8]
    exact = a @ x.T
    low, high = np.full((8, 1), -np.inf), np.full((8, 1), np.inf)
    full = []
    einsum = np.einsum
    monkeypatch.setattr(np, "einsum", lambda *k: (full.append(len(k[1])), einsum(*k))[1])
    i, j, r, s = hard_negatives.search(a, x, np.arange(4000), low, high, 5, lambda p, q: np.zeros((p.stop - p.start, q.stop - q.start), bool))
    got = {k: sorted(zip(-s[i == k], r[i == k])) for k in range(8)}
    assert all([int(b) for _, b in got[k]] == sorted(range(4000), key=lambda b: (-exact[k, b], b))[:5] for k in range(8))
    assert sum(full) < exact.size  # most pairs never see their lower planes


@pytest.mark.parametrize("name", ["op11_substring_dedup", "op12_spelling_variants", "op13_hard_negatives"])
def test_queries_over_whole_tables(spark, name):
    got = {tuple(r) for r in QUERIES[name](spark, SF).collect()}
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    if name.startswith("op11"):
        assert got == {(i, *r[:3]) for (i, _), r in zip(docs, brute_passages([t for _, t in docs], 35))}
    elif name.startswith("op12"):
        words = {r[0]: r for r in got}
        some = set(sorted(words)[:: max(1, len(words) // 60)])
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        n = Counter(slipped(d, m.translate(lower)) for d, t in docs for m in re.findall("[A-Za-zÀ-ÿ]+", t or ""))
        assert {w: r[3] for w, r in words.items()} == {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
        assert all(words[w][4] == sum(one_edit(w, v) for v in words) for w in some)
    else:
        rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in table(spark, SF, "embeddings").collect()]
        assert got == brute_negatives(rows)
    assert table(spark, SF, "documents").where(F.lit(True)).count() == len(docs)
