import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.llm import decontaminate, html_extract, near_dedup, packing, repeats, token_store
from voxframe.llm.queries import tokenizer_path
from voxframe.llm.tokens import WordEncoder


def brute_repeats(texts, n):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] = seen.get(b[i : i + n], 0) + 1
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = [True] * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("at_once", [20_000, 1])
def test_repeats_match_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(repeats, "SPANS_AT_ONCE", at_once)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(30)) for _ in range(4)]
    texts = []
    for _ in range(40):
        t = " ".join(word() for _ in range(rng.randint(0, 60)))
        if rng.random() < 0.6:
            s = rng.choice(shared)
            t = t[: len(t) // 2] + s[rng.randrange(20) : len(s) - rng.randrange(20)] + t[len(t) // 2 :]
        texts.append(t)
    texts += [texts[0], texts[0], "", None, "x", "ab" * 200, "y" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(df, length=40, gram=12).collect()}
    want = brute_repeats(texts, 40)
    assert [got[i] for i in range(len(texts))] == want


def test_repeats_of_many_copies_and_clashing_names(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    hot, other = text(400), text(300)
    texts = [hot] * 200 + [hot[:150] + text(80) + hot[150:], other, other[:120] + text(50), text(500)] + [text(90) + hot[100:180] for _ in range(20)]
    names = "key long, n int, anchor long, n_bytes string, lo int, _n long"
    df = spark.createDataFrame([(i, t, 1, 2, 3, "x", 4, 5) for i, t in enumerate(texts)], "doc_id long, text string, " + names).repartition(3)
    out = repeats.remove_repeats(df, length=60, gram=20)
    assert out.columns.count("n_bytes") == 1 and "key" in out.columns
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out.collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 60)


def test_repeats_of_nothing(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    data = np.frombuffer(bytes(random.Random(1).choices(b"abcd", k=9000)), np.uint8)
    monkeypatch.setattr(repeats, "PIECE", 1000)
    n = sum(b - a - 199 for a, b in repeats._pieces(len(data), 200))
    assert n == len(data) - 199


def test_near_duplicates(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(6))
    rows, want = [], {}
    for g in range(25):
        base = [word() for _ in range(rng.choice([8, 80, 120, 150, 400]))]
        for k in range(rng.randint(1, 4)):
            t = list(base)
            if k and len(t) > 30:
                t[rng.randrange(len(t))] = word()
            want[len(rows)] = g
            rows.append((len(rows), " ".join(t)))
    n = len(rows)
    rows += [(n, ""), (n + 1, None), (n + 2, "!!"), (None, "only here once in this small table"), (0, rows[0][1])]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    classes = {}
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] < n:
            classes.setdefault(r["class_id"], set()).add(want[r["doc_id"]])
    assert all(len(v) == 1 for v in classes.values()) and len(classes) == 25
    assert {r["class_id"] for r in out if r["doc_id"] in (n, n + 1, n + 2)} == {n, n + 1, n + 2}
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert kept.where(F.col("doc_id") < n).count() == 25


def test_icws_agrees_as_often_as_the_texts():
    rng = np.random.default_rng(2)
    h = rng.integers(1, 2**63, 600, dtype=np.uint64)
    a, b = h[:500], h[100:]
    w = np.exp(rng.normal(0, 0.5, 600))
    true = near_dedup.similarity((np.sort(a), w[:500][np.argsort(a)]), (np.sort(b), w[100:][np.argsort(b)]))[0]
    for binned, k in ((False, 2000), (True, 144)):
        x, y = near_dedup.samples(a, w[:500], k, binned), near_dedup.samples(b, w[100:], k, binned)
        assert abs(float(np.mean(x == y)) - true) < (0.05 if not binned else 0.15)


def brute_classes(texts, p, docs=None):
    """Least index of the component of each text under all pairs of weighted similarity p.similarity or more."""
    sk, n = np.zeros((2, p.sketch_width), np.int64), len(texts)
    docs = docs or n
    made = [near_dedup.shingles(t, p.words) for t in texts]
    for h, _ in made:
        for row, cell in enumerate(near_dedup._cells(h, p.sketch_width)):
            np.add.at(sk[row], cell, 1)
    made = [(h, near_dedup.weights(h, tf, sk, docs, p)) for h, tf in made]
    least = list(range(n))

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(n):
        for j in range(i):
            if near_dedup.similarity(made[i], made[j])[0] >= p.similarity:
                a, b = sorted((root(i), root(j)))
                least[b] = a
    return [root(i) for i in range(n)]


def test_near_duplicates_of_one_stem_match_brute_force(spark):
    """Copies at all distances from one text, edits that several share, excerpts and many exact copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("bcdfgaeiou") for _ in range(6))
    base = [word() for _ in range(110)]
    edits = [(rng.randrange(110), word()) for _ in range(12)]
    texts = []
    for _ in range(160):
        t = list(base)
        for _ in range(rng.randint(0, 5)):
            at, w = rng.choice(edits) if rng.random() < 0.6 else (rng.randrange(110), word())
            t[at] = w
        a = rng.choice((0, 0, 0, 10, 20, 30))
        texts.append(" ".join(t[a : 110 - rng.choice((0, 0, 5, 15))]))
    texts += [texts[0]] * 60
    want = brute_classes(texts, near_dedup.NearParams())
    assert 10 < len(set(want)) < 150
    schema = "doc_id long, text string, component long, node long, class_id string, key int, u int, n long"
    docs = spark.createDataFrame([(i, t, i, i, "x", 1, 2, 3) for i, t in enumerate(texts)], schema)
    out = near_dedup.near_duplicates(docs)
    got = {r["doc_id"]: (r["class_id"], r["n_class"]) for r in out.collect()}
    assert [got[i][0] for i in range(len(texts))] == want
    assert all(got[i][1] == want.count(want[i]) for i in got)
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def test_differences_tell_what_two_texts_share():
    rng = np.random.default_rng(5)
    for _ in range(50):
        h = np.unique(rng.integers(1, 2**63, 80, dtype=np.uint64) << np.uint64(1))
        lead, x, y = ((h[m], rng.uniform(0.5, 3, m.sum())) for m in (rng.random(len(h)) < 0.7 for _ in range(3)))
        (ex, dx), (ey, dy) = near_dedup.differences(lead, x), near_dedup.differences(lead, y)
        common = near_dedup.similarity((ex, dx), (ey, dy))[1]
        less = [d[e & np.uint64(1) == 0].sum() for e, d in ((ex, dx), (ey, dy))]
        assert abs(lead[1].sum() - sum(less) + common - near_dedup.similarity(x, y)[1]) < 1e-9


@pytest.mark.parametrize(
    "text",
    ["", " _ ", "a", "It's A_b c2 \u00c4\u0130\u03a3\u0661 \u4e2d\u6587 \U0001d538x a", "ab " * 30_000 + "c" * 70_000 + " ab", "\u00e9" * 40_000 + " x " + "y" * 32_768 + "\u00e9"],
)
def test_word_hashes_match_the_pattern(text):
    words, hashes = re.findall(r"[^\W_]+", text.lower()), near_dedup.word_hashes(text).tolist()
    assert len(words) == len(hashes) and len(set(zip(words, hashes))) == len(set(words)) == len(set(hashes))
    alone = {w: near_dedup.word_hashes(f"- {w}.").item() for w in set(words)}
    assert hashes == [alone[w] for w in words]


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    stop = "the of and to in".split()
    word = lambda: rng.choice(stop) if rng.random() < 0.4 else "".join(rng.choice("bcdfgaeiou") for _ in range(7))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(i, say(30) + ". " + say(10) + ".") for i in range(20)] + [(50, ""), (51, None), (52, "short item"), (53, "the of and to in the of the")]
    docs = [(i, say(200)) for i in range(150)]
    planted = {}
    for i in range(20):
        t = items[i][1].split()
        if i % 3 == 0:
            for j in range(2, 28, 9):
                t[j] = "changed"
        docs[i * 3] = (i * 3, say(80) + " " + " ".join(t).upper() + " " + say(80))
        planted[i * 3] = i
    docs += [(900, ""), (901, None), (902, "x the of and to in the of the x")]
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == set(planted.items()) | {(902, 53)}
    left = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - set(planted) - {902}


def test_decontamination_of_frequent_leaks(spark):
    """Copies in far more than 1 % of the passages, each with words of its own changed."""
    rng = random.Random(12)
    say = lambda n: ["".join(rng.choice("bcdfgaeiou") for _ in range(7)) for _ in range(n)]
    items = [say(37), say(37)]
    docs = [(i, " ".join(say(100))) for i in range(200)]
    for i in range(0, 120, 2):
        t = list(items[0])
        for j in rng.sample(range(37), 1 + i % 3):
            t[j] = f"changed{i}"
        docs[i] = (i, " ".join(say(rng.randrange(60)) + t + say(60)))
    docs[151] = (151, " ".join(say(300) + items[1][:5] + ["other"] + items[1][6:] + say(10)))
    benchmark = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(i, 0) for i in range(0, 120, 2)} | {(151, 1)}


def test_decontamination_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find_leaks(none, one).count() == 0
    assert decontaminate.find_leaks(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_lcs():
    for _ in range(50):
        rng = random.Random(_)
        a, b = [rng.randrange(5) for _ in range(12)], [rng.randrange(6) for _ in range(20)]
        t = [[0] * 21 for _ in range(13)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(decontaminate.masks_of(a), 12, b) == t[12][20]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    alpha = "abcXYZ éÉß.,' \n\t\x1c\x85\xa0²½0(İΣ中"
    return ["".join(rng.choice(alpha) for _ in range(rng.randint(0, 400))) for _ in range(60)] + ["", None, "<|endoftext|> a<|endoftext|>", "long " * 3000, "same", "same"]


def expected(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


def test_word_encoder(texts):
    for cache in (50, 100_000):
        e = WordEncoder(tokenizer_path(), cache)
        assert [x.tolist() for x in e.encode(texts)] == [x.tolist()[:-1] for x in expected(texts, 0)]


def test_packing(spark, texts):
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, other string").repartition(3)
    rows = packing.pack(df, tokenizer_path(), with_ids=True).collect()
    want = expected(texts, 1)
    got, seqs = {}, {}
    for r in rows:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] and r["doc_tokens"] == len(want[r["doc_id"]]) and r["other"] == "k"
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, w in enumerate(want):
        assert b"".join(x for _, x in sorted(got[i])) == w.tobytes()
    assert sorted(seqs) == list(range(len(seqs)))
    for spots in seqs.values():
        at = 0
        for o, n in sorted(spots):
            assert o == at
            at += n
        assert at <= packing.CAPACITY
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_packing_replaces_columns_with_result_names(spark):
    df = spark.createDataFrame([(1, "some text", 9, "x"), (2, None, 9, "y")], "doc_id long, text string, start long, Offset string")
    out = packing.pack(df, tokenizer_path())
    assert [c.lower() for c in out.columns].count("offset") == 1 and {r["start"] for r in out.collect()} == {0}


def test_packing_pads_little():
    rng = random.Random(1)
    assert all(sum(packing.cuts(n)) == n for n in range(1, 5000, 7))
    assert max(packing.cuts(rng.randrange(1, 9999))) <= packing.CAPACITY


def test_token_store_round_trip(spark, texts, tmp_path):
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(7, "twice"), (7, "again"), (None, "no id")]
    manifest = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), f"file://{tmp_path}/store", tokenizer_path())
    got = [tuple(r) for r in token_store.read_store(spark, manifest).orderBy("start").collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for (d, _), ids in zip(order, expected([t for _, t in order], 2)):
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    by_id = {}
    for (d, start, n, crc), (_, t) in zip(want, order):
        by_id.setdefault(d, []).append((len(by_id.get(d, [])), start, n, crc))
    asked = [7, 7, None, 1000, 1000 - len(texts) // 2, 5, 10**12, -4] + [7] * 50
    rows = token_store.lookup(spark.createDataFrame([(i,) for i in asked], "doc_id long"), manifest).collect()
    found = {}
    for r in rows:
        found.setdefault(r["doc_id"], []).append((r["occurrence"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])))
    assert {d: sorted(x) for d, x in found.items()} == {d: by_id[d] for d in set(asked) if d in by_id}
    shard = token_store.Shard(manifest[0]["name"])
    found, _, _ = shard.find(np.arange(10**9, 10**9 + 2000), np.zeros(2000, np.int64))
    assert found.sum() == 0
    empty = token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", tokenizer_path())
    assert token_store.read_store(spark, empty).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 20_000, dtype=np.uint64))
    slots = token_store.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


PAGES = [
    ('<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Home page</a></li></ul></nav><div class="ad">Buy this now</div><article><h1>A &amp; B</h1><p><b>First  words\n here, and more of them.<br><p>Second &lt;part&gt; of it.</p><div class="share">Share me</div></article><footer>&copy; us</footer></body></html>', "A & B\nFirst words here, and more of them.\nSecond <part> of it."),
    ('<body><div class="menu">one two</div><div id="content"><h2>Title</h2><p>Many words in this paragraph of the page are here.</p><form>name <input></form><ul><li>item one</li><li>item two</li></ul><div class="comments"><p>I like it very much indeed, thanks.</p></div></div><div class="footer">end</div>', "Title\nMany words in this paragraph of the page are here.\nitem one\nitem two"),
    ("", ""),
    (None, ""),
    ("<nav>only menu</nav>", ""),
    ("just text with <i>inline</i> tags", "just text with inline tags"),
    ("<p>a < b and <!-- no --> c</p><p>unfinished <b", "a < b and c\nunfinished"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_html(page, text):
    assert html_extract.main_text(page, html_extract.learn(html_extract.labelled_pages())) == text


def test_html_classes_do_not_drop_articles():
    w = html_extract.learn(html_extract.labelled_pages())
    words = "some words of a story that is long enough to be the page's own text"
    for page, text in (
        (f'<article class="post search-result"><h1>T</h1><p>{words}</p></article>', f"T\n{words}"),
        (f'<div class="post-share-body"><h1>T</h1><p>{words}</p></div><footer>x y</footer>', f"T\n{words}"),
        (f'<p>{words}</p><div class="story alert-level"><h1>T</h1><p>{words} {words}</p></div>', f"{words}\nT\n{words} {words}"),
        (f'<div class="article-header"><h1>Head line</h1></div><div class="article-body"><p>{words}</p></div>', f"Head line\n{words}"),
        (f'<div class="with-sidebar"><div class="main"><p>{words}</p></div><div class="sidebar">x y z</div></div>', words),
        (f'<article><p>{words}</p></article><div id="comments"><article class="comment">{words} {words} {words}</article></div>', words),
        (f'<article><p>{words}</p><div class="ad">{words}</div><ul><li>a</li><li>b</li></ul></article><p>beside</p>', f"{words}\na\nb"),
    ):
        assert html_extract.main_text(page, w) == text, page


def test_html_of_any_depth_and_in_linear_time():
    w = html_extract.learn(html_extract.labelled_pages())
    assert html_extract.main_text("<body>" + "<div>" * 20_000 + "text down here" + "</div>" * 20_000, w) == "text down here"
    start = time.monotonic()
    for page in ("<body>" + "<div>" * 20_000 + "</p></x>" * 20_000 + "word", "<a '" * 20_000 + "word", "<" * 50_000, "<p>x" * 50_000, "<!--" * 20_000, '<b "' * 19_999 + ">word", "<article>" * 20_000 + "w" + "<div class=comment>" * 20_000):
        html_extract.main_text(page, w)
    assert time.monotonic() - start < 20


def test_best_region_is_the_maximal_run():
    rng = random.Random(5)
    for _ in range(300):
        x = [rng.choice((-3, -2, -1, 0, 1, 2, 3)) for _ in range(rng.randint(0, 14))]
        best = max((sum(x[i : j + 1]) for i in range(len(x)) for j in range(i, len(x))), default=0)
        lo, hi = html_extract.best_region(x)
        assert sum(x[lo : hi + 1]) == max(0, best)


def unlike_page(rng):
    """A page of other layouts and words than those that the weights come from, and its text."""
    said = lambda a, b: " ".join("".join(rng.choices("bdklmnrstaeiou", k=rng.randint(2, 9))) for _ in range(rng.randint(a, b)))
    blocks, inner = [], ""
    for _ in range(rng.randint(3, 12)):
        t = said(6, 70)
        blocks.append(t)
        inner += rng.choice((f"<p>{t}</p>", f"<section><p><em>{t}</em></p></section>", f"<pre>{t}</pre>", f"<table><tr><td>{t}</td></tr></table>"))
        if rng.random() < 0.2:
            inner += f"<div class='advert'>{said(1, 20)}</div>"
    title = said(2, 8)
    page = rng.choice(
        (
            f"<div id=page><div class=site-header><a href=/>{said(1, 3)}</a></div><main><header><h1>{title}</h1></header>{inner}</main><div class=related><a>{said(3, 9)}</a></div></div>",
            f"<div class='cookie-notice'>{said(5, 30)}</div><div id=content><h1>{title}</h1>{inner}</div><div id=disqus_thread>{said(5, 200)}</div>",
            f"<header><form>{said(1, 3)}</form></header><article><h2>{title}</h2>{inner}<footer>{said(2, 9)}</footer></article><aside>{said(2, 40)}</aside>",
            f"<body><ul><li><a>{said(1, 2)}</a><li><a>{said(1, 2)}</a></ul><div><h1>{title}</h1>{inner}</div><div role=contentinfo>{said(2, 9)}</div>",
        )
    )
    return page, "\n".join([title, *blocks])


def test_html_on_unlike_pages(spark):
    rng = random.Random(8)
    pages = [unlike_page(rng) for _ in range(80)]
    df = spark.createDataFrame([(i, p, "x") for i, (p, _) in enumerate(pages)] + [(80, None, "x"), (81, "", "x")], "page_id long, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert sum(got[i] == t for i, (_, t) in enumerate(pages)) >= 76
    assert got[80] == got[81] == "" and html_extract.extract(df.limit(0)).count() == 0
