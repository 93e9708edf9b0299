import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxframe.llm import license_scan, pii, quality_rules, secrets
from voxframe.llm.quality_rules import QualityParams
from voxframe.llm.spans import outside


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        s += x - 9 if x > 9 else x
    return s % 10 == 0


def brute_pii(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = {
        "email": [m for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15],
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, ms in out.items() for m in ms]


def brute_secrets(t):
    a = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{x}:{y}" for x, k, y in sorted(a + b + c)]


def texts(alphabet, parts, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) if rng.random() < 0.4 else rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_pii_spans_match_brute_force(spark):
    some = texts("aB1.@_%+- é𝔘()", ["a@b.c", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 010-9999", "0001.2.3.4", "@", ".."], 600, 1)
    some += ["a@b.c_d@e.f", "x@y@z.com", "1.2.3.4.5.6.7.8", "x" * 20000 + "@", "", None, "9" * 5000]
    got = pii.sanitise(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()
    assert len(got) == len(some)
    for r in got:
        assert r["base_spans"] == brute_pii(some[r["doc_id"]] or ""), some[r["doc_id"]]


def test_pii_terms_that_disclose(spark):
    rng = random.Random(4)
    words = ["alpha", "bravo", "candle", "delta", "ember", "fable", "grove", "harbor"]
    rows = [(i, f"{' '.join(rng.choices(words, k=6))} {i} Zebulon writes from z@corp.example.com about {' '.join(rng.choices(words, k=6))}") for i in range(6)]
    rows += [(100 + i, " ".join(rng.choices(words, k=30))) for i in range(400)]
    out = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(any(s.startswith("term:") for s in out[i]["spans"]) for i in range(6))
    assert "Zebulon" not in out[0]["sanitised"] and "[EMAIL]" in out[0]["sanitised"]
    assert all(not out[100 + i]["spans"] for i in range(400))


def test_pii_terms_count_documents(spark):
    """One signature line in many documents, and a term with few contexts in many documents."""
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choices("bcdfgaeiou", k=6)) for _ in range(n))
    rows = [(i, f"{say(20)} some text\nZebulon at z@corp.example.com signs\n{say(20)}") for i in range(40)]
    lines = [f"{say(5)} Quillon knows q@corp.example.com {say(5)}" for _ in range(3)]
    rows += [(100 + i, f"{say(8)} {lines[i % 3]} {say(8)}") for i in range(40)]
    rows += [(200 + i, say(20) + " at some text knows signs " + say(20)) for i in range(200)]
    rows += [(500 + i, f"{say(8)} Rare r{i}@corp.example.com {say(8)}") for i in range(2)]
    out = {r["doc_id"]: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Zebulon" not in out[i]["sanitised"] and "signs" in out[i]["sanitised"] for i in range(40))
    assert all("Quillon" not in out[100 + i]["sanitised"] and "knows" in out[100 + i]["sanitised"] for i in range(40))
    assert all(not out[200 + i]["spans"] for i in range(200)) and "Rare" in out[500]["sanitised"]


def test_secret_spans_match_brute_force(spark):
    some = texts("aF09 =:\"'AK", ["token: ", "API_KEY=", "secret", "AKIA" + "Z9" * 9, "deadbeef" * 3, "pass", "passwd=abc", "AKIA"], 600, 2)
    some += ["token: token: abcdefgh", "secret=token=abcdefghij", "", None, "0" * 23, "0" * 24]
    model = [0.0] * len(secrets.ALPHABET) ** 2
    got = secrets.find_secrets(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), model).collect()
    for r in got:
        assert r["base_spans"] == brute_secrets(some[r["doc_id"]] or ""), some[r["doc_id"]]


def test_markov_model_on_held_out_strings(spark):
    model = secrets.train(secrets.random_samples(spark, 2000).unionByName(secrets.identifier_samples(spark, 2000)))
    rng = random.Random(8)
    rand = ["".join(rng.choice(secrets.ALPHABET[:62]) for _ in range(32)) for _ in range(200)]
    ordinary = ["_".join(rng.choices(secrets.PARTS, k=4)) + str(rng.randrange(100)) for _ in range(200)]
    df = spark.createDataFrame([(x, True) for x in rand] + [(x, False) for x in ordinary], "t string, y boolean")
    p = secrets.SecretParams()
    wrong = df.where((secrets.ratio(F.col("t"), model) >= p.min_ratio) != F.col("y")).count()
    assert wrong <= 8
    text = f"id={rand[0]} name={ordinary[0]}"
    r = secrets.find_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert r["n_markov"] == 1 and rand[0] not in r["redacted"] and ordinary[0] in r["redacted"]


def test_markov_model_on_strings_without_digits(spark):
    model = secrets.train(secrets.random_samples(spark, 2000).unionByName(secrets.identifier_samples(spark, 2000)))
    rng = random.Random(9)
    rand = ["".join(rng.choice(secrets.ALPHABET[:52]) for _ in range(rng.choice([16, 20, 32]))) for _ in range(200)]
    ordinary = ["".join(map(str.capitalize, rng.choices(secrets.PARTS, k=5))) for _ in range(100)] + ["_".join(rng.choices(secrets.PARTS, k=5)) for _ in range(100)]
    ordinary += ["-" * 40, "=" * 16, "/" * 20, "-" * 30 + "Title", "internationalization", "Donaudampfschifffahrtsgesellschaft"]
    rows = [(i, f"see {x} here") for i, x in enumerate(rand + ordinary)]
    out = {r["doc_id"]: r for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert sum(out[i]["n_markov"] == 1 and rand[i] not in out[i]["redacted"] for i in range(200)) >= 190
    assert all(not out[200 + i]["spans"] for i in range(len(ordinary)))


def brute_quality(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    where = {}
    for k in range(len(w) - 7):
        where.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {j for ks in where.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def test_quality_statistics_match_brute_force(spark):
    rng = random.Random(6)
    some = [" ".join(rng.choice("ab cd\n e\t# * é".split(" ")) for _ in range(rng.randint(0, 120))) for _ in range(150)] + ["", None, "a " * 500, "\x1c \x85\xa0 x"]
    df = spark.createDataFrame([(i, t, rng.choice(["en", "de", None])) for i, t in enumerate(some)], "doc_id long, text string, lang string")
    for r in quality_rules.quality_rules(df).collect():
        t = some[r["doc_id"]] or ""
        want = brute_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, repr(t)
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def brute_divergence(p, q):
    p, q = ([x / sum(v) for x in v] for v in (p, q))
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
    return (half(p, q) + half(q, p)) / 2


def test_quality_divergence_matches_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "of", "Ab", "c3,", "#x", "lengthy", "é.", "to", "zz"]
    rows = [(i, " ".join(rng.choices(words, [9, 7, 1, 2, 1, 5, 1, 4, i % 3], k=rng.randint(1, 200))), rng.choice(("en", "de", None)), "x") for i in range(40)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string"))
    assert out.columns.count("kept") == 1
    classes = (r"[A-ZÉ]", r"[0-9]", r"[#*$%&|<>]", r"[.,;:!?'\"()\-]")

    def chars(t):
        known = [len(re.findall(c, t)) for c in classes]
        return [*known, len(t) - sum(known)]

    for r in out.collect():
        t, lang = rows[r["doc_id"]][1:3]
        own = [x for x in rows if lang is None or x[2] == lang]
        total = [sum(v) for v in zip(*(chars(x[1]) for x in own))]
        assert abs(r["char_divergence"] - brute_divergence(chars(t), total)) < 1e-9
        counts = Counter(w for x in own for w in x[1].split() if len(w) <= 5)
        common = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:32]
        mine = [t.split().count(w) for w in common]
        if sum(mine):
            assert abs(r["word_divergence"] - brute_divergence(mine, [counts[w] for w in common])) < 1e-9


def test_quality_verdict(spark):
    rng = random.Random(1)
    common = "the of and to in a is that it was".split()
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.5 else "".join(rng.choices("aeioulnrst", k=7)) for _ in range(150)) + "."
    rows = [(i, prose(), "en") for i in range(60)] + [(100, "".join(rng.choices("#$%&*", k=3)).join(rng.choices("QXZ", k=400)), "en"), (101, " ".join("".join(rng.choices("QXZ", k=6)) + "$$$" for _ in range(150)), "en")]
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), QualityParams()).collect()}
    assert all(kept[i] for i in range(60)) and not kept[101]


def test_quality_verdict_without_languages(spark):
    rng = random.Random(2)
    prose = lambda words: " ".join(rng.choice(words) if rng.random() < 0.5 else "".join(rng.choices("aeioulnrst", k=7)) for _ in range(150)) + "."
    en, xx = "the of and to in a is that it was".split(), "og det er en som på til av at ikke".split()
    junk = " ".join("".join(rng.choices("QXZ", k=6)) + "$$$" for _ in range(150))
    schema = "doc_id long, text string, lang string"
    kept = lambda rows, **k: {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, schema), **k).collect()}
    none = kept([(i, prose(en), None) for i in range(60)] + [(100, junk, None)])
    assert all(none[i] for i in range(60)) and not none[100]
    most = kept([(i, prose(xx), None) for i in range(60)] + [(60 + i, prose(en), "en") for i in range(3)] + [(100, junk, None)])
    assert all(most[i] for i in range(63)) and not most[100]
    empty = quality_rules.fit_references(spark.createDataFrame([], schema))
    assert kept([(1, prose(en), "en")], references=empty) == {1: True}


@pytest.mark.parametrize("run", [lambda d: quality_rules.quality_rules(d), lambda d: pii.sanitise(d), lambda d: secrets.find_secrets(d, [0.0] * len(secrets.ALPHABET) ** 2), lambda d: license_scan.scan_licenses(d.withColumn("path", F.col("source")))])
def test_empty_tables_and_clashing_columns(spark, run):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, start long, kind string")
    assert run(empty).count() == 0
    one = spark.createDataFrame([(None, None, None, None, 1, "x"), (None, None, None, None, 1, "x"), (3, "a@b.co 1.2.3.4", None, "s", 2, "y")], empty.schema)
    out = run(one)
    assert out.count() == 3 and {"start", "kind", "source"} <= set(out.columns)


def test_licences_and_inheritance(spark):
    mit = license_scan.TEMPLATES["MIT"][2]
    rows = [
        ("a/LICENSE", mit), ("a/b/x.py", "hello"), ("a/b/c/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/d/y", "code"),
        ("z/q", "nothing"), ("z/own.txt", "Some words first.\nReleased under the MIT License.\nand many more words that are no licence at all"), (None, None), ("a/b/x.py", "hello"),
    ]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()
    by = {r["path"]: (r["license"], r["origin"]) for r in got}
    assert len(got) == len(rows)
    assert by["a/b/x.py"] == ("MIT", "inherited") and by["a/b/c/d/y"] == ("GPL-3.0", "inherited") and by["z/own.txt"] == ("MIT", "own") and by["z/q"] == (None, "none")


def test_licences_in_wrapped_headers(spark):
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\n\nimport x\n"
    gpl = "/*\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License version 3 as\n * published by the Free Software Foundation\n */\nint x;\n"
    rows = [("m/a.js", mpl), ("g/b.c", gpl), ("z/q", "nothing\nat all"), ("w/x", "one line\nReleased under the MIT\nLicense.\n")] + [(f"p/{i}", f"some copyright words number {i}.") for i in range(30)]
    by = {r["path"]: r["license"] for r in license_scan.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert by["m/a.js"] == "MPL-2.0" and by["g/b.c"] == "GPL-3.0" and by["z/q"] is None and all(by[f"p/{i}"] is None for i in range(30))


def brute_cosine(statement, idf):
    """(cosine, licence) of the closest template, from the definition."""
    mine, out = Counter(re.findall(license_scan.WORD, statement.lower())), (0.0, None)
    size = math.sqrt(sum((n * idf.get(w, idf[""])) ** 2 for w, n in mine.items()))
    for name in sorted(license_scan.TEMPLATES):
        for t in license_scan.TEMPLATES[name]:
            its = Counter(re.findall(license_scan.WORD, t.lower()))
            dot = sum(mine[w] * n * idf[w] ** 2 for w, n in its.items())
            c = dot / size / math.sqrt(sum((n * idf[w]) ** 2 for w, n in its.items())) if size else 0.0
            if c > out[0] + 1e-12:
                out = (c, name)
    return out


def test_licence_cosines_match_brute_force(spark):
    rng = random.Random(4)
    every = [t for some in license_scan.TEMPLATES.values() for t in some]
    words = [w for t in every for w in t.split()]
    said = every + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    said += [" ".join(w for w in rng.choice(every).split() if rng.random() < 0.8) + rng.choice(("", " and more words here")) for _ in range(60)] + ["", "  ", "a a a b"]
    df = spark.createDataFrame(list(enumerate(said)), "i long, text string")
    idf = license_scan.inverse_frequencies(df)
    got = df.select("i", license_scan.best_template(F.col("text"), idf, 0.6).alias("b")).collect()
    for r in got:
        c, name = brute_cosine(said[r["i"]], idf)
        if c >= 0.6:
            assert abs(r["b"]["cosine"] - c) < 1e-9 and (r["b"]["license"] == name or c < 1 + 1e-9 and brute_cosine(said[r["i"]], idf)[0] == pytest.approx(r["b"]["cosine"]))
        else:
            assert r["b"] is None or r["b"]["cosine"] < 0.6


def test_licence_files_and_long_texts(spark, tmp_path):
    """The opening lines of licence files, a text of 200,000 words, and whole texts from a folder."""
    openings = {
        "GPL-3.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n",
        "ISC": "ISC License\n\nCopyright (c) 2020 Some One\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n",
        "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n",
    }
    (tmp_path / "Own-1.0.txt").write_text("You may frobnicate the licensed gadget on every second Tuesday of the quarter under permission of the guild")
    templates = license_scan.templates_from(str(tmp_path))
    rows = [(f"{k}/LICENSE", t, 1.0) for k, t in openings.items()] + [("own/LICENSE", "You may frobnicate the licensed gadget on every second Tuesday\nof the quarter under permission of the guild", 1.0)]
    rows += [("long/x", "license word " * 100_000, 1.0)] + [(f"p/{i}", f"some copyright words number {i}.", 1.0) for i in range(30)]
    out = license_scan.scan_licenses(spark.createDataFrame(rows, "path string, text string, cosine double"), templates=templates)
    assert out.columns.count("cosine") == 1
    by = {r["path"]: r["license"] for r in out.collect()}
    assert {k: by[f"{k}/LICENSE"] for k in openings} == {k: k for k in openings}
    assert by["own/LICENSE"] == "Own-1.0" and by["long/x"] is None


def test_spans_of_texts_with_many_matches(spark):
    """Cuts, overlaps and replacements against plain code, at sizes over several blocks; 30,000 matches in one text."""
    rng = random.Random(12)
    texts = [" ".join(rng.choice(("a@b.co", "1.2.3.4", "x", "é", "+49 30 1234567", "4111 1111 1111 1111", "1.2.3.4@c.de")) for _ in range(n)) for n in (1, 31, 32, 33, 400, 1500)]
    out = pii.sanitise(spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string, n_ip string"))
    assert out.columns.count("spans") == out.columns.count("n_ip") == 1
    for r in out.collect():
        t, at, made = texts[r["doc_id"]], 0, ""
        for start, end, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in r["spans"])):
            if start >= at:
                made, at = made + t[at:start] + f"[{kind.upper()}]", end
        assert r["sanitised"] == made + t[at:]
    spans = [sorted((a := rng.randrange(300), a + rng.randint(1, 9)) for _ in range(rng.randint(0, 50))) for _ in range(40)]
    others = [[(a := rng.randrange(300), a + rng.randint(1, 9)) for _ in range(rng.randint(0, 50))] for _ in range(40)]
    kind = "array<struct<start:int,end:int,value:string>>"
    df = spark.createDataFrame([(i, [(*x, "v") for x in a], [(*x, "o") for x in b]) for i, (a, b) in enumerate(zip(spans, others))], f"i int, a {kind}, b {kind}")
    for r in df.select("i", outside(F.col("a"), F.col("b")).alias("c")).collect():
        assert [(x["start"], x["end"]) for x in r["c"]] == [s for s in spans[r["i"]] if not any(o[0] < s[1] and s[0] < o[1] for o in others[r["i"]])]
    start = time.monotonic()
    long = spark.createDataFrame([(1, "a@b.co " * 30_000)], "doc_id long, text string")
    r = pii.sanitise(long).select("n_email", F.length("sanitised").alias("n"), F.element_at("spans", -1).alias("last")).collect()[0]
    assert tuple(r) == (30_000, 8 * 30_000, f"email:{7 * 29_999}:{7 * 29_999 + 6}") and time.monotonic() - start < 40
