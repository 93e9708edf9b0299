"""Licence scans: sparse TF-IDF cosine of licence statements to templates, and inheritance from directories.

Every sentence or line of a file that names licences, copyright or permissions is a statement, and so is every block
of consecutive lines that does (comment marks stripped, lines joined), every sentence of such a block, and the whole
of a file with a licence file's name. Its TF-IDF vector is compared with those of the templates; the best cosine from ``min_cosine`` on names the file's own licence. Inverse
document frequencies of the templates' words are counted over all sentences and lines of the corpus (other words count as
rare). A file is a licence file if its name says so or at least ``min_file_share`` of its words are matching
statements of one sort; its licence holds for its directory. Files without a licence of their own take that of the nearest
ancestor directory that has one. Everything is column expressions, one small aggregate and joins on directories.

Defined cases: a null path or text counts as empty (no directory, no statement); repeated rows each get their result;
of several licence files of one directory the one of highest cosine, then least path, holds; of statements with equal
cosine the first template in alphabetical order; an empty table gives an empty result; other columns pass through
(inner columns are prefixed ``_lic_``), but for columns that have the name of a result column, which are replaced.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.llm.columns import computed_once
from voxframe.llm.spans import named

#: Short notices and key sentences of common licences.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License Version 2.0, January 2004",
    ),
    "AGPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL-3.0",
    ),
    "BSD-2-Clause": (
        "Released under the BSD 2-Clause License",
        "BSD 2-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "CC0-1.0": (
        "Licensed under CC0 1.0",
        "To the extent possible under law, the author has dedicated all copyright to this work to the public domain worldwide under the Creative Commons CC0 1.0 license",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "SPDX-License-Identifier: GPL-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL-3.0": (
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This library is licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-3.0",
    ),
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
CLUES = ("licen", "copyright", "spdx", "redistribut", "permission", "permitted", "public domain", "unencumbered", "free to copy")
#: Comment marks at both ends of a line.
MARKS = r"(?m)^[ \t]*(?:<!--+|/?\*+/?|//+|#+|--+|;+|%+)?[ \t]*|[ \t]*(?:\*+/|--+>)?[ \t\r]*$"
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"
WORD = r"[a-z0-9]+"
RESULTS = ("license", "cosine", "origin", "licensed_by")


@dataclass(frozen=True)
class LicenseParams:
    min_cosine: float = 0.6
    min_file_share: float = 0.5


def _clue(x: Column) -> Column:
    out = F.lit(False)
    for c in CLUES:
        out = out | x.contains(c)
    return out


def _terms(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0))


def statements(text: Column) -> Column:
    """Sentences and lines with a clue; empty for most texts, which are only searched for the clues."""
    parts = F.filter(F.split(text, r"\n|(?<=[.;!?])[ \t]+", -1), lambda s: _clue(F.lower(s)))
    return F.when(_clue(F.lower(text)), parts).otherwise(F.array().cast("array<string>"))


def blocks(text: Column) -> Column:
    """Runs of lines without an empty one that have a clue, comment marks stripped, each as one line."""
    parts = F.transform(F.split(F.regexp_replace(text, MARKS, ""), r"\n{2,}", -1), lambda b: F.regexp_replace(b, r"\n", " "))
    return F.when(_clue(F.lower(text)), F.filter(parts, lambda b: _clue(F.lower(b)))).otherwise(F.array().cast("array<string>"))


Templates = Mapping[str, Sequence[str]]


def templates_from(folder: str) -> dict[str, tuple[str, ...]]:
    """Whole licence texts of a folder on the driver, one file a licence named for it (``GPL-3.0.txt``), beside the notices."""
    found = {path.stem if path.suffix == ".txt" else path.name: path.read_text(errors="replace") for path in sorted(Path(folder).iterdir()) if path.is_file()}
    return {name: (*TEMPLATES.get(name, ()), *([found[name]] if name in found else [])) for name in sorted({*TEMPLATES, *found})}


def inverse_frequencies(files: DataFrame, text: str = "text", templates: Templates = TEMPLATES) -> dict[str, float]:
    """ln(1 + statements / statements with the word) of each template word, over all files; "" is that of other words."""
    words = sorted({w for some in templates.values() for t in some for w in re.findall(WORD, t.lower())})
    found = files.select(F.explode(statements(F.coalesce(F.col(text), F.lit("")))).alias("s")).select(F.array_distinct(_terms(F.col("s"))).alias("w"))
    known = F.split(F.lit(" ".join(words)), " ")
    rows = found.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect("w", known))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()  # one row a template word
    df = {r["w"]: r["n"] for r in rows}
    total = df.get("", 0)
    return {w: math.log(1 + (total + 1) / (df.get(w, 0) + 1)) for w in words} | {"": math.log(2 + total)}


def _vectors(idf: dict[str, float], templates: Templates) -> list[tuple[str, dict[str, float]]]:
    """(licence, a factor for each word's count in a text) of each template, licences in alphabetical order."""
    out = []
    for name in sorted(templates):
        for t in templates[name]:
            tf = Counter(re.findall(WORD, t.lower()))
            norm = math.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items()))
            out.append((name, {w: n * idf[w] ** 2 / norm for w, n in tf.items()}))
    return out


def best_template(statement: Column, idf: dict[str, float], min_cosine: float, templates: Templates = TEMPLATES) -> Column:
    """struct(cosine, license, words) of the closest template of one statement, its words counted; null below min_cosine.

    The time is in proportion to the statement's length (but for sorting its words). Templates are only gone through
    if the words that any of them has weigh enough in the statement for the least cosine.
    """
    vectors = _vectors(idf, templates)
    table = {w: [x, *(v.get(w, 0.0) for _, v in vectors)] for w, x in idf.items() if w}
    weights = F.from_json(F.lit(json.dumps(table)), "map<string,array<double>>")
    names = F.split(F.lit("\n".join(n for n, _ in vectors)), "\n")
    vocabulary = F.split(F.lit(" ".join(table)), " ")

    def run(a: Column, t: Column) -> Column:
        """Adds up the squares of words' counts over sorted words."""
        same = a["last"] == t
        return F.struct(t.alias("last"), F.when(same, a["n"] + 1).otherwise(1).alias("n"), (a["squares"] + F.when(same, a["n"] * 2 + 1).otherwise(1)).alias("squares"))

    def compared(terms: Column) -> Column:
        squares = F.aggregate(F.array_sort(terms), F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("squares")), lambda a, t: _run_as(run(a, t)), lambda a: a["squares"])

        def of_words(counts: Column) -> Column:
            known = F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.pow(c["n"] * c["w"][0], 2))
            others = squares - F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c["n"] * c["n"])

            def judged(norms: Column) -> Column:
                zero = F.array_repeat(F.lit(0.0), len(vectors) + 1)
                dots = F.aggregate(counts, zero, lambda acc, c: F.zip_with(acc, c["w"], lambda x, y: x + c["n"] * y))
                own = F.sqrt(norms["own"])
                best = F.array_max(F.transform(dots, lambda x, i: F.when(i > 0, F.struct((x / own).alias("cosine"), (-i).alias("i")))))
                found = named(best, lambda x: F.struct(x["cosine"].alias("cosine"), F.element_at(names, -x["i"]).alias("license"), F.size(terms).alias("words")))
                return F.when((norms["own"] > 0) & (norms["known"] >= norms["own"] * (min_cosine**2 * (1 - 1e-9))), found)

            return named(F.struct(known.alias("known"), (known + others * idf[""] ** 2).alias("own")), judged)

        counts = F.transform(F.array_intersect(terms, vocabulary), lambda w: F.struct((F.size(terms) - F.size(F.array_remove(terms, w))).cast("long").alias("n"), F.element_at(weights, w).alias("w")))
        return named(counts, of_words)

    return named(_terms(statement), compared)


def _run_as(x: Column) -> Column:
    return x.cast("struct<last:string,n:int,squares:bigint>")


def scan_licenses(files: DataFrame, p: LicenseParams = LicenseParams(), path: str = "path", text: str = "text", templates: Templates = TEMPLATES) -> DataFrame:
    """files plus license, cosine, origin (own, inherited, none) and licensed_by (the path it comes from)."""
    idf = inverse_frequencies(files, text, templates)
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    kept = [c for c in files.columns if c.lower() not in RESULTS]
    df = files.withColumn("_lic_path", F.coalesce(F.col(path), F.lit(""))).withColumn("_lic_blocks", blocks(t))
    by_name = F.regexp_extract("_lic_path", r"([^/]*)$", 1).rlike(FILE_NAME)
    whole = F.when(by_name & (F.size("_lic_blocks") > 0), F.array(t)).otherwise(none)
    sorts = (statements(t), F.flatten(F.transform("_lic_blocks", statements)), F.col("_lic_blocks"), whole)
    df = df.withColumn("_lic_said", F.array(*sorts))

    def scored(s: Column) -> Column:
        return F.struct(s.alias("s"), best_template(s, idf, p.min_cosine, templates).alias("b"))

    every = F.array_distinct(F.flatten("_lic_said"))
    df = df.withColumn("_lic_scores", F.when(F.size("_lic_blocks") > 0, F.filter(F.transform(every, scored), lambda x: x["b"]["cosine"] >= p.min_cosine)))
    nothing = F.struct(F.lit(0.0).alias("cosine"), F.lit(None).cast("string").alias("license"))
    best = F.reduce("_lic_scores", nothing, lambda a, x: F.when((x["b"]["cosine"] > a["cosine"]) | ((x["b"]["cosine"] == a["cosine"]) & (x["b"]["license"] < a["license"])), F.struct(x["b"]["cosine"].alias("cosine"), x["b"]["license"].alias("license"))).otherwise(a))

    def matching(said: Column) -> Column:
        """Words of the matching statements of one sort."""
        return F.aggregate(said, F.lit(0), lambda a, s: a + F.coalesce(F.get(F.filter("_lic_scores", lambda x: x["s"] == s), F.lit(0))["b"]["words"], F.lit(0)))

    share = F.array_max(F.transform("_lic_said", matching))
    df = df.withColumn("_lic_best", best)
    df = df.select(
        *files.columns,
        "_lic_path",
        F.regexp_replace("_lic_path", r"/?[^/]*$", "").alias("_lic_dir"),
        F.col("_lic_best.license").alias("_lic_own"),
        F.coalesce(F.col("_lic_best.cosine"), F.lit(0.0)).alias("_lic_cosine"),
        computed_once(F.when(F.size("_lic_scores") > 0, by_name | (share >= p.min_file_share * F.size(_terms(t)))).otherwise(False)).alias("_lic_file"),
    )
    holds = df.where("_lic_file and _lic_own is not null").groupBy(F.col("_lic_dir").alias("_lic_at")).agg(
        F.min(F.struct((-F.col("_lic_cosine")).alias("c"), F.col("_lic_path").alias("path"), F.col("_lic_own").alias("license"))).alias("h")
    )
    dirs = df.select("_lic_dir").distinct()
    depth = F.size(F.split("_lic_dir", "/"))
    ancestors = dirs.select("_lic_dir", F.explode(F.transform(F.sequence(F.lit(0), depth), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(F.split("_lic_dir", "/"), F.lit(1), i), "/").alias("dir")))).alias("a"))
    nearest = (
        ancestors.join(holds, F.col("a.dir") == F.col("_lic_at"))
        .groupBy(F.col("_lic_dir").alias("_lic_of"))
        .agg(F.max_by("h", "a.depth").alias("_lic_from"))
    )
    out = df.join(nearest, F.col("_lic_dir") == F.col("_lic_of"), "left")
    own = F.col("_lic_own").isNotNull()
    return out.select(
        *kept,
        F.coalesce("_lic_own", "_lic_from.license").alias("license"),
        F.when(own, F.col("_lic_cosine")).when(F.col("_lic_from").isNotNull(), -F.col("_lic_from.c")).otherwise(0.0).alias("cosine"),
        F.when(own, "own").when(F.col("_lic_from").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(own, F.col("_lic_path")).otherwise(F.col("_lic_from.path")).alias("licensed_by"),
    )
