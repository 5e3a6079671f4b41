"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest directory.

Templates are statements, file headers and the openings of licence texts, few and given by the caller, so their words and
weights are constants of the plan. IDF is that of the template collection; a word that no template has weighs as one
that a single template has; term frequencies enter by their logarithm. Compared are lines, whole licence files, and
sliding windows of words in sizes such that every template lies whole in some window of nearly its own length, wherever
it stands and however it is wrapped.

A unit has to hold a word that names licences or rights and at least three different words of a template, and a cosine is
at most the length of the part of the template whose words the unit holds. So texts without any such word are left out
before they are cut, and only units that hold enough of one template are weighed: exact bounds, taken where the text lies. Directories, not files, look for their nearest
licensed ancestor, by a join on path prefixes.
"""

import math
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bourse.llm.shared import body, quoted, stored

TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
THRESHOLD = 0.6
SHORT = 16  # words up to which a template's windows have its own length and start at every word
SIZES = (20, 30, 46, 68, 103, 154, 231)  # of longer templates' windows, in words; they start every sixth of their size
LINE, WHOLE = 0, -1  # sizes that stand for lines and whole texts
MET = 3  # different words of a template that a unit has to hold
# A unit states a licence only where it holds one of these words; every template does.
ANCHORS = ("license", "licensed", "licenses", "licence", "licenced", "sublicense", "permission", "software", "copyright", "domain")
ANCHORED = "licen[sc]e|permission|software|copyright|domain"  # found in every text that holds an anchor

# Public licence names and the statements by which files commonly name them.
STATEMENTS = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright to this work under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, version 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
# File headers and openings of the licences' own texts.
_FREE = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
_CONDITIONS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
TEXTS = (
    ("AGPL-3.0", _FREE.format("program", "Affero General", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", _CONDITIONS),
    ("BSD-3-Clause", _CONDITIONS + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    ("GPL-2.0", _FREE.format("program", "General", "2")),
    ("GPL-3.0", _FREE.format("program", "General", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _FREE.format("library", "Lesser General", "2.1")),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)
TEMPLATES = (*STATEMENTS, *TEXTS, *((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n for n, _ in (*STATEMENTS, *TEXTS))))


class Templates:
    """Word weights of the templates (1 + ln of the count, times IDF, each template of length one), and the window size of each."""

    def __init__(self, statements: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD):
        words = [re.findall(TOKEN, text.lower()) for _, text in statements]
        df = Counter(w for own in words for w in set(own))
        self.threshold = threshold
        self.idf = {w: self.weight_of(len(words), n) for w, n in df.items()}
        self.unseen = self.weight_of(len(words), 1)
        self.rows, self.units = [], []
        for k, ((name, _), own) in enumerate(zip(statements, words, strict=True)):
            size = len(own) if len(own) <= SHORT else next((s for s in SIZES if 5 * s // 6 >= len(own)), SIZES[-1])
            heavy = {w: (1 + math.log(n)) * self.idf[w] for w, n in Counter(own).items()}
            norm = math.sqrt(sum(x * x for x in heavy.values()))
            self.units.append({w: x / norm for w, x in heavy.items()})
            self.rows += [(k, name, size, w, x) for w, x in self.units[-1].items()]
        self.sizes = sorted({r[2] for r in self.rows})

    @staticmethod
    def weight_of(n: int, df: int) -> float:
        return math.log((1 + n) / (1 + df)) + 1


def step_of(size: int) -> int:
    return 1 if size <= SHORT else size // 6


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1)


def _units(lowered: Column, tokens: Column, named: Column, sizes: Sequence[int]) -> Column:
    """Arrays of (size, at, words): lines, the whole of licence files, and the windows of each size; the last window of a size may be short."""
    unit = lambda size, at, words: F.struct(F.lit(size).alias("size"), at.cast("int").alias("at"), words.alias("words"))
    lines = F.transform(F.split(lowered, "\n", -1), lambda line, k: unit(LINE, k, _tokens(line)))
    whole = F.when(named, F.array(unit(WHOLE, F.lit(0), tokens))).otherwise(F.array().cast("array<struct<size:int,at:int,words:array<string>>>"))

    def windows(size: int) -> Column:
        step = step_of(size)
        last = F.ceil(F.greatest(F.size(tokens) - size, F.lit(0)) / F.lit(step))
        return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda k: unit(size, k, F.slice(tokens, (k * step + 1).cast("int"), F.lit(size))))

    return F.concat(lines, whole, *[windows(s) for s in sizes])


def stated_licences(files: DataFrame, path: str, text: str, templates: Templates, whole: str = r"(?i)^(licen[cs]e|copying|notice|unlicense)") -> DataFrame:
    """(_path, license, score) of the files that state a licence: the best cosine of any unit of theirs with a template.

    Units are the lines and the windows of words (each size with the templates of that size), and the whole text where
    the base name matches `whole`. Ties go to the first licence by name.
    """
    threshold, anchors = templates.threshold, F.array(*[F.lit(w) for w in ANCHORS])
    lowered = F.lower(body(text))
    named = F.regexp_extract(quoted(path), r"([^/]*)$", 1).rlike(whole)
    some = files.where(lowered.rlike(ANCHORED)).select(quoted(path).alias("_path"), lowered.alias("_lowered"), named.alias("_named"))
    some = some.withColumn("_tokens", _tokens(F.col("_lowered")))
    units = F.filter(_units(F.col("_lowered"), F.col("_tokens"), F.col("_named"), templates.sizes), lambda u: F.arrays_overlap(u["words"], anchors))
    told = some.select("_path", F.explode(units).alias("_u")).select("_path", F.struct("_u.size", "_u.at").alias("_unit"), F.col("_u.words").alias("_words"))
    squares = F.array(*[F.create_map(*[F.lit(y) for w, x in unit.items() for y in (w, x * x)]) for unit in templates.units])
    hits = F.array_intersect("_words", F.array(*[F.lit(w) for w in templates.idf]))
    reach = F.exists(squares, lambda t: F.aggregate("_hits", F.lit(0.0), lambda sum_, w: sum_ + F.coalesce(F.element_at(t, w), F.lit(0.0))) >= F.lit(threshold**2 - 1e-9))
    told = told.withColumn("_hits", hits).where(reach)
    counted = told.select("_path", "_unit", F.explode("_words").alias("word")).groupBy("_path", "_unit", "word").agg(F.count("*").alias("n"))
    spark = files.sparkSession
    idf = spark.createDataFrame(sorted(templates.idf.items()), "word string, idf double")
    weights = spark.createDataFrame(templates.rows, "template int, license string, size int, word string, unit double")
    heavy = counted.join(F.broadcast(idf), "word", "left").withColumn("w", (1 + F.log("n")) * F.coalesce("idf", F.lit(templates.unseen))).select("_path", "_unit", "word", "w")
    heavy = stored(heavy, "licence-words")
    norms = heavy.groupBy("_path", "_unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    met = heavy.join(F.broadcast(weights), "word").where((F.col("_unit.size") <= LINE) | (F.col("_unit.size") == F.col("size")))
    dots = met.groupBy("_path", "_unit", "template", "license").agg(F.sum(F.col("w") * F.col("unit")).alias("dot"), F.count("*").alias("met")).where(F.col("met") >= MET)
    scored = dots.join(norms, ["_path", "_unit"]).select("_path", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= threshold)
    best = F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), "license"))
    return scored.groupBy("_path").agg(best.alias("b")).select("_path", "b.license", "b.score")


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def license_scan(files: DataFrame, id: str = "doc_id", path: str = "path", text: str = "text", templates: Templates | None = None, licensing: str = ".*", whole: str = r"(?i)^(licen[cs]e|copying|notice|unlicense)") -> DataFrame:
    """One row per input row: `id`, path, license, score, inherited, from_dir.

    A file that states a licence has it (inherited false, from_dir its directory). Any other gets that of the nearest
    directory at or above its own in which a file whose base name matches `licensing` states one (there the best score,
    then the first licence by name); files without any have nulls and inherited false. Files whose base name matches
    `whole` are also compared as a whole. Null texts state nothing; null
    paths inherit nothing, as do paths without "/" unless a licence lies at the top. Rows that share a path are one
    file: the best of their statements holds for all. Other columns are not passed on. Empty in, empty out.
    """
    templates = templates or Templates()
    own = stored(stated_licences(files.where(quoted(path).isNotNull()), path, text, templates, whole), "licences")
    given = own.where(F.regexp_extract("_path", r"([^/]*)$", 1).rlike(licensing))
    best = F.min_by(F.struct("license", "score"), F.struct(-F.col("score"), "license"))
    granted = given.groupBy(_directory(F.col("_path")).alias("_from")).agg(best.alias("_granted"))

    rows = files.select(quoted(id).alias("_id"), quoted(path).alias("_path")).withColumn("_dir", _directory(F.col("_path")))
    parts = F.split("_dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("_from")))
    steps = rows.where("_dir is not null").select("_dir").distinct().select("_dir", F.explode(above).alias("_a")).select("_dir", "_a.depth", "_a._from")
    near = steps.join(granted, "_from").groupBy("_dir").agg(F.max_by(F.struct("_from", "_granted"), "depth").alias("_near"))
    found = rows.join(own, "_path", "left").join(near, "_dir", "left")
    stated = F.col("license").isNotNull()
    return found.select(
        F.col("_id").alias(id), F.col("_path").alias("path"), F.coalesce("license", "_near._granted.license").alias("license"), F.coalesce("score", "_near._granted.score").alias("score"),
        (~stated & F.col("_near").isNotNull()).alias("inherited"), F.when(stated, F.col("_dir")).otherwise(F.col("_near._from")).alias("from_dir"),
    )
