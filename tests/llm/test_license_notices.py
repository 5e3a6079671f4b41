"""Notices as files have them: inside paragraphs, wrapped, in one long line, with other words around; whole licence files."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402
from bourse.llm import license_scan  # noqa: E402

GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

  * Redistributions of source code must retain the above copyright notice,
    this list of conditions and the following disclaimer.
  * Redistributions in binary form must reproduce the above copyright notice,
    this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution."""
APACHE = """# Licensed under the Apache License, Version 2.0 (the "License"); you may not
# use this file except in compliance with the License. You may obtain a copy
# of the License at
#
#   http://www.apache.org/licenses/LICENSE-2.0"""
NOTICES = [
    (GRANT, "MIT"), (GPL, "GPL-3.0"), (BSD, "BSD-2-Clause"), (APACHE, "Apache-2.0"), ("Released under the MIT License.", "MIT"), ("SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("SPDX-License-Identifier: MIT", "MIT"),
    ("Released under the MIT License by the authors of the project in 2019.", "MIT"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("This work is licensed under the GNU General\nPublic License, version 2.", "GPL-2.0"),
]


def _around(rng, notice, how):
    before, after = plain.prose(rng, rng.randint(15, 200)), plain.prose(rng, rng.randint(15, 200))
    return {"alone": notice, "lines": f"{before}\n{notice}\n{after}", "paragraph": f"{before} {notice} {after}", "one line": " ".join(f"{before} {notice} {after}".split())}[how]


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for notice, name in NOTICES:
        for how in ("alone", "lines", "paragraph", "one line"):
            want[len(rows)] = (name, how, notice[:40])
            rows.append((len(rows), f"d{len(rows)}/x.c", _around(rng, notice, how)))
    clean = ["The software was late, and the licence to trade was not renewed.", "mit", "Version 2.0 of the general terms", "", None, "license " * 3000, plain.prose(rng, 3000), "Copyright 2020 by the town. All rights reserved.", GRANT.split("\n")[0][:30]]
    for text in clean:
        rows.append((len(rows), f"d{len(rows)}/x.c", text))
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    return want, {r.doc_id: r.license for r in got}


def test_notices_are_found_wherever_they_stand(found):
    want, got = found
    missed = {i: (w, got[i]) for i, w in want.items() if got[i] != w[0]}
    assert not missed


def test_other_texts_state_nothing(found):
    want, got = found
    assert {i: x for i, x in got.items() if i not in want and x is not None} == {}


def test_whole_licence_files_and_long_texts(spark):
    rng = random.Random(9)
    mit = "MIT License\n\nCopyright (c) 2021 Some Body\n\n" + GRANT + "\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    long = plain.prose(rng, 30_000) + "\nReleased under the MIT License.\n" + plain.prose(rng, 30_000)
    rows = [(1, "a/LICENSE", mit), (2, "a/b/c.py", "x = 1"), (3, "b/COPYING", GPL), (4, "b/d.c", None), (5, "c/long.txt", long), (6, None, mit)]
    files = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: (r.license, r.inherited) for r in license_scan.license_scan(files).collect()}
    assert got == {1: ("MIT", False), 2: ("MIT", True), 3: ("GPL-3.0", False), 4: ("GPL-3.0", True), 5: ("MIT", False), 6: (None, False)}
    whole = license_scan.Templates()
    scores = {r._path: r.score for r in license_scan.stated_licences(files.where("path is not null"), "path", "text", whole).collect()}
    lines = {r._path: r.score for r in license_scan.stated_licences(files.where("path is not null"), "path", "text", whole, whole="^$").collect()}
    assert all(scores[p] >= lines[p] for p in lines)


def test_every_template_is_found_by_itself(spark):
    rows = [(k, f"d{k}/f", text) for k, (_, text) in enumerate(license_scan.TEMPLATES)]
    got = {r.doc_id: (r.license, r.score) for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert all(got[k] == (name, pytest.approx(1.0, abs=1e-6)) for k, (name, _) in enumerate(license_scan.TEMPLATES))
