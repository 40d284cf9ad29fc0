import math
import re
from collections import Counter

import pytest
from checktool import SF_DIR, compare, connection

from crosstide.llm import catalogue, license_scan as L

SCHEMA = "id int, path string, text string, _scan string, license string"


TOKENS = [(name, Counter(re.findall(L.TOKEN, x.lower()))) for name, x in L.TEMPLATES]


def cosine(block):
    """Best template of one block: (score, name)."""
    n = len(TOKENS)
    idf = lambda t: math.log((1 + n) / (1 + sum(t in c for _, c in TOKENS))) + 1
    vector = lambda c: {t: (1 + math.log(k)) * idf(t) for t, k in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values())) or 1
    w = vector(Counter(re.findall(L.TOKEN, block.lower())))
    out = []
    for name, c in TOKENS:
        v = vector(c)
        out.append((-round(sum(x * v.get(t, 0) for t, x in w.items()) / norm(w) / norm(v), 6), name))
    return -min(out)[0], min(out)[1]


def blocks(path, text):
    lines = (text or "").split("\n")
    has = [bool(re.search(L.ANCHORS, x)) for x in lines]
    out = [x for x, h in zip(lines, has, strict=True) if h]
    out += [f"{x} {y}" for x, y, h, k in zip(lines, lines[1:], has, has[1:], strict=False) if h or k]
    out += [x for x in re.split(L.BLANK_LINE, text or "") if re.search(L.ANCHORS, x)]
    if path is not None and re.match(L.LICENSE_FILE, path.rsplit("/", 1)[-1]):
        out.append(text or "")
    return out


def brute(rows):
    own = []
    for _, path, text in rows:
        found = [cosine(x) for x in blocks(path, text)]
        found = [(-s, n) for s, n in found if s >= L.LEAST]
        found = sorted((s, n) for s, n in found if not any(o.startswith(n + "-") for _, o in found))
        own.append((-found[0][0], found[0][1]) if found else None)
    held = {}
    for (_, path, _), o in zip(rows, own, strict=True):
        if path is not None and o and re.match(L.LICENSE_FILE, path.rsplit("/", 1)[-1]):
            d = path.rpartition("/")[0]
            held[d] = min(held.get(d, (9, "")), (-o[0], o[1]))
    out = []
    for (_, path, _), o in zip(rows, own, strict=True):
        if o:
            out.append((o[1], o[1], "own", None))
            continue
        d = path.rpartition("/")[0] if path is not None else None
        while d is not None and d not in held and d:
            d = d.rpartition("/")[0]
        out.append((None, held[d][1], "inherited", d) if d in held else (None, None, "none", None))
    return out


def test_scan_equals_brute_force(spark):
    mit, gpl = "Released under the MIT License.", "words\nThis work is licensed under the GNU General Public License, version 3.\nmore"
    rows = [(0, "a/LICENSE", mit), (1, "a/b/c/f.txt", "no words"), (2, "a/b/LICENCE.md", gpl), (3, "a/b/c/g", None), (4, "z/f", ""), (5, None, None), (6, None, mit),
            (7, "LICENSE", "Licensed under the Apache License, Version 2.0."), (8, "top", "x"), (9, "ab/f", "a license of some kind we made up here for you"),
            (10, "a/b/x", "Released under CC0."), (11, "a/b/LICENCE.md", gpl), (12, "a/d/COPYING", "x\n" * 20_000 + "Licensed under CC BY-NC 4.0."), (13, "a/d/e/f", "x"),
            (14, "a/d/LICENSE", mit), (15, "", "x"), (16, "a//f", "x"), (17, "/root/f", "x"), (18, "licenses/f", "Licensed LICENSE LicenSe under mit")]
    out = L.scan(spark.createDataFrame([(i, p, t, "q", "r") for i, p, t in rows], SCHEMA))
    assert out.columns[:4] == ["id", "path", "_scan", "license"]
    s = out.columns[-1]
    got = {r.id: (r[s].own, r[s].license, r[s].origin, r[s].holder) for r in out.collect()}
    for (i, _, _), want in zip(rows, brute(rows), strict=True):
        assert got[i] == want, rows[i]


def test_scores(spark):
    lines = [t for _, t in L.TEMPLATES] + ["Licensed under CC BY-SA 4.0, see the license", "license", "MIT license MIT license", "licence gpl version 2", "", "zzz zzz qq"]
    got = spark.createDataFrame([(x,) for x in lines], "x string").select("x", L.best_match(L.F.col("x")).alias("m")).collect()
    for r in got:
        score, name = cosine(r.x)
        assert r.m.name == name and r.m.score == pytest.approx(score, abs=2e-6)
    assert all(r.m.name == name for r, (name, _) in zip(got, L.TEMPLATES))


MIT_BODY = """Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


@pytest.mark.parametrize("path, text, want", [
    ("a/f.py", "# SPDX-License-Identifier: Apache-2.0\nimport os", "Apache-2.0"), ("a/f.py", "// SPDX-License-Identifier: MIT", "MIT"),
    ("a/f.py", "SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"), ("a/f.py", "SPDX-License-Identifier: Zlib", None),
    ("a/README", "BSD 3-Clause License", "BSD-3-Clause"), ("a/COPYING", "GNU GENERAL PUBLIC LICENSE", "GPL"),
    ("a/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy", "GPL-3.0"),
    ("a/COPYING", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999", "LGPL-2.1"),
    ("a/f.c", "/* This program is licensed under\n * the GNU General Public License, version 2. */", "GPL-2.0"),
    ("a/LICENSE", MIT_BODY, "MIT"), ("a/notes.txt", "prose before\n\n" + MIT_BODY, "MIT"),
    ("a/LICENSE", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n\n"
     "1. Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the following disclaimer.\n\n2. Redistributions in binary form "
     "must reproduce the above copyright\nnotice, this list of conditions and the following disclaimer in the\ndocumentation and/or other materials provided with the distribution.\n\n"
     "3. Neither the name of the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior "
     "written permission.\n", "BSD-3-Clause"),
    ("a/f.txt", "she has a driving licence and a fishing license", None), ("a/LICENSE.txt", "a recipe for soup with onions", None)])
def test_known_licenses(spark, path, text, want):
    out = L.scan(spark.createDataFrame([(1, path, text, "", "")], SCHEMA)).first()
    assert out[-1].own == want


def test_a_long_block_is_counted_in_one_pass(spark):
    text = "a license " + " ".join(f"w{i % 30_000}" for i in range(60_000))
    out = L.scan(spark.createDataFrame([(1, "a/LICENSE", text, "", "")], SCHEMA)).first()
    assert out[-1].own is None


def test_repeats_and_empty_table(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License.", "", "")] * 3 + [(2, "a/f", "x", "", "")] * 2
    out = L.scan(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.id, r[-1].license) for r in out.collect()) == [(1, "MIT")] * 3 + [(2, "MIT")] * 2
    assert L.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_table_equals_sql(spark):
    assert compare(catalogue.QUERIES["op3_license_scan"](spark, SF_DIR).toPandas(), connection().execute(L.SQL).df()) == ""
