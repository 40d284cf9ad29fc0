"""License scan: TF-IDF cosine of headers and license files to templates, then inheritance by directory.

Blocks are compared: every line with a phrase that licenses use (``ANCHORS``), two lines in a row of which one has it (a wrapped
statement), every paragraph that has it (a header, a part of a license text), and the whole text of a license file.
A block's words are weighted by 1 plus the logarithm of their count, times their inverse frequency among the templates, and compared with
every template by the cosine of the sparse vectors; a file's own license is its best match of at least ``LEAST``. Templates are
statements, standard headers, titles, license texts and SPDX identifiers; a family's title without a version names the family.
This needs no shuffle: the templates are a small fixed table in the plan.

A file whose name begins with LICENSE, LICENCE or COPYING speaks for its directory. A file without a license
of its own takes that of the nearest directory above it that has one. Directories are collected first; each
distinct directory is expanded to its ancestors (as many as its path has parts) and joined with the directories
that have a license; files are joined with their directory last. So a directory with very many files
is one row until that last join.

Defined cases: a null or empty text has no license of its own. A null path has no directory: nothing is
inherited. Ties go to the first license name. Repeated rows are scanned alike; several license files of a
directory count as one, the best match. An empty table gives an empty result. ``scan`` keeps the
input columns; its results stand in one struct column whose name no input column has.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, functions as F

from crosstide.llm.common import fresh, let
from crosstide.session import stage

LEAST = 0.5
TOKEN = r"[a-z0-9]+(?:[.][0-9]+)*"
ANCHORS = r"(?i)licen[sc]e|copying|copyleft|public domain|spdx|permission is hereby granted|permission to use, copy|redistribution and use"
BLANK_LINE = r"\n[ \t\r]*\n"
LICENSE_FILE = r"(?i)^(licen[sc]e|copying)"

# Statements, headers, titles and texts of well-known licenses.
_DISCLAIMER = ("the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of "
               "merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any "
               "claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the "
               "software or the use or other dealings in the software.")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution.")
_BSD_DISCLAIMER = (" This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not "
                   "limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.")
_BSD_NAMES = (" Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
              "software without specific prior written permission.")


def _gnu(name: str, number: str) -> str:
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software "
            f"Foundation, either version {number} of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
            f"useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU {name} "
            "for more details.")


TEMPLATES = (
    ("AGPL", "GNU Affero General Public License"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may "
                   "obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
                   "implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause simplified license."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", _BSD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style 3-Clause license."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_DISCLAIMER),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under the CC0 1.0 Universal license."),
    ("GPL", "GNU General Public License"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("ISC", "Distributed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
    ("LGPL", "GNU Lesser General Public License"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
            + _DISCLAIMER),
    ("MPL-2.0", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
                  "binary, for any purpose, commercial or non-commercial, and by any means."),
    *((name, f"SPDX-License-Identifier: {identifier}") for name, identifier in (
        ("AGPL-3.0", "AGPL-3.0-only"), ("AGPL-3.0", "AGPL-3.0-or-later"), ("Apache-2.0", "Apache-2.0"), ("BSD-2-Clause", "BSD-2-Clause"),
        ("BSD-3-Clause", "BSD-3-Clause"), ("CC-BY-4.0", "CC-BY-4.0"), ("CC-BY-NC-4.0", "CC-BY-NC-4.0"), ("CC-BY-SA-4.0", "CC-BY-SA-4.0"),
        ("CC0-1.0", "CC0-1.0"), ("GPL-2.0", "GPL-2.0-only"), ("GPL-2.0", "GPL-2.0-or-later"), ("GPL-3.0", "GPL-3.0-only"),
        ("GPL-3.0", "GPL-3.0-or-later"), ("ISC", "ISC"), ("LGPL-2.1", "LGPL-2.1-only"), ("LGPL-2.1", "LGPL-2.1-or-later"),
        ("LGPL-3.0", "LGPL-3.0-only"), ("LGPL-3.0", "LGPL-3.0-or-later"), ("MIT", "MIT"), ("MPL-2.0", "MPL-2.0"), ("Unlicense", "Unlicense"))),
)


def _weights() -> tuple[dict[str, float], float, list[tuple[str, dict[str, float]]]]:
    """Inverse frequencies, that of an unknown word, and the templates as unit vectors."""
    counts = [(name, Counter(re.findall(TOKEN, text.lower()))) for name, text in TEMPLATES]
    n = len(counts)
    idf = {t: math.log((1 + n) / (1 + sum(t in c for _, c in counts))) + 1 for t in sorted({t for _, c in counts for t in c})}
    vectors = []
    for name, c in counts:
        weights = {t: (1 + math.log(k)) * idf[t] for t, k in sorted(c.items())}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        vectors.append((name, {t: w / norm for t, w in weights.items()}))
    return idf, math.log(1 + n) + 1, vectors


IDF, UNKNOWN, VECTORS = _weights()


def best_match(block: Column) -> Column:
    """A struct (score, license) of the template nearest to a block."""
    idf = F.from_json(F.lit(json.dumps(IDF)), "map<string,double>")
    templates = F.from_json(F.lit(json.dumps([{"name": n, "terms": v} for n, v in VECTORS])), "array<struct<name:string,terms:map<string,double>>>")

    def counted(tokens: Column) -> Column:
        """Each distinct token of a sorted array with its weight."""
        starts = F.filter(F.transform(tokens, lambda t, i: i), lambda i: (i == 0) | (F.get(tokens, i - 1) != F.get(tokens, i)))

        def runs(at: Column) -> Column:
            weighed = F.transform(at, lambda i, k: F.struct(
                F.get(tokens, i).alias("t"), (F.coalesce(F.get(at, k + 1), F.size(tokens)) - i).alias("n"), F.try_element_at(idf, F.get(tokens, i)).alias("idf")))
            return F.transform(weighed, lambda x: F.struct(x["t"].alias("t"), x["idf"].isNotNull().alias("known"),
                                                           ((F.log(x["n"].cast("double")) + 1) * F.coalesce(x["idf"], F.lit(UNKNOWN))).alias("w")))
        return let(starts, runs)

    def nearest(terms: Column) -> Column:
        norm = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        known = F.filter(terms, lambda x: x["known"])

        def best(known: Column, norm: Column) -> Column:
            dot = lambda v: F.aggregate(known, F.lit(0.0), lambda a, x: a + x["w"] * F.coalesce(F.try_element_at(v, x["t"]), F.lit(0.0)))
            scores = F.transform(templates, lambda t: F.struct((-F.round(dot(t["terms"]) / F.greatest(norm, F.lit(1e-9)), 6)).alias("less"), t["name"].alias("name")))
            return let(F.array_min(scores), lambda b: F.struct((-b["less"]).alias("score"), b["name"].alias("name")))
        return let(F.struct(known.alias("known"), norm.alias("norm")), lambda x: best(x["known"], x["norm"]))

    return let(F.sort_array(F.regexp_extract_all(F.lower(block), F.lit(TOKEN), 0)), lambda tokens: let(counted(tokens), nearest))


def blocks(text: Column, speaks: Column) -> Column:
    """The blocks of a text that are compared; ``speaks`` for a license file, which is compared as a whole too."""
    has = lambda x: F.regexp_like(x, F.lit(ANCHORS))

    def of_lines(lines: Column) -> Column:
        single = F.filter(lines, has)
        pairs = F.transform(lines, lambda x, i: F.when(has(x) | F.coalesce(has(F.get(lines, i + 1)), F.lit(False)),
                                                       F.concat(x, F.lit(" "), F.get(lines, i + 1))))
        return F.concat(single, F.filter(pairs, lambda x: x.isNotNull()))

    none = F.array().cast("array<string>")
    found = F.concat(let(F.split(text, "\n"), of_lines), F.filter(F.split(text, BLANK_LINE), has))
    return F.array_distinct(F.concat(F.when(has(text), found).otherwise(none), F.when(speaks, F.array(text)).otherwise(none)))


def own_license(text: Column, speaks: Column) -> Column:
    """A struct (score, name) of the file's best block, or null."""
    found = blocks(F.coalesce(text, F.lit("")), F.coalesce(speaks, F.lit(False)))
    matches = F.filter(F.transform(found, best_match), lambda m: m["score"] >= LEAST)

    def best(all_: Column) -> Column:
        # a family's title says less than another block that names its version
        said = F.filter(all_, lambda m: ~F.exists(all_, lambda o: F.startswith(o["name"], F.concat(m["name"], F.lit("-")))))
        return F.array_min(F.transform(said, lambda m: F.struct((-m["score"]).alias("less"), m["name"].alias("name"))))

    return let(let(matches, best), lambda b: F.when(b.isNotNull(), F.struct((-b["less"]).alias("score"), b["name"].alias("name"))))


def scan(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``files`` without the text, with a struct: own (score, name), license, origin (own, inherited, none), holder (directory)."""
    name = fresh(files, "scan")
    d, anc, lic, here, best = (fresh(files, x) for x in ("dir", "ancestor", "licensed", "holder", "best"))
    speaks = F.regexp_like(F.regexp_extract(F.col(path), r"([^/]*)$", 1), F.lit(LICENSE_FILE))
    rows = stage(files.withColumn(name, own_license(F.col(text), speaks)).drop(text)
                 .withColumn(d, F.regexp_replace(F.col(path), r"/?[^/]*$", "")))
    licensed = stage(rows.filter(F.col(name).isNotNull() & speaks)
                     .groupBy(F.col(d).alias(lic)).agg(F.min(F.struct((-F.col(name)["score"]).alias("less"), F.col(name)["name"].alias("name")))["name"].alias(best)))
    parts = F.split(F.col(d), "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))
    ancestors = rows.filter(F.col(d).isNotNull()).select(d).distinct().select(d, F.inline(up).alias("depth", anc))
    nearest = stage(ancestors.join(licensed, F.col(anc) == F.col(lic)).groupBy(F.col(d).alias(here)).agg(
        F.max_by(F.struct(F.col(best).alias("name"), F.col(anc).alias("dir")), "depth").alias(best)))
    out = rows.join(nearest, F.col(d) == F.col(here), "left")
    own, above = F.col(name), F.col(best)
    return out.withColumn(name, F.struct(
        own["score"].alias("score"), own["name"].alias("own"), F.coalesce(own["name"], above["name"]).alias("license"),
        F.when(own.isNotNull(), "own").when(above.isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(own.isNull(), above["dir"]).alias("holder"))).drop(d, here, best)


def document_path() -> Column:
    """A file path for a document: its source and language, then directories by its number; one in
    seven is the license file of a directory at one of four levels."""
    i = F.col("doc_id")
    dirs = F.array(F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")),
                   F.concat(F.lit("a"), F.pmod(F.floor(i / 10), F.lit(10))), F.concat(F.lit("b"), F.pmod(i, F.lit(10))))
    depth = F.when(i % 7 == 0, F.pmod(F.floor(i / 7), F.lit(4)) + 1).otherwise(4).cast("int")
    name = F.concat(F.when(i % 7 == 0, F.lit("LICENSE.")).otherwise(F.lit("f")), i)
    return F.concat_ws("/", F.slice(dirs, F.lit(1), depth), name)


def report(docs: DataFrame) -> DataFrame:
    """License of every document: that of its own blocks, or its directory's."""
    files = docs.select("doc_id", document_path().alias("path"), "text")
    out = scan(files)
    s = F.col(out.columns[-1])
    return out.select("doc_id", "path", s["own"].alias("own_license"), s["score"].alias("own_score"), s["license"].alias("license"),
                      s["origin"].alias("origin"), s["holder"].alias("holder"))


def _sql() -> str:
    idf = ", ".join(f"('{t}', {w!r}::double)" for t, w in IDF.items())
    terms = ", ".join(f"({i}, '{name}', '{t}', {w!r}::double)" for i, (name, v) in enumerate(VECTORS) for t, w in v.items())
    dirs = "[coalesce(source, 'none'), coalesce(lang, 'none'), 'a' || ((doc_id // 10) % 10), 'b' || (doc_id % 10)]"
    return f"""
with idf as (select * from (values {idf}) as t(tok, idf)), terms as (select * from (values {terms}) as t(template, name, tok, w)),
d as (select row_number() over () as rid, doc_id, array_to_string(list_slice({dirs}, 1, case when doc_id % 7 = 0 then (doc_id // 7) % 4 + 1 else 4 end), '/') as dir,
        case when doc_id % 7 = 0 then 'LICENSE.' else 'f' end || doc_id as file, coalesce(text, '') as text from documents),
lines as (select rid, line, lead(line) over (partition by rid order by n) as after from (
      select rid, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as n from (select rid, string_split(text, chr(10)) as lines from d where regexp_matches(text, '{ANCHORS}')))),
b as (select rid, line as block from lines where regexp_matches(line, '{ANCHORS}')
      union select rid, line || ' ' || after from lines where after is not null and (regexp_matches(line, '{ANCHORS}') or regexp_matches(after, '{ANCHORS}'))
      union select rid, block from (select rid, unnest(string_split_regex(text, '{BLANK_LINE}')) as block from d) where regexp_matches(block, '{ANCHORS}')
      union select rid, text from d where file like 'LICENSE.%'),
l as (select rid, row_number() over () as n, regexp_extract_all(lower(block), '{TOKEN}') as toks from b),
c as (select rid, n, tok, (ln(count(*)) + 1) * any_value(coalesce(idf.idf, {UNKNOWN!r})) as w from (select rid, n, unnest(toks) as tok from l) left join idf using (tok) group by rid, n, tok),
norm as (select rid, n, sqrt(sum(w * w)) as norm from c group by rid, n),
s as (select c.rid, c.n, terms.name, round(sum(c.w * terms.w) / any_value(norm.norm), 6) as score
      from c join terms using (tok) join norm on c.rid = norm.rid and c.n = norm.n group by c.rid, c.n, terms.template, terms.name),
m as (select rid, name, score from (select *, row_number() over (partition by rid, n order by score desc, name) as k from s where score >= {LEAST}) where k = 1),
own as (select rid, name, score from (select *, row_number() over (partition by rid order by score desc, name) as k from m
      where not exists (select 1 from m o where o.rid = m.rid and starts_with(o.name, m.name || '-'))) where k = 1),
f as (select d.*, own.name as own, own.score from d left join own using (rid)),
held as (select dir as held, first(own order by score desc, own) as lic from f where own is not null and file like 'LICENSE.%' group by dir),
near as (select f.rid, first(held.lic order by length(held.held) desc) as lic, max_by(held.held, length(held.held)) as holder
         from f join held on f.dir = held.held or starts_with(f.dir, held.held || '/') group by f.rid)
select f.doc_id, f.dir || '/' || f.file as path, f.own as own_license, f.score as own_score, coalesce(f.own, near.lic) as license,
  case when f.own is not null then 'own' when near.lic is not null then 'inherited' else 'none' end as origin,
  case when f.own is null then near.holder end as holder
from f left join near using (rid)"""


SQL = _sql()
