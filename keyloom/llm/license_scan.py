"""Licence scans: Dice coefficient over word bigrams against templates. DataFrame functions only.

A text is cut into segments, at line breaks and behind the marks ``.!?;:`` that a blank follows. A
unit is any run of consecutive segments, so that a notice is found on its own line, inside a longer
line, wrapped over several lines, or as the whole text. Its words are normalised (letters A-Z
lower-cased, everything but letters and digits of ASCII a separator), and its word bigrams, each as
often as it stands there, are compared with each template whose bigram count lies within the bounds
that the wanted coefficient allows: for coefficient c, a template of t bigrams can only match units
of t * c / (2 - c) to t * (2 - c) / c bigrams. A unit counts by its best template; of units that
overlap the best is a finding (more shared bigrams, else a higher coefficient, an earlier start, an
earlier end), then the best of those that do not overlap it, and so on.

What cannot match is left out before: a match shares over two thirds of a template's bigrams, so
of words that stand in over a third of them it has one at least, and one regular expression looks
for these; units hold enough bigrams of templates for their size, by running sums, and begin and
end with segments that add such bigrams, as without them they would score more. Templates are constants of the plan, and a
text's units stay in its row, so nothing is joined or shuffled.

Defined cases: a null or empty text, and a unit of fewer than two words, matches nothing; of
templates that tie, the first in order of name wins; a very long text is scanned whole; rows that
repeat, and null ids, give findings each; an empty table gives an empty result; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8

# Public licence names and the notices or texts that stand for them.
TEMPLATES: dict[str, str] = {
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


# Common words, which say little about a text.
COMMON = "0 1 2 3 4 a all an and any are as at available be by conditions copy for free from general if in including is it may must no not of on or other possible product provided public published related shall source subject that the this to under use we with without work you".split()
BREAK = r"([.!?;:])[\x20\t]+"


def _split(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def template_bigrams(text: str) -> list[str]:
    """The bigrams of a text; what stands there again is numbered, so that sets of them are bags of bigrams."""
    words, seen = _split(text), {}
    out = []
    for g in (f"{a} {b}" for a, b in zip(words, words[1:], strict=False)):
        seen[g] = seen.get(g, 0) + 1
        out.append(f"{g}#{seen[g]}")
    return sorted(out)


def _plain(bigrams: list[str]) -> list[str]:
    return sorted({g.split("#")[0] for g in bigrams})


def needed_words(bigrams: list[str], least: float) -> set[str]:
    """Words that stand in more bigrams of a template than a match can lack: one of them is in every match."""
    left, out = set(bigrams), set()
    lacking = len(bigrams) - least / (2 - least) * len(bigrams)
    while len(bigrams) - len(left) <= lacking + 1e-9:
        words = sorted({w for g in left for w in g.split("#")[0].split()})
        best = max(words, key=lambda w: (w not in COMMON, sum(w in g.split("#")[0].split() for g in left), len(w)))
        out.add(best)
        left = {g for g in left if best not in g.split("#")[0].split()}
    return out


def _any_of(words: set[str]) -> str:
    """A regular expression for any of the words that tells by their common beginnings."""
    by: dict[str, set[str]] = {}
    for w in words:
        by.setdefault(w[:1], set()).add(w[1:])
    parts = [re.escape(c) + _any_of(rest) if c else "" for c, rest in sorted(by.items(), reverse=True)]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _words(text: Column) -> Column:
    flat = F.lower(F.trim(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")))
    return F.split(flat, " ")


def _bigrams(words: Column) -> Column:
    n = F.size(words) - 1
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column through a generator, so that later filters read it instead of computing it again."""
    return df.select([c for c in df.columns if c != name] + [F.explode(F.array(value)).alias(name)])


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per finding: doc_id, line_no and last_line (from 0), license, dice, unit_bigrams."""
    grams = {name: g for name, text in sorted((templates or TEMPLATES).items()) if (g := template_bigrams(text))}
    low, high = least / (2 - least), (2 - least) / least
    fewest, most = min(map(len, grams.values())), max(map(len, grams.values()))
    known = sorted(set().union(*map(_plain, grams.values())))
    needed = set().union(*(needed_words(g, least) for g in grams.values()))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.where(F.col("text").rlike(f"(?i)(?<![A-Za-z0-9]){_any_of(needed)}(?![A-Za-z0-9])"))

    def segments(line: Column, no: Column) -> Column:
        parts = F.split(F.regexp_replace(line, BREAK, "$1\u0001"), "\u0001")
        return F.transform(parts, lambda part: F.struct(no.cast("int").alias("line"), _words(part).alias("w")))

    segs = F.filter(F.flatten(F.transform(F.split("text", "\n"), segments)), lambda s: F.get(s.w, F.lit(0)) != "")
    rows = _once(rows.select("doc_id", segs.alias("s")), "s", F.col("s")).where(F.size("s") > 0)
    # Of each segment: its words, its bigrams of templates, and whether that over its end is one; then the running sums.
    at = lambda c, i: F.get(F.col(c), i)
    hits = F.transform("s", lambda s: F.size(F.filter(_bigrams(s.w), lambda g: g.isin(known))))
    over = F.transform("s", lambda s, i: F.when(F.concat_ws(" ", F.element_at(s.w, -1), F.get(at("s", i + 1).w, F.lit(0))).isin(known), 1).otherwise(0))
    rows = _once(rows, "m", F.struct(F.transform("s", lambda s: F.size(s.w)).alias("size"), hits.alias("hits"), over.alias("over")))
    upto = lambda c: F.aggregate(c, F.array().cast("array<int>"), lambda sums, x: F.concat(sums, F.array(F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0)) + x)))
    rows = _once(rows, "u", F.struct(upto(F.col("m.size")).alias("size"), upto(F.col("m.hits")).alias("hits"), upto(F.col("m.over")).alias("over")))
    before = lambda c, i: F.coalesce(F.get(F.col(c), i - 1), F.lit(0))
    largest = most * high + 1e-9

    def ends(i: Column) -> Column:
        """The last segments of units that begin with segment ``i``."""

        def fits(j: Column) -> Column:
            n = at("u.size", j) - before("u.size", i) - 1
            shared = at("u.hits", j) - before("u.hits", i) + before("u.over", j) - before("u.over", i)
            adds = (at("m.hits", j) > 0) | (before("m.over", j) > 0)
            return adds & n.between(F.lit(fewest * low - 1e-9), F.lit(largest)) & (shared * 2 >= F.lit(least) * (n + fewest) - 1e-9)

        return F.filter(F.sequence(i, F.least(F.size("s") - 1, i + F.lit(int(largest) + 1))), fits)

    def score(g: Column) -> Column:
        """(dice, unit_bigrams, shared, license) of the best template."""
        n, each = F.size(g), []
        for name, t in grams.items():
            fits = (n >= F.lit(len(t) * low - 1e-9)) & (n <= F.lit(len(t) * high + 1e-9))
            shared = F.when(fits, F.size(F.array_intersect(g, F.array(*map(F.lit, t))))).otherwise(0)
            each.append(F.struct(F.round(shared * 2 / (n + len(t)), 9).alias("dice"), F.lit(-len(each)).alias("order"), F.lit(name).alias("license"), n.alias("unit_bigrams"), shared.alias("shared")))
        return F.array_max(F.array(*each))

    def numbered(g: Column) -> Column:
        return F.transform(g, lambda x, k: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(g, F.lit(1), k + 1), lambda y: y == x)).cast("string")))

    def unit(i: Column, j: Column) -> Column:
        words = F.flatten(F.transform(F.slice("s", i + 1, j - i + 1), lambda s: s.w))
        plain = _let(words, _bigrams)
        enough = lambda g: F.size(F.filter(g, lambda x: x.isin(known))) * 2 >= F.lit(least) * (F.size(g) + fewest) - 1e-9
        best = _let(plain, lambda g: F.when(enough(g), _let(numbered(g), score)))
        return F.struct(i.alias("i"), j.alias("j"), best.alias("b"))

    first = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (at("m.hits", i) > 0) | (at("m.over", i) > 0))
    spans = F.flatten(F.transform(first, lambda i: F.transform(ends(i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    rows = _once(rows, "spans", spans).where(F.size("spans") > 0)
    rows = _once(rows, "units", F.transform("spans", lambda x: unit(x.i, x.j))).drop("spans")
    rows = _once(rows, "found", F.filter("units", lambda x: x.b.dice >= F.lit(least))).drop("units").where(F.size("found") > 0)
    ranked = F.array_sort(F.transform("found", lambda x: F.struct((-x.b.shared).alias("n"), (-x.b.dice).alias("d"), x.i.alias("i"), x.j.alias("j"), x.b.alias("b"))))
    rows = _once(rows, "found", ranked)
    apart = lambda kept, x: ~F.exists(kept, lambda y: (y.i <= x.j) & (x.i <= y.j))
    best = F.aggregate("found", F.slice("found", 1, 1), lambda kept, x: F.when(apart(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    rows = rows.select("doc_id", "s", F.explode(best).alias("x"))
    line = lambda i: F.get(F.col("s"), i).line
    return rows.select("doc_id", line(F.col("x.i")).alias("line_no"), line(F.col("x.j")).alias("last_line"), F.col("x.b.license").alias("license"), F.col("x.b.dice").alias("dice"), F.col("x.b.unit_bigrams").alias("unit_bigrams"))


def oracle(least: float = LEAST) -> str:
    """The same findings in DuckDB SQL: every unit with enough bigrams of templates against every template."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    grams = {n: template_bigrams(t) for n, t in sorted(TEMPLATES.items())}
    rows = ", ".join(f"({q(n)}, [{', '.join(map(q, g))}])" for n, g in grams.items())
    known = f"[{', '.join(map(q, sorted(set().union(*map(_plain, grams.values())))))}]"
    fewest, most = min(map(len, grams.values())), int(max(map(len, grams.values())) * (2 - least) / least) + 2
    return f"""
WITH templates(license, tg) AS (VALUES {rows}),
known AS (SELECT {known} AS kg),
lines AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
line AS (SELECT rid, doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS x FROM lines),
parts AS (SELECT rid, doc_id, line_no, string_split(regexp_replace(x, '([.!?;:])[\\x20\\t]+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM line),
part AS (SELECT rid, doc_id, line_no, unnest(range(len(ps))) AS p, unnest(ps) AS x FROM parts),
words AS (SELECT rid, doc_id, line_no, p, string_split(lower(trim(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM part),
hits AS (SELECT words.*, len(list_filter(range(1, len(w)), lambda x: list_contains(kg, w[x] || ' ' || w[x + 1]))) AS h FROM words, known WHERE w[1] <> ''),
segs AS (SELECT *, row_number() OVER s AS k, sum(len(w)) OVER s AS upto, sum(h) OVER s AS hupto FROM hits WINDOW s AS (PARTITION BY rid ORDER BY line_no, p)),
docs AS (SELECT rid, list(w ORDER BY k) AS ws FROM segs GROUP BY rid),
spans AS (SELECT a.rid, a.doc_id, a.k AS i, b.k AS j, a.line_no, b.line_no AS last_line
          FROM segs a JOIN segs b ON a.rid = b.rid AND a.k <= b.k AND b.upto - a.upto + len(a.w) BETWEEN 2 AND {most}
          WHERE 2 * (b.hupto - a.hupto + a.h + b.k - a.k) >= {least} * (b.upto - a.upto + len(a.w) - 1 + {fewest}) - 1e-9),
units AS (SELECT spans.*, flatten(ws[i : j]) AS w FROM spans JOIN docs USING (rid)),
plain AS (SELECT * EXCLUDE (w), list_transform(range(1, len(w)), lambda x: w[x] || ' ' || w[x + 1]) AS p FROM units),
grams AS (SELECT * EXCLUDE (p), list_transform(range(1, len(p) + 1), lambda x: p[x] || '#' || len(list_filter(p[1 : x], lambda y: y = p[x]))) AS g FROM plain),
shared AS (SELECT grams.* EXCLUDE (g), license, len(g) AS n, len(tg) AS t, len(list_intersect(g, tg)) AS m FROM grams, templates),
scored AS (SELECT *, round(CAST(2.0 * m / (n + t) AS DOUBLE), 9) AS dice FROM shared),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid, i, j ORDER BY dice DESC, license) AS r FROM scored WHERE dice >= {least}),
best AS (SELECT rid, list([{{'x': {{'n': -m, 'd': -dice, 'i': i, 'j': j, 'doc_id': doc_id, 'line_no': line_no, 'last_line': last_line, 'license': license, 'u': n}}}}] ORDER BY -m, -dice, i, j) AS b FROM ranked WHERE r = 1 GROUP BY rid),
kept AS (SELECT unnest(list_reduce(b, lambda a, y: CASE WHEN len(list_filter(a, lambda z: z.x.i <= y[1].x.j AND y[1].x.i <= z.x.j)) > 0 THEN a ELSE list_concat(a, y) END)).x AS x FROM best)
SELECT x.doc_id AS doc_id, CAST(x.line_no AS INTEGER) AS line_no, CAST(x.last_line AS INTEGER) AS last_line, x.license AS license, -x.d AS dice, CAST(x.u AS INTEGER) AS unit_bigrams FROM kept"""
