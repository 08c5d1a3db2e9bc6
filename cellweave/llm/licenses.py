"""License scans: sparse TF-IDF cosine of lines, paragraphs and whole texts to templates, then inheritance from directories.

Templates are notices, titles, SPDX tags, licence texts and the paragraphs of those that no other licence shares. The units of a
text are its lines, its paragraphs of several lines (lines without a word part them) and the whole of it, so that a header
wrapped over lines is one unit, apart from the body. A unit's vector has a weight tf * idf for each word of the templates'
vocabulary; idf comes from counts over all documents. A word of no template counts as a rare word of its own. A document
declares the licence of its best unit, if that reaches `least`. A document is a licence file and speaks for its directory
if at least half of its words stand in such lines, or in such paragraphs, if its whole text reaches `least`, or if it
declares a licence and is named like a licence file; a document that declares nothing takes the licence of the nearest
directory above it, found by joins of paths.

Words are digits and ASCII letters, A-Z folded. Only texts and units with a key word are compared: without any of a
template's words (its keys, rare ones first) a unit cannot reach `least` with a template, whatever else it holds (Cauchy-Schwarz).

Defined results: a null, empty or wordless text declares nothing; equal cosines go to the first licence by name;
several licence files of a directory: the highest cosine, then the first licence by name; null parts of a path are
left out; repeated rows are rows of their own; an empty table gives an empty table; other columns are kept, those named
like the results are replaced; a text of any length is read whole.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

# Notices, titles and texts of public licences.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
TITLES = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
)
#: Tags by the licence's identifier, those of one licence's variants under its name.
TAGGED = (
    ("MIT", ("MIT",)),
    ("Apache-2.0", ("Apache-2.0",)),
    ("GPL-2.0", ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later")),
    ("GPL-3.0", ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later")),
    ("LGPL-2.1", ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later")),
    ("LGPL-3.0", ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")),
    ("AGPL-3.0", ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")),
    ("BSD-2-Clause", ("BSD-2-Clause",)),
    ("BSD-3-Clause", ("BSD-3-Clause",)),
    ("ISC", ("ISC",)),
    ("MPL-2.0", ("MPL-2.0",)),
    ("Unlicense", ("Unlicense",)),
    ("CC-BY-4.0", ("CC-BY-4.0",)),
    ("CC0-1.0", ("CC0-1.0",)),
)
#: A tag of another identifier is nearest to the tag alone.
TAGS = (*((name, f"SPDX-License-Identifier: {tag}") for name, tags in TAGGED for tag in tags), ("NOASSERTION", "SPDX-License-Identifier:"))
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_ENDORSEMENT = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = (
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", "\n\n".join((BSD_CONDITIONS, BSD_WARRANTY))),
    ("BSD-3-Clause", "\n\n".join((BSD_CONDITIONS, BSD_ENDORSEMENT, BSD_WARRANTY))),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)


def _templates() -> tuple[tuple[str, str], ...]:
    """Notices, titles, tags, whole texts, and the paragraphs that stand in one licence's text alone and name no address only."""
    pieces = [(licence, p) for licence, t in TEXTS for p in t.split("\n\n")]
    shared = Counter(p for _, p in pieces)
    own = [(licence, p) for licence, p in pieces if shared[p] == 1 and " " in p]
    return tuple(sorted({*NOTICES, *TITLES, *TAGS, *TEXTS, *own}))


#: Least cosine of a declaration; names of licence files.
LEAST = 0.6
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|notice)[^/]*$"
#: What parts paragraphs: lines without a word.
GAP = r"\n[^0-9A-Za-z]*\n"
#: Columns of these names are replaced.
RESULTS = ("declared", "cosine", "is_license_file", "license", "inherited_from", "distance")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "[^0-9a-z]+"), lambda w: w != "")


def _template_words(text: str) -> Counter:
    return Counter("".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split())


TEMPLATES = _templates()


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in _template_words(t)})


def inverse_frequencies(docs: DataFrame, templates=TEMPLATES, text: str = "text") -> tuple[dict[str, float], float]:
    """(idf of each word of the vocabulary, idf of an unseen word), counted over all rows of docs.

    What reaches the driver is a count for each word of the templates.
    """
    words = vocabulary(templates)
    held = F.array_intersect(words_of(F.col(text)), F.array(*map(F.lit, words)))
    rows = docs.select(F.explode(F.array_append(held, F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("df")).collect()
    df = {r.word: r.df for r in rows}
    total = df.get("", 0)  # every row adds the empty word once
    return {w: math.log((1 + total) / (1 + df.get(w, 0))) + 1 for w in words}, math.log(1 + total) + 1


def weighed(templates, idf: dict[str, float]) -> list[tuple[str, float, dict[str, float]]]:
    """(licence, norm, weight of each word) of each template."""
    out = []
    for licence, text in templates:
        weights = {w: n * idf[w] for w, n in _template_words(text).items()}
        out.append((licence, math.sqrt(sum(x * x for x in weights.values())), weights))
    return out


def key_words(vectors: list[tuple[str, float, dict[str, float]]], idf: dict[str, float], least: float) -> list[str]:
    """For each template its rarest words, until the others alone cannot reach `least`."""
    keys: set[str] = set()
    for _, norm, weights in vectors:
        rest = norm**2
        for w, x in sorted(weights.items(), key=lambda p: (-idf[p[0]], -p[1], p[0])):
            if math.sqrt(max(rest, 0.0)) < 0.999 * least * norm:
                break
            keys.add(w)
            rest -= x * x
    return sorted(keys)


def _units(vectors, idf: dict[str, float], unseen: float, keys: Column, text: Column) -> Column:
    """An array of (cosine, licence, n, kind) for the units of a text with a key word, each with its best template.

    n: words; kind: 0 a line, 1 a paragraph of several lines, 2 the whole.
    """
    table = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(norm).alias("norm"), F.array(*[F.struct(F.lit(w).alias("w"), F.lit(x * idf[w]).alias("x")) for w, x in sorted(weights.items())]).alias("terms")) for licence, norm, weights in vectors])
    idfs = F.create_map(*[F.lit(v) for pair in sorted(idf.items()) for v in pair])
    known = F.array(*[F.lit(w) for w in sorted(idf)])
    text = F.coalesce(text, F.lit(""))
    lines, paragraphs = F.split(text, "\n"), F.split(text, GAP)
    several = F.filter(paragraphs, lambda p: p.contains("\n") & (F.size(paragraphs) > 1))
    whole = F.filter(F.array(text), lambda t: t.contains("\n"))

    def of_kind(parts: Column, kind: int) -> Column:
        return F.transform(parts, lambda t: F.struct(words_of(t).alias("words"), F.lit(kind).alias("kind")))

    units = F.concat(of_kind(lines, 0), of_kind(several, 1), of_kind(whole, 2))
    units = F.filter(units, lambda u: F.arrays_overlap(u["words"], keys))
    units = F.transform(units, lambda u: F.struct(F.filter(u["words"], lambda w: F.array_contains(known, w)).alias("shared"), F.size(u["words"]).alias("n"), u["kind"].alias("kind")))

    def counted(u: Column) -> Column:
        each = F.transform(F.array_sort(F.array_distinct(u["shared"])), lambda w: F.struct(w.alias("w"), F.size(F.filter(u["shared"], lambda x: x == w)).cast("double").alias("tf")))
        return F.struct(F.map_from_entries(each).alias("tf"), F.size(u["shared"]).alias("shared"), u["n"].alias("n"), u["kind"].alias("kind"))

    def squared(u: Column) -> Column:
        own = F.aggregate(F.map_entries(u["tf"]), F.lit(0.0), lambda acc, e: acc + F.pow(e["value"] * F.element_at(idfs, e["key"]), F.lit(2.0)))
        return own + (u["n"] - u["shared"]) * F.lit(unseen * unseen)

    def best(u: Column) -> Column:
        dots = F.transform(table, lambda t: F.struct(F.aggregate(t["terms"], F.lit(0.0), lambda acc, p: acc + p["x"] * F.coalesce(F.try_element_at(u["tf"], p["w"]), F.lit(0.0))).alias("dot"), t["licence"].alias("licence"), t["norm"].alias("norm")))
        cosines = F.transform(dots, lambda d: F.struct((-F.round(d["dot"] / (d["norm"] * F.sqrt(u["square"])), 9)).alias("c"), d["licence"].alias("licence")))
        return F.array_min(cosines)

    units = F.transform(units, counted)
    units = F.transform(units, lambda u: F.struct(u["tf"].alias("tf"), u["n"].alias("n"), u["kind"].alias("kind"), squared(u).alias("square")))
    units = F.transform(units, lambda u: F.struct(best(u).alias("best"), u["n"].alias("n"), u["kind"].alias("kind")))
    return F.transform(units, lambda u: F.struct((-u["best"]["c"]).alias("cosine"), u["best"]["licence"].alias("licence"), u["n"].alias("n"), u["kind"].alias("kind")))


def _numbered(docs: DataFrame, *special: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with numbered columns in place of its names, and the names of those that stay: all but the text (the first of
    special) and those named like results."""
    base = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return base, {f"c{k}": n for k, n in enumerate(docs.columns) if n != special[0] and n not in RESULTS}


def declared(docs: DataFrame, templates=TEMPLATES, least: float = LEAST, text: str = "text") -> DataFrame:
    """docs with declared, cosine (of the best unit, where it reaches `least`) and is_license_file, without the text."""
    base, own = _numbered(docs, text)
    found = _declared(base, templates, least, f"c{docs.columns.index(text)}", list(own))
    return found.select(*[F.col(c).alias(n) for c, n in own.items()], *RESULTS[:3])


def _declared(docs: DataFrame, templates, least: float, text: str, names: list[str]) -> DataFrame:
    """declared for columns by number."""
    idf, unseen = inverse_frequencies(docs, templates, text)
    vectors = weighed(templates, idf)
    keys = F.array(*map(F.lit, key_words(vectors, idf, least)))
    words = words_of(F.col(text))
    found = F.when(F.arrays_overlap(words, keys), F.filter(_units(vectors, idf, unseen, keys, F.col(text)), lambda u: u["cosine"] >= F.lit(least)))
    # Kept, as all that follows reads it several times: the texts are compared once.
    marked = keep(docs.select(*names, F.when(F.arrays_overlap(words, keys), F.size(words)).alias("_n"), found.alias("_units")), "units")
    top = F.array_min(F.transform("_units", lambda u: F.struct((-u["cosine"]).alias("c"), u["licence"].alias("licence"))))
    held = lambda kind: F.aggregate("_units", F.lit(0), lambda acc, u: acc + F.when(u["kind"] == kind, u["n"]).otherwise(0))
    is_file = (F.size("_units") > 0) & ((2 * held(0) >= F.col("_n")) | (2 * held(1) >= F.col("_n")) | F.exists("_units", lambda u: u["kind"] == 2))
    return marked.select(*names, top["licence"].alias("declared"), (-top["c"]).alias("cosine"), F.coalesce(is_file, F.lit(False)).alias("is_license_file"))


def parent(path: Column) -> Column:
    """The directory of a path; that of a path without a slash is the root, an empty string."""
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def ancestors(directory: Column) -> Column:
    """(directory, distance) of a directory and all above it, up to the root."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/").alias("above"), k.alias("distance")))


def scan_licenses(docs: DataFrame, path: str = "path", templates=TEMPLATES, least: float = LEAST, text: str = "text") -> DataFrame:
    """docs without the text, with declared, cosine, is_license_file, license, inherited_from and distance.

    Ancestors are listed for distinct directories, not for documents. The last join has one row a directory on its
    small side; a directory that holds many documents is split by the adaptive skew join where it isn't broadcast.
    """
    base, own = _numbered(docs, text)
    place = f"c{docs.columns.index(path)}"
    marked = _declared(base, templates, least, f"c{docs.columns.index(text)}", [*own, *({place} - {*own})])
    named = F.col("declared").isNotNull() & F.coalesce(F.col(place).rlike(FILE_NAME), F.lit(False))
    marked = marked.withColumn("is_license_file", F.col("is_license_file") | named)
    marked = marked.withColumn("_dir", F.array_join(F.filter(F.split(parent(F.coalesce(F.col(place), F.lit(""))), "/"), lambda p: p != ""), "/"))
    speaks = marked.where("is_license_file").groupBy("_dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("declared").alias("licence"))).alias("m")).select(F.col("_dir").alias("above"), F.col("m.licence").alias("said"))
    above = marked.where("declared is null").select("_dir").distinct().select("_dir", F.inline(ancestors(F.col("_dir"))))
    nearest = above.join(speaks, "above").groupBy("_dir").agg(F.min(F.struct("distance", "above", "said")).alias("near"))
    return marked.join(nearest, "_dir", "left").select(
        *[F.col(c).alias(n) for c, n in own.items()],
        *RESULTS[:3],
        F.coalesce("declared", "near.said").alias("license"),
        F.when(F.col("declared").isNull(), F.col("near.above")).alias("inherited_from"),
        F.when(F.col("declared").isNull(), F.col("near.distance")).cast("long").alias("distance"),
    )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """documents have no paths: their directory here is source, language and, in hundreds, their id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shelf = F.floor(F.col("doc_id") / 100).cast("string")
    docs = docs.select("doc_id", F.concat_ws("/", "source", "lang", shelf, F.col("doc_id").cast("string")).alias("path"), "text")
    out = scan_licenses(docs)
    return out.select("doc_id", "path", "declared", F.round("cosine", 6).alias("cosine"), "is_license_file", "license", "inherited_from", "distance")


_VALUES = ", ".join(f"({k}, '{licence}', '{w}', {n})" for k, (licence, text) in enumerate(TEMPLATES) for w, n in sorted(_template_words(text).items()))
_WORDS = "list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z]+'), lambda x: x <> '')"
SQL = {
    "op1_license_scan": rf"""
WITH tpl(tid, licence, w, tf) AS (VALUES {_VALUES}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, concat_ws('/', source, lang, CAST(CAST(floor(doc_id / 1e2) AS BIGINT) AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path FROM documents),
dw AS (SELECT r, {_WORDS.format("text")} AS ws FROM d),
tot AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
df AS (SELECT v.w, count(x.r) AS df FROM (SELECT DISTINCT w FROM tpl) v LEFT JOIN (SELECT DISTINCT r, unnest(ws) AS w FROM dw) x ON x.w = v.w GROUP BY v.w),
idf AS (SELECT w, ln((1 + n) / (1 + df)) + 1 AS idf FROM df, tot),
tn AS (SELECT tid, sqrt(sum(tf * idf * tf * idf)) AS norm FROM tpl JOIN idf USING (w) GROUP BY tid),
un AS (SELECT r, k AS u, 0 AS kind, ls[k] AS t FROM (SELECT r, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT r, string_split(text, chr(10)) AS ls FROM d))
  UNION ALL SELECT r, -k, 1, ps[k] FROM (SELECT r, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT r, string_split_regex(text, '{GAP}') AS ps FROM d) WHERE len(ps) > 1) WHERE contains(ps[k], chr(10))
  UNION ALL SELECT r, 0, 2, text FROM d WHERE contains(text, chr(10))),
uw AS (SELECT r, u, kind, {_WORDS.format("t")} AS ws FROM un),
us AS (SELECT r, u, kind, len(ws) AS n, ws FROM uw WHERE len(ws) > 0),
uf AS (SELECT r, u, w, count(*) AS tf FROM (SELECT r, u, unnest(ws) AS w FROM us) WHERE w IN (SELECT w FROM idf) GROUP BY r, u, w),
sq AS (SELECT us.r, us.u, any_value(us.n) AS n, any_value(us.kind) AS kind, sum(uf.tf * idf * uf.tf * idf) + (any_value(us.n) - sum(uf.tf)) * pow(ln(1 + any_value(tot.n)) + 1, 2) AS sq
  FROM us JOIN uf ON us.r = uf.r AND us.u = uf.u JOIN idf USING (w), tot GROUP BY us.r, us.u),
cs AS (SELECT uf.r, uf.u, tid, any_value(tpl.licence) AS licence, sum(uf.tf * idf * tpl.tf * idf) AS dot FROM uf JOIN tpl USING (w) JOIN idf USING (w) GROUP BY uf.r, uf.u, tid),
co AS (SELECT cs.r, cs.u, licence, n, kind, round(dot / (norm * sqrt(sq)), 9) AS c FROM cs JOIN tn USING (tid) JOIN sq ON cs.r = sq.r AND cs.u = sq.u),
ub AS (SELECT * FROM co WHERE c >= 0.6 QUALIFY row_number() OVER (PARTITION BY r, u ORDER BY c DESC, licence) = 1),
best AS (SELECT * FROM ub QUALIFY row_number() OVER (PARTITION BY r ORDER BY c DESC, licence) = 1),
fl AS (SELECT ub.r, bool_or(kind = 2) OR 2 * greatest(sum(CASE WHEN kind = 0 THEN n ELSE 0 END), sum(CASE WHEN kind = 1 THEN n ELSE 0 END)) >= any_value(len(dw.ws)) AS f FROM ub JOIN dw USING (r) GROUP BY ub.r),
m AS (SELECT d.r, doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, best.licence AS declared, best.c AS cosine, coalesce(fl.f, false) OR (best.licence IS NOT NULL AND coalesce(regexp_matches(path, '{FILE_NAME}'), false)) AS is_license_file FROM d LEFT JOIN best USING (r) LEFT JOIN fl USING (r)),
sp AS (SELECT dir AS above, declared AS said FROM m WHERE is_license_file QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, declared) = 1),
an AS (SELECT dir, k AS distance, array_to_string(ps[1 : len(ps) - k], '/') AS above FROM (SELECT dir, ps, unnest(range(0, len(ps) + 1)) AS k FROM (SELECT DISTINCT dir, list_filter(string_split(dir, '/'), lambda x: x <> '') AS ps FROM m))),
nr AS (SELECT dir, above, distance, said FROM an JOIN sp USING (above) QUALIFY row_number() OVER (PARTITION BY dir ORDER BY distance) = 1)
SELECT doc_id, path, declared, round(cosine, 6) AS cosine, is_license_file, coalesce(declared, said) AS license,
  CASE WHEN declared IS NULL THEN above END AS inherited_from, CAST(CASE WHEN declared IS NULL THEN distance END AS BIGINT) AS distance FROM m LEFT JOIN nr USING (dir)"""
}
