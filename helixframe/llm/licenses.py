"""Licence scan by canonical digests, in DataFrame operations only (operator 3)."""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_NO_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_1 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."

#: Licence texts and notices as published, one row per spelling that is looked up.
KNOWN: list[tuple[str, str]] = [
    ("MIT", f"MIT License {_MIT} {_NO_WARRANTY}"),
    ("MIT", f"The MIT License {_MIT} {_NO_WARRANTY}"),
    ("MIT", f"{_MIT} {_NO_WARRANTY}"),
    ("ISC", f"ISC License Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_WARRANTY}"),
    ("BSD-2-Clause", f"BSD 2-Clause License {_BSD_1} {_BSD_2} {_BSD_WARRANTY}"),
    ("BSD-2-Clause", f"{_BSD_1} {_BSD_2} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"BSD 3-Clause License {_BSD_1} {_BSD_2} {_BSD_3} {_BSD_WARRANTY}"),
    ("BSD-3-Clause", f"{_BSD_1} {_BSD_2} {_BSD_3} {_BSD_WARRANTY}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


@cache
def known_texts() -> list[tuple[str, str]]:
    """KNOWN, and the whole texts of licences as published, which are files of this package named by SPDX identifier."""
    files = sorted((Path(__file__).parent / "license_texts").glob("*.txt"))
    return KNOWN + [(f.stem, f.read_text(encoding="utf-8")) for f in files]


#: Words that count as the same, as the SPDX matching guidelines list them.
SPELLINGS: dict[str, str] = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "https": "http",
    "initialise": "initialize", "judgement": "judgment", "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed",
    "licences": "licenses", "maximise": "maximize", "modelled": "modeled", "modelling": "modeling", "offence": "offense", "optimise": "optimize",
    "organisation": "organization", "organise": "organize", "owner": "holder", "owners": "holders", "practise": "practice", "programme": "program",
    "realise": "realize", "recognise": "recognize", "signalling": "signaling", "utilisation": "utilization", "whilst": "while", "wilful": "willful",
}
#: Lines that name a holder: with a sign, a year or a place for one.
_COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright[ \t]*(?:\(c\)|©|[<\[{(]+(?:year|yyyy))[^\n]*|(?:copyright|\(c\))[^\n]*[0-9]{4}[^\n]*|©[^\n]*)$|^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, without lines of copyright, everything but letters and digits as one blank, and words in one spelling."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    marked = F.contains(lower, F.lit("copyright")) | F.contains(lower, F.lit("(c)")) | F.contains(lower, F.lit("©")) | F.contains(lower, F.lit("all rights"))
    kept = F.when(marked, F.regexp_replace(lower, _COPYRIGHT_LINE, "")).otherwise(lower)
    plain = F.trim(F.regexp_replace(kept, r"[^\p{L}\p{N}]+", " "))
    spelling = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))

    def spelled(p: Column) -> Column:
        words = F.transform(F.split(p, " "), lambda w: F.coalesce(F.try_element_at(spelling, w), w))
        return F.when(p.rlike(rf"\b(?:{'|'.join(SPELLINGS)})\b"), F.array_join(words, " ")).otherwise(p)

    return F.get(F.transform(F.array(plain), spelled), F.lit(0))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame | None = None) -> DataFrame:
    """license, digest and first word of known texts, given as pairs or as a table (license, text)."""
    rows = known if isinstance(known, DataFrame) else spark.createDataFrame(known_texts() if known is None else known, "license string, text string")
    plain = rows.select("license", canonical(F.col("text")).alias("plain"))
    return plain.groupBy(F.sha2("plain", 256).alias("digest")).agg(F.min("license").alias("license"), F.min(F.substring_index("plain", " ", 1)).alias("first_word"))


def begins_with(line: Column, words: list[str]) -> Column:
    """Whether the canonical form of a line can begin with one of the words: a cheap test that spares most lines their digest."""
    spelled = sorted({*words, *(a for a, b in SPELLINGS.items() if b in words)})
    return F.regexp_extract(F.lower(line), r"[\p{L}\p{N}]+", 0).isin(spelled)


def scan_licenses(docs: DataFrame, known: list[tuple[str, str]] | DataFrame | None = None, most_notices: int = 10_000) -> DataFrame:
    """A row per document: doc_id, digest, license (whose text the whole document is, else null), notices.

    notices lists, sorted and comma-joined, the licences of which a known text fills a whole line of the document (empty if
    none). The whole texts are joined by digest; no side is forced to be broadcast. For lines, up to most_notices known
    digests go to the tasks as one literal; with more, lines are exploded and joined as well. Null and empty texts
    have the digest of the empty text, which is no licence. Rows of equal doc_id are documents of their own; equal texts of
    two licences give the first by name.
    """
    spark = docs.sparkSession
    digests = known_digests(spark, known).where(F.col("digest") != F.sha2(F.lit(""), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    few = digests.limit(most_notices + 1).collect()
    if len(few) <= most_notices:
        table = F.create_map(*(F.lit(x) for r in few for x in (r["digest"], r["license"]))) if few else F.create_map().cast("map<string,string>")
        lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l: begins_with(l, [r["first_word"] for r in few]))
        found = F.filter(F.transform(lines, lambda l: F.try_element_at(table, digest(l))), lambda x: x.isNotNull())
        rows = rows.withColumn("notices", F.array_join(F.array_sort(F.array_distinct(found)), ","))
    else:
        lines = rows.select("doc_id", F.xxhash64("text").alias("key"), F.explode(F.split("text", "\n")).alias("line"))
        hit = lines.withColumn("digest", digest(F.col("line"))).join(digests.select("digest", "license"), "digest").groupBy("doc_id", "key").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("found"))
        rows = rows.withColumn("key", F.xxhash64("text")).alias("r").join(hit.alias("h"), F.col("r.key").eqNullSafe(F.col("h.key")) & F.col("r.doc_id").eqNullSafe(F.col("h.doc_id")), "left")
        rows = rows.select("r.doc_id", "r.text", F.coalesce("found", F.lit("")).alias("notices"))
    whole = rows.select("doc_id", digest(F.col("text")).alias("digest"), "notices")
    return whole.join(digests.select("digest", "license"), "digest", "left").select("doc_id", "digest", "license", "notices")


def _sql_canonical(text: str) -> str:
    cut = f"regexp_replace(lower(coalesce({text}, '')), '{_COPYRIGHT_LINE}', '', 'g')"
    plain = rf"trim(regexp_replace({cut}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    spelling = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in SPELLINGS.items()) + "}"
    return f"array_to_string(list_transform(string_split({plain}, ' '), lambda w: coalesce({spelling}[w], w)), ' ')"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in known_texts())
    return f"""
WITH k AS (SELECT sha256({_sql_canonical('t')}) AS digest, min(n) AS license FROM (VALUES {values}) v(n, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, sha256({_sql_canonical('text')}) AS digest FROM documents),
l AS (SELECT rid, sha256({_sql_canonical('line')}) AS digest FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
n AS (SELECT rid, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices FROM l JOIN k USING (digest) GROUP BY rid)
SELECT d.doc_id, d.digest, k.license, coalesce(n.notices, '') AS notices FROM d LEFT JOIN k USING (digest) LEFT JOIN n USING (rid)
"""
