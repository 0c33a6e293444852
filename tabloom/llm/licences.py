"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form: ASCII lower case; copyright lines, "all rights reserved" and years of notices go;
equivalent spellings become one; everything but letters and digits becomes one space. Its digest (SHA-256) is joined by
hash with the digests of known licences, which are made by the same expression. Two kinds of texts are looked up: the
entire document, and each of its lines, so notices inside other text are found as well. The known digests are a table
of `known`; it is broadcast after its rows were counted (at most `BROADCAST_ROWS`), and joined by Spark's choice beyond.

Null and empty texts have the digest of the empty string and no licence; an empty canonical form never matches.
Repeated rows are scanned each; null ids stay null; an empty table gives no rows; other columns are not read. Texts are
normalised whole, by regular expressions that take time in proportion to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.llm.common import texts_of

BROADCAST_ROWS = 10_000

# Texts of public licences and the notices that name a licence in one line.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
KNOWN = [
    ("MIT", MIT),
    ("MIT", "MIT License\n\n" + MIT),
    ("MIT", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", ISC),
    ("ISC", "ISC License\n\n" + ISC),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This work is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
]
# Characters that become others before all else: capitals and typographic signs.
FROM_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ“”‘’–—\u00a0"
TO_SIGNS = "abcdefghijklmnopqrstuvwxyz\"\"''-- "
# Fixed values: (pattern, replacement) on lower-case text with single spaces; spellings that mean the same.
SPELLINGS = [
    ("\\b(licence|license)(s|d)?\\b", "license$2"),
    ("\\bnon ?commercial\\b", "noncommercial"),
    ("\\bsub ?licen[cs]e\\b", "sublicense"),
    ("\\bcopyright holders?\\b", "copyright owner"),
    ("\\bversion (\\d)( 0)?\\b", "v$1"),
    ("\\bhttps?\\b", "http"),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    lower = F.translate(text, FROM_SIGNS, TO_SIGNS)
    out = F.regexp_replace(lower, "(?m)^[^a-z0-9\\n]*(copyright( \\(c\\)|\\s*©)?|\\(c\\)|©)[^\\n]*[0-9]{4}[^\\n]*$", " ")
    out = F.regexp_replace(out, "\\ball rights reserved\\b", " ")
    out = F.regexp_replace(out, "[^a-z0-9\\x{80}-\\x{10FFFF}]+", " ")
    for pattern, replacement in SPELLINGS:
        out = F.regexp_replace(out, pattern, replacement)
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(F.coalesce(text, F.lit(""))), 256)


def known_licences(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """(licence, digest) of known texts."""
    table = spark.createDataFrame(known, "licence string, known_text string")
    return table.select("licence", digest(F.col("known_text")).alias("digest")).filter(F.col("digest") != F.sha2(F.lit(""), 256)).distinct()


def scan(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, digest, licence (of the entire text), notices (sorted licences named by a line)."""
    rows = texts_of(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: x != ""), lambda x: F.struct(F.lit(False).alias("entire"), x.alias("part")))
    units = rows.select("_row", "doc_id", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("entire"), F.col("text").alias("part"))), lines)).alias("unit"))
    digests = units.select("_row", "doc_id", "unit.entire", digest(F.col("unit.part")).alias("digest"))
    table = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    hits = digests.join(table, "digest", "left")
    return hits.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"), F.max(F.when(F.col("entire"), F.col("digest"))).alias("digest"), F.max(F.when(F.col("entire"), F.col("licence"))).alias("licence"),
        F.array_sort(F.collect_set(F.when(~F.col("entire"), F.col("licence")))).alias("notices"),
    ).drop("_row")
