"""Licence scan by canonical digests, in Spark expressions only.

A text is lower-cased, lines that only carry a copyright statement are taken out, equivalent
spellings are made one, and everything but letters and digits becomes single spaces.  The
digest of the result is looked up by a hash join in the table of known licence texts and
notices.  The whole text is looked up, and each of its lines that speaks of a licence.

Defined results: a null or empty text has no digest and no licence; rows with one id are one
document (a null id included) whose licences are united and whose lines add up; catalogue entries with one canonical
form are one licence (the first name).  Only ids, digests and hits are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings taken as equal, applied in this order to lower-case text.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("https://", "http://"),
    ("copyright owner", "copyright holder"),
    ("merchantibility", "merchantability"),
    ("per cent", "percent"),
    ("owing to", "because of"),
    ("organisation", "organization"),
    ("(^|[^a-z0-9])v[.]? ?([0-9])", "$1version $2"),
]
# Fixed value: a line that only states a copyright.
COPYRIGHT_LINE = r"(?md)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^a-z0-9\n]*(?:\(c\)|©)?[^a-z0-9\n]*(?:19|20)[0-9][0-9][^\n]*$"
SPEAKS = r"licen[cs]e|public domain|spdx|creative commons|cc by|cc0"

# Known notices and short licence texts (public, SPDX ids).
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License."""
KNOWN = [
    ("MIT", MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Apache-2.0", APACHE_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]


def canonical(text: Column) -> Column:
    """The form that is hashed."""
    t = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    t = reduce(lambda s, p: F.regexp_replace(s, p[0], p[1]), SPELLINGS, t)
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", " "))


def digest(text: Column) -> Column:
    """sha256 of the canonical form; null when nothing is left."""
    form = canonical(text)
    return F.when(form != "", F.sha2(form, 256))


def catalogue(spark, known=KNOWN) -> DataFrame:
    """(digest, license), one row per canonical form."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(t).alias("text")) for k, t in known]))
    texts = spark.range(1).select(rows.alias("k")).select("k.license", digest(F.col("k.text")).alias("digest"))
    return texts.filter("digest IS NOT NULL").groupBy("digest").agg(F.min("license").alias("license"))


def scan_licenses(df: DataFrame, doc_id: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(doc_id, digest, text_license, n_lines, notices), one row per id.

    ``text_license`` is the licence that the whole text is, ``n_lines`` the number of different lines that speak
    of licences, and ``notices`` the known licences among those lines, sorted and comma-joined.
    """
    known = catalogue(df.sparkSession) if known is None else known
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.lower(x).rlike(SPEAKS))
    whole = F.array(F.struct(F.lit("text").alias("scope"), digest(F.col(text)).alias("digest")))
    each = F.transform(F.array_distinct(lines), lambda x: F.struct(F.lit("line").alias("scope"), digest(x).alias("digest")))
    entries = df.select(F.col(doc_id), F.explode(F.concat(whole, each)).alias("_e")).select(doc_id, "_e.scope", "_e.digest")
    hits = entries.join(known, "digest", "left")
    is_text = F.col("scope") == "text"
    return hits.groupBy(doc_id).agg(
        F.min(F.when(is_text, F.col("digest"))).alias("digest"),
        F.min(F.when(is_text, F.col("license"))).alias("text_license"),
        F.count_if(~is_text).alias("n_lines"),
        F.array_join(F.sort_array(F.collect_set(F.when(~is_text, F.col("license")))), ",").alias("notices"),
    )


def sql_canonical(text: str) -> str:
    """The same form in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"regexp_replace(lower({text}), {quote(COPYRIGHT_LINE.replace('(?md)', '(?m)'))}, '', 'g')"
    for old, new in SPELLINGS:
        out = f"regexp_replace({out}, {quote(old)}, {quote(new.replace('$', chr(92)))}, 'g')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"
