"""Operator 1, license scans: canonical digest lookup (DataFrame functions only).

A text's canonical form is lower case, without copyright lines, with one spelling of words that are
written in several ways, and with every run of other characters than letters and digits as one space.
The SHA-256 of the canonical whole text is hash-joined to the digests of known licences.  The same
form and digests are used for every line by itself, so notices that stand on a line of a longer text
are found as well.

Known licences are a table of (license_id, text), :func:`known_licenses` by default; its digests are a
table of as many rows, broadcast up to ``max_broadcast`` rows.  Beyond it the digests of texts and of their distinct
lines are joined to it by a shuffle.  The scan reads each text once and never shuffles it, only digests.

Defined cases: a null or empty text has the digest of the empty text and no licence; null ids pass
through; repeated rows give repeated results; an empty table gives an empty result; further columns
are ignored.  If two known licences share a digest, the smaller id is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, require, table, text_of

#: Spellings of one word; the first form of each pair becomes the second.
EQUIVALENT = (("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("favour", "favor"), ("judgement", "judgment"), ("non commercial", "noncommercial"), ("per cent", "percent"), ("whilst", "while"), ("owner", "holder"))

_COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©)[^\n]*$"
_NOT_WORD = r"[^\p{L}\p{N}\n]+"

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_NAMES = {
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "GPL-2.0-only": ("GNU General Public License, version 2", "GNU GPL v2"),
    "GPL-3.0-only": ("GNU General Public License, version 3", "GNU GPL v3"),
    "LGPL-3.0-only": ("GNU Lesser General Public License, version 3", "GNU LGPL v3"),
    "AGPL-3.0-only": ("GNU Affero General Public License, version 3", "GNU AGPL v3"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
}
#: Title lines that whole texts open with.
_TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License"),
    "Zlib": ("zlib License", "The zlib License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD 2-Clause \"Simplified\" License", "The 2-Clause BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD 3-Clause \"New\" or \"Revised\" License", "The 3-Clause BSD License"),
}
_NOTICES = ("{}", "Released under {}", "Released under the {}", "Licensed under {}", "Licensed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "Distributed under the {}")


def known_licenses() -> list[tuple[str, str]]:
    """(license_id, text): short licences, file headers, and one-line notices of common licences."""
    full = [
        ("MIT", _MIT), ("ISC", _ISC), ("Zlib", _ZLIB),
        ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-3-Clause", _BSD_HEAD + _BSD_NAMES + _BSD_TAIL),
        ("Apache-2.0", _APACHE_NOTICE), ("MPL-2.0", _MPL_NOTICE),
    ]
    titled = [(k, f"{title}\n{text}") for k, text in full for title in _TITLES.get(k, ())]
    return full + titled + [(k, n.format(name)) for k, names in _NAMES.items() for name in names for n in _NOTICES]


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line feeds kept."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT_LINE, "")
    out = F.regexp_replace(out, _NOT_WORD, " ")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def canonical(lines: Column) -> Column:
    """The canonical form of a whole text from :func:`canonical_lines`."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def digests(spark: SparkSession, known: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """license_id and digest of each known text."""
    texts = known if isinstance(known, DataFrame) else spark.createDataFrame(known, "license_id string, text string")
    form = canonical(canonical_lines(text_of("text")))
    return texts.select("license_id", F.sha2(form.cast("binary"), 256).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


#: Most known digests that are broadcast and looked up in place.
MAX_BROADCAST = 20_000


def scan(df: DataFrame, known: list[tuple[str, str]] | DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """id, canonical_sha256, license_id (whole text) and line_license_ids (sorted, without repeats)."""
    require(df, id_col, text_col)
    table_ = digests(df.sparkSession, known)
    rows = table_.limit(max_broadcast + 1).collect()  # known licences up to the bound, not the corpus
    lines = df.select(F.col(id_col).alias("__rw_id"), canonical_lines(text_of(text_col)).alias("__rw_lines"))
    whole = F.sha2(canonical(F.col("__rw_lines")).cast("binary"), 256)
    each = F.transform(F.split("__rw_lines", "\n"), lambda x: F.sha2(F.trim(x).cast("binary"), 256))
    found = _few(lines, whole, each, table_, rows) if len(rows) <= max_broadcast else _many(lines, whole, each, table_)
    return found.select(F.col("__rw_id").alias(id_col), "canonical_sha256", F.when(F.col("canonical_sha256") != _empty(), F.col("license_id")).alias("license_id"), F.coalesce(F.array_join("__rw_hits", ","), F.lit("")).alias("line_license_ids"))


def _empty() -> Column:
    return F.sha2(F.lit("").cast("binary"), 256)


def _few(lines: DataFrame, whole: Column, each: Column, table_: DataFrame, rows: list) -> DataFrame:
    """Digests looked up in place."""
    ids = {r["digest"]: r["license_id"] for r in rows}
    digest_list = F.array(*map(F.lit, ids)) if ids else F.array().cast("array<string>")
    named = F.map_from_arrays(digest_list, F.array(*map(F.lit, ids.values())) if ids else F.array().cast("array<string>"))
    out = lines.select("__rw_id", whole.alias("canonical_sha256"), F.array_intersect(each, digest_list).alias("__rw_hits"))
    hits = F.array_sort(F.array_distinct(F.transform(F.filter("__rw_hits", lambda d: d != _empty()), lambda d: F.element_at(named, d))))
    side = F.broadcast(lines.sparkSession.createDataFrame(rows, table_.schema)) if rows else table_
    return out.withColumn("__rw_hits", hits).join(side.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left")


def _many(lines: DataFrame, whole: Column, each: Column, table_: DataFrame) -> DataFrame:
    """Digests joined by a shuffle; a digest many texts share is split at run time."""
    # row numbers must not change between the two uses
    rows = cut_lineage(lines.select("__rw_id", whole.alias("canonical_sha256"), F.array_remove(F.array_distinct(each), _empty()).alias("__rw_each"), F.monotonically_increasing_id().alias("__rw_row")))
    at = rows.select("__rw_row", F.explode("__rw_each").alias("digest"))
    hits = at.join(table_, "digest").groupBy("__rw_row").agg(F.array_sort(F.collect_set("license_id")).alias("__rw_hits"))  # at most as many as there are licences
    named = rows.drop("__rw_each").join(table_.withColumnRenamed("digest", "canonical_sha256"), "canonical_sha256", "left")
    return named.join(hits, "__rw_row", "left")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_licenses())


def _sql(text: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({text}), '{_COPYRIGHT_LINE}', '', 'g'), '{_NOT_WORD}', ' ', 'g')"
    for a, b in EQUIVALENT:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


QUERIES = {"op1_license_scans": op1_license_scans}
ORACLES = {
    "op1_license_scans": f"""
WITH known(license_id, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in known_licenses())}),
digests AS (SELECT sha256(trim(regexp_replace({_sql("text")}, '[ \\n]+', ' ', 'g'))) AS digest, min(license_id) AS license_id FROM known GROUP BY 1),
docs AS (SELECT doc_id, {_sql("coalesce(text, '')")} AS lines FROM documents),
whole AS (SELECT doc_id, sha256(trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))) AS canonical_sha256 FROM docs),
by_line AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS ids
  FROM (SELECT doc_id, trim(x) AS x FROM docs, unnest(string_split(lines, chr(10))) u(x)) JOIN digests ON sha256(x) = digest WHERE x <> '' GROUP BY doc_id)
SELECT doc_id, canonical_sha256, license_id, coalesce(ids, '') AS line_license_ids
FROM whole LEFT JOIN digests ON digest = canonical_sha256 LEFT JOIN by_line USING (doc_id)"""
}
