"""License scans by canonical digest, in DataFrame functions alone.

A line's canonical form has lower case, letters and digits only, one spelling for equivalent ones, and is empty where
it is a copyright line. A text's canonical form joins those of its lines. Digests of canonical forms, of entire texts
and of single lines, are hash-joined to the digests of known licences and notices.
"""

from __future__ import annotations

import hashlib

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import load, materialise

#: Spellings that count as the same (after case and punctuation are gone).
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("authoris", "authoriz"),
    ("organis", "organiz"),
    ("recognis", "recogniz"),
    ("utilis", "utiliz"),
    ("acknowledgement", "acknowledgment"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("fulfilment", "fulfillment"),
    ("judgement", "judgment"),
    ("non commercial", "noncommercial"),
    ("web site", "website"),
    ("copyright owner", "copyright holder"),
]
_OTHER = r"[^\p{L}\p{N}]+"
_COPYRIGHT = r"^(c |portions )*copyright( |$)|^c [0-9]{4}|^all rights reserved$"

#: Names by which notices call a licence.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License", "ISC"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD-3-Clause"],
    "GPL-2.0-only": ["GNU General Public License, version 2", "GPL-2.0", "GPLv2", "GPL-2.0-only"],
    "GPL-3.0-only": ["GNU General Public License, version 3", "GPL-3.0", "GPLv3", "GPL-3.0-only"],
    "LGPL-3.0-only": ["GNU Lesser General Public License, version 3", "LGPL-3.0", "LGPLv3", "LGPL-3.0-only"],
    "AGPL-3.0-only": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3", "AGPL-3.0-only"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
VERBS = ["Licensed under", "Released under", "Distributed under", "Available under", "Published under"]
SUBJECTS = ["", "This work is ", "This file is ", "This document is ", "This software is ", "This program is ", "This text is "]

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Entire licence texts, with and without their title.
TEXTS = {
    "MIT": (
        "MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY,
    ),
    "ISC": (
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_WARRANTY,
    ),
    "0BSD": ("BSD Zero Clause License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_WARRANTY),
    "BSD-2-Clause": ("BSD 2-Clause License", _BSD_START + _BSD_END),
    "BSD-3-Clause": ("BSD 3-Clause License", _BSD_START + _BSD_NAMES + _BSD_END),
}


def known_licenses() -> list[tuple[str, str]]:
    """(license id, text): entire texts, and the notices that names, verbs and subjects make by rule."""
    out = [(k, x) for k, (title, body) in TEXTS.items() for x in (body, f"{title}\n{body}")]
    for k, names in NAMES.items():
        out.append((k, f"SPDX-License-Identifier: {k}"))
        for name in names:
            for verb in VERBS:
                out += [(k, f"{s}{verb if not s else verb.lower()} {the}{name}") for s in SUBJECTS for the in ("", "the ")]
    return out


def canonical_line(line: Column) -> Column:
    out = F.trim(F.regexp_replace(F.replace(F.lower(line), F.lit("©"), F.lit(" c ")), _OTHER, " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(out.rlike(_COPYRIGHT), "").otherwise(out)


def canonical_lines(text: Column) -> Column:
    """The canonical forms of a text's lines that have any."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), canonical_line), lambda x: x != "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, text_digest (SHA-256 of the canonical text), license_id (whose entire text it is, or
    null), notices (ids of licences that its lines name, sorted, comma-joined, or null).

    ``known`` has license_id and text; of licences with one canonical form the first id counts. Null and blank texts
    have the digest of the empty text. Rows with one id share their notices; a null id is an id; other columns are
    ignored; an empty table gives an empty result. Lines longer than the longest known form can't match and are not
    digested; entire texts always are.
    """
    spark = docs.sparkSession
    if known is None:
        # one literal, cut up by the engine: hundreds of literals would weigh on every plan
        rows = F.lit("\x1e".join(f"{k}\x1f{x}" for k, x in known_licenses()))
        known = materialise(spark.range(1).select(F.explode(F.split(rows, "\x1e")).alias("k")).select(F.split_part("k", F.lit("\x1f"), F.lit(1)).alias("license_id"), F.split_part("k", F.lit("\x1f"), F.lit(2)).alias("text")))
    forms = known.select("license_id", F.array_join(canonical_lines(F.col("text")), " ").alias("form")).where("form <> ''")
    table = materialise(forms.groupBy("form").agg(F.min("license_id").alias("license_id")).select(F.length("form").alias("n"), F.sha2("form", 256).alias("digest"), "license_id"))
    longest = table.agg(F.max("n")).first()[0] or 0
    lines = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    short = F.array_distinct(F.filter("lines", lambda x: F.length(x) <= longest))
    digested = materialise(lines.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("text_digest"), F.transform(short, lambda x: F.sha2(x, 256)).alias("line_digests")))
    # Spark sends the table of known digests to all tasks only if its written size is below the broadcast threshold
    keys = table.select("digest", "license_id")
    noticed = digested.select("doc_id", F.explode("line_digests").alias("digest")).join(keys, "digest").groupBy(F.col("doc_id").alias("noted")).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    entire = digested.select("doc_id", "text_digest").join(keys.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    return entire.join(noticed, F.col("doc_id").eqNullSafe(F.col("noted")), "left").select("doc_id", "text_digest", "license_id", "notices")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))


def canonical(text: str) -> str:
    """The same form in Python, for the SQL's table of known digests."""
    out = []
    for line in text.split("\n"):
        x = regex.sub(_OTHER, " ", line.lower().replace("©", " c ")).strip(" ")
        for a, b in SPELLINGS:
            x = x.replace(a, b)
        if x and not regex.search(_COPYRIGHT, x):
            out.append(x)
    return " ".join(out)


def op4_sql() -> str:
    forms: dict[str, str] = {}
    for k, x in known_licenses():
        form = canonical(x)
        forms[form] = min(k, forms.get(form, k))
    values = ", ".join(f"('{hashlib.sha256(f.encode()).hexdigest()}', '{k}')" for f, k in sorted(forms.items()))
    x = f"trim(regexp_replace(replace(lower(x), '©', ' c '), '{_OTHER}', ' ', 'g'))"
    for a, b in SPELLINGS:
        x = f"replace({x}, '{a}', '{b}')"
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
raw AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {x}) AS lines FROM documents),
forms AS (SELECT doc_id, list_filter(lines, lambda x: x <> '' AND NOT regexp_matches(x, '{_COPYRIGHT}')) AS lines FROM raw),
noticed AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT DISTINCT doc_id, sha256(unnest(lines)) AS digest FROM forms) l JOIN known USING (digest) GROUP BY doc_id
)
SELECT f.doc_id, sha256(array_to_string(f.lines, ' ')) AS text_digest, k.license_id, n.notices
FROM forms f LEFT JOIN known k ON k.digest = sha256(array_to_string(f.lines, ' ')) LEFT JOIN noticed n ON n.doc_id IS NOT DISTINCT FROM f.doc_id
"""


OP4_SQL = op4_sql()
