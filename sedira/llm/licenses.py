"""License scans by canonical digest lookup.

A text is brought to a canonical form (case, punctuation also of typesetters, copyright lines, titles, equivalent
spellings), and the SHA-256 of the whole form is joined to the digests of known licences. Every line that names a licence is
looked up in the same way, as a text of its own, since notices of one line stand inside other texts. All of it is DataFrame
functions; of the lines, only those that are known leave the tasks that read them.

A line is a copyright line, and dropped, if it begins with a sign (©), with "copyright" and a sign or (c), or with any of
these and a year; a clause "(c) you must retain ..." and the second line of "the above / copyright notice ..." are text.
So is "all rights reserved" at the start of a line dropped, and a title such as "The MIT License (MIT)" as the first line.

Cases: null and empty texts, and texts without a letter or digit once copyright lines are gone, have a null digest and
match nothing; a known licence of that kind is ignored; two known licences with one canonical form give the first name by
code point; a text without lines that are known has an empty list of them; repeated documents each give a row; an empty
table gives none. `scan` keeps the input's columns in a struct.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedira.llm.common import Scratch, read

#: Equivalent spellings of the public licence matching guidelines (this word counts as that one).
EQUIVALENT = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}
#: Fixed values, of the same guidelines: runs of words, as they stand once punctuation is blank.
EQUIVALENT_RUNS = {
    "copyright owner": "copyright holder",
    "copyright owners": "copyright holders",
    "non commercial": "noncommercial",
    "per cent": "percent",
    "sub license": "sublicense",
}

#: Short public licence texts and notices, by their public identifiers. A caller passes a table of its own.
KNOWN = {
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "CC-BY-NC-4.0-notice": """Licensed under CC BY-NC 4.0.""",
    "GPL-3.0-notice": """This work is licensed under the GNU General Public License, version 3.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
#: Digests of the canonical forms of longer public licence texts, as Debian distributes them.
KNOWN_DIGESTS = {
    "Apache-2.0": "036b5ff6d47b44974c624da95e5bf0ac7ddfe5030e41dfa7ff8ac0c1daa9f32b",
    "Artistic-1.0-Perl": "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71",
    "GFDL-1.3": "93d6108daecdddc5f284cf8f2512fb0d72f6e9ee12381feb9704ba194b00c3e6",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0": "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "3f0343dd4f3b064be36e0c6584737c9b7bb5c322721694563f9009e088ce96d1",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}
#: Known digests (64 bytes and a name each), and texts with known lines, that are broadcast at most.
BROADCAST = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INDENT = r"[ \t#*/;.-]*"
#: Fixed patterns, in the syntax that Java's and RE2's regular expressions share; texts are in lower case.
COPYRIGHT = rf"(\A|\n){_INDENT}(portions )?(copyright[ \t]*(\(c\)|©)|©|(copyright|\(c\))[ \t:,]*[\[<{{(]?((19|20)[0-9][0-9]|year|yyyy))[^\n]*"
RESERVED = rf"(\A|\n){_INDENT}all rights reserved[ \t.]*"
TITLE = r"\A[\s#*/;.-]*(the )?(mit|isc|zlib|0bsd|bsd|bsd zero clause|bsd [23][ -]clause|2-clause bsd|3-clause bsd|new bsd|simplified bsd) licen[cs]e( \((mit|isc|0bsd|expat)\))?[ \t\r.:]*\n"
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\x{A0}-\x{A9}\x{AB}-\x{B1}\x{B4}\x{B6}-\x{B8}\x{BB}\x{BF}\x{2000}-\x{206F}\x{20A0}-\x{20CF}\x{2190}-\x{2BFF}\x{3000}-\x{303F}\x{FEFF}]+"
#: Which lines are looked up: those that name a licence.
NAMES = "(?i)licen[cs]e"


def _spellings() -> list[tuple[str, str]]:
    """What is replaced, between single blanks, in a form whose words stand between two blanks each (so that neighbours do not share one); words before runs, as a run may hold a word."""
    return [*sorted(EQUIVALENT.items()), *((a.replace(" ", "  "), b.replace(" ", "  ")) for a, b in sorted(EQUIVALENT_RUNS.items(), reverse=True))]


def _plain(text: Column) -> Column:
    """Letters A-Z in lower case; copyright lines, a title and punctuation dropped; words between single spaces."""
    t = F.translate(text, _UPPER, _LOWER)
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, COPYRIGHT, "\n"), RESERVED, "\n"), TITLE, "")
    return F.concat(F.lit(" "), F.regexp_replace(t, PUNCTUATION, " "), F.lit(" "))


def with_digest(rows: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` and digest: the SHA-256 of the canonical form of `text`, null if that is empty. Spellings are only replaced in texts that have one of them; each step is a column, so that none is computed twice."""
    spelled = F.col("_plain").rlike(f" ({'|'.join(sorted([*EQUIVALENT, *EQUIVALENT_RUNS]))}) ")
    wide = F.replace(F.col("_plain"), F.lit(" "), F.lit("  "))
    one = reduce(lambda c, ab: F.replace(c, F.lit(f" {ab[0]} "), F.lit(f" {ab[1]} ")), _spellings(), wide)
    one = F.replace(one, F.lit("  "), F.lit(" "))
    rows = rows.select(*keep, _plain(F.col("text")).alias("_plain")).select(*keep, F.trim(F.when(spelled, one).otherwise(F.col("_plain"))).alias("_form"))
    return rows.select(*keep, F.nullif(F.sha2("_form", 256), F.lit(hashlib.sha256(b"").hexdigest())).alias("digest"))


def known(spark: SparkSession) -> DataFrame:
    """license_id with a text or, of longer ones, a digest."""
    rows = [(k, v, None) for k, v in sorted(KNOWN.items())] + [(k, None, v) for k, v in sorted(KNOWN_DIGESTS.items())]
    return spark.createDataFrame(rows, "license_id string, text string, digest string")


def scan(docs: DataFrame, licenses: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc (struct of the input's columns, or of those of `carry`), digest, license_id (null: no known licence's text) and line_licenses (array of the names whose text is a line of the document, ascending). `licenses`: license_id, text, digest (used where text is null).

    Up to `BROADCAST` known digests, and texts with known lines, are broadcast, so that documents are not exchanged; beyond
    that the optimizer chooses the join.
    """
    scratch = Scratch(docs.sparkSession)
    table = with_digest(licenses.select("license_id", "text", F.col("digest").alias("given")), ["license_id", "given"]).select("license_id", F.coalesce("digest", "given").alias("digest"))
    table = scratch.keep(table.where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id")), "licenses")
    table = F.broadcast(table) if table.count() <= BROADCAST else table
    rows = docs.select(F.struct(*(carry or ["*"])).alias("doc"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    lines = rows.where(F.col("text").rlike(NAMES)).select("th", F.explode(F.split("text", "\n")).alias("text")).where(F.col("text").rlike(NAMES))
    named = with_digest(lines, ["th"]).join(table, "digest").groupBy("th").agg(F.array_sort(F.collect_set("license_id")).alias("line_licenses"))
    named = scratch.keep(named, "lines")
    named = F.broadcast(named) if named.count() <= BROADCAST else named
    found = with_digest(rows, ["doc", "th"]).join(table, "digest", "left").join(named, "th", "left")
    return found.select("doc", "digest", "license_id", F.coalesce("line_licenses", F.array().cast("array<string>")).alias("line_licenses"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, known(spark), ["doc_id"]).select(F.col("doc.doc_id").alias("doc_id"), "digest", "license_id", F.concat_ws(",", "line_licenses").alias("line_licenses"))


def _sql_text(column: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    sql = f"translate({column}, '{_UPPER}', '{_LOWER}')"
    for pattern, by in ((COPYRIGHT, "chr(10)"), (RESERVED, "chr(10)")):
        sql = f"regexp_replace({sql}, {quoted(pattern)}, {by}, 'g')"
    sql = f"regexp_replace({sql}, {quoted(TITLE)}, '')"
    sql = f"replace(' ' || regexp_replace({sql}, '{PUNCTUATION}', ' ', 'g') || ' ', ' ', '  ')"
    return "trim(replace(" + reduce(lambda c, ab: f"replace({c}, ' {ab[0]} ', ' {ab[1]} ')", _spellings(), sql) + ", '  ', ' '))"


ORACLE_OP1 = f"""
WITH known(license_id, text) AS (VALUES {", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(KNOWN.items()))}),
longer(license_id, digest) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in sorted(KNOWN_DIGESTS.items()))}),
digests AS (
  SELECT digest, min(license_id) AS license_id FROM (
    SELECT license_id, sha256(c) AS digest FROM (SELECT license_id, {_sql_text("text")} AS c FROM known) WHERE c <> '' UNION ALL SELECT * FROM longer) GROUP BY 1),
docs AS (SELECT doc_id, text, CASE WHEN c <> '' THEN sha256(c) END AS digest FROM (SELECT doc_id, text, {_sql_text("text")} AS c FROM documents)),
lines AS (SELECT DISTINCT text AS whole, unnest(string_split(text, chr(10))) AS text FROM documents WHERE regexp_matches(text, '{NAMES}')),
named AS (
  SELECT whole, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses
  FROM (SELECT whole, sha256(c) AS digest FROM (SELECT whole, {_sql_text("text")} AS c FROM lines WHERE regexp_matches(text, '{NAMES}')) WHERE c <> '') JOIN digests USING (digest) GROUP BY 1)
SELECT doc_id, digest, license_id, coalesce(line_licenses, '') AS line_licenses FROM docs LEFT JOIN digests USING (digest) LEFT JOIN named ON docs.text = named.whole
"""
