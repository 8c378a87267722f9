"""Licence scans by canonical digests: whole texts, and whole lines and paragraphs, are looked up among known licence texts."""

from __future__ import annotations

import hashlib
import itertools
import re
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import LOWER, UPPER, ascii_lower, table, write_table

# Licence texts as their publishers word them.
MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so"""
MIT_NOTICE = """, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software."""
MIT_END = """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted"""
ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies."
ISC_END = """

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_BODY = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
BSD_END = """

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF
OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <http://unlicense.org/>"""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it
and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you
use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
BOOST = """Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and
transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is
furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by
a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT
HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Copyright (C) 2004 Sam Hocevar <sam@hocevar.net>

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is
allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", "MIT License\n\n" + MIT_BODY + MIT_NOTICE + MIT_END),
    ("MIT", "The MIT License (MIT)\n\n" + MIT_BODY + MIT_NOTICE + MIT_END),
    ("MIT", "The MIT License\n\n" + MIT_BODY + MIT_NOTICE + MIT_END),
    ("MIT", MIT_BODY + MIT_NOTICE + MIT_END),
    ("MIT-0", "MIT No Attribution\n\n" + MIT_BODY + "." + MIT_END),
    ("MIT-0", MIT_BODY + "." + MIT_END),
    ("ISC", "ISC License\n\n" + ISC_GRANT + ISC_NOTICE + ISC_END),
    ("ISC", ISC_GRANT + ISC_NOTICE + ISC_END),
    ("0BSD", "BSD Zero Clause License\n\n" + ISC_GRANT + "." + ISC_END),
    ("0BSD", ISC_GRANT + "." + ISC_END),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + BSD_BODY + BSD_END),
    ("BSD-2-Clause", BSD_BODY + BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + BSD_BODY + BSD_THIRD + BSD_END),
    ("BSD-3-Clause", BSD_BODY + BSD_THIRD + BSD_END),
    ("Apache-2.0", APACHE_NOTICE),
    ("Unlicense", UNLICENSE),
    ("Zlib", "zlib License\n\n" + ZLIB),
    ("Zlib", "The zlib/libpng License\n\n" + ZLIB),
    ("Zlib", ZLIB),
    ("BSL-1.0", BOOST),
    ("WTFPL", WTFPL),
)
#: Digests of longer texts, made by digest_of() of each licence's text as it is published (Debian ships them all in
#: /usr/share/common-licenses; a test makes them again where that folder is).
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("GPL-1.0-only", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0-only", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0-only", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0-only", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1-only", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0-only", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
    ("Artistic-1.0-Perl", "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2-only", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3-only", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
)
#: What a notice of one line says: somebody or nothing, how, and which licence by which name. Every combination is known.
SUBJECTS = ("", "this work is ", "this software is ", "this project is ", "this program is ", "this document is ", "this code is ", "the code is ")
VERBS = ("licensed", "released", "distributed", "available", "published")
VERSIONED = (("GPL", "General Public License", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", ("2.1", "3.0")), ("AGPL", "Affero General Public License", ("3.0",)))
COMMONS = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
NAMES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("the MIT License", "the MIT License (MIT)", "MIT")),
    ("Apache-2.0", ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0")),
    ("BSD-2-Clause", ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License")),
    ("BSD-3-Clause", ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License")),
    ("MPL-2.0", ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL 2.0")),
    ("ISC", ("the ISC License",)),
    ("Zlib", ("the zlib License",)),
    ("BSL-1.0", ("the Boost Software License, Version 1.0", "the Boost Software License 1.0")),
    ("Unlicense", ("the Unlicense",)),
    ("CC0-1.0", ("CC0 1.0", "CC0", "CC0 1.0 Universal")),
    *((f"{short}-{v}-only", tuple(f"{the}{name}{sep}{n}" for the, name in (("the GNU ", long), ("the ", f"GNU {short}"), ("", short)) for sep in (" version ", " v", "v", " ") for n in {v, v.removesuffix(".0")})) for short, long, versions in VERSIONED for v in versions),
    *((f"CC-{short}-{v}", (f"CC {short} {v}", f"the Creative Commons {long} {v} License", f"the Creative Commons {long} {v} International License", f"a Creative Commons {long} {v} International License")) for short, long in COMMONS for v in ("3.0", "4.0")),
)


@cache
def known_notices() -> tuple[tuple[str, str], ...]:
    """(licence, notice) of all combinations, and of identifiers as SPDX has them."""
    said = [(licence, f"{who}{how} under {name}") for (licence, names), who, how in itertools.product(NAMES, SUBJECTS, VERBS) for name in names]
    ids = sorted({licence for licence, _ in (*TEXTS, *DIGESTS, *NAMES)})
    return (*said, *((licence, f"SPDX-License-Identifier: {licence}") for licence in ids), *((licence, f"License: {licence}") for licence in ids))


#: Spellings that count as one, between spaces, once punctuation is gone.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
    ("acknowledgement", "acknowledgment"), ("authorisation", "authorization"), ("authorised", "authorized"), ("favour", "favor"), ("organisation", "organization"),
    ("https", "http"),
)
#: A line that states a copyright: nothing but marks before the word or sign, and a sign, a year or the usual phrase somewhere
#: after it; "(c)" alone counts before a year only, as it also numbers the items of lists.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright\b[^\n]*(?:\(c\)|©|\b[12][0-9]{3}\b|all rights reserved|<year>|\[yyyy\])|\(c\)[ \t]*(?:copyright[ \t]*)?[12][0-9]{3}\b|©|all rights reserved)[^\n]*$"
NOT_WORD = r"[^\p{L}\p{N}]+"


def _any_in(text: Column, *passages: str) -> Column:
    found = F.lit(False)
    for passage in passages:
        found = found | F.contains(text, F.lit(passage))
    return found


def canonical(lower: Column) -> Column:
    """Of a text in lower case: without copyright lines and punctuation, one spelling, single spaces."""
    stated = _any_in(lower, "copyright", "(c)", "©", "all rights reserved")
    plain = F.when(stated, F.regexp_replace(lower, COPYRIGHT_LINE, "")).otherwise(lower)
    plain = F.concat(F.lit(" "), F.regexp_replace(plain, NOT_WORD, " "), F.lit(" "))
    for said, meant in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {said} "), F.lit(f" {meant} "))
    return F.trim(plain)


def canonical_text(text: str) -> str:
    """What canonical() gives for a known text, made on the driver."""
    plain = " " + re.sub(r"[\W_]+", " ", re.sub(COPYRIGHT_LINE, "", text.translate(str.maketrans(UPPER, LOWER)))) + " "
    for said, meant in SPELLINGS:
        plain = plain.replace(f" {said} ", f" {meant} ")
    return plain.strip(" ")


def digest_of(text: str) -> str:
    """The digest of a text's canonical form."""
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


@cache
def known_digests() -> tuple[tuple[str, str], ...]:
    """(digest, licence) of all texts, longer texts and notices, and of paragraphs that only one licence has: some thousand rows."""
    whole = {(digest_of(text), licence) for licence, text in (*TEXTS, *known_notices())} | {(digest, licence) for licence, digest in DIGESTS}
    of: dict[str, set[str]] = {}
    for licence, text in TEXTS:
        for paragraph in text.split("\n\n"):
            if any(hint in canonical_text(paragraph) for hint in HINTS) and len(canonical_text(paragraph)) >= LEAST_PARAGRAPH:
                of.setdefault(digest_of(paragraph), set()).add(licence)
    return tuple(sorted(whole | {(digest, *licences) for digest, licences in of.items() if len(licences) == 1}))


#: A line, paragraph or text without one of these is no known text; every known one has one in its canonical form, and so before.
HINTS = ("license", "licence", "permission", "redistribution", "under", "public domain")
#: Paragraphs of known texts that stand for their licence have at least so many code points; shorter ones are titles.
LEAST_PARAGRAPH = 100
#: Between paragraphs: lines without a letter or digit, which may have marks of a comment.
PARAGRAPH_END = r"\n(?:[^\p{L}\p{N}\n]*\n)+"


def _paragraphs(text: Column) -> Column:
    """Paragraphs of more than one line; those of one are found as lines."""
    cut = F.transform(F.split(text, PARAGRAPH_END, -1), lambda x: F.regexp_replace(x, r"^\n+|\n+\z", ""))
    return F.filter(cut, lambda x: F.contains(x, F.lit("\n")))


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """id_col, digest (of the whole canonical text), license (if the whole text is a known one), notices, n_notices.

    Texts join the digests of the fixed list by hash; so do their lines and their paragraphs of several lines, which
    finds notices inside other documents: notices are the different licences of such passages, in order, between commas,
    n_notices the passages. Only rows with a word that all known texts share have their passages looked up; the passages
    found are summed by row in map tasks, and nothing but ids and digests shuffles.

    known: more digests (digest string, license string) as of digest_of(); Spark chooses how to join those by their size.
    The fixed list alone is broadcast: its length is fixed in this module.

    - Null text counts as empty; the empty text is no licence. Repeated rows get equal rows; null ids are kept.
    - No rows give no rows; other columns are ignored, whatever their names. Texts and lines of any length are scanned whole.
    """
    spark = docs.sparkSession
    names = F.broadcast(spark.createDataFrame(known_digests(), "_known string, license string"))
    if known is not None:
        names = names.unionByName(known.select(F.col("digest").alias("_known"), "license")).distinct()
    likely = lambda text: _any_in(text, *HINTS)
    digest = lambda text: F.sha2(canonical(text).cast("binary"), 256)
    lower = docs.select(F.col(id_col).alias("id"), ascii_lower(F.col(text_col)).alias("text"))
    units = F.transform(F.filter(F.concat(F.split("text", "\n", -1), _paragraphs(F.col("text"))), likely), digest)
    none = F.array().cast("array<string>")
    # Texts are read once; all that follows is on ids and digests.
    rows = lower.select("id", digest(F.col("text")).alias("digest"), F.when(likely(F.col("text")), units).otherwise(none).alias("units"))
    rows = write_table(rows.withColumn("rid", F.monotonically_increasing_id()), "licence-digests")
    passages = rows.where(F.size("units") > 0).select("rid", "id", "digest", F.explode("units").alias("_unit")).join(names.withColumnRenamed("license", "notice"), F.col("_unit") == F.col("_known"), "left")
    by_row = passages.groupBy("rid").agg(F.first("id").alias("id"), F.first("digest").alias("digest"), F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"), F.count("notice").alias("n_notices"))
    rest = rows.where(F.size("units") == 0).select("id", "digest", F.lit("").alias("notices"), F.lit(0).cast("long").alias("n_notices"))
    every = by_row.select("id", "digest", "notices", "n_notices").unionByName(rest)
    return every.join(names, F.col("digest") == F.col("_known"), "left").select(F.col("id").alias(id_col), "digest", "license", "notices", "n_notices")


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    lower = f"regexp_replace(translate({{0}}, '{UPPER}', '{LOWER}'), '{COPYRIGHT_LINE}', '', 'g')"
    canon = f"(' ' || regexp_replace({lower}, '{NOT_WORD}', ' ', 'g') || ' ')"
    for said, meant in SPELLINGS:
        canon = f"replace({canon}, ' {said} ', ' {meant} ')"
    canon = f"sha256(trim({canon}))"
    values = ", ".join(f"('{digest}', '{licence}')" for digest, licence in known_digests())
    return f"""
        WITH known(known_digest, license) AS (VALUES {values}),
        docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
        passages AS (
          SELECT rid, unnest(string_split(text, chr(10))) AS passage FROM docs
          UNION ALL
          SELECT rid, passage FROM (SELECT rid, regexp_replace(unnest(string_split_regex(text, '{PARAGRAPH_END}')), '^\\n+|\\n+\\z', '', 'g') AS passage FROM docs)
          WHERE contains(passage, chr(10))),
        found AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n_notices
                  FROM passages JOIN known ON {canon.replace('{0}', 'passage')} = known_digest GROUP BY rid)
        SELECT d.doc_id, d.digest, known.license, coalesce(notices, '') AS notices, coalesce(n_notices, 0) AS n_notices
        FROM (SELECT doc_id, rid, {canon.replace('{0}', 'text')} AS digest FROM docs) d
        LEFT JOIN known ON d.digest = known_digest LEFT JOIN found ON d.rid = found.rid"""


QUERIES = {"op9_licence_scan": op9_licence_scan}
SQL = {"op9_licence_scan": _sql()}
