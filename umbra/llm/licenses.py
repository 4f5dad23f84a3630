"""License scans by canonical digest lookup, with DataFrame functions only.

A text's canonical form is lower case, without a title line ("MIT License") and without
copyright lines, with one of several equivalent spellings, and with each run of anything
but letters and digits turned into one space. The SHA-256 of that form is joined to the
digests of known licences, so a licence is found whatever its wrapping, case, punctuation,
title or holder. Whole texts are compared; besides, each line that speaks of a licence is
looked up as a text of its own (``line_license_ids``: distinct, in order of name,
comma-joined). The catalogue has a fixed number of rows and is the broadcast side. If two
licences have one canonical form, the name that sorts first stands for it.

Long licences are known by the digest of their canonical form alone (``DIGESTS``);
``digests`` makes such entries from texts.

Null text counts as empty; an empty canonical form matches nothing. Every row gives one
row; repeated rows and null ids are allowed, an empty table gives an empty result, and
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole licence texts and one-line notices, by SPDX name.
KNOWN: list[tuple[str, str]] = [
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License").'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0-or-later", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]
#: Canonical SHA-256 of licences too long to be kept here, by SPDX name. Fixed values.
DIGESTS: list[tuple[str, str]] = [
    ("Apache-2.0", "50f878d4c0ebc23dbd62e3b493e6184d74000058a3edd67f8811ed51ddbb9c1d"),
    ("Apache-2.0", "daedac2c1452112ebf33589d4e4f5f0de249ef37590668bb63739a5e5912a7ed"),
    ("Apache-2.0", "df8b90f2f37b1aae8f7a7c1d5873fb80d8ecf13321fed983a1901812b80f7247"),
    ("Artistic-1.0-Perl", "4eaaa9e33aeef0af0ff83ab5edac0ad421a1da9cc861c564630460107b4b772c"),
    ("BSD-3-Clause", "8c59f95fd84d1bee2ce36de4f41efd609fe243ce3e4b60da7abffdae981b8963"),
    ("CC0-1.0", "5ae3f76dda2e69e50143522ea539402a0b5e33eb1a4ba0497fc88f282d5c0d33"),
    ("GFDL-1.2", "b8fc1476fcb02a8c859046708b4843944af8ef9ae2f634b9f46b5a633388f9f3"),
    ("GFDL-1.3", "e907f46bdc7f3e8e6160d770fd1642b01fb33d2f98ef7b09c8988fbe26f79fae"),
    ("GPL-1.0", "a5d3ac1692766ac88e19f426e9bffdd192a9460b9e1346ca9e966b4c65902193"),
    ("GPL-1.0", "dfad1cf97b2c037fa83eaae9980475bb1656797eb88939a0c8eb78786437a571"),
    ("GPL-1.0", "e7c976720a871faa16da302d8fa082a5d8dbfa80301e54141a53f286e944b6e7"),
    ("GPL-2.0", "78be77d7a09cc7ff1790471142b6f0a733e17f839edc0bbfcd9048967dc09a80"),
    ("GPL-2.0", "b5d1342d304faa7b005b6e79428476b333f307c3022dcd59fa7f42365dab9dbb"),
    ("GPL-2.0", "bf9bbae39c7c2667ce7bcb4a7801b1d891fe5874028f333053b2805b488b7ef6"),
    ("GPL-3.0", "7970297614874a292b1f476599551d251bc558e6a8a8748ce48c8cf5c74e8b7c"),
    ("GPL-3.0", "7a9d11925630c973803b0c5b52f3db1fb3a10c25863f3809b3b229d10460eeb8"),
    ("GPL-3.0", "ed7609a9b5f3f6c304541fdcf5d9aa5c87a7d794f6a4a86ea4ac499852689d2f"),
    ("LGPL-2.0", "00eb30c73d091bbdba413403e15516ea1b188a775f77894ce07dd998af37717a"),
    ("LGPL-2.0", "9ab3a7dc9a6a6a54aaec4de5d72c5651fa3cb56a9e46a023354b203fa90d8ffc"),
    ("LGPL-2.0", "f1e1ac93da327e9ac0c72b70a80511e17e5cd72a56207ec17d247b098f45addb"),
    ("LGPL-2.1", "079d3425c6fa1f9a6a09d871c5699197d205f659412266f6a709ba299bd622ed"),
    ("LGPL-2.1", "43484c2fdbc29b992457b950e6e689476b1677c12ce5b3d2cab025ec5962f5db"),
    ("LGPL-2.1", "9d01149b49e7aaf5fe0f4ba65a72891be104037d8a703a0ca4ddcff17e7df9f2"),
    ("LGPL-3.0", "e1c7b25e9116bcad127297bbfb82e6a89822822ba6bfa3af9eae995aad877765"),
    ("MPL-1.1", "cbfc00b9f88d8b5c99c2b680632d93a36e40c29744dea389252791b72d254d66"),
    ("MPL-2.0", "e07dcdcc3b2c19db7e604dfb1498cc5dafa0e9cecf6ffc44f7c2b093fe9bafc2"),
]
TITLE = r"\A\s*[^\n]{0,60}licen[sc]e\b[^\n]{0,20}\n"
SENTENCE = r"copyright([ \t]+(?:notice|holder|owner|law|licen|interest|statement|and\b|or\b|in\b|to\b|on\b|is\b))"
COPYRIGHT = r"(?m)^[ \t*#/;-]*(?:copyright|\(c\)|©)(?:[ \t:,][^\n]*)?$|^[ \t*#/;-]*all rights reserved[^\n]*$"
SPELLINGS = [("kopyright", "copyright"), ("licenc", "licens"), ("authoris", "authoriz"), ("organis", "organiz"), ("merchantability", "merchantibility"), ("noninfringement", "non infringement"), ("and/or", "and or"), ("&", " and "), ("https://", "http://")]
OTHER = r"[^\p{L}\p{N}]+"
HINT = r"(?i)licen[cs]"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), TITLE, "\n")
    # a wrapped sentence may have "copyright notice" at the start of a line
    out = F.regexp_replace(F.regexp_replace(out, SENTENCE, "kopyright$1"), COPYRIGHT, " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, OTHER, " "))


def digests(texts: DataFrame) -> DataFrame:
    """``texts(license_id, text)`` to license_id and canonical_sha256."""
    return texts.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))


def _rows(spark, pairs: list[tuple[str, str]], names: tuple[str, str]) -> DataFrame:
    row = F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(p, names)]) for p in pairs]))
    return spark.range(1).select(row.alias("k")).select(*[f"k.{n}" for n in names])


def catalogue(spark) -> dict[str, str]:
    """The known digests with their licences: a fixed number of entries."""
    known = digests(_rows(spark, KNOWN, ("license_id", "text"))).unionByName(_rows(spark, DIGESTS, ("license_id", "canonical_sha256")))
    rows = known.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id")).orderBy("canonical_sha256")
    return {r["canonical_sha256"]: r["license_id"] for r in rows.collect()}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None) -> DataFrame:
    """doc_id, canonical_sha256, license_id (or null) and line_license_ids per row."""
    known = catalogue(docs.sparkSession) if known is None else known
    table = _rows(docs.sparkSession, list(known.items()), ("canonical_sha256", "license_id"))
    lines = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    text = F.coalesce(F.col(text_col), F.lit(""))
    hinted = F.when(text.rlike(HINT), F.filter(F.split(text, "\n"), lambda x: x.rlike(HINT)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(canonical(text), 256).alias("canonical_sha256"), hinted.alias("hinted"))
    rows = rows.join(F.broadcast(table), "canonical_sha256", "left")
    found = F.filter(F.transform("hinted", lambda x: F.try_element_at(lines, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    return rows.select("doc_id", "canonical_sha256", "license_id", F.coalesce(F.array_join(F.array_sort(F.array_distinct(found)), ","), F.lit("")).alias("line_license_ids"))


#: The same rules in the spelling of the SQL side follow.
def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower({text}), '^[[:space:]]*[^\\n]{{0,60}}licen(?:s|c)e\\b[^\\n]{{0,20}}\\n', chr(10))"
    out = f"regexp_replace({out}, 'copyright([ \\t]+(?:notice|holder|owner|law|licen|interest|statement|and\\b|or\\b|in\\b|to\\b|on\\b|is\\b))', 'kopyright\\1', 'g')"
    out = f"regexp_replace({out}, '(?m)^[ \\t*#/;-]*(?:(?:copyright|[(]c[)]|©)(?:[ \\t:,][^\\n]*)?|all rights reserved[^\\n]*)$', ' ', 'g')"
    for pair in (("kopyright", "copyright"), ("licenc", "licens"), ("authoris", "authoriz"), ("organis", "organiz"), ("merchantability", "merchantibility"), ("noninfringement", "non infringement"), ("and/or", "and or"), ("&", " and "), ("https://", "http://")):
        out = "replace({}, '{}', '{}')".format(out, *pair)
    return f"trim(regexp_replace({out}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def oracle() -> str:
    quote = lambda x: x.replace("'", "''")
    values = ", ".join(f"('{k}', '{quote(v)}')" for k, v in KNOWN)
    digest_values = ", ".join(f"('{k}', '{v}')" for k, v in DIGESTS)
    return f"""
WITH raw(license_id, text) AS (VALUES {values}),
long(license_id, canonical_sha256) AS (VALUES {digest_values}),
known AS (SELECT canonical_sha256, min(license_id) AS license_id FROM (SELECT license_id, sha256({_sql_canonical('text')}) AS canonical_sha256 FROM raw UNION ALL SELECT * FROM long) GROUP BY 1),
lines AS (SELECT map(list(canonical_sha256), list(license_id)) AS lines FROM known),
docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT d.doc_id, sha256({_sql_canonical('d.text')}) AS canonical_sha256, k.license_id,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(string_split(d.text, chr(10)), lambda x: regexp_matches(x, '(?i)licen[cs]')),
    lambda x: l.lines[sha256({_sql_canonical('x')})]), lambda x: x IS NOT NULL))), ',') AS line_license_ids
FROM docs d CROSS JOIN lines l LEFT JOIN known k ON k.canonical_sha256 = sha256({_sql_canonical('d.text')})"""
