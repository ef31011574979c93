"""Operator 6: licence scan by canonical digests.

Whole texts, and the lines of texts, are brought to one canonical form (case,
punctuation, copyright lines, equivalent spellings), and the SHA-256 of that form is
hash-joined to the digests of known licence texts and notices.  The known table is a
constant of this module, so its broadcast has a fixed size.  Everything is a column
expression; only units whose canonical length some known text has are digested.
Short texts are known by their words, long ones by digests (``WHOLE``).

Defined results: one row per matching unit (``unit`` is "text" or "line", ``line_no``
counts from 0 and is -1 for a whole text); null and empty texts match nothing;
repeated rows match once each; a very long text is canonised whole, in linear time; a null ``doc_id`` is reported as null; an empty table
gives an empty table; other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm.shared import let

#: (pattern, replacement), in order; the same in Java, RE2 and Python.
STEPS = (
    (r"\r\n?", "\n"),
    # Words of a licence's own text, which a wrap may put at the start of a line; what else begins so is a notice.
    (r"copyright (holder|owner|notice|law|licen|interest|statement|protection|right|treat|disclaimer|status|permission|the software|the library|and|or|in|is|to|on|of|for|as|but|with|under|that|which|resulting|conditions|permissions|list)", "copyrighted $1"),
    (r"(^|\n)[^a-z0-9\n]*((portions|parts) )?(copyright\b|\(c\)|©)[^\n]*", "\n"),
    (r"copyrighted", "copyright"),
    (r"all rights reserved\.?", " "),
    (r"https://", "http://"),
    (r"sub-licen[cs]e", "sublicense"),
    (r"licenc", "licens"),
    (r"non-infringement", "noninfringement"),
    (r"merchantibility", "merchantability"),
    (r"favour", "favor"),
    (r"(organi|authori|recogni)s(e|ation)", "$1z$2"),
    (r"wilful", "willful"),
    (r"copyright owner", "copyright holder"),
    (r"&", " and "),
    (r"version |\bv\.? ?([0-9])", "v$1"),
    (r"[^a-z0-9\n]+", " "),
    (r" *\n *", "\n"),
)

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""

BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

"""

BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

"""

BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: (licence, form, text): known whole texts and one-line notices.
KNOWN = (
    ("MIT", "text", MIT),
    ("MIT", "text", "MIT License\n\n" + MIT),
    ("MIT", "text", "The MIT License (MIT)\n\n" + MIT),
    ("ISC", "text", ISC),
    ("ISC", "text", "ISC License\n\n" + ISC),
    ("0BSD", "text", ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("Unlicense", "text", UNLICENSE),
    ("BSD-2-Clause", "text", BSD_HEAD + BSD_TAIL),
    ("BSD-2-Clause", "text", "BSD 2-Clause License\n\n" + BSD_HEAD + BSD_TAIL),
    ("BSD-3-Clause", "text", BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("BSD-3-Clause", "text", "BSD 3-Clause License\n\n" + BSD_HEAD + BSD_THIRD + BSD_TAIL),
    ("Apache-2.0", "notice", APACHE_NOTICE),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "notice", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "notice", "Licensed under the MIT License."),
    ("MIT", "notice", "Released under the MIT License."),
    ("MIT", "notice", "SPDX-License-Identifier: MIT"),
    ("GPL-2.0", "notice", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "notice", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-3.0", "notice", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "notice", "Licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "notice", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "notice", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "notice", "SPDX-License-Identifier: MPL-2.0"),
    ("CC0-1.0", "notice", "Released under CC0 1.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "notice", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "notice", "Licensed under CC BY-NC-ND 4.0."),
)


#: Fixed values: (licence, SHA-256, length) of the canonical forms of long licences, from the texts that Debian installs
#: under /usr/share/common-licenses: whole, and up to the end of their terms.
WHOLE = (
    ("Apache-2.0", "71e89069712ecf600e16cfa2566d7990b052fe00666513dbdca1c6eeeacf14b5", 9804),
    ("Apache-2.0", "d3d877c55b6e844ab202f0d15ce36326fecce6794172323ef6b9ddfd7d9c0390", 8767),
    ("Apache-2.0", "881c60547fc1c5d0e865a3e1b248f2ee7a92908941cc19e081aad292b6cbb561", 8795),
    ("Artistic-1.0-Perl", "16165f3791f0d7e4e37b0ab884a75d7d62124b100814c66dda4b54a47e1dfa22", 5798),
    ("CC0-1.0", "efa01e1f98bc5d90ca373f597e31e8f26b9c2e392a701828ae8cab513d864640", 6685),
    ("GFDL-1.2", "733216fc1bea83d841dd059046543d4e8a08e8fca8a8c0d2c1ac34073a644a56", 19415),
    ("GFDL-1.3", "a06dd8c86872864ed83fb5d057ce56945ca1e8acc250e351116d8cc1fd8e3faf", 21836),
    ("GPL-1.0", "18ae0034076a8eb8f2a7a8f884ccf767dd4d14b83236c1f9f56b9c67ffac16d5", 11630),
    ("GPL-1.0", "8957a3252dc04044ede2d835e70e6167398ab1a3b12d1aeff4518f3fcc36fc23", 9329),
    ("GPL-1.0", "d7df4a0ec9eb24dcfacdfd1deaf0b504377f568846ff772e7eab7da231844134", 9357),
    ("GPL-2.0", "7da4d03495123b349da7f6bdbc04f7423ee346a0ec77a4a753e583fdb29de3f6", 17043),
    ("GPL-2.0", "bb51e22280e3a54b4fe90045d496c7e2ad24d75179079442d1e8b48cf5a01ac3", 14395),
    ("GPL-2.0", "4491fe239c59dd2b2eda8210df6f01df60921c2a713848e9d21a5213ff86cde1", 14423),
    ("GPL-3.0", "9f01c8fc9739f3ab351adbd847a7a88d80a727c1da7f95b9b80b9931e2be9216", 33229),
    ("GPL-3.0", "7bc430237f799992270e3acc37f6831e9879841c768749190a6e2ffc4b7cefab", 30770),
    ("GPL-3.0", "5835652090262df04a3283e06998275c612c8eeff258ec73c6fc8664c1287ac7", 30798),
    ("LGPL-2.0", "b99609d15037df8901c9f4c65a00eb344718584467e7d1fe0ab7fe4486f800b8", 23958),
    ("LGPL-2.0", "ccfbe70f158dffa287cb834ec211ea8f8ac88a6d94aa34b3a222cc6d7849f596", 22147),
    ("LGPL-2.0", "31854cd0160da314234227e355b20fad51273bc21c4635debcf99025a945de7f", 22175),
    ("LGPL-2.1", "ff9a53ba598bbf5d4668e7840a85b63c4d33d82782ad51ccf9f69bcec085b7b4", 25003),
    ("LGPL-2.1", "d942294f3f7850a53dbe31c8440341bc08f1e9d18ddff071c52511c8cc3243de", 23193),
    ("LGPL-2.1", "587e3aa87940907d02e276b77f4fa4148958b737ba260d865c93210ab8f11789", 23221),
    ("LGPL-3.0", "5c596d73ce671bf605bbdee26813192c5526af7efd4a060975bec2c6970dcf0f", 6985),
    ("MPL-1.1", "7105bc8ac780a232cc3e236f60f493db1812b20f63c1042e12eab70cb2d7711b", 22111),
    ("MPL-2.0", "32ec17b145fbf008a4c7a63ca180f600cdbea37527fdbcf2aa818c7e1354810d", 14193),
)


def canonical(text: str | None) -> str:
    """Canonical form of one text, lines kept; the Python twin of ``canonical_lines``."""
    text = (text or "").lower()
    for pattern, put in STEPS:
        text = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", put), text)
    return text


def whole(lines: str) -> str:
    return " ".join(lines.split())


def variants(text: str) -> list[str]:
    """A long licence as it is passed on: whole, or up to the end of its terms, with or without that line."""
    out = [text]
    mark = re.search(r"\n[^\n]*END OF TERMS AND CONDITIONS[^\n]*\n", text)
    if mark:
        out += [text[: mark.start()], text[: mark.end()]]
    return out


def digest_table() -> list[tuple[str, str, int]]:
    """(digest, licence, canonical length) of every known text."""
    rows = {digest: (licence, n) for licence, digest, n in WHOLE}
    for licence, _, text in KNOWN:
        form = whole(canonical(text))
        rows[hashlib.sha256(form.encode()).hexdigest()] = (licence, len(form))
    return [(d, *v) for d, v in rows.items()]


def canonical_lines(text: Column) -> Column:
    out = F.lower(text)
    for pattern, put in STEPS:
        out = F.regexp_replace(out, pattern, put)
    return out


def scan(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, unit, line_no, license_id) of every unit that is a known licence or notice."""
    known = digest_table()
    lengths = sorted({n for *_, n in known})

    def units(c: Column) -> Column:
        one = F.struct(F.lit("text").alias("unit"), F.lit(-1).alias("line_no"), F.trim(F.regexp_replace(c, r"\s+", " ")).alias("form"))
        lines = F.transform(
            F.split(c, "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("line_no"), F.trim(x).alias("form"))
        )
        return F.filter(F.concat(F.array(one), lines), lambda u: F.length(u["form"]).isin(lengths))

    found = docs.select("doc_id", F.explode(let(canonical_lines(F.col(f"`{text}`")), units)).alias("u"))
    found = found.select("doc_id", "u.unit", "u.line_no", F.sha2("u.form", 256).alias("digest"))
    table = spark.createDataFrame([(d, licence) for d, licence, _ in known], "digest string, license_id string")
    return found.join(F.broadcast(table), "digest").select("doc_id", "unit", "line_no", "license_id")


def oracle() -> str:
    """The same scan in DuckDB SQL."""
    form = "lower(text)"
    quote = lambda s: s.replace("'", "''")
    for pattern, put in STEPS:
        put = re.sub(r"\$(\d)", r"\\\1", put)
        nl = lambda s: "'" + quote(s).replace("\n", "' || chr(10) || '") + "'"
        form = f"regexp_replace({form}, '{quote(pattern)}', {nl(put)}, 'g')"
    values = ", ".join(f"('{d}', '{licence}')" for d, licence, _ in digest_table())
    return f"""
WITH known(digest, license_id) AS (VALUES {values}),
canon AS (SELECT row_number() OVER () AS r, doc_id, {form} AS c FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(c, chr(10))) AS x, generate_subscripts(string_split(c, chr(10)), 1) - 1 AS line_no FROM canon),
units AS (
  SELECT doc_id, 'text' AS unit, -1 AS line_no, trim(regexp_replace(c, '\\s+', ' ', 'g')) AS form FROM canon
  UNION ALL SELECT doc_id, 'line', CAST(line_no AS INTEGER), trim(x) FROM lines)
SELECT doc_id, unit, CAST(line_no AS INTEGER) AS line_no, license_id FROM units JOIN known ON sha256(form) = digest"""
