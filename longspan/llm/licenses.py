"""Licence scan by canonical digest lookup.

A text is brought to a canonical form (case, copyright lines, equivalent spellings, punctuation and white space
as in the public SPDX matching guidelines), digested, and hash-joined to the digests of known licence texts.
Three kinds of entire text are looked up: the whole document, each of its paragraphs of several lines, and each of its
lines, as a notice such as "Released under the MIT License." is itself a known text.  The table of known digests is part
of the code (``MOST`` at most) and broadcast, so no line is shuffled; a caller's own table goes through
``known_digests`` as well or is joined as Catalyst sees fit.

Defined results: null texts, and texts, paragraphs and lines of which nothing is left, match nothing; repeated rows are
reported each under their id (summed if ids repeat); an empty table gives an empty one; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spelling rules applied in order, as regular expressions that Java and RE2 read alike.
SPELLINGS = (
    ("licence", "license"),
    ("sub-?licens", "sublicens"),
    ("non-?infring", "noninfring"),
    ("non-?commercial", "noncommercial"),
    ("(organ|author|real|recogn|util)is(e|ing|ation)", "$1iz$2"),
    ("https?", "http"),
    ("&", " and "),
    ("(version |v\\.? ?)([0-9])", "version $2"),
)
COPYRIGHT = "(?m)^[^\\n]*(copyright[ \\t]*(\\(c\\)|©|[0-9]{4})|©)[^\\n]*$"

#: Canonical digests of whole licence texts: with and without title lines, and where a text has an end of its terms, also
#: up to there; BSD-3-Clause with numbers or marks and with or without "All rights reserved".
WHOLE_TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT", "04ddd61083899c2a5ef03d9fe09b79c9"),
    ("MIT", "90a17991c3ba7b04d183a6467fbe3449"),
    ("ISC", "63179b48dd80764d198b18b1a4a65df0"),
    ("ISC", "b6ab23f33a368e7f225abed7065c8009"),
    ("Apache-2.0", "3f75cdec37a8a9cf2daa486022386970"),  # the notice for files
    ("Apache-2.0", "1c74907a26c353bf5f44011124266a59"),
    ("Apache-2.0", "3f3ecd7d2d9563fea353671599b4c3b4"),
    ("Apache-2.0", "552ad1d664aed2cf768fe58d1237bf47"),
    ("Apache-2.0", "5d2795cb35f13d3f170c4a82e7d9f97f"),
    ("Apache-2.0", "907c90224903199ffe6fc357841e86c5"),
    ("Apache-2.0", "a4f874aaeee4dfe824fb3cc3dcca2009"),
    ("Apache-2.0", "dcc9230fdd69e3e1c95655dd57b3ce49"),
    ("Apache-2.0", "f273dc6b076b6eb634de0839015dbc00"),
    ("Apache-2.0", "f6bdc8dada1b111c6539ba36e7da94f4"),
    ("BSD-3-Clause", "0b730fab1fdb87df8c6c7ab209156fe1"),
    ("BSD-3-Clause", "1211c5b42a270fc1dbec29f8c6288807"),
    ("BSD-3-Clause", "22d101e755b8a71e8a1110668d841dd5"),
    ("BSD-3-Clause", "607dfcf19e7b38858ad7b50b281db4ed"),
    ("BSD-3-Clause", "6989781d8e3e31bf06f590dd203d4e65"),
    ("BSD-3-Clause", "893a4b53d0cd5c2bab12e6bf21862bb0"),
    ("BSD-3-Clause", "c245a9d439da9a8ea626ab19c280d998"),
    ("BSD-3-Clause", "d4cef4d9ad8054ea8d2cc83477a6f637"),
    ("BSD-3-Clause", "d7b8e7252a7f0eaa91d55f59b816a38a"),
    ("BSD-3-Clause", "dbcc6b46cd5b3ad519ba6d13a4021fcd"),
    ("BSD-3-Clause", "ddcd765ed0a3236bf96e15f76c36983a"),
    ("BSD-3-Clause", "dfd9463b7bcad50bb1270be3d6bf0c2a"),
    ("BSD-3-Clause", "e28eb0a989f3d0d112480a3905886d91"),
    ("BSD-3-Clause", "e34ea76315523716d2b9af28ecb2f304"),
    ("BSD-3-Clause", "e82046f0b7f72505ecac75064a0d3ab0"),
    ("BSD-3-Clause", "eee209a92d0e588427ff375080449984"),
    ("BSD-3-Clause", "f20a3679d40c0ef02d2cb7563217bd78"),
    ("BSD-3-Clause", "fda5d0035067d21f2e6c85bfc3567343"),
    ("CC0-1.0", "93a180096f6cfcf2c0dd24f75c2eec48"),
    ("CC0-1.0", "c1dba131d6e3e7e601c073645a508fc9"),
    ("CC0-1.0", "fa8a03d1b9df2c6dbd261e2159fa72bd"),
    ("GFDL-1.2", "7a0a547ecac612b526676be523eacf80"),
    ("GFDL-1.2", "8c1043bdc34de8f068d072c8a434510c"),
    ("GFDL-1.2", "abc0f949f6a0be22990ee5efd22e5d3d"),
    ("GFDL-1.3", "1cedde6c4073f7610c0a5ffd1d0bedc3"),
    ("GFDL-1.3", "7132e8380bc59358f27c3129a2136bf1"),
    ("GFDL-1.3", "de5bc065dcd1809500333796d547b19c"),
    ("GPL-1.0", "03f8ed04f66c4aa38c0d9b1f71f5a05e"),
    ("GPL-1.0", "21fa8693acc5194a648fe02e11f65a72"),
    ("GPL-1.0", "3cae58c564bd007093c44926b42897fb"),
    ("GPL-1.0", "41970afcbf855774d9df3fcc1aa6507d"),
    ("GPL-1.0", "43b270b91b142a4f1c724e6ce5e885bd"),
    ("GPL-1.0", "7de27fb242d6b203bbc14bba976a1241"),
    ("GPL-1.0", "b09bbea84322fdbb5a9b29e82e106de5"),
    ("GPL-1.0", "dbf3c47f5a8f127e58d08cabc1ebb916"),
    ("GPL-1.0", "ddcb0a395eb768f37a6e17a44139f4a9"),
    ("GPL-2.0", "21bda761651fab59a5fd5cf523638f38"),
    ("GPL-2.0", "513bc60d9cca85efe97e78048af51966"),
    ("GPL-2.0", "57dae875e4e0088751ba2baf1d276391"),
    ("GPL-2.0", "664b50109aaebd35881a60272e669c25"),
    ("GPL-2.0", "68380dbeadb093b94ecf563db7312db7"),
    ("GPL-2.0", "72d9c01a117462b3209741d025a411d5"),
    ("GPL-2.0", "a0d591c271f136c7e491f1b109e659d6"),
    ("GPL-2.0", "adda57d0f6698f9d83368a4ab0dda083"),
    ("GPL-2.0", "f2c06efe640b4a281cbe5337cdde80ab"),
    ("GPL-3.0", "092e6dfdaafde496343542ad81bf1681"),
    ("GPL-3.0", "17e434cc6db7003444b088cb4cc81e91"),
    ("GPL-3.0", "227b78e0798b681fac26c55fb09c43fe"),
    ("GPL-3.0", "2a4180c7870bff8b7857263a1c8b056b"),
    ("GPL-3.0", "444f95dc767ede978b60cfb20fbd0bca"),
    ("GPL-3.0", "4f16e3a448ec920ed5b538ea25d8a893"),
    ("GPL-3.0", "7ef16bd808a93bb7eeae3ad376f92bf2"),
    ("GPL-3.0", "97ed56e5c55a6d427bdbf2e5ad0d5800"),
    ("GPL-3.0", "b585be0cf2ff3e9362303bb637995e26"),
    ("LGPL-2.0", "6c4299486b1aa80b8198a9d060cf4b5d"),
    ("LGPL-2.0", "74cf7fcef3b29a39165a795b2cad3a3a"),
    ("LGPL-2.0", "7635abe16d4f0e5d50aa8f53dc87c1dc"),
    ("LGPL-2.0", "925cd3f297b753e67d0ad55a14018ca9"),
    ("LGPL-2.0", "97832943be1e344d51af5aee1b658e4f"),
    ("LGPL-2.0", "9bd9bd9f3e7b37551b243b4f26b948e4"),
    ("LGPL-2.0", "9e11fca3c297d25d4af63987125a7fd0"),
    ("LGPL-2.0", "a34861e6f66450057d08c3192f8b454b"),
    ("LGPL-2.0", "c396ba2f94537628797123bc12cd2d6e"),
    ("LGPL-2.1", "3054b3781b1af43f906dc753acad15ee"),
    ("LGPL-2.1", "469b325e1e3630601f3dd2ef6d91cd19"),
    ("LGPL-2.1", "70b7d21f82b978135d65cf7a86d46b6a"),
    ("LGPL-2.1", "71c2726d9e90169b7d92bcc09c90b8ca"),
    ("LGPL-2.1", "831e292c78b816e1a9fdba07c006b1b4"),
    ("LGPL-2.1", "90b400ecd8efecbf2e1465fe240ea32c"),
    ("LGPL-2.1", "9c45cf1b455f75a34b2035910ad1dc79"),
    ("LGPL-2.1", "eaf6afb73fc860a002bfbccbe6f07ce7"),
    ("LGPL-2.1", "f998bc436710cfece156aaa84fd26dd4"),
    ("LGPL-3.0", "1b8dd7a9c66d7a25c54515f3aa622e66"),
    ("LGPL-3.0", "33fad1678ccee0a0d16f8788ad08749e"),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d"),
    ("MPL-1.1", "ae7ac7367303b00b6311a6d27b1dcdab"),
    ("MPL-1.1", "f99cb85033bd28131d7b479baa61ff17"),
    ("MPL-2.0", "2ee3d33d7b7a737160c99e039ff828b3"),
    ("MPL-2.0", "8ec28632a0d54334f947e2c3422240d2"),
)

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE'
_DEALINGS = "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_MIT = f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

{_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, {_DEALINGS}"""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_FEE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NO_FEE = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_ISC = f"{_FEE}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_NO_FEE}"
_UNLICENSE = f"""This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

{_AS_IS} AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, {_DEALINGS}"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_BSL = f"""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

{_AS_IS}, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, {_DEALINGS}"""


def _forms(body: str, *titles: str) -> list[str]:
    """A text as it is printed: alone, under its titles, with the line that often follows the copyright line, with or without item numbers."""
    bare = body.replace("\n1. ", "\n").replace("\n2. ", "\n").replace("\n3. ", "\n")
    bodies = list(dict.fromkeys((body, bare)))
    heads = ["", *(f"{x}\n\n" for x in titles)]
    return [head + more + x for x in bodies for head in heads for more in ("", "All rights reserved.\n\n")]


#: Full texts of short licences, in the forms in which they are printed.
TEXTS: tuple[tuple[str, str], ...] = tuple(
    (name, form)
    for name, body, titles in (
        ("MIT", _MIT, ("MIT License", "The MIT License", "The MIT License (MIT)")),
        ("BSD-2-Clause", _BSD2, ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "The BSD 2-Clause License")),
        ("BSD-2-Clause", _BSD2.replace("COPYRIGHT HOLDER OR", "COPYRIGHT OWNER OR"), ("BSD 2-Clause License",)),
        ("ISC", _ISC, ("ISC License", "The ISC License", "ISC License (ISC)")),
        ("0BSD", f"{_FEE}.\n\n{_NO_FEE}", ("BSD Zero Clause License", "Zero-Clause BSD")),
        ("Unlicense", _UNLICENSE, ("The Unlicense",)),
        ("Unlicense", _UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org>", ("The Unlicense",)),
        ("Zlib", _ZLIB, ("zlib License", "The zlib License", "zlib/libpng license")),
        ("BSL-1.0", _BSL, ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License - Version 1.0")),
    )
    for form in _forms(body, *titles)
)

_FREE = "This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation{2} either version {3} of the License, or (at your option) any later version."

#: Notices, kept as they read: single lines, and headers that are printed as a paragraph.
KNOWN: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", _FREE.format(";", "", ";", "2")),
    ("GPL-3.0", _FREE.format(":", "", ",", "3")),
    ("AGPL-3.0", _FREE.format(":", "Affero ", ",", "3")),
    ("LGPL-2.1", _FREE.format(";", "Lesser ", ";", "2.1").replace("program", "library")),
    ("LGPL-3.0", _FREE.format(":", "Lesser ", ",", "3").replace("program", "library")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)

MOST = 100_000  # digests that are broadcast, at most (10 MB)


def canonical(text: Column) -> Column:
    """Canonical lines of a text: lower case, one blank between words, copyright lines empty."""
    out = F.regexp_replace(F.lower(text), COPYRIGHT, "")
    for old, new in SPELLINGS:
        out = F.regexp_replace(out, old, new)
    return F.regexp_replace(out, "[^\\p{L}\\p{N}\\n]+", " ")


def _flat(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \\n]+", " "))


def known_digests(
    spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN + TEXTS, whole: tuple[tuple[str, str], ...] = WHOLE_TEXTS
) -> DataFrame:
    """``license_id, digest``, one row a digest, of texts and of digests already made; marked for broadcast, so bounded."""
    if len(known) + len(whole) > MOST:
        raise ValueError(f"more than {MOST} texts are not broadcast: join their digests yourself")
    texts = spark.createDataFrame(list(known), "license_id string, text string")
    made = texts.select("license_id", F.md5(_flat(canonical(F.col("text")))).alias("digest"))
    if whole:
        made = made.unionAll(spark.createDataFrame(list(whole), "license_id string, digest string"))
    return F.broadcast(made.groupBy("digest").agg(F.min("license_id").alias("license_id")))


SEVERAL_LINES = "[^ \\n] *\\n[ \\n]*[^ \\n]"


def scan(docs: DataFrame, digests: DataFrame) -> DataFrame:
    """``doc_id, license_id, whole_text, n_paragraphs, n_lines`` of every document that holds or is a known text."""
    lines = docs.where("text IS NOT NULL").select("doc_id", canonical(F.col("text")).alias("lines"))
    unit = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    paragraphs = F.filter(F.split("lines", "\n *\n", -1), lambda x: F.regexp_like(x, F.lit(SEVERAL_LINES)))
    units = F.concat(
        F.array(unit("whole", _flat(F.col("lines")))),
        F.transform(paragraphs, lambda x: unit("paragraph", _flat(x))),
        F.transform(F.filter(F.split("lines", "\n", -1), lambda x: F.trim(x) != ""), lambda x: unit("line", F.trim(x))),
    )
    rows = lines.select("doc_id", F.explode(units).alias("unit")).where("unit.text <> ''")
    found = rows.select("doc_id", "unit.kind", F.md5("unit.text").alias("digest")).join(digests, "digest")
    return found.groupBy("doc_id", "license_id").agg(
        F.max(F.col("kind") == "whole").alias("whole_text"),
        F.count_if(F.col("kind") == "paragraph").alias("n_paragraphs"),
        F.count_if(F.col("kind") == "line").alias("n_lines"),
    )


def printed_forms(text: str) -> list[str]:
    """The forms in which a long licence's digests are kept: whole, without its first line, and up to the end of its terms."""
    ends = ["END OF TERMS AND CONDITIONS", "HOW TO USE THIS LICENSE", "ADDENDUM: How to use"]
    cut = [text.split(x)[0] for x in ends if x in text]
    return list(dict.fromkeys(y for x in (text, *cut) for y in (x, x.lstrip().split("\n", 1)[-1])))


def make_digests(spark: SparkSession, texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(id, digest) of full texts, as ``WHOLE_TEXTS`` keeps them, for extending that table from printed copies."""
    rows = [(i, form) for i, text in texts for form in printed_forms(text)]
    made = spark.createDataFrame(rows, "license_id string, text string").select("license_id", F.md5(_flat(canonical(F.col("text")))).alias("digest"))
    return sorted({(r["license_id"], r["digest"]) for r in made.collect()})
