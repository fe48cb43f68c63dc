"""License scans by canonical digest: texts in one canonical spelling are hash-joined, whole, to the digests of known licenses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that follow "copyright" where a license's own sentence begins a line with it: such a line is no copyright notice.
SENTENCE = (
    "holder|owner|notice|licen|law|statement|act |interest|right|grant|disclaim|protect|patent|treat|and |or |in |is |are |to |of |for |that |as |the above|the following|the software|this "
    "|which|claim|with|under|on |management|permission|also|like|doctrine|resulting|control|terms|line|infring|exception|year|work|status|material|author|free|available|because|may |must "
    "|shall |will |can |if |be |not |any |such |its |except|applies|page|information|file|issue|own |has |have |it |covers|held|extends|from |but |by an|by publish|therefore|provision|those |c all rights|all rights"
)
#: Rewritings of a lower-case text, in order: plain strings, or patterns in the syntax that Java's and RE2's share. \1 and so on are groups.
REWRITINGS: tuple[tuple[str, str], ...] = (
    ("©", "(c)"),
    ("&copy;", "(c)"),
    (r"[^\n\pL\pN]+", " "),  # punctuation and white space within lines
    (rf"(^|\n)( ?)copyright(s|ed|)( ?\n| (?:{SENTENCE}))", r"\1\2copy right\3\4"),
    (r"(^|\n) ?(portions |parts |)(copyright |copr |c [0-9][0-9][0-9][0-9])[^\n]*", r"\1"),  # copyright lines
    ("copy right", "copyright"),
    (r"([a-z])is(e|ed|es|ing|ation|ations)( |\n|$)", r"\1iz\2\3"),  # authorise, organisation: on either side of the comparison
    (r"([a-z])our(s|ed|able|ite|)( |\n|$)", r"\1or\2\3"),  # favour, labour
    ("licence", "license"),
    ("offence", "offense"),
    ("defence", "defense"),
    ("https", "http"),
    (r"([a-z])ll(ed|ing)( |\n|$)", r"\1l\2\3"),  # cancelled, labelling
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("analogue", "analog"),
    ("catalogue", "catalog"),
    ("calibre", "caliber"),
    ("centre", "center"),
    ("analys", "analyz"),
    ("artefact", "artifact"),
    ("fulfill", "fulfil"),
    ("willful", "wilful"),
    ("practice", "practize"),
    ("programme", "program"),
    ("whilst", "while"),
    (r" ?\n ?", "\n"),
)
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december"
NAMES = (
    "mit|expat|isc|zlib|zlib libpng|bsd|new bsd|modified bsd|revised bsd|simplified bsd|freebsd|x11|apache|unlicense|boost software|mozilla public|gnu general public|gnu lesser general public"
    "|gnu library general public|gnu affero general public|gnu free documentation|eclipse public|artistic|postgresql|creative commons|cc0 1 0|do what the fuck you want to public"
)
#: Whole lines that a license's text may have above it or not: its name, version and address, and the rights line below a copyright line.
HEADS = (
    rf"(?:(?:the |)(?:{NAMES})(?: [0-9](?: [0-9]|) clause| clear|)(?: new or revised| new| revised| modified| simplified|)(?: license|)(?: mit| isc| expat| bsd [0-9] clause|)(?: universal| legal code|)"
    rf"(?: v| version|)(?: [0-9][0-9 ]*|)(?: (?:{MONTHS}) [0-9]+|)|version [0-9][0-9 ]*(?: (?:{MONTHS})(?: [0-9]+|)|)|http www apache org licenses|spdx license identifier [a-z0-9 ]+"
    rf"|[0-9]+ (?:{MONTHS}) [0-9]+|all rights reserved)"
)
#: All such lines, and blank ones, at a text's start. Java takes the lines by a loop if the repetition is possessive and by recursion if not, and
#: no end of a line leaves a choice to come back to; RE2, which never recurses, has no such repetition.
ABOVE = rf"^(?:[ \n]+|{HEADS} ?(?:\n|$))+"
ABOVE_JAVA = ABOVE + "+"
#: Rewritings of a text without such lines, made one line: spellings of several words, and whoever is named where a template leaves a place for it.
PLACES: tuple[tuple[str, str], ...] = (
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("copyright holder", "copyright owner"),
    (r"neither the names? of [a-z0-9 ]{1,120}? nor the names of", "neither the name of copyright owner nor the names of"),
    (r"is provided by [a-z0-9 ]{1,120}? as is", "is provided by copyright owner as is"),
    (r"in no event shall [a-z0-9 ]{1,120}? be liable", "in no event shall copyright owner be liable"),
)

#: Notices, each a line of its own.
NOTICES: dict[str, str] = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Released under the MIT License.",
    "all-rights-reserved": "All rights reserved.",
}

#: Whole license texts.
LICENSES: dict[str, str] = NOTICES | {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    "mit-0": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "0bsd": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software
to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We
intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright
law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>""",
    "bsl-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to
prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the
following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following
disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies
or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING
THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}

#: SHA-256 of the canonical spelling of long license texts, as their publishers give them; -terms: without what comes after the terms.
DIGESTS: dict[str, str] = {
    "apache-2.0": "d63365e742333148d6a8473b7540586037730cc323c79043d5f5e53bf3edb63c",
    "apache-2.0-terms": "4022c047ce34689996976dbd58abf6a1f8f9aeb326c05eaf6967edadb0dca2ab",
    "artistic-1.0": "cf9142ac7514c462a9f2bbe5ed2f4401d63c5fa1e6a0c5dda1d32cd05a3fdcca",
    "cc0-1.0": "19e01d3fdf9a0d9d23f31def57929b2bf30d1eeeddfdf8e0115de1c03f04f4da",
    "gfdl-1.2": "96f11f71817ba98961ae2b670b003da7e674dc10628c242b1bf8d3c3beeadf7e",
    "gfdl-1.3": "9ffae281f6e904a77efd2488c1a5a323b16de9e9be9950caefea4d1130d72064",
    "gpl-1.0": "ba027f16339ec03745709feafa945abafe488ff957fe76d87c16692cd8435e32",
    "gpl-1.0-terms": "0577a83c0b9710a26ace721ddd5237c4cc1b5c3003d858c5494aecc926d8ebbc",
    "gpl-2.0": "867781f29ae58cb1931b3c2d008e18796c6c89f3fed15c8770d35628b34a9723",
    "gpl-2.0-terms": "9d2ae547f4c82b914568f27b3c0d43e54423debafcb8755f7d8d2f98e5d886ec",
    "gpl-3.0": "3b6e1853529ecb699018a30472bfa4b2e2c7f57ee945df93b9c6040950528b84",
    "gpl-3.0-terms": "681d61c089a6b6d7b92b4f61faed569d2691e4294840780e2f7ddade3148da60",
    "lgpl-2.0": "56239134cabf3af0f4e8ed037b464eebc875d2e7100717f677776698caafd6d0",
    "lgpl-2.0-terms": "9b2fdfdb1f98cc0dfced9a1f5c8d2f841a5bd0bb144f773a0ca90c76d39a7db6",
    "lgpl-2.1": "f9f43d1bfaab697b44c9ed9346e2e3be2044d26b34a3733a65682dfa86decdfe",
    "lgpl-2.1-terms": "6904f493f024883d206a815b9afb0a880bdbf3f03c74abb52c565884d4b47e29",
    "lgpl-3.0": "d33eeaa77eec4b5f2546d3bfe95c21d2d548188ebdcd41595fd1d29894a2bd62",
    "mpl-1.1": "89b2fc853adec5c64ff33d43793e296395ec7886de521bbf6297d72f09afd366",
    "mpl-2.0": "14c0e9f00cb4b76542a9abad52a776f251bf83535da355e1528b74a61e4cfe2b",
}


def canonical(text: Column) -> Column:
    """The canonical spelling, line by line: lower case, single spaces for punctuation, no copyright lines, one of equivalent spellings."""
    return _rewritten(F.lower(text), REWRITINGS)


def _plain(pattern: str) -> bool:
    return not set(pattern) & set(".^$*+?()[]{}|\\")


def _rewritten(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Plain strings are replaced without decoding the text, which is most of a pattern's cost where it is not found."""
    for pattern, to in rules:
        text = F.replace(text, F.lit(pattern), F.lit(to)) if _plain(pattern) else F.regexp_replace(text, pattern, to.replace("\\", "$"))
    return text


def joined(lines: Column) -> Column:
    """A canonical text as one line."""
    return F.trim(F.regexp_replace(lines, r"[ \n]+", " "))


def with_digest(df: DataFrame, lines: str, out: str) -> DataFrame:
    """df with the digest of a canonical text as one line, without what may stand above a license or not; of all of it if nothing else is there."""
    rest = _rewritten(joined(F.regexp_replace(lines, ABOVE_JAVA, "")), PLACES)
    df = df.withColumn("__rest", rest)  # a column of its own, so that it is found once
    return df.withColumn(out, F.sha2(F.when(F.col("__rest") == "", joined(F.col(lines))).otherwise(F.col("__rest")), 256)).drop("__rest")


def scan(
    docs: DataFrame, known: Mapping[str, str] | None = None, notices: Mapping[str, str] | None = None, digests: Mapping[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, digest (SHA-256 of the canonical text), license_id (of the known text that the whole text is) and notices of every row.

    known are texts by name, digests canonical digests by name (by default those of DIGESTS if known is not given either). notices names the
    known notices that are a whole line of the text, in the order of their names, separated by commas; empty if there are none. A null text
    has null in all three; a text without letters and digits has the digest of the empty text and matches nothing. Known texts of one
    canonical spelling answer to the name that sorts first. Rows are kept as they are. What is known is a parameter of the caller, so its
    digests, 100 bytes for each text, are broadcast; texts stay where they are read.
    """
    spark = docs.sparkSession
    digests = digests if digests is not None else DIGESTS if known is None else {}
    known, notices = (LICENSES if known is None else known), (NOTICES if notices is None else notices)
    lists = spark.createDataFrame([*((k, v, False) for k, v in known.items()), *((k, v, True) for k, v in notices.items())], "name string, text string, line boolean")
    spelled = lists.select("name", "line", canonical(F.col("text")).alias("c"))
    rows = with_digest(spelled, "c", "d").withColumn("c", joined(F.col("c"))).filter("c <> ''").collect()  # as many as were passed in
    names_of = [*digests.items(), *((r["name"], r["d"]) for r in rows if not r["line"])]
    by_digest: dict[str, str] = {}
    for name, d in sorted(names_of, reverse=True):
        by_digest[d] = name
    found = spark.createDataFrame(sorted(by_digest.items()), "digest string, license_id string")
    lines: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: r["name"], reverse=True):
        if r["line"]:
            lines[r["c"]] = r["name"]
    base = docs.select(id_col, canonical(F.col(text_col).cast("string")).alias("c"))
    own = F.lit("")
    if lines:
        names = F.create_map(*(F.lit(x) for kv in sorted(lines.items()) for x in kv))
        whole = F.transform(F.split("c", "\n"), lambda x: F.trim(x))
        hits = F.filter(whole, lambda x: x.isin(list(lines)))
        own = F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda x: F.element_at(names, x)))), ",")
    base = with_digest(base.select(id_col, "c", own.alias("notices")), "c", "digest")
    return base.join(F.broadcast(found), "digest", "left").select(id_col, "digest", "license_id", "notices")


def oracle_sql(known: Mapping[str, str] | None = None, notices: Mapping[str, str] | None = None, digests: Mapping[str, str] | None = None) -> str:
    """The scan in DuckDB's SQL."""
    digests = digests if digests is not None else DIGESTS if known is None else {}
    known, notices = (LICENSES if known is None else known), (NOTICES if notices is None else notices)
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    replaced = lambda x, pattern, to: f"replace({x}, {quote(pattern)}, {quote(to)})" if _plain(pattern) else f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'g')"

    def spelled(x: str) -> str:
        x = f"lower({x})"
        for pattern, to in REWRITINGS:
            x = replaced(x, pattern, to)
        return x

    one = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"

    def rest(x: str) -> str:
        x = one(replaced(x, ABOVE, ""))
        for pattern, to in PLACES:
            x = replaced(x, pattern, to)
        return x

    values = ", ".join(f"({quote(k)}, {quote(v)}, {flag})" for m, flag in ((known, "false"), (notices, "true")) for k, v in m.items())
    fixed = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in digests.items()) or "(null::varchar, null::varchar)"
    return f"""
    with listed(name, body, line) as (values {values}),
    spelled as (select name, line, {spelled("body")} as c from listed),
    bodies as (select name, line, {one("c")} as c, {rest("c")} as r from spelled),
    keys as (select line, case when line or r = '' then c else r end as c, name from bodies where c <> ''),
    digests(name, d) as (values {fixed} union all select name, sha256(c) from keys where not line),
    known as (select d, min(name) as name from digests where d is not null group by 1),
    notes as (select c, min(name) as name from keys where line group by 1),
    base as (select doc_id, {spelled("text")} as c from documents),
    lines as (select doc_id, trim(unnest(string_split(c, chr(10)))) as l from base),
    hits as (select doc_id, string_agg(name, ',' order by name) as names from (select distinct doc_id, k.name from lines join notes k on k.c = l) group by 1),
    rests as (select doc_id, {one("c")} as c, {rest("c")} as r from base),
    whole as (select doc_id, sha256(case when r = '' then c else r end) as digest from rests)
    select w.doc_id, w.digest, k.name as license_id, coalesce(h.names, '') as notices
    from whole w left join known k on k.d = w.digest left join hits h on h.doc_id = w.doc_id"""
