"""Licence scan by digests of canonical texts, with DataFrame functions only."""

from __future__ import annotations

import hashlib
import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts and notices of well-known public licences.
KNOWN = {
    "Apache-2.0-notice": ["Licensed under the Apache License, Version 2.0."],
    "MIT-notice": ["Released under the MIT License.", "Licensed under the MIT License."],
    "GPL-3.0-notice": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0-notice": ["Licensed under CC BY-NC 4.0."],
    "MIT": [
        """MIT License
Copyright (c) <year> <holder>
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
    ],
    "ISC": [
        """ISC License
Copyright (c) <year> <holder>
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
    ],
    "BSD-2-Clause": [
        """BSD 2-Clause License
Copyright (c) <year>, <holder>
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
    ],
    "BSD-3-Clause": [
        """BSD 3-Clause License
Copyright (c) <year>, <holder>
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        """Copyright (c) The Regents of the University of California.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
3. Neither the name of the University nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS'' AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.  IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF
SUCH DAMAGE.""",
    ],
    "Unlicense": [
        """The Unlicense
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
    ],
}
# Long licences, each a file with its whole text as published.
KNOWN |= {f.name.removesuffix(".txt"): [f.read_text("utf-8")] for f in sorted(files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}

# Spellings that count as one; the pairs apply in this order to the text in lower case.
SPELLINGS = [
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("merchantibility", "merchantability"),
    ("non-commercial", "noncommercial"),
    ("per cent", "percent"),
    ("&", "and"),
]
_NOTICE = r"(^|\n)[ \t*#/;-]*(?:copyright|\(c\)|©)[^\n]*"
_MARKS = r"[^\p{L}\p{N}\n]+"
_EDGES = r" *\n[ \n]*"
_TITLE_WORDS = 20
_BLANK = r"\n[ \t]*\n"
_END = r"(?i)end of terms and conditions"
_OWNER = re.compile(r"\s*copyright (?:\(c\)|[\[<])", re.I)


def canonical(text: Column) -> Column:
    """Canonical lines, joined by line ends: lower case, one spelling, no copyright lines, a space for other marks."""
    out = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.regexp_replace(out, _NOTICE, "$1")
    out = F.regexp_replace(out, _MARKS, " ")
    return F.trim(F.regexp_replace(out, _EDGES, "\n"))


def canonical_text(text: str) -> str:
    """The same for one text on the driver: for the table of known licences only."""
    out = text.lower()
    for a, b in SPELLINGS:
        out = out.replace(a, b)
    out = re.sub(_NOTICE, r"\1", out)
    out = re.sub(r"(?:[^\w\n]|_)+", " ", out)
    return re.sub(_EDGES, "\n", out).strip(" ")


def _digest(canon: str) -> str:
    return hashlib.sha256(canon.strip("\n").replace("\n", " ").encode()).hexdigest()


def _flowed(text: str, apart: bool) -> str:
    """A wrapped text with a line for each paragraph. apart: copyright notices stay lines of their own."""
    out: list[str] = []
    for line in text.split("\n"):
        if out and out[-1].strip() and line.strip() and not (apart and (_OWNER.match(line) or _OWNER.match(out[-1]))):
            out[-1] += " " + line.strip()
        else:
            out.append(line)
    return "\n".join(out)


def forms(text: str) -> set[str]:
    """A licence as it is met: with and without its title and what follows its terms, wrapped or a line a paragraph.

    The title is the first paragraph or, in a text without blank lines, a first line of few words. Wrapping matters
    since a line that begins with the word copyright isn't part of a canonical text.
    """
    text = text.strip()
    head = re.match(r"[^\n]+(?:\n[^\n]+)*?" + _BLANK if re.search(_BLANK, text) else r"[^\n]+\n", text)
    titled = {text}
    if head and len(head[0].split()) <= _TITLE_WORDS:
        titled.add(text[head.end() :])
    ended = titled | {t[: m.end()] for t in titled for m in [re.search(_END, t)] if m}
    linked = ended | {t.replace("https://", "http://") for t in ended}
    return linked | {_flowed(t, apart) for t in linked if re.search(_BLANK, t) for apart in (True, False)}


def catalogue() -> list[tuple[str, str, int]]:
    """(digest, licence, its number) of every known text in all its forms."""
    return sorted({(_digest(canonical_text(form)), name, i) for i, (name, texts) in enumerate(KNOWN.items()) for t in texts for form in forms(t)})


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Find known licences that are a whole text or a whole line of one, by equal digests of canonical texts.

    Returns doc_id, canonical_sha256 (of the whole text), whole_license (null if it is none), line_licenses (names,
    sorted, joined by commas; empty if none), n_license_lines. A null or empty text, or one of marks only, has the
    digest of the empty text and no licence. Repeated rows with one id and one canonical text give one row, whose
    lines count each time; a row without an id counts like any other; other columns are ignored. The known digests
    are a table in this module, so their broadcast has a fixed size. The digest, licences and count of a document
    are summed in the task that reads it before anything is shuffled.
    """
    spark: SparkSession = docs.sparkSession
    known = spark.createDataFrame([(d, i) for d, _, i in catalogue()], "digest string, number int")
    names = F.array(*[F.lit(n) for n in KNOWN])
    canon = docs.select(F.col("doc_id").cast("long"), canonical(F.col("text")).alias("canon"))
    lines = canon.select("doc_id", F.filter(F.split("canon", "\n"), lambda x: x != "").alias("lines"))
    whole = lines.select("doc_id", "lines", F.sha2(F.array_join("lines", " "), 256).alias("canonical_sha256"))
    units = whole.select("doc_id", "canonical_sha256", F.posexplode(F.concat(F.array("canonical_sha256"), F.transform("lines", lambda x: F.sha2(x, 256)))).alias("nth", "digest"))
    bit = F.expr("shiftleft(1L, number)")
    found = units.join(F.broadcast(known), "digest", "left").select("doc_id", "canonical_sha256", F.when(F.col("nth") == 0, bit).alias("whole"), F.when(F.col("nth") > 0, bit).alias("line"))
    sums = found.groupBy("doc_id", "canonical_sha256").agg(F.bit_or("whole").alias("whole"), F.bit_or("line").alias("line"), F.count("line").alias("n_license_lines"))

    def named(mask: str) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(len(KNOWN) - 1))
        return F.array_sort(F.transform(F.filter(numbers, lambda i: F.getbit(F.coalesce(F.col(mask), F.lit(0).cast("long")), i) == 1), lambda i: F.get(names, i)))

    return sums.select("doc_id", "canonical_sha256", F.get(named("whole"), F.lit(0)).alias("whole_license"), F.array_join(named("line"), ",").alias("line_licenses"), "n_license_lines")


def oracle() -> str:
    """DuckDB SQL with the rows of scan_licenses over documents."""
    spelled = "lower(coalesce(text, ''))"
    for a, b in SPELLINGS:
        spelled = f"replace({spelled}, '{a}', '{b}')"
    known = ", ".join(f"('{d}', '{n}')" for d, n, _ in catalogue())
    return f"""
with known(digest, license) as (values {known}),
canon as (select doc_id, trim(regexp_replace(regexp_replace(regexp_replace({spelled}, '{_NOTICE}', '\\1', 'g'), '{_MARKS}', ' ', 'g'), '{_EDGES}', chr(10), 'g'), ' ') as canon from documents),
parts as (select doc_id, list_filter(string_split(canon, chr(10)), lambda x: x <> '') as lines from canon),
whole as (select doc_id, lines, sha256(array_to_string(lines, ' ')) as canonical_sha256 from parts),
per_line as (select doc_id, canonical_sha256, sha256(unnest(lines)) as digest from whole),
hits as (select p.doc_id, p.canonical_sha256, string_agg(distinct k.license, ',' order by k.license) as line_licenses, count(*) as n_license_lines from per_line p join known k using (digest) group by all)
select w.doc_id, w.canonical_sha256, k.license as whole_license, coalesce(h.line_licenses, '') as line_licenses, coalesce(h.n_license_lines, 0) as n_license_lines
from (select distinct doc_id, canonical_sha256 from whole) w
left join known k on k.digest = w.canonical_sha256
left join hits h on h.doc_id = w.doc_id and h.canonical_sha256 = w.canonical_sha256"""
