"""Licence scans by canonical digest lookup.

A text is brought into canonical form: lower case, copyright lines out,
equivalent spellings made one, punctuation and white space turned into
blanks. The SHA-256 of the canonical form is looked up among the digests of
known licence texts. Entire texts are compared, never parts: a document as a
whole, and each of its lines as a text of its own (licence notices stand on
lines). A text without any of a few words, one of each known text, can match
none and is not brought into canonical form. Only built-in functions run.

Cases: null and empty texts and lines have no canonical form and match nothing;
a text repeated is found for each row; other columns are ignored. Known texts
with equal canonical forms count under the first name in order. Known are twelve
notices and the eight short licences in TEXTS; others can be given.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pairs of spellings that mean the same, as whole words.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright owner", "copyright holder"),
    ("favour", "favor"),
    ("http", "https"),
    ("initialise", "initialize"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("sub license", "sublicense"),
    ("per cent", "percent"),
    ("utilisation", "utilization"),
    ("while", "whilst"),
    ("wilful", "willful"),
)
COPYRIGHT_LINE = r"(^|\n)[ \t]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9])[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F‘’“”–—©®™]+"

# Notices, with their SPDX names.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
)

# Whole licences: SPDX name, title, text. {n} stands where items are numbered or only marked.
TEXTS = (
    (
        "MIT",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        "to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES '
        "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS "
        "OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MIT-0",
        "MIT No Attribution",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
        'to do so.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
        "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission notice "
        'appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH '
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR "
        "OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "0BSD",
        "Zero-Clause BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        'without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL '
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE.",
    ),
    (
        "BSD-2-Clause",
        "BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:\n\n{1} Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer.\n\n{2} Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY "
        'THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:\n\n{1} Redistributions of source code must retain the above "
        "copyright notice, this list of conditions and the following disclaimer.\n\n{2} Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution.\n\n{3} Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY "
        'THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
        "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
        "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
        "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "Zlib",
        "zlib License",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors "
        "be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone "
        "to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions:\n\n{1} The origin of this software must not be "
        "misrepresented; you must not claim that you wrote the original software. If you use this software in a "
        "product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n"
        "{2} Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
        "original software.\n\n{3} This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "The Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize "
        "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS "
        'PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>",
    ),
)
RESERVED = "All rights reserved."


def spelled_out(texts=TEXTS) -> tuple[tuple[str, str], ...]:
    """(name, text) of every way a whole licence is written: with or without its title and
    "All rights reserved", items numbered ``1.`` or only marked."""
    out = []
    for name, title, text in texts:
        numbered = re.sub(r"\{(\d)\}", r"\1.", text)
        for body in dict.fromkeys((numbered, re.sub(r"\{\d\} ", "", text))):
            for head in ((), (title,), (RESERVED,), (title, RESERVED)):
                out.append((name, "\n\n".join((*head, body))))
    return tuple(out)


KNOWN = NOTICES + spelled_out()


def canonical(text: Column) -> Column:
    """The canonical form of a text; empty if nothing is left of it, null for null."""
    out = F.lower(text)
    out = F.regexp_replace(out, COPYRIGHT_LINE, "")
    # two spaces between words, so that neighbours of equal spelling are both seen
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, PUNCTUATION, "  ")), F.lit(" "))
    for one, other in SPELLINGS:
        one, other = one.replace(" ", "  "), other.replace(" ", "  ")
        out = F.replace(out, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(out)


def anchor_words(known=KNOWN) -> list[str]:
    """A word of each known text that no spelling touches: what lacks them all matches none.

    A known text without such a word gives the empty word, which every text has.
    """
    touched = {word for pair in SPELLINGS for side in pair for word in side.split()}
    anchors: set[str] = set()
    for _, text in known:
        words = {w for w in re.findall(r"[a-z]+", text.lower()) if w not in touched}
        lines = [w for w in words if re.search(rf"(?<![a-z0-9]){w}(?![a-z0-9])", text.lower())]
        if not anchors & set(lines):
            anchors.add(max(lines, key=lambda w: (len(w), w), default=""))
    return sorted(anchors)


def _has_anchor(text: Column, anchors: list[str]) -> Column:
    low = F.lower(text)
    return reduce(or_, (F.contains(low, F.lit(word)) for word in anchors), F.lit(False))


def known_digests(spark: SparkSession, known=KNOWN) -> DataFrame:
    """(digest, license) of known texts, given as a bounded list of (name, text)."""
    rows = spark.createDataFrame(list(known), "license string, known_text string")
    rows = rows.select("license", F.sha2(canonical(F.col("known_text")), 256).alias("digest"))
    return rows.where(F.col("digest") != F.sha2(F.lit(""), 256)).groupBy("digest").agg(F.min("license").alias("license"))


def license_matches(docs: DataFrame, known=KNOWN) -> DataFrame:
    """doc_id, line_no (-1: the whole text, else from 0), license, digest of every match."""
    anchors = anchor_words(known)
    text = docs.select("doc_id", "text").where(_has_anchor(F.col("text"), anchors))
    parts = F.concat(F.array("text"), F.split("text", "\n"))
    # a text of one line is the whole text: not found twice
    parts = F.when(F.contains("text", F.lit("\n")), parts).otherwise(F.array("text"))
    rows = text.select("doc_id", F.posexplode(parts).alias("place", "part"))
    rows = rows.where(_has_anchor(F.col("part"), anchors))
    rows = rows.select("doc_id", (F.col("place") - 1).alias("line_no"), F.sha2(canonical(F.col("part")), 256).alias("digest"))
    found = rows.join(F.broadcast(known_digests(docs.sparkSession, known)), "digest")
    return found.select("doc_id", "line_no", "license", "digest")
