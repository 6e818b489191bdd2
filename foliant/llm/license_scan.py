"""Licence scans by canonical digest, in DataFrame operations only.

A text is reduced to a canonical form: lower case, equivalent spellings made one, copyright lines
left out, punctuation and white space to single blanks. Its SHA-256 is hash-joined to the digests of
known licence texts, made by the same expressions. Lines are looked up too, since a notice is often
the last line of something else.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch, small_or_shuffled

_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
#: Known texts and notices (fixed values).
KNOWN = {
    "MIT": (_MIT, "The MIT License " + _MIT, "MIT License " + _MIT, "The MIT License (MIT) " + _MIT, "Released under the MIT License.", "Licensed under the MIT License."),
    "MIT-0": (_MIT.split(", subject to")[0] + ". " + _MIT[_MIT.index("THE SOFTWARE IS") :],),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", "ISC License " + "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "0BSD": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",),
    "BSD-2-Clause": (f"{_BSD} {_WARRANTY}",),
    "BSD-3-Clause": (
        f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_WARRANTY}",
    ),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <http://unlicense.org/>",
    ),
    "WTFPL": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.",),
}
#: Digests of the canonical forms of long licence texts as they are distributed, and a word of each (fixed values).
LONG_TEXTS = {
    "cc31b92fc0ea6895531537118f604200d6560f6fd6e2394146ed1707168cc0cc": ("Apache-2.0", "license"),
    "08fe576fe0b58cdba2ce74db4b4a03861f339a8abec5e910aff7657b0e4ec33b": ("Apache-2.0", "license"),
    "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2": ("Artistic-1.0-Perl", "license"),
    "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f": ("CC0-1.0", "license"),
    "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f": ("GFDL-1.2", "license"),
    "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7": ("GFDL-1.3", "license"),
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": ("GPL-1.0", "license"),
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": ("GPL-2.0", "license"),
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": ("GPL-2.0", "license"),
    "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68": ("GPL-3.0", "license"),
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": ("GPL-3.0", "license"),
    "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908": ("LGPL-2.0", "license"),
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": ("LGPL-2.1", "license"),
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": ("LGPL-2.1", "license"),
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": ("LGPL-3.0", "license"),
    "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354": ("MPL-1.1", "license"),
    "3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7": ("MPL-2.0", "license"),
}
#: Spellings that count as one, first by second (fixed values).
SPELLINGS = (("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"), ("acknowledgement", "acknowledgment"), ("http://", "https://"))
#: Known texts are broadcast; the list must not grow beyond this.
MOST_KNOWN = 10_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\x0b\f\r ‘’“”–—•"
COPYRIGHT = r"(?m)^[^\S\n]*(?:copyright[^\S\n]*(?:\(c\)|©|[0-9]{4})|\(c\)|©)[^\n]*$|^[^\S\n]*all rights reserved\.?[^\S\n]*$"


def spelled(text: Column) -> Column:
    """Lower case, with equivalent spellings made one."""
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, F.lower(text))


def canonical(text: Column) -> Column:
    """The canonical form; null stays null, a text of copyright lines and punctuation only becomes empty."""
    x = spelled(text)
    x = F.when(F.contains(x, F.lit("copyright")) | F.contains(x, F.lit("(c)")) | F.contains(x, F.lit("©")) | F.contains(x, F.lit("all rights reserved")), F.regexp_replace(x, COPYRIGHT, "")).otherwise(x)
    return F.btrim(F.regexp_replace(F.translate(x, PUNCTUATION, " " * len(PUNCTUATION)), " {2,}", " "))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form; null if there is nothing left."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known_digests(spark: SparkSession, known: dict[str, tuple[str, ...]] = KNOWN, long_texts: dict[str, tuple[str, str]] = LONG_TEXTS) -> DataFrame:
    """(digest, license, words) of the known texts; words, long ones of the canonical form, are what a text must hold to be one."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    made = spark.createDataFrame(rows, "license string, text string").select("license", digest(F.col("text")).alias("digest"), F.split(canonical(F.col("text")), " ").alias("words"))
    if long_texts:
        made = made.union(spark.createDataFrame([(name, d, [word]) for d, (name, word) in long_texts.items()], made.schema))
    longest = F.filter("words", lambda w: F.length(w) >= 7)
    return made.groupBy("digest").agg(F.min("license").alias("license"), F.first(F.when(F.size(longest) > 0, longest).otherwise(F.col("words"))).alias("words"))


def anchors(known: DataFrame) -> list[str] | None:
    """A few words of which each known text holds one; None if known, which is read here up to MOST_KNOWN rows, has no words or more rows."""
    if "words" not in known.columns:
        return None
    left = [set(r["words"]) for r in known.select("words").limit(MOST_KNOWN + 1).collect()]
    if len(left) > MOST_KNOWN:
        return None
    out = []
    while left:
        counts: dict[str, int] = {}
        for words in left:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
        out.append(min(counts, key=lambda w: (-counts[w], w)))
        left = [words for words in left if out[-1] not in words]
    return out


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, digest, license, notices): the entire text's digest and licence, and the licences of its lines, sorted and comma-joined.

    digest is null for null or empty texts and license where no known text matches; notices is then empty. Every line is
    looked up that holds a word of a known text, without which it could be none. known: (digest, license[, words]), broadcast
    up to MOST_KNOWN rows; without words all lines are looked up. Rows with a null or repeated id keep their own notices;
    other columns are ignored. Very long texts are scanned whole. An empty table gives an empty one.
    """
    known = Scratch(docs.sparkSession, "licenses").save(known if known is not None else known_digests(docs.sparkSession), "known")
    words = anchors(known)
    holds = lambda x: F.lit(True) if words is None else reduce(lambda a, b: a | b, (F.contains(x, F.lit(w)) for w in words), F.lit(False))
    small = small_or_shuffled(known.select("digest", "license"), MOST_KNOWN, known)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    whole = rows.select("doc_id", "th", digest(F.col("text")).alias("digest")).join(small, "digest", "left").select("doc_id", "th", "digest", "license")
    lines = rows.select("doc_id", "th", spelled(F.col("text")).alias("x")).where(holds(F.col("x"))).select("doc_id", "th", F.explode(F.filter(F.split("x", "\n"), holds)).alias("line"))
    named = lines.select("doc_id", "th", digest(F.col("line")).alias("digest")).join(small, "digest").groupBy("doc_id", "th").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    named = named.select(F.col("doc_id").alias("of"), F.col("th").alias("of_th"), "notices")
    out = whole.join(named, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("of_th")), "left")
    return out.select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
