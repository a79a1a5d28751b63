"""License scans by canonical digest lookup, in DataFrame functions only.

A text is normalised (case, copyright lines, typographic signs, punctuation, white space and, after those,
equivalent spellings, so that they are found across a line break), hashed with SHA-256 and hash-joined to the digests of
known licence texts.  Those of short licences are computed by the same expression from their texts, with and without their
titles; those of long ones are listed.  Digests of a given list of texts are broadcast up to BROADCAST_ROWS; beyond, and for
a caller's own table, Spark chooses the join by size.

A copyright line begins, perhaps behind a comment sign, with the word or the sign, and goes; not if the word begins one of
a licence's own phrases (LICENSE_PHRASES), as in "copyright notice".

Known: the licences of LICENSES and DIGESTS, whole; a text with more than the licence (two licences in a row, a file
header) is none.  Letters are folded from A to Z only; other scripts have no licences here.

Defined cases: null text gives a null digest and no licence; an empty text, or one of copyright lines
and punctuation only, has the digest of the empty string and no licence; repeated rows are kept; only the columns that are
added may clash with those of the table, and replace them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and notices, as their stewards publish them, without copyright lines.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0.""",
    "CC-BY-NC-4.0-notice": """Licensed under CC BY-NC 4.0.""",
    "GPL-3.0-notice": """This work is licensed under the GNU General Public License, version 3.""",
    "MIT-notice": """Released under the MIT License.""",
}

# Titles that stand above those texts.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", "Boost Software License 1.0"),
    "Zlib": ("zlib License", "The zlib License", "The zlib/libpng License"),
}

# Digests, as digest() gives them, of long licences as their stewards publish them: the whole text; its terms up to
# and with the line that ends them; and without that line.
DIGESTS = {
    "Apache-2.0": "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
    "Apache-2.0 terms": "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40",
    "Apache-2.0 sections": "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f",
    "GPL-1.0": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-1.0 terms": "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
    "GPL-1.0 sections": "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
    "GPL-2.0": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-2.0 terms": "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
    "GPL-2.0 sections": "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
    "GPL-3.0": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "GPL-3.0 terms": "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
    "GPL-3.0 sections": "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
    "LGPL-2.0": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.0 terms": "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
    "LGPL-2.0 sections": "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
    "LGPL-2.1": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-2.1 terms": "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
    "LGPL-2.1 sections": "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2": "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
    "GFDL-1.3": "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
    "Artistic": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
}

# What follows "copyright" in licences' own sentences.
LICENSE_PHRASES = "and,as,control,disclaimer,doctrine,except,for,from,grant,holder,if,in,infringement,interest,is,law,licence,license,management,may,notice,of,on,or,owner,permission,protection,resulting,rights,shall,statement,status,that,the,to,treaty,under,when,which,with,work,years".split(",")

# Spellings that licence matching guidelines count as equal, once punctuation is white space.
EQUIVALENT = {
    "licence": "license",
    "sub license": "sublicense",
    "non commercial": "noncommercial",
    "non infringement": "noninfringement",
    "acknowledgement": "acknowledgment",
    "favour": "favor",
    "fulfilment": "fulfillment",
    "merchantibility": "merchantability",
    "organisation": "organization",
    "per cent": "percent",
    "copyright owner": "copyright holder",
    "wilful": "willful",
    "https ": "http ",
}

#: Known texts up to which their digests are broadcast: at 100 bytes each, 10 MB.
BROADCAST_ROWS = 100_000

# Typographic signs and what they become.
SIGNS_FROM, SIGNS_TO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ‘’“”‐‑‒–— ", "abcdefghijklmnopqrstuvwxyz''\"\"----- "

#: Where one of a licence's own phrases begins.  It is joined by a sign, so that its line is none of a copyright; the sign goes
#: with the punctuation.
PHRASE = r"copyright[ \t]+(" + "|".join(LICENSE_PHRASES) + ")"
#: Of a line that begins with "(c)", a year, or the line's end after a few words, tells a copyright from the third point of a list.
COPYRIGHT_LINE = r"(?m)^[ \t#*/;-]*((copyright([ \t:(]|\x{a9})|\x{a9}|all rights reserved|\(c\)[ \t]*[0-9])[^\n]*|\(c\)[ \t]*([^ \t\r\n]+[ \t]+){0,3}[^ \t\r\n]*[^ \t\r\n.,:;][ \t\r]*$)"
PUNCTUATION = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def normalised(text: Column) -> Column:
    """The canonical form that the digest covers."""
    out = F.translate(text, SIGNS_FROM, SIGNS_TO)
    out = F.regexp_replace(out, PHRASE, "copyright_$1")
    out = F.regexp_replace(out, "(?d)" + COPYRIGHT_LINE, "")  # lines end with \\n only
    out = F.trim(F.regexp_replace(out, PUNCTUATION, " "))
    for spelling, canonical in EQUIVALENT.items():
        out = F.replace(out, F.lit(spelling), F.lit(canonical))
    return out


def digest(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def titled(licenses: dict[str, str] = LICENSES, titles: dict[str, tuple[str, ...]] = TITLES) -> list[tuple[str, str]]:
    """(license_id, text) of each text as it is and behind each of its titles."""
    return [(k, head + v) for k, v in licenses.items() for head in ("", *(f"{t}\n\n" for t in titles.get(k, ())))]


def known_digests(spark: SparkSession, licenses: dict[str, str] = LICENSES, titles: dict[str, tuple[str, ...]] = TITLES, digests: dict[str, str] = DIGESTS) -> DataFrame:
    """digest, license_id of the known texts; of several with one digest, the first id."""
    given = titled(licenses, titles)
    rows = F.array(*[F.struct(F.lit(k).alias("license_id"), F.lit(v).alias("text")) for k, v in given])
    texts = spark.range(1).select(F.explode(rows).alias("l")).select("l.*")
    known = texts.select(digest(F.col("text")).alias("digest"), "license_id")
    if digests:
        listed = F.array(*[F.struct(F.lit(d).alias("digest"), F.lit(k.partition(" ")[0]).alias("license_id")) for k, d in digests.items()])
        known = known.unionByName(spark.range(1).select(F.explode(listed).alias("l")).select("l.*"))
    known = known.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    return F.broadcast(known) if len(given) + len(digests) <= BROADCAST_ROWS else known


def license_scan(docs: DataFrame, known: DataFrame, text: str = "text", out: tuple[str, str] = ("license_digest", "license_id")) -> DataFrame:
    """docs with the canonical digest of each text and the licence whose whole text it is, else null."""
    name, hit = out
    marked = docs.drop(*out).withColumn(name, digest(F.col(text)))
    lookup = known.select(F.col("digest").alias("__known"), F.col("license_id").alias(hit))
    return marked.join(lookup, F.col(name) == F.col("__known"), "left").drop("__known")


def op5_license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, license_digest, license_id, is_license of every document."""
    found = license_scan(docs.select("doc_id", "text"), known_digests(docs.sparkSession))
    return found.select("doc_id", "license_digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _form(text: str) -> str:
    """digest() in DuckDB's SQL."""
    out = f"translate({text}, {_quoted(SIGNS_FROM)}, {_quoted(SIGNS_TO)})"
    out = f"regexp_replace({out}, {_quoted(PHRASE)}, {_quoted('copyright_' + chr(92) + '1')}, 'g')"
    out = f"regexp_replace({out}, {_quoted(COPYRIGHT_LINE)}, '', 'g')"
    out = f"trim(regexp_replace({out}, {_quoted(PUNCTUATION)}, ' ', 'g'), ' ')"
    for spelling, canonical in EQUIVALENT.items():
        out = f"replace({out}, {_quoted(spelling)}, {_quoted(canonical)})"
    return f"sha256({out})"


def oracle() -> str:
    """The same in DuckDB's SQL."""
    values = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in titled())
    listed = "".join(f" UNION ALL SELECT {_quoted(d)}, {_quoted(k.partition(' ')[0])}" for k, d in DIGESTS.items())
    return (
        f"WITH texts AS (SELECT {_form('t')} AS digest, id FROM (VALUES {values}) AS v(id, t){listed}), "
        "known AS (SELECT digest, min(id) AS license_id FROM texts GROUP BY 1), "
        f"marked AS (SELECT doc_id, {_form('text')} AS license_digest FROM documents) "
        "SELECT doc_id, license_digest, license_id, license_id IS NOT NULL AS is_license FROM marked LEFT JOIN known ON license_digest = digest"
    )


#: What a licence text may look like in a repository: a change that the scan sees through, or one that it must not.
VARIANTS = {
    "plain": lambda t: t,
    "copyright lines": lambda t: f"Copyright (c) 2020 Jane Doe\nCopyright Foo Inc. and contributors\n\n{t}\n\nAll rights reserved.",
    "capitals": lambda t: t.upper(),
    "one word a line": lambda t: t.replace(" ", "\n"),
    "signs": lambda t: t.replace('"', "\u201c").replace("'", "\u2019").replace("license", "licence"),
    "comment": lambda t: "/* " + t.replace("\n", "\n * ") + " */",
    "more words": lambda t: t + "\nAnd more.",
    "fewer words": lambda t: t.rpartition(" ")[0],
}


def variants(spark: SparkSession) -> DataFrame:
    """name, license_id of each variant of each known text, through the scan."""
    rows = [(f"{n} {license} {i}", change(text)) for i, (license, text) in enumerate(titled()) for n, change in VARIANTS.items()]
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("text")) for n, t in rows])
    texts = spark.range(1).select(F.explode(cells).alias("c")).select("c.*")
    return license_scan(texts, known_digests(spark)).select("name", "license_id")


def variants_oracle() -> str:
    """What must come out, stated and not computed."""
    rows = ", ".join(f"({_quoted(f'{n} {license} {i}')}, {'NULL' if 'words' in n else _quoted(license)})" for i, (license, _) in enumerate(titled()) for n in VARIANTS)
    return f"SELECT name, license_id FROM (VALUES {rows}) AS v(name, license_id)"
