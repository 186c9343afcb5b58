"""License scans by canonical digest lookup; DataFrame functions only.

A text is made canonical (case, punctuation, copyright lines, equivalent spellings, white space), hashed, and the digest is
joined to the digests of known licences: full texts of short licences, standard notices, and one-line statements.  Whole
documents are looked up, and so is each of their lines, as a licence statement may be one line of a document.  A licence text
inside a longer document is found by blocks (what stands between lines without letters or digits): each block's digest is
joined to the known texts' blocks, and a run of blocks in a row that is a known text from first block to last is a hit.

Most lines and blocks start with a word that no known form starts with.  They are skipped before they are made canonical, which
is exact: the first word of a canonical form is the text's first word or the first word of its equivalent spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spellings that licence matching treats as equal (public licence-matching guidelines), written -> read.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact",
    "authorisation": "authorization", "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled",
    "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "copyright owner": "copyright holder", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite",
    "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licenced": "licensed", "maximise": "maximize",
    "modelled": "modeled", "modelling": "modeling", "noncommercial": "non commercial", "offence": "offense",
    "optimise": "optimize", "organisation": "organization", "organise": "organize", "percent": "per cent",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize",
    "signalling": "signaling", "sub license": "sublicense", "utilisation": "utilization", "whilst": "while",
    "wilful": "wilfull",
}

#: SPDX identifiers and the names under which statements refer to them.
NAMES = {
    "0BSD": ["0BSD License", "Zero-Clause BSD License"], "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPL-3.0"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License"],
    "Artistic-2.0": ["Artistic License 2.0"], "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"], "BSL-1.0": ["Boost Software License, Version 1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"], "EPL-2.0": ["Eclipse Public License 2.0"], "EUPL-1.2": ["European Union Public Licence 1.2"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPL-2.0", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GPL-3.0", "GPLv3"], "ISC": ["ISC License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "LGPL-2.1"], "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPL-3.0"],
    "MIT": ["MIT License", "MIT/X11 License"], "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
    "OFL-1.1": ["SIL Open Font License 1.1"], "Unlicense": ["Unlicense"], "WTFPL": ["WTFPL"], "Zlib": ["zlib License"],
}
#: The statements in which those names stand.
STATEMENTS = ["{}", "Licensed under {}", "Licensed under the {}", "Released under the {}", "Distributed under the {}",
              "Available under the {}", "This work is licensed under the {}", "This work is licensed under {}",
              "This project is licensed under the {}", "This software is licensed under the {}", "SPDX-License-Identifier: {id}"]

#: Full texts and notices, without title and copyright lines.  ``#`` is the number or bullet of a list item.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

# Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

# Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

# Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

# Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution.

# Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE
OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:

# The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

# Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

# This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}

COPYRIGHT_MARK = r"copyright|\(c\)|©|all rights reserved"
#: A line that starts with a copyright mark; "copyright notice" at the start of a wrapped line is text.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\n(©]*(?:copyright (?: *(?:\(c\)|©|by )|[^\n]*[0-9]{4})|\(c\)|©|all rights reserved)[^\n]*$"
#: What separates blocks: line ends with no letter or digit between them.
BLOCK_BREAK = r"\n[^\p{L}\p{N}]*\n"
#: A block of several lines (a block of one line is looked up as a line).
SEVERAL_LINES = r"^[^\p{L}\p{N}]*[\p{L}\p{N}][^\n]*\n[^\n]*[\p{L}\p{N}]"
#: Known forms that may be broadcast (a few digests and a name each); beyond it the join is left to Spark.
BROADCAST_ROWS = 100_000
#: First words of known forms that may be held as literals; with more of them no line or block is skipped.
FIRST_WORDS = 10_000


def without_copyright(text: Column) -> Column:
    """The lower-case text without its copyright lines."""
    t = F.lower(text)
    return F.when(t.rlike(COPYRIGHT_MARK), F.regexp_replace(t, COPYRIGHT_LINE, "")).otherwise(t)


def canonical_words(t: Column) -> Column:
    """The canonical form of a text that ``without_copyright`` gave."""
    t = F.regexp_replace(t, r"[^\p{L}\p{N}]+", "  ")
    # every word now has spaces of its own on both sides: words and phrases are replaced as they stand
    t = F.concat(F.lit("  "), t, F.lit("  "))
    for written, read in EQUIVALENT.items():
        t = F.replace(t, F.lit(f" {written.replace(' ', '  ')} "), F.lit(f" {read.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def canonical(text: Column) -> Column:
    """The canonical form of a licence text ('' if nothing but copyright lines and punctuation is left)."""
    return canonical_words(without_copyright(text))


def _hash(canonical_text: Column) -> Column:
    return F.sha2(canonical_text.cast("binary"), 256)


def _first_word(t: Column) -> Column:
    return F.regexp_extract(t, r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1)


def statement_rows() -> list[tuple[str, str]]:
    return sorted({(spdx, s.format(name, id=spdx)) for spdx, names in NAMES.items() for name in names for s in STATEMENTS})


def text_rows() -> list[tuple[str, str]]:
    """``(license, text)`` of the full texts: list items with numbers or bullets, each text with and without a title."""
    rows = set()
    for spdx, text in TEXTS.items():
        head, *items = text.split("# ")
        numbered = head + "".join(f"{k}. {item}" for k, item in enumerate(items, 1))
        for body in {numbered, head + "".join(f"* {item}" for item in items)}:
            rows |= {(spdx, body)} | {(spdx, f"{name}\n\n{body}") for name in NAMES[spdx]}
            # list items in a row, without blank lines between them
            tight = body.replace("\n\n* ", "\n* ") if "* " in body else body
            for k in range(2, len(items) + 1):
                tight = tight.replace(f"\n\n{k}. ", f"\n{k}. ")
            rows |= {(spdx, tight)}
    return sorted(rows)


def known_statements(spark) -> DataFrame:
    """``license, text`` of the statements above, made by rule."""
    return spark.createDataFrame(statement_rows(), "license string, text string")


def known_licenses(spark) -> DataFrame:
    """``license, text`` of the statements and of the full texts and notices."""
    return spark.createDataFrame(statement_rows() + text_rows(), "license string, text string")


def _forms(known: DataFrame) -> DataFrame:
    """``is_block, known_digest, form, license, at, size``: each known text as a whole, and each of its blocks in order."""
    base = known.select(without_copyright(F.col("text").cast("string")).alias("t"), "license")
    whole = (base.select("t", canonical_words(F.col("t")).alias("c"), "license").where("c <> ''"))
    named = whole.groupBy(_hash(F.col("c")).alias("form")).agg(F.min("license").alias("license"))
    split = F.split(F.regexp_replace("t", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), BLOCK_BREAK, -1)
    # one known form may be written with several block layouts; each is a sequence of its own
    layouts = (whole.select(_hash(F.col("c")).alias("form"), split.alias("blocks"))
               .select("form", F.xxhash64("blocks").alias("layout"), F.size("blocks").alias("size"), F.posexplode("blocks").alias("at", "block"))
               .select("form", "layout", "size", "at", _hash(canonical_words(F.col("block"))).alias("known_digest"))
              .distinct().join(named, "form"))
    forms = named.select(F.lit(False).alias("is_block"), F.col("form").alias("known_digest"), "form", "license",
                         F.lit(0).alias("at"), F.lit(1).alias("size"), F.lit(0).cast("long").alias("layout"))
    return forms.unionByName(layouts.select(F.lit(True).alias("is_block"), "known_digest", "form", "license", "at", "size", "layout"))


def _starts(known: DataFrame, bound: int) -> list[str] | None:
    """The first words with which a text may begin whose canonical form, or block, is known; None beyond the bound."""
    base = known.select(without_copyright(F.col("text").cast("string")).alias("t"))
    parts = base.select(F.explode(F.concat(F.array("t"), F.split("t", BLOCK_BREAK, -1))).alias("part"))
    words = parts.select(F.substring_index(canonical_words(F.col("part")), " ", 1).alias("w")).where("w <> ''").distinct()
    found = {r.w for r in words.limit(bound + 1).collect()}
    if len(found) > bound:
        return None
    return sorted(found | {written.split()[0] for written, read in EQUIVALENT.items() if read.split()[0] in found})


def scan_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  broadcast_rows: int = BROADCAST_ROWS, first_words: int = FIRST_WORDS) -> DataFrame:
    """``id, digest, whole_license, n_statements, n_texts, licenses`` per row: the canonical digest of the whole text and the
    licence it is, the number of lines that state a known licence, the number of block runs that are a known text (counted
    by their last block; a run of one block has several lines), and the distinct licences found, sorted and comma-joined ('' if none).

    ``known`` holds ``license, text``.  Defined cases: a NULL or empty text has the digest of the empty text and no licence;
    lines and blocks that come to nothing match nothing; a text that is a known licence as a whole, a line and a run counts as
    each; of licences with one digest the first by name counts; rows that repeat an id, or have none, are scanned one by one;
    texts are read whole, however long, each line and block once; empty tables are fine on either side; further columns are ignored.
    """
    forms = _forms(known)
    if forms.limit(broadcast_rows + 1).count() <= broadcast_rows:
        forms = F.broadcast(forms)
    starts = _starts(known, first_words)
    row = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"),
                      without_copyright(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("t"))
    # kind 0: the whole text, 1: its lines, 2: its blocks
    pieces = lambda kind, parts: F.transform(parts, lambda x, k: F.struct(F.lit(kind).alias("kind"), k.alias("place"), x.alias("part")))
    parts = row.select("rid", "id", F.inline(F.concat(pieces(0, F.array("t")), pieces(1, F.split("t", "\n", -1)), pieces(2, F.split("t", BLOCK_BREAK, -1)))))
    if starts is not None:
        parts = parts.where((F.col("kind") == 0) | _first_word(F.col("part")).isin(starts))
    looked = parts.select("rid", "id", "kind", "place", (F.col("kind") == 2).alias("block"), F.col("part").rlike(SEVERAL_LINES).alias("several"),
                          _hash(canonical_words(F.col("part"))).alias("digest"))
    hits = (looked.join(forms, (F.col("digest") == F.col("known_digest")) & (F.col("block") == F.col("is_block")), "left")
            .where((F.col("kind") == 0) | (F.col("license").isNotNull() & ((F.col("kind") == 1) | (F.col("size") > 1) | F.col("several")))))
    # a line or whole text is a run of one; a run of blocks counts if it has all of its form's blocks
    first = F.when(F.col("kind") == 2, F.col("place") - F.col("at")).otherwise(F.col("place"))
    runs = (hits.groupBy("rid", "id", "kind", "form", "layout", "license", "size", first.alias("first"))
            .agg(F.count("license").alias("n"), F.max(F.when(F.col("kind") == 0, F.col("digest"))).alias("digest"))
            .where("kind = 0 or n = size"))
    whole, line, block = (F.col("kind") == k for k in range(3))
    return (runs.groupBy("rid", "id")
            .agg(F.max(F.when(whole, F.col("digest"))).alias("digest"), F.max(F.when(whole, F.col("license"))).alias("whole_license"),
                 F.count(F.when(line, F.col("license"))).alias("n_statements"),
                 F.count_distinct(F.when(block, F.col("first") + F.col("size"))).alias("n_texts"),
                 F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses")).drop("rid"))
