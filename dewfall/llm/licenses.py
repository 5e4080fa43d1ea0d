"""Licence scans: lines of a text compared with licence templates by Dice coefficient over word bigrams.

All of it is built-in functions over arrays within a row: no shuffle, no Python. A text is looked at closely only if it
holds one of a few words without which no unit of it could reach the least coefficient against any template. A line is compared with a
template only if their numbers of bigrams allow that coefficient; lines too short or too varied for
every template never have bigrams built."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices and permission texts, several to a licence.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
]
#: Names by which licences are called in a sentence, and identifiers in a tag.
NAMES = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache 2.0", "Apache-2.0"], "BSD-2-Clause": ["BSD 2-Clause", "BSD-2-Clause"], "BSD-3-Clause": ["BSD 3-Clause", "BSD-3-Clause"], "ISC": ["ISC"],
    "GPL-2.0": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0"], "GPL-3.0": ["GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0"], "LGPL-2.1": ["LGPL-2.1-only", "LGPL-2.1-or-later"], "LGPL-3.0": ["LGPL-3.0-only", "LGPL-3.0-or-later"],
    "AGPL-3.0": ["AGPL-3.0-only", "AGPL-3.0-or-later"], "MPL-2.0": ["MPL-2.0"], "BSL-1.0": ["BSL-1.0"], "Zlib": ["Zlib"], "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0-1.0"], "CC-BY-4.0": ["CC-BY-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"],
}
TEMPLATES += [("Apache-2.0", "Licensed under the Apache License 2.0."), ("GPL-3.0", "Licensed under the GNU General Public License v3.0."), ("GPL-2.0", "Licensed under the GNU General Public License v2.0.")]
TEMPLATES += [(name, f"Licensed under the {own[0]} license.") for name, own in NAMES.items() if not own[0][:2] == "CC"]
TEMPLATES += [(name, f"SPDX-License-Identifier: {tag}") for name, own in NAMES.items() for tag in own if " " not in tag]
#: Full texts, compared as windows alone.
FULL_TEXTS: list[tuple[str, str]] = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    ),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
]
LEAST = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    words = re.findall("[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def bounds(n: int, least: float = LEAST) -> tuple[int, int]:
    """Least and greatest number of bigrams with which a text can reach `least` against n bigrams."""
    return math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)


def anchors(grams: list[str], least: float = LEAST) -> list[str]:
    """The longest bigrams, as a stand-in for the rarest: so many that a window which reaches `least` must hold one."""
    missing = len(grams) - bounds(len(grams), least)[0]
    return sorted(grams, key=lambda g: (-len(g), g))[: missing + 1]


#: Words of the templates that are frequent in English, so that they are taken last.
COMMON = frozenset(
    "a above acknowledgment all as by an and any anyone are arising available be basis being binary but by can charge code conditions covered damages deal direct distribution either "
    "entire event express file following for form free from full fullness general granted greater held hope if implied in including intellectual international is it language later law less limitation limitations limited list "
    "loss made may modification modify more must name national no not notice of on open or order organization origin other out parties party permitted person persons prior product products profits program promote provided "
    "public purpose purposes published receive received required rights see should source specific statement subject such substantial than that the their these this to under use used useful using version "
    "whether which whole will with without work works world written you your 0 1 2 3 4".split()
)


def telling_words(grams: list[list[str]], least: float = LEAST) -> list[str]:
    """Beginnings of words of which any unit that reaches `least` against one of the templates must hold at least one.

    Of n bigrams such a unit lacks at most n - lo, so words that touch more than that many of them cannot all be missing. Words are taken
    greedily: those that serve most templates, long ones first, as they are rarer in other texts, and frequent words last."""
    lack = [len(g) - bounds(len(g), least)[0] + 1 for g in grams]
    begins = lambda w: {w} if w in COMMON else {w, *(w[:k] for k in (6, 7) if k < len(w))}
    open_ = [{g: set().union(*map(begins, g.split(" "))) for g in own} for own in grams]
    weight = lambda w: len(w) ** 1.5 * (0.02 if w in COMMON else 1)
    out: list[str] = []
    while any(n > 0 for n in lack):
        gain: dict[str, int] = {}
        for n, own in zip(lack, open_, strict=True):
            if n > 0:
                touched: dict[str, int] = {}
                for words in own.values():
                    for w in words:
                        touched[w] = touched.get(w, 0) + 1
                for w, k in touched.items():
                    gain[w] = gain.get(w, 0) + min(k, n)
        best = min(gain, key=lambda w: (-gain[w] * weight(w), w))
        out.append(best)
        for k, own in enumerate(open_):
            gone = [g for g, words in own.items() if any(w.startswith(best) for w in words)]
            lack[k] -= len(gone)
            for g in gone:
                del own[g]
    return out


def telling_pattern(words: list[str]) -> str:
    """A pattern that finds a word which begins with one of `words`, in lower-case text; alternatives are parted by first letter."""
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0], []).append(w[1:])
    return "(?:^|[^a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items())) + ")"


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _windows(known: list[tuple[str, list[str]]], lengths: list[int], least: float) -> Column:
    """Hits of windows over `rest`: each has its template's number of words, and starts where one of its bigrams puts it."""
    shelf = F.array(
        *(
            F.struct(F.lit(k).alias("k"), F.lit(n).alias("words"), _strings(g).alias("grams"), _strings(anchors(g, least)).alias("anchors"))
            for k, ((_, g), n) in enumerate(zip(known, lengths, strict=True))
        )
    )
    done = F.transform(F.filter("line_hits", lambda h: h["line"] == 0), lambda h: -h["k"])
    near = F.filter(shelf, lambda t: F.arrays_overlap(F.col("rest_grams"), t["anchors"]) & ~F.array_contains(done, t["k"]))

    def windows(t: Column) -> Column:
        put = F.transform("rest_grams", lambda g, j: F.struct(j.alias("j"), F.array_position(t["grams"], g).cast("int").alias("at")))
        starts = F.array_distinct(F.transform(F.filter(put, lambda p: p["at"] > 0), lambda p: F.greatest(p["j"] - p["at"] + 1, F.lit(0))))

        def rated(start: Column) -> Column:
            grams = F.array_distinct(F.slice("rest_grams", start + 1, t["words"] - 1))
            dice = 2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"]))
            return F.struct((-dice).alias("worse"), start.alias("start"))

        def apart(kept: Column, w: Column) -> Column:
            clash = F.exists(kept, lambda other: F.abs(other["start"] - w["start"]) < t["words"])
            return F.when(clash, kept).otherwise(F.concat(kept, F.array(w)))

        # the best window first, then the best of those that don't overlap one taken before
        good = F.array_sort(F.filter(F.transform(starts, rated), lambda w: -w["worse"] >= least))
        taken = F.aggregate(good, F.array().cast("array<struct<worse:double,start:int>>"), apart)
        return F.transform(taken, lambda w: F.struct((-w["worse"]).alias("dice"), (-F.get(F.col("rest_lines"), w["start"])).alias("line"), (-t["k"]).alias("k")))

    return F.flatten(F.transform(near, windows))


def _pairs(words: Column) -> Column:
    """Bigrams in order, repeats included."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def _grams(words: Column) -> Column:
    return F.array_distinct(_pairs(words))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, full_texts: list[tuple[str, str]] = FULL_TEXTS) -> DataFrame:
    """(doc_id, license, dice, line, n_matches) for every row of docs.

    Needs doc_id and text; other columns are ignored. Units are the lines of the text, numbered from 1, and, where
    there are several, the whole text as line 0. Lines without a match are joined, and windows of as many words as a template, full texts included, are units
    under the line of their first word: the best one, and then each next best that overlaps none taken before. A-Z are lower-cased; words are runs of [a-z0-9]. license is that of the template
    with the highest coefficient, ties going to the earlier line, then the earlier template; n_matches counts
    pairs of unit and template that reach `least`. Without any, license, dice and line are null: so for null
    and empty texts. Repeated rows are each scanned. An empty table gives an empty result."""
    known = [(name, bigrams(text)) for name, text in templates]
    sizes = [bounds(len(g), least) for _, g in known]
    fewest, most = min(lo for lo, _ in sizes), max(hi for _, hi in sizes)
    shelf = F.array(
        *(
            F.struct(F.lit(k).alias("k"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.array(*map(F.lit, g)).alias("grams"))
            for k, ((_, g), (lo, hi)) in enumerate(zip(known, sizes, strict=True))
        )
    )
    sought = [*templates, *full_texts]
    wide = [(name, bigrams(text)) for name, text in sought]
    # in lower case the words only decide which texts are looked at
    gate = F.rlike("low", F.lit(telling_pattern(telling_words([g for _, g in wide], least))))
    plain = F.regexp_replace(F.translate(F.when(gate, F.col("text")).otherwise(""), UPPER, LOWER), "[^a-z0-9\n]+", " ")
    lines = F.split(plain, "\n")
    whole = F.when(F.size("lines") > 1, F.translate("plain", "\n", " ")).otherwise("")
    units = F.concat(F.array(whole), F.col("lines"))
    words = F.transform("units", lambda u, k: F.struct(k.alias("line"), F.filter(F.split(u, " "), lambda w: w != "").alias("words")))
    # V distinct words make V - 1 distinct bigrams at least, n words n - 1 at most
    fits = F.filter("spoken", lambda s: (F.size(s["words"]) > fewest) & (F.size(F.array_distinct(s["words"])) - 1 <= most))
    grams = F.transform("fits", lambda s: F.struct(s["line"].alias("line"), _grams(s["words"]).alias("grams")))

    def against(unit: Column) -> Column:
        n = F.size(unit["grams"])
        near = F.filter(F.col("shelf"), lambda t: n.between(t["lo"], t["hi"]))
        return F.transform(
            near,
            lambda t: F.struct(
                (2.0 * F.size(F.array_intersect(unit["grams"], t["grams"])) / (n + F.size(t["grams"]))).alias("dice"),
                (-unit["line"]).alias("line"),
                (-t["k"]).alias("k"),
            ),
        )

    hits = F.filter(F.flatten(F.transform("grams", against)), lambda h: h["dice"] >= least)
    steps = docs.select("doc_id", "text", F.lower("text").alias("low")).select("doc_id", plain.alias("plain")).withColumn("lines", F.split("plain", "\n"))
    steps = steps.withColumn("units", units).withColumn("spoken", words).withColumn("fits", fits).withColumn("grams", grams)
    steps = steps.withColumn("shelf", shelf).withColumn("line_hits", hits)
    lengths = [len(re.findall("[a-z0-9]+", text.lower())) for _, text in sought]
    matched = F.transform("line_hits", lambda h: -h["line"])
    # a line that matches leaves one word that is no word, so that no window joins what stands around it
    kept = F.transform(
        F.filter("spoken", lambda s: s["line"] > 0),
        lambda s: F.struct(s["line"].alias("line"), F.when(F.array_contains(matched, s["line"]), F.array(F.lit("."))).otherwise(s["words"]).alias("words")),
    )
    rest_lines = F.flatten(F.transform("kept", lambda s: F.array_repeat(s["line"], F.size(s["words"]))))
    every = sorted({a for _, g in wide for a in anchors(g, least)})
    # columns of their own, as a lambda would work out an expression anew for each element
    steps = steps.withColumn("kept", kept).withColumn("rest", F.flatten(F.transform("kept", lambda s: s["words"]))).withColumn("rest_lines", rest_lines)
    steps = steps.withColumn("rest_grams", F.when(F.size("rest") > 1, _pairs(F.col("rest"))).otherwise(F.array().cast("array<string>")))
    found = F.when(F.arrays_overlap("rest_grams", _strings(every)), _windows(wide, lengths, least)).otherwise(F.filter("line_hits", lambda h: F.lit(False)))
    steps = steps.withColumn("hits", F.concat("line_hits", found)).withColumn("best", F.array_max("hits"))
    names = _strings([name for name, _ in sought])
    return steps.select(
        "doc_id",
        F.get(names, -F.col("best.k")).alias("license"),
        F.col("best.dice").alias("dice"),
        (-F.col("best.line")).alias("line"),
        F.size("hits").cast("long").alias("n_matches"),
    )


def _sql_rows() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({k}, {quoted(name)}, [{', '.join(map(quoted, bigrams(text)))}])" for k, (name, text) in enumerate(TEMPLATES))


OP9_SQL = f"""
WITH t(k, name, grams) AS (VALUES {_sql_rows()}), p AS (
  SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9\\n]+', ' ', 'g') AS plain FROM documents
), l AS (
  SELECT doc_id, 0 AS line, replace(plain, chr(10), ' ') AS unit FROM p WHERE contains(plain, chr(10))
  UNION ALL
  SELECT doc_id, unnest(range(1, len(string_split(plain, chr(10))) + 1)), unnest(string_split(plain, chr(10))) FROM p
), w AS (
  SELECT doc_id, line, list_filter(string_split(unit, ' '), lambda x: x <> '') AS words FROM l
), g AS (
  SELECT doc_id, line, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams
  FROM w WHERE len(words) > 1
), h AS (
  SELECT doc_id, line, k, name, 2.0::DOUBLE * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice
  FROM g JOIN t ON list_has_any(g.grams, t.grams)
), b AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, line, k) AS r, count(*) OVER (PARTITION BY doc_id) AS n
  FROM h WHERE dice >= {LEAST}
)
SELECT p.doc_id, b.name AS license, b.dice, CAST(b.line AS INTEGER) AS line, coalesce(b.n, 0) AS n_matches
FROM p LEFT JOIN b ON p.doc_id = b.doc_id AND b.r = 1
"""
