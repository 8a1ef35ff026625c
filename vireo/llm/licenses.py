"""Licence scan, in DataFrame functions only.

A text is cut into units: its lines, its paragraphs of several lines (blank lines separate), and the whole. Each unit is normalised
(ASCII case folded; all ASCII but letters and digits separates words) and becomes its set of word bigrams. It is licensed by
the template whose set is most alike by the Dice coefficient 2 * common / (a + b), if that is at least THRESHOLD percent (of
equals, the last identifier in the alphabet).

Size bounds prune: with Dice at t, b lies between a * t / (2 - t) and a * (2 - t) / t, so a unit meets only templates of about
its size; and it must have a share t / (2 - t) of its own bigrams in the templates' vocabulary to meet any. A match has that
share of the template's bigrams too, so it holds one of a few words that touch more than the rest of them: texts and units
with none of those words are not even normalised. None of these bounds loses a match. The templates are literals of the plan: constants of the program, a few kilobytes.

Defined cases: null and empty texts match nothing, nor do units of one word; rows that repeat a doc_id count together, those
without one too; an empty table gives an empty result; other columns of the input are never read.
"""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vireo.llm.common import LOWER, UPPER, read_table

THRESHOLD = 80
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Short notices and standard passages of public licences, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("Zlib", "Licensed under the zlib License."),
    (
        "BSD-2-Clause OR BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_KEPT = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_LIABILITY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_LIABILITY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_LIABILITY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_ZLIB = "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."

#: Whole licences: texts that share most of their words, as the two of BSD, differ in a clause, and the more alike one is taken.
TEMPLATES += [
    ("BSD-2-Clause", f"{_BSD} {_BSD_KEPT} {_BSD_LIABILITY}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_KEPT} {_BSD_NAMES} {_BSD_LIABILITY}"),
    ("MIT", " ".join([next(t for n, t in TEMPLATES if n == "MIT" and t.startswith("Permission")), next(t for n, t in TEMPLATES if n == "MIT" and t.startswith("The above")), _MIT_LIABILITY])),
    ("ISC", " ".join([next(t for n, t in TEMPLATES if n == "ISC"), _ISC_LIABILITY])),
    ("Zlib", _ZLIB),
]


def _bigrams(text: str) -> list[str]:
    words = re.sub(SEPARATOR, " ", text.translate(str.maketrans(UPPER, LOWER))).split()
    return list(dict.fromkeys(" ".join(p) for p in zip(words, words[1:])))


def signs(templates: list[list[str]], percent: int = THRESHOLD) -> list[str]:
    """A few ASCII words, one of which is in every unit that matches a template (bigrams); none if there are no such words.

    A match may lack b * (200 - 2 * percent) / (200 - percent) of a template's b bigrams. Words are taken, the most useful and
    longest first, until those taken touch more of every template's bigrams than that.
    """
    open_ = [{tuple(x.split(" ")) for x in grams} for grams in templates]
    due = [len(g) + percent * len(g) // (percent - 200) + 1 for g in open_]
    taken: list[str] = []
    while any(due):
        gain: dict[str, int] = {}
        for pairs, n in zip(open_, due, strict=True):
            for w in {w for pair in pairs for w in pair if n and w.isascii()}:
                gain[w] = gain.get(w, 0) + min(n, sum(w in pair for pair in pairs))
        if not gain:
            return []
        word = max(gain, key=lambda w: (gain[w] if len(w) > 5 else 0, len(w), gain[w], w))
        taken.append(word)
        due = [max(0, n - sum(word in pair for pair in pairs)) for pairs, n in zip(open_, due, strict=True)]
        open_ = [{pair for pair in pairs if word not in pair} for pairs in open_]
    return [w for w in taken if not any(v in w for v in taken if v != w)]


def _has_sign(text: Column, words: list[str]) -> Column:
    """Whether any of the words is part of the text, case ignored; true where there are no words to look for."""
    if not words:
        return F.lit(True)
    # a function of an array's one element: the text is put in lower case once for all words
    return F.exists(F.array(F.lower(text)), lambda low: functools.reduce(operator.or_, (F.contains(low, F.lit(w)) for w in words)))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), SEPARATOR, " "))


def units(docs: DataFrame) -> DataFrame:
    """doc_id and unit: every line, every paragraph of several lines, and the text if it is several paragraphs or one of several lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).filter(F.length("t") > 0)
    blocks = F.filter(F.split("t", r"\n[\x20\t\r]*\n", -1), lambda p: F.contains(p, F.lit("\n")))
    blocks = F.when(F.contains("t", F.lit("\n\n")) | F.regexp_like("t", F.lit(r"\n[\x20\t\r]+\n")), blocks).otherwise(F.array().cast("array<string>"))
    whole = F.when(F.contains("t", F.lit("\n")), F.array("t")).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", F.explode(F.concat(F.split("t", "\n", -1), blocks, whole)).alias("unit"))


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, license, n_units (that match it) and best_dice of every document and licence it states."""
    t = [(name, grams) for name, text in templates if (grams := _bigrams(text))]
    least = min(len(g) for _, g in t) * percent / (200 - percent)
    most = max(len(g) for _, g in t) * (200 - percent) / percent
    words_due = signs([g for _, g in t], percent)
    marked = units(docs.select("doc_id", "text").filter(_has_sign(F.col("text"), words_due))).filter(_has_sign(F.col("unit"), words_due))
    normal = marked.select("doc_id", _normal(F.col("unit")).alias("n"))
    # a unit of k distinct bigrams has k bytes for spaces at least: too short or too long ones need no splitting
    words = normal.filter(F.length("n") >= least + 1).select("doc_id", F.split("n", " ").alias("w"))
    words = words.filter(F.size("w") >= 2)
    pairs = F.array_distinct(F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    grams = words.select("doc_id", pairs.alias("g")).withColumn("a", F.size("g")).filter(F.col("a").between(least, most))
    vocabulary = sorted({x for _, g in t for x in g})
    known = grams.withColumn("g", F.filter("g", lambda x: x.isin(vocabulary)))
    known = known.filter((200 - percent) * F.size("g") >= percent * F.col("a"))
    literal = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("b"), F.array(*map(F.lit, g)).alias("grams")) for name, g in t))
    fits = lambda x: ((200 - percent) * x["b"] >= percent * F.col("a")) & (percent * x["b"] <= (200 - percent) * F.col("a"))
    score = lambda x: F.struct((2 * F.size(F.array_intersect(F.col("g"), x["grams"])) / (F.col("a") + x["b"])).alias("dice"), x["license"].alias("license"))
    met = known.select("doc_id", F.array_max(F.transform(F.filter(literal, fits), score)).alias("best"))
    met = met.filter(100 * F.col("best.dice") >= percent)
    return met.groupBy("doc_id", F.col("best.license").alias("license")).agg(F.count("*").alias("n_units"), F.max(F.round("best.dice", 6)).alias("best_dice"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, n_units and best_dice of all documents. A passage that two licences share counts as either (SPDX's OR). Awkward cases: see the module."""
    return license_matches(read_table(spark, sf_dir, "documents"))


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, percent: int = THRESHOLD) -> str:
    """The same in DuckDB's SQL, without any pruning."""
    quoted = ",\n".join("('{}', '{}')".format(*(x.replace("'", "''") for x in t)) for t in templates)
    norm = f"string_split(trim(regexp_replace(translate(%s, '{UPPER}', '{LOWER}'), '{SEPARATOR}', ' ', 'g')), ' ')"
    grams = "list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
    return rf"""
WITH t(license, text) AS (VALUES {quoted}),
tw AS (SELECT row_number() OVER () AS tid, license, {norm % "text"} AS w FROM t),
tg AS (SELECT tid, license, {grams} AS g FROM tw),
d AS (SELECT doc_id, text AS t FROM documents WHERE length(text) > 0),
u AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS unit FROM d
      UNION ALL SELECT * FROM (SELECT doc_id, unnest(regexp_split_to_array(t, '\n[\x20\t\r]*\n')) AS unit FROM d WHERE regexp_matches(t, '\n[\x20\t\r]*\n')) WHERE contains(unit, chr(10))
      UNION ALL SELECT doc_id, t FROM d WHERE contains(t, chr(10))),
un AS (SELECT row_number() OVER () AS uid, doc_id, {norm % "unit"} AS w FROM u),
ug AS (SELECT uid, doc_id, {grams} AS g FROM un WHERE len(w) >= 2),
ux AS (SELECT uid, unnest(g) AS x FROM ug),
tx AS (SELECT tid, unnest(g) AS x FROM tg),
c AS (SELECT uid, tid, count(*) AS common FROM ux JOIN tx USING (x) GROUP BY uid, tid),
m AS (SELECT uid, doc_id, license, 2 * common / (len(ug.g) + len(tg.g)) AS dice FROM c JOIN ug USING (uid) JOIN tg USING (tid)),
top AS (SELECT doc_id, license, dice FROM m WHERE 100 * dice >= {percent} QUALIFY row_number() OVER (PARTITION BY uid ORDER BY dice DESC, license DESC) = 1)
SELECT doc_id, license, count(*) AS n_units, max(round(dice, 6)) AS best_dice FROM top GROUP BY doc_id, license
"""
