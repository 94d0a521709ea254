"""Licence scans: windows of normalised text against licence templates, by the Dice coefficient of their sets of word bigrams.

Texts and templates are lower-cased, and what stands between runs of a-z and 0-9 is left out. A window of words with U distinct bigrams matches a template with T
of them when 2 I / (U + T) >= least, I being the bigrams in common. Lines do not matter: a licence wrapped in a longer file and a notice within a line are windows like any other.

Where word x of a text begins a bigram that begins at word o of a template of n words, the template's diagonal is x - o, and its own window the n words from
there. A diagonal is strong with one in STRONG of the template's bigrams on it. Windows are those of strong diagonals, and those from the beginning of one to the end of a later one (words put into a copy
part its diagonals). As I <= min(U, T), only windows of T least / (2 - least) <= U <= T (2 - least) / least bigrams can match, and only in texts that
have T least / (2 - least) of the template's bigrams. As that is most of them, a match has one of any few of them that are more than the rest (seeds()): a
search for these spares most texts all else.

Of windows that match, one goes if a better one (more bigrams in common, then a higher coefficient, the earlier start, the earlier end, the first by name) covers over half of the shorter of the two.
DataFrame functions only. Null and empty texts and those of one word match nothing. A very long text is one array of words, and only its stretches around seeds are looked at. Repeated rows are scanned each on their own. Empty tables
give empty results. Extra columns are ignored.

The templates given here are notices, headers and short licences; full texts of long ones are read from files (read_templates) and scanned for in the same way.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Kept

LEAST, STRONG = 0.8, 8
#: Words that most English texts have.
COMMON = frozenset("a all and any as at be by for from if in is it may not of or that the this to under was will with you".split())
#: Bytes of templates that are read from files.
TEMPLATE_BYTES = 16 << 20
#: Windows meet others that touch a stretch of so many words.
STRETCH = 256
#: Notices and licences by which texts declare their terms.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT notice": "Released under the MIT License.",
    "MIT notice 2": "Licensed under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 long notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 long notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 long notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0 notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>",
    "All rights reserved": "Copyright. All rights reserved.",
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def bigrams(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def needed(t: int, least: float) -> int:
    """Least number of a template's t bigrams that a match has."""
    return math.ceil(t * least / (2 - least) - 1e-9)


def seeds(sets: dict[str, set], least: float) -> list[str]:
    """Bigrams such that every match of a template has one of them: of each template so many that the others are too few for a match, those without common words and of many letters first."""
    def plain(gram: str):
        return sum(w in COMMON for w in gram.split()), -len(gram), gram

    return sorted({g for grams in sets.values() for g in sorted(grams, key=plain)[: len(grams) - needed(len(grams), least) + 1]})


def pattern_of(grams: list[str]) -> str:
    """A regular expression of any of these bigrams, by common beginnings, so that a place in a text meets one branch for each letter."""
    def branch(tails: list[str]) -> str:
        if tails == [""]:
            return ""
        heads: dict = {}
        for t in tails:
            heads.setdefault(t[:1], []).append(t[1:])
        parts = [("[^a-z0-9]++" if h == " " else h) + branch(sorted(heads[h])) for h in sorted(heads) if h]
        return (parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})") if "" not in heads else f"(?:{'|'.join([*parts, '(?![a-z0-9])'])})"

    return f"(?<![a-z0-9]){branch(sorted(grams))}(?![a-z0-9])"


def index_of(templates: dict[str, str]) -> list[tuple[str, str, int, int, int]]:
    """(bigram, template, its place, words of the template, distinct bigrams) for each place of each template."""
    out = []
    for name, text in sorted(templates.items()):
        w = words_of(text)
        out += [(g, name, o, len(w), len(set(bigrams(w)))) for o, g in enumerate(bigrams(w))]
    return out


def read_templates(spark: SparkSession, path: str) -> dict[str, str]:
    """Templates for scan() from a folder of licence texts, one a file, named by the files without their suffix .txt: full licences, as files named LICENSE hold them. Texts of more than TEMPLATE_BYTES together are refused, as all of them go to every executor."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_name", r"\.txt$", "").alias("name"), "value")
    size = files.agg(F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("n")).first()["n"]
    if size > TEMPLATE_BYTES:
        raise ValueError(f"{size} bytes of templates; {TEMPLATE_BYTES} at most")
    return {r["name"]: r["value"] for r in files.collect()}


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, strong: int = STRONG) -> DataFrame:
    """doc_id, template, first_word and n_words (of the normalised text), shared, dice of each window that matches and stays."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    places = index_of(templates)
    sets = {k: set(bigrams(words_of(t))) for k, t in templates.items()}
    schema = "bigram string, template string, o int, n int, t int"
    index = F.broadcast(spark.createDataFrame(places, schema))
    sizes = F.broadcast(spark.createDataFrame([(k, sorted(s), len(s)) for k, s in sets.items()], "template string, grams array<string>, size int"))
    low = F.lower("text")
    # Few texts are left by the search; they are written once, with numbers that all of what follows shares.
    rows = docs.where(low.rlike(pattern_of(seeds(sets, least))) if places else F.lit(False)).select("doc_id", F.monotonically_increasing_id().alias("row"), F.filter(F.split(low, "[^a-z0-9]+"), lambda w: w != "").alias("w"))
    rows = Kept(rows.where(F.size("w") > 1), "licence-texts").df
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    met = rows.select("row", F.posexplode(pairs).alias("x", "bigram")).join(index, "bigram")
    # Texts without enough of a template's bigrams have no match of it.
    ratio = least / (2 - least)
    enough = met.groupBy("row", "template", "t").agg(F.count_distinct("bigram").alias("has")).where(F.col("has") >= F.ceil(F.col("t") * ratio - 1e-9)).select("row", "template")
    diagonals = met.join(enough, ["row", "template"]).groupBy("row", "template", "n", "t", (F.col("x") - F.col("o")).alias("d")).agg(F.count("*").alias("hits")).where(F.col("hits") * strong >= F.col("t"))
    d = diagonals.select("row", "template", "n", "t", "d")
    # From the beginning of one diagonal to the end of another not much later: diagonals meet in stretches.
    most = F.floor(F.col("n") * ((1 / ratio) - 1))
    here = d.withColumn("s", F.explode(F.sequence(F.floor(F.col("d") / STRETCH), F.floor((F.col("d") + most) / STRETCH))))
    there = d.select("row", "template", F.col("d").alias("e"), F.floor(F.col("d") / STRETCH).alias("s"))
    spans = here.join(there, ["row", "template", "s"]).where((F.col("e") >= F.col("d")) & (F.col("e") <= F.col("d") + most))
    window = F.slice("w", F.greatest("d", F.lit(0)) + 1, F.greatest(F.col("e") + F.col("n"), F.lit(0)) - F.greatest("d", F.lit(0)))
    spans = spans.select("row", "template", "t", "d", "e", "n").join(rows.select("row", "doc_id", "w"), "row")
    spans = spans.select("doc_id", "row", "template", "t", F.greatest("d", F.lit(0)).alias("first_word"), window.alias("v"))
    held = F.array_distinct(F.zip_with(F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0))), F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))
    spans = spans.select("doc_id", "row", "template", "t", "first_word", F.size("v").alias("n_words"), held.alias("held")).withColumn("u", F.size("held"))
    spans = spans.where((F.col("u") >= F.col("t") * ratio - 1e-9) & (F.col("u") <= F.col("t") / ratio + 1e-9)).join(sizes, "template")
    spans = spans.withColumn("shared", F.size(F.array_intersect("held", "grams"))).withColumn("dice", 2.0 * F.col("shared") / (F.col("u") + F.col("t"))).where(F.col("dice") >= least)
    close = spans.select("doc_id", "row", "template", "first_word", "n_words", "shared", "dice").distinct()
    close = Kept(close, "licence-windows").df
    # Better windows that cover over half of one: they touch a stretch together. The best of each stretch come first, so that a stretch of many windows is no pairing of all.
    end = F.col("first_word") + F.col("n_words")
    touched = close.withColumn("s", F.explode(F.sequence(F.floor(F.col("first_word") / STRETCH), F.floor((end - 1) / STRETCH))))
    a, b = touched.alias("a"), touched.alias("b")
    order = "struct(-{0}.shared, -{0}.dice, {0}.first_word, {0}.n_words, {0}.template)"
    over = "2 * (least(a.first_word + a.n_words, b.first_word + b.n_words) - greatest(a.first_word, b.first_word)) > least(a.n_words, b.n_words)"
    beaten = a.join(b, F.expr(f"a.row = b.row and a.s = b.s and {order.format('b')} < {order.format('a')} and {over}")).select("a.row", "a.template", "a.first_word", "a.n_words").distinct()
    return close.join(beaten, ["row", "template", "first_word", "n_words"], "left_anti").select("doc_id", "template", "first_word", "n_words", "shared", "dice")


def scan_sql(least: float = LEAST, strong: int = STRONG) -> str:
    """The same rows of documents in DuckDB's SQL, without the seeds and the search by stretches; for rows without repeats."""
    quoted = ", ".join("('" + g + "', '" + k.replace("'", "''") + f"', {o}, {n}, {t})" for g, k, o, n, t in index_of(TEMPLATES))
    better = "(-b.shared, -b.dice, b.first_word, b.n_words, b.template) < (-a.shared, -a.dice, a.first_word, a.n_words, a.template)"
    ratio = f"({least}::DOUBLE / (2 - {least}::DOUBLE))"
    return f"""
    WITH t(bigram, template, o, n, t) AS (VALUES {quoted}), grams AS (SELECT template, list(DISTINCT bigram) AS grams FROM t GROUP BY template),
    r AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda y: y <> '') AS w FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(range(len(w) - 1)) AS x, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM r WHERE len(w) > 1),
    m AS (SELECT * FROM p JOIN t USING (bigram)),
    en AS (SELECT doc_id, template FROM m GROUP BY doc_id, template, t HAVING count(DISTINCT bigram) >= ceil(t * {ratio} - 1e-9)),
    d AS (SELECT doc_id, template, n, t, x - o AS d FROM m JOIN en USING (doc_id, template) GROUP BY ALL HAVING count(*) * {strong} >= t),
    s AS (SELECT a.doc_id, a.template, a.t, greatest(a.d, 0) AS first_word, greatest(b.d + a.n, 0) - greatest(a.d, 0) AS size FROM d a JOIN d b ON a.doc_id = b.doc_id AND a.template = b.template AND b.d >= a.d AND b.d <= a.d + floor(a.n * (1 / {ratio} - 1))),
    v AS (SELECT DISTINCT s.doc_id, s.template, t, first_word, w[first_word + 1 : first_word + size] AS v FROM s JOIN r USING (doc_id)),
    h AS (SELECT doc_id, template, t, first_word, len(v) AS n_words, list_distinct(list_transform(range(1, len(v)), lambda i: v[i] || ' ' || v[i + 1])) AS held FROM v),
    c AS (SELECT DISTINCT doc_id, template, first_word, n_words, len(list_intersect(held, grams)) AS shared, 2.0::DOUBLE * len(list_intersect(held, grams)) / (len(held) + t) AS dice FROM h JOIN grams USING (template)
     WHERE 2.0::DOUBLE * len(list_intersect(held, grams)) / (len(held) + t) >= {least})
    SELECT doc_id, template, first_word, n_words, shared, dice FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.doc_id = a.doc_id AND {better}
     AND 2 * (least(a.first_word + a.n_words, b.first_word + b.n_words) - greatest(a.first_word, b.first_word)) > least(a.n_words, b.n_words))"""
