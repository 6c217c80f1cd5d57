"""License scans (9, native): Dice coefficient over word bigrams.

A text is one sequence of words (lower case, everything but letters and digits
is a space), so a notice is found inside a line as well as over many lines or
blocks. A window of it is compared with a licence template by the Dice
coefficient of their bigrams, in which a template bigram counts once and every
other bigram of the window each time:

    dice = 2 * c / (c + others + m)

with c template bigrams in the window and m in the template. The best window
begins and ends with a template bigram, so only those are tried: from each such
beginning every such end. Size bounds prune templates first: a window at the
threshold t has at least t / (2 - t) * m of the template's bigrams, so a text
with fewer is not compared; and a window has at most (2 - t) / t times the
template's length. A template's family words and all its bigrams with a digit
must be in the window: version 2 of a licence is never reported as version 3,
nor a Lesser or ShareAlike licence as the plain one.

Templates are a small literal of the plan; documents are neither shuffled nor
exploded into windows, only into templates that they may hold.

Defined results: null or empty text has no matches; words that make no bigram
match nothing; of overlapping windows of one template those with a better one
beside them (higher dice, then the earlier) are left out; several templates may
match one stretch (a 3-clause text holds most of the 2-clause one), the closest
has the highest dice; an empty table gives an empty result; repeated rows give
repeated matches; other columns are ignored.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Licence notices and short licence texts (public wording): id, text, family words.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0.", "apache license"),
    ("MIT", "Released under the MIT License.", "mit license"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", "gnu general public"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", "by nc"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "attribution 4"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "attribution sharealike"),
    ("all-rights-reserved", "All rights reserved.", ""),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
     "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
     "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the "
     "License.", "apache license"),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
     "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
     "in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
     "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN "
     "NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
     "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", ""),
    ("ISC-text", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
     "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
     "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
     "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
     "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", ""),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
     "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
     "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU "
     "General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "gnu general public"),
    ("Apache-2.0-short", "Licensed under the Apache License 2.0.", "apache license"),
    ("BSD-notice", "Licensed under the BSD License.", "bsd license"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "clause license"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "clause license"),
    ("BSD-style", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "a bsd style license"),
    ("ISC", "Released under the ISC License.", "isc license"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "gnu general public"),
    ("GPL-2.0-short", "Licensed under the GNU General Public License v2.0.", "gnu general public"),
    ("GPL-3.0-short", "Licensed under the GNU General Public License v3.0.", "gnu general public"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1.", "gnu lesser general public"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", "gnu lesser general public"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", "gnu affero general public"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla public license"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "eclipse public license"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered software"),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0.", "under cc0"),
    ("CC-BY-4.0-short", "Licensed under CC BY 4.0.", "cc by"),
    ("CC-BY-SA-4.0-short", "Licensed under CC BY-SA 4.0.", "by sa"),
    ("CC-BY-ND-4.0-short", "Licensed under CC BY-ND 4.0.", "by nd"),
    ("CC-BY-NC-SA-4.0-short", "Licensed under CC BY-NC-SA 4.0.", "nc sa"),
    ("CC-BY-NC-ND-4.0-short", "Licensed under CC BY-NC-ND 4.0.", "nc nd"),
    ("CC-BY-NC-4.0-long", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "attribution noncommercial"),
    ("GPL-2.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is "
     "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
     "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU "
     "General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "gnu general public"),
    ("LGPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
     "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
     "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy "
     "of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "gnu lesser general public"),
    ("AGPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
     "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
     "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy "
     "of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "gnu affero general public"),
    ("BSD-2-Clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
     "following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
     "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
     "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
     "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
     "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
     "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY "
     "WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", ""),
    ("BSD-3-Clause-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
     "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
     "following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the "
     "copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
     "specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
     "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE "
     "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
     "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
     "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
     "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY "
     "OF SUCH DAMAGE.", "endorse or promote products"),
]

THRESHOLD = 0.8


def words_of(col: str) -> str:
    return f"filter(split(regexp_replace(lower({col}), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '), ' '), w -> w != '')"


def bigrams_of(words: str) -> str:
    """Hashed bigrams of a word array, in order; none below two words."""
    return (f"CASE WHEN size({words}) < 2 THEN cast(array() as array<bigint>) ELSE "
            f"transform(sequence(1, size({words}) - 1), i -> xxhash64({words}[i - 1], {words}[i])) END")


def _longs(xs) -> str:
    return "cast(array(" + ", ".join(f"{x}L" if x > -2**63 else "bigint(-9223372036854775808)" for x in xs) + ") as array<bigint>)"


def _literal(spark, templates, threshold: float) -> tuple[str, str]:
    """The templates and their distinct bigrams as SQL literals."""
    rows = [(i, t[0], t[1], t[2] if len(t) > 2 else "") for i, t in enumerate(templates)]
    t = (spark.createDataFrame(rows, "no int, id string, body string, family string")
         .withColumn("w", F.expr(words_of("body"))).withColumn("f", F.expr(words_of("family"))))
    t = t.withColumn("g", F.expr(bigrams_of("w"))).withColumn("fg", F.expr(bigrams_of("f")))
    t = t.withColumn("digits", F.expr("transform(filter(sequence(1, greatest(size(w) - 1, 1)), i -> size(w) > 1 AND (w[i - 1] RLIKE '[0-9]' OR w[i] RLIKE '[0-9]')), i -> g[i - 1])"))
    rows = t.selectExpr("no", "id", "size(g) AS length", "array_distinct(g) AS g", "array_distinct(concat(digits, fg)) AS must").collect()
    most = (2 - threshold) / threshold + 1e-9
    one = [f"named_struct('no', {r.no}, 'license', '{r.id}', 'm', {len(r.g)}, 'need', {max(1, math.ceil(len(r.g) / most))}, 'longest', {int(most * r.length)}, "
           f"'g', {_longs(r.g)}, 'must', {_longs(r.must)})" for r in rows if r.length > 0]
    return "array(" + ", ".join(one) + ")", _longs(sorted({x for r in rows for x in r.g}))


def license_matches(docs: DataFrame, templates=None, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, license, template (its number), first_word, last_word (numbers of
    the window's words from 0), dice. ``templates``: (license, text) or (license,
    text, family words that must be in the window)."""
    lit, every = _literal(docs.sparkSession, templates or TEMPLATES, threshold)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.expr(words_of(f"coalesce(`{text}`, '')")).alias("w"))
    d = d.select("doc_id", F.expr(bigrams_of("w")).alias("g"))
    d = d.withColumn("known", F.expr(f"array_intersect(g, {every})"))
    d = d.withColumn("t", F.explode(F.expr(f"filter({lit}, t -> size(array_intersect(known, t.g)) >= t.need "
                                           f"AND size(array_intersect(known, t.must)) = size(t.must))"))).drop("known")
    # the template's bigrams in the text: place, place of the same bigram before, whether it must be there
    d = d.withColumn("hits", F.expr("array_sort(filter(transform(g, (x, i) -> named_struct('b', x, 'at', i)), h -> array_contains(t.g, h.b)))")).drop("g")
    d = d.withColumn("hits", F.expr("array_sort(transform(hits, (h, i) -> named_struct('at', h.at, 'before', if(i > 0 AND hits[greatest(i - 1, 0)].b = h.b, "
                                    "hits[greatest(i - 1, 0)].at, -1), 'must', array_contains(t.must, h.b))))"))
    new = "if(k.before < h.at, 1, 0)"
    dice = f"2.0D * (a.c + {new}) / ((a.c + {new}) + (k.at - h.at + 1) - (a.n + 1) + t.m)"
    ok = f"(k.at - h.at < t.longest AND a.u + if(k.must, {new}, 0) = size(t.must) AND {dice} > a.dice)"
    step = (f"named_struct('n', a.n + 1, 'c', a.c + {new}, 'u', a.u + if(k.must, {new}, 0), "
            f"'dice', if({ok}, {dice}, a.dice), 'to', if({ok}, k.at, a.to))")
    d = d.withColumn("wins", F.expr(
        f"filter(transform(hits, (h, i) -> aggregate(slice(hits, i + 1, t.longest), named_struct('n', 0, 'c', 0, 'u', 0, 'dice', 0.0D, 'to', -1), "
        f"(a, k) -> {step}, a -> named_struct('at', h.at, 'to', a.to, 'dice', a.dice))), x -> x.dice >= {threshold}D)")).drop("hits")
    d = d.withColumn("best", F.explode(F.expr(
        "filter(wins, (x, i) -> NOT exists(slice(wins, greatest(i - t.longest, 0) + 1, 2 * t.longest + 1), "
        "v -> v.at <= x.to AND x.at <= v.to AND (v.dice > x.dice OR (v.dice = x.dice AND v.at < x.at))))")))
    return d.select("doc_id", F.col("t.license").alias("license"), F.col("t.no").alias("template"), F.col("best.at").cast("long").alias("first_word"),
                    (F.col("best.to") + 1).cast("long").alias("last_word"), F.col("best.dice").alias("dice"))
