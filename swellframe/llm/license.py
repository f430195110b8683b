"""Licence scans: windows of normalised text compared to licence templates by the Dice coefficient of word bigrams; DataFrame expressions only.

Text is normalised (lower case, other than a-z and 0-9 to single spaces, so line breaks don't matter) and cut into words. Templates are notices of a
line, standard headers and whole licences. Comparing every window of every size with each of them is pruned by sizes:

* Dice >= t between sets of a and b bigrams needs b * t / (2 - t) <= a <= b * (2 - t) / t, and hence b * t / (2 - t) common ones. So
  of any b - ceil(b * t / (2 - t)) + 1 bigrams of a template, a window that reaches t has one. A template's longest bigrams, the rarest, are its
  anchors.
* Where an anchor of place j stands at place i of a text, the window of as many words as the template has, from i - j on, is compared: a copy is aligned
  by any anchor that it has, one with words put in or left out by those before or after the change. Windows outside the size bounds are left out.
* Windows of a text that overlap are one notice, of the likest template, then the first by name.

A text's words meet the anchors by a broadcast of the anchors, under a counted bound; only where one stands are bigrams built. Texts never move.

Defined results: null texts have no words; texts of fewer than two words have no bigrams and match nothing; rows that repeat a doc_id are scanned
apart and reported as one document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .decontam import small

#: Notices of a line that name a licence.
NOTICES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause Simplified License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause New or Revised License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law the author has waived all copyright and related rights to this work.",
    "EPL-2.0": "Licensed under the Eclipse Public License, Version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Standard headers and whole licences, without title, copyright line and names.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright
notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE
USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY
WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY
DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,
OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy
of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy
of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should
have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one
at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author
or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and
to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
TEMPLATES = [*sorted(NOTICES.items()), *sorted(TEXTS.items())]


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(w: Column, start: Column, stop: Column) -> Column:
    """Distinct pairs of neighbouring words from place start (from 0) to before stop; none for fewer than two words."""
    pairs = F.transform(F.sequence(start, F.greatest(stop - 2, start)), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    return F.when(stop - start > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def template_table(templates: DataFrame, least: float) -> DataFrame:
    """template (a number), licence, size (words), of (bigrams), low and high (bounds of a window's bigrams), anchors (first, second, place in the template).

    Written after each step: the table is small, and no expression is put into the next.
    """
    t = stored(templates.select(F.xxhash64("licence", "template").alias("template"), "licence", F.split(normalised(F.col("template")), " ").alias("w")), "templates")
    t = stored(t.where(F.size("w") > 1).withColumn("of", bigrams(F.col("w"), F.lit(0), F.size("w"))).withColumn("b", F.size("of")), "templates")
    t = t.withColumns({"low": F.ceil(F.col("b") * least / (2 - least) - 1e-9).cast("int"), "high": F.floor(F.col("b") * (2 - least) / least + 1e-9).cast("int")})
    rarest = F.sort_array(F.transform("of", lambda g: F.struct((-F.length(g)).alias("n"), g.alias("g"))))
    t = stored(t.withColumn("rare", F.transform(F.slice(rarest, 1, F.col("b") - F.col("low") + 1), lambda x: x.g)), "templates")
    places = F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda j: F.struct(F.get("w", j).alias("first"), F.get("w", j + 1).alias("second"), j.alias("place")))
    anchors = F.filter(places, lambda p: F.array_contains("rare", F.concat_ws(" ", p.first, p.second)))
    return stored(t.select("template", "licence", F.size("w").alias("size"), "of", "low", "high", anchors.alias("anchors")), "templates")


def matches(docs: DataFrame, templates: DataFrame | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, licence, start, stop (words of the normalised text), dice: every compared window that reaches `least`."""
    if templates is None:
        templates = docs.sparkSession.createDataFrame(TEMPLATES, "licence string, template string")
    table = template_table(templates, least)
    anchors = stored(table.select("template", F.inline("anchors")), "anchors")
    near = F.broadcast if small(anchors) else (lambda df: df)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.split(normalised(F.col(text_col)), " ").alias("words"))
    places = rows.select("doc_id", "row", "words", F.posexplode("words").alias("at", "word"))
    found = places.join(near(anchors), F.col("word") == F.col("first")).where(F.get("words", F.col("at") + 1) == F.col("second"))
    found = found.select("doc_id", "row", "words", "template", (F.col("at") - F.col("place")).alias("from"))
    found = found.join(near(table.drop("anchors").withColumnRenamed("template", "own")), F.col("template") == F.col("own"))
    start, stop = F.greatest("from", F.lit(0)), F.least(F.col("from") + F.col("size"), F.size("words"))
    window = F.when(F.col("template").isNotNull(), bigrams(F.col("words"), start, stop))
    # one struct, so that the window is built once for each anchor that is found
    found = found.select("doc_id", "row", "licence", start.alias("start"), stop.alias("stop"), F.inline(F.array(F.struct(window.alias("window"), F.col("of"), F.col("low"), F.col("high")))))
    common = F.size(F.array_intersect("window", "of"))
    dice = F.when(F.size("window").between(F.col("low"), F.col("high")), F.round(2.0 * common / (F.size("window") + F.size("of")), 6))
    return found.select("doc_id", "row", "licence", "start", "stop", dice.alias("dice")).where(F.col("dice") >= least)


def notices(docs: DataFrame, templates: DataFrame | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row, start, licence, dice of every notice: of windows that overlap the likest, then the first by name."""
    hits = matches(docs, templates, least, id_col, text_col).groupBy("row", "doc_id", "start", "stop", "licence").agg(F.max("dice").alias("dice"))
    before = Window.partitionBy("row").orderBy("start", "stop", "licence").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("opens", F.when(F.col("start") < F.max("stop").over(before), 0).otherwise(1))
    hits = hits.withColumn("notice", F.sum("opens").over(Window.partitionBy("row").orderBy("start", "stop", "licence").rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min(F.struct((-F.col("dice")).alias("d"), F.col("licence").alias("l")))
    out = hits.groupBy("row", "doc_id", "notice").agg(F.min("start").alias("start"), best.alias("best"))
    return out.select("doc_id", "row", "start", F.col("best.l").alias("licence"), (-F.col("best.d")).alias("dice"))


def scan(docs: DataFrame, templates: DataFrame | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_notices, licence and dice of the likest notice (null without one), a row per doc_id."""
    best = F.min(F.struct((-F.col("dice")).alias("d"), F.col("licence").alias("l")))
    per_doc = notices(docs, templates, least, id_col, text_col).groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"), best.alias("best"))
    every = docs.select(F.col(id_col).alias("doc_id")).distinct()
    out = every.join(per_doc, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_notices"), F.col("best.l").alias("licence"), (-F.col("best.d")).alias("dice"))


def _sql() -> str:
    plain = lambda t: re.sub("[^a-z0-9]+", " ", t.lower()).strip()
    rows = ", ".join(f"({i}, '{k}', '{plain(v)}')" for i, (k, v) in enumerate(TEMPLATES))
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
with t as (select id, licence, w, {grams.format("w")} g from (select id, licence, string_split(template, ' ') w from (values {rows}) v(id, licence, template))),
tb as (select *, ceil(len(g) * 0.8 / 1.2 - 1e-9)::int low, floor(len(g) * 1.2 / 0.8 + 1e-9)::int high from t),
rare as (select id, x from (select id, x, low, b, row_number() over (partition by id order by length(x) desc, x) r from (select id, low, len(g) b, unnest(g) x from tb)) where r <= b - low + 1),
p as (select id, unnest(range(1, len(w))) j, w from t), a as (select p.id, j - 1 place, w[j] f, w[j + 1] s from p join rare on rare.id = p.id and x = w[j] || ' ' || w[j + 1]),
d as (select row_number() over () r, doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') w from documents),
e as (select r, unnest(range(1, len(w))) i, w from d), h as (select distinct e.r, a.id, i - 1 - place pos from e join a on w[i] = f and w[i + 1] = s),
x as (select h.r, doc_id, tb.licence, greatest(h.pos, 0) start, least(h.pos + len(tb.w), len(d.w)) stop, tb.g, tb.low, tb.high, d.w[greatest(h.pos, 0) + 1 : least(h.pos + len(tb.w), len(d.w))] o from h join d using (r) join tb using (id)),
y as (select r, doc_id, licence, start, stop, g, {grams.format("o")} q, low, high from x),
m as (select distinct r, doc_id, licence, start, stop, round(2.0 * len(list_intersect(q, g)) / (len(q) + len(g)), 6) dice from y where len(q) between low and high),
k as (select * from m where dice >= 0.8),
o as (select *, case when start < max(stop) over (partition by r order by start, stop, licence rows between unbounded preceding and 1 preceding) then 0 else 1 end opens from k),
n as (select *, sum(opens) over (partition by r order by start, stop, licence rows unbounded preceding) notice from o),
b as (select r, doc_id, notice, arg_min(licence, (-dice, licence)) licence, max(dice) dice from n group by 1, 2, 3),
c as (select doc_id, count(*) n, arg_min(licence, (-dice, licence)) licence, max(dice) dice from b group by doc_id)
select d.doc_id, coalesce(n, 0)::bigint n_notices, licence, dice from (select distinct doc_id from documents) d left join c on d.doc_id is not distinct from c.doc_id
"""


SQL = _sql()
