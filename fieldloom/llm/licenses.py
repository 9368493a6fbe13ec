"""License scans: MinHash bands over overlapping windows retrieve templates, containment verifies them.

DataFrame functions only. A text's words become hashes of five-word shingles. Texts and long templates are
looked at in overlapping windows of shingles; windows that agree in all minima of a band retrieve the
template, whose shingles are then counted in the text around the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public license notices, headers and permission texts, by name and variant.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0 header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": "Released under the MIT License.",
    "mit text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "lgpl header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "mpl-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "bsd clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
SHINGLE = 5  #: words
WINDOW, STRIDE = 18, 6  #: shingles; any 13 in a row lie whole in some window
PART = WINDOW - STRIDE + 1  #: shingles of a template's window
MINIMA, ROWS = 8, 2  #: a band is any two of a window's eight minima, so there are 28


def collision(similarity: float, minima: int = MINIMA) -> float:
    """Probability that two windows of a Jaccard similarity agree in a band, that is in two minima."""
    miss = 1 - similarity
    return 1 - miss**minima - minima * similarity * miss ** (minima - 1)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingle_hashes(w: Column) -> Column:
    """Hash of each run of SHINGLE words; fewer words have none."""
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
    return F.when(F.size(w) >= SHINGLE, runs).otherwise(F.array().cast("array<long>"))


def _once(value: Column, then) -> Column:
    """``then`` of an array that is made once, as the only step of a fold, and not at each reference."""
    return F.aggregate(F.array(value), F.array().cast("array<long>"), lambda _, v: then(v))


def window_minima(h: Column, width: int, step: int, count: int) -> Column:
    """``count`` arrays of minima of seeded hashes, in each a value for every window."""
    least = lambda v, at, n: F.least(*(F.get(v, at + i) for i in range(n)))
    starts = lambda n, size, gap: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - size) / gap)).cast("int")), lambda i: i * gap)

    def minima(v: Column) -> Column:
        n = F.size(v)
        if width % step:
            return F.transform(starts(n, width, step), lambda at: least(v, at, width))
        # Windows overlap: the minima of stretches of `step` come first.
        parts = F.transform(starts(n, step, step), lambda at: least(v, at, step))
        return _once(parts, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - width) / step)).cast("int")), lambda i: least(p, i, width // step)))

    return F.array(*(_once(F.transform(h, lambda x: F.xxhash64(x, F.lit(k))), minima) for k in range(count)))


def license_scan(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    containment: float = 0.8,
    minima: int = MINIMA,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, license, variant, containment, first_word, n_windows``: the templates that a text holds.

    Texts are cut into windows of 18 five-word shingles, 6 apart, and templates of 17 words or more into
    windows of 13 shingles. A copy of one lies whole in a window of the text, so their similarity is
    13/18 or more, and they agree in a band, two of 8 minima, with a probability of 0.999; a long template
    has many such chances. Shorter templates (5 words at least) have windows of one shingle, as texts
    have for them: their minima are equal if and only if the shingles are.

    A retrieved template is verified exactly: the share of its distinct shingles that stand in the text
    within its own length of the window must be ``containment`` or more. Per row and template the best
    share is given, the word at which its first verified window begins, and the number of these. A name
    like "gpl header" is variant "header" of license "gpl".

    The templates are a short list given by the caller, and so are small in every plan. Null or empty
    texts, and those without a template, give no row; rows with equal or null ids are scanned one by one.
    """
    templates = TEMPLATES if templates is None else templates
    if not templates:
        raise ValueError("no templates")
    spark = docs.sparkSession
    rows_sql = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.lit(v).alias("notice")) for k, v in templates.items())))
    known = spark.range(1).select(rows_sql.alias("n")).select("n.name", F.explode(F.array(shingle_hashes(words(F.col("n.notice"))))).alias("h"))
    if known.filter(F.size("h") == 0).count():
        raise ValueError(f"templates must have {SHINGLE} words or more")
    long = F.size("h") >= PART
    several = known.filter(long).select("name", "h", F.posexplode(window_minima(F.col("h"), PART, STRIDE, minima)).alias("seed", "m")).select("name", "h", "seed", F.posexplode("m").alias("part", "key"))
    single = known.filter(~long).select("name", "h", F.lit(minima).alias("seed"), F.posexplode("h").alias("part", "key"))
    keys = several.unionByName(single).select("seed", "key", "name", "part", F.array_distinct("h").alias("wanted"))
    listed = [r[0] for r in keys.select("key").distinct().collect()]  # the templates' own keys
    marks = F.array(*(F.lit(x) for x in listed)).cast("array<long>")

    # Each array comes out of a generator of one row: the optimizer would otherwise put the whole
    # expression in the place of every reference, and split the text anew for every shingle.
    text = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.explode(F.array(words(F.col(f"`{text_col}`").cast("string")))).alias("w"))
    text = text.select("doc_id", "row", F.explode(F.array(shingle_hashes(F.col("w")))).alias("h")).filter(F.size("h") > 0)
    every = F.array_append(window_minima(F.col("h"), WINDOW, STRIDE, minima), F.col("h"))
    found = text.select("doc_id", "row", "h", F.explode(F.array(every)).alias("m"))
    # A text without any minimum of a template agrees with none in two.
    found = found.withColumn("hit", F.explode(F.array(F.array_intersect(F.flatten("m"), marks)))).filter(F.size("hit") > 0)
    found = found.select("doc_id", "row", "h", "hit", F.posexplode("m").alias("seed", "own"))
    found = found.filter(F.arrays_overlap("own", "hit")).select("doc_id", "row", "h", "seed", F.posexplode("own").alias("nth", "key"))
    found = found.withColumn("at", F.col("nth") * F.when(F.col("seed") < minima, STRIDE).otherwise(1))
    span = F.size("wanted")
    near = F.slice("h", F.greatest(F.lit(1), F.col("at") + 1 - span), WINDOW + 2 * span)
    share = F.size(F.array_intersect(near, F.col("wanted"))) / span
    hits = found.join(F.broadcast(keys), ["seed", "key"]).select("doc_id", "row", "name", "part", "at", "seed", share.alias("share")).filter(F.col("share") >= containment)
    agreed = hits.groupBy("row", "doc_id", "name", "part", "at").agg(F.count_distinct("seed").alias("n"), F.max("seed").alias("seed"), F.max("share").alias("share"))
    agreed = agreed.filter((F.col("n") >= ROWS) | (F.col("seed") == minima))
    out = agreed.groupBy("row", "doc_id", "name").agg(F.max("share").alias("containment"), F.min("at").cast("long").alias("first_word"), F.count_distinct("at").alias("n_windows"))
    name = F.split("name", " ", 2)
    return out.select("doc_id", name[0].alias("license"), F.coalesce(F.get(name, F.lit(1)), F.lit("")).alias("variant"), "containment", "first_word", "n_windows")
