"""License scan: MinHash bands over overlapping text windows, then exact containment.

Templates are of any length.  One that takes n shingles can lie in ``reach`` = n * 100 / ``percent``
shingles of a text; templates of about the same reach are a length class, and the class's windows
are twice as long and start at every multiple of half their length.  So whatever lies within
``reach`` shingles of any start position lies whole in one window of its class.

Each of a window's MinHash values is a band of its own: a window retrieves every template of its
class with an equal value.  A place that holds need = m * ``percent`` / 100 of a template's m shingles
makes the similarity of its window and the template at least s = need / (window + m - need); the
class has as many bands as make the chance (1 - s) ** bands to miss it ``MISS`` or less.

Equal MinHash values come from equal shingles, and a place lacks at most m - need of a template's
shingles, so it holds one of any m - need + 1; only windows with one of those get MinHash values.  What
is retrieved is verified exactly, at every start position of the window: the share of the template's
shingles in the next ``reach`` ones.  Of places that overlap only the best counts.  No text is shuffled.

``license_places`` judges every start position without windows: see there.  All work is done
in DataFrame expressions.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flawscope.session import materialize

PERCENT = 80
MISS = 1e-6  # chance that a window with a place of just ``percent`` is not retrieved

# Short public license notices, by SPDX identifier
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "MPL-2.0": "This file is subject to the Mozilla Public License, version 2.0.",
}

# Whole texts and file headers of the same licenses
TEXTS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
        except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
        PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR
        ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
        OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    **{f"GPL-{v}.0": f"""This program is free software; you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation; either version {v} of the
        License, or (at your option) any later version. This program is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
        PARTICULAR PURPOSE. See the GNU General Public License for more details.""" for v in (2, 3)},
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: 1. Redistributions of source code must retain
        the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the
        name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
        IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
        SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
        GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
        ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
}
TEMPLATES = [*NOTICES.items(), *TEXTS.items()]  # (license, text); a license can have several


def words(text) -> Column:
    """Lower-cased runs of letters and digits."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(F.split(t, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w) -> Column:
    """32-bit hashes of neighbouring words, in order; one word is one shingle, none has none."""
    n = F.size(w)
    two = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n, F.lit(1))),
                     lambda a, b: F.hash(a, b))
    return F.when(n >= 2, two).when(n == 1, F.transform(w, lambda a: F.hash(a))).otherwise(F.array().cast("array<int>"))


def templates_of(spark: SparkSession, templates: list[tuple[str, str]], percent: int) -> DataFrame:
    """t (number), license, template (distinct shingles), n_shingles, reach (shingles of text that are
    judged at once: the length of the template and as much more as percent leaves open), letters (of
    each of the distinct shingles, where it first stands)."""
    rows = [F.struct(F.lit(t).alias("t"), F.lit(k).alias("license"), F.lit(v).alias("notice"))
            for t, (k, v) in enumerate(templates)]
    return (spark.range(1).select(F.inline(F.array(*rows)))
            .select("t", "license", words(F.col("notice")).alias("w")).withColumn("s", shingles(F.col("w"))).where(F.size("s") > 0)
            .select("t", "license", F.array_distinct("s").alias("template"),
                    F.size(F.array_distinct("s")).alias("n_shingles"),
                    F.expr("transform(array_distinct(s), h -> length(array_join(slice(w, cast(array_position(s, h) as int), 2), '')))")
                    .alias("letters"),
                    F.expr(f"cast((size(s) * 100 + {percent - 1}) div {percent} as int)").alias("reach")))


def _rivals(known: DataFrame, percent: int) -> DataFrame:
    """t, apart: for each template of another license that shares ``percent`` of t's shingles, those that it
    does not share."""
    other = known.select(F.col("license").alias("l"), F.col("template").alias("o"))
    apart = F.array_except("template", "o")
    return (known.join(F.broadcast(other), F.col("license") != F.col("l"))
            .where((F.size(F.array_intersect("template", "o")) * 100 >= F.col("n_shingles") * percent) & (F.size(apart) > 0))
            .groupBy("t").agg(F.collect_list(apart).alias("apart")))


def license_places(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
                   percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text), template and start position that holds it: doc_id, row, t, license,
    start, end, n_found, n_shingles, held.

    The distinct shingles of a template of n (with repeats) are counted in the ``reach`` = n * 100 / ``percent``
    shingles from every position on where one of them stands; ``percent`` or more of them are a
    place (n_found).  Its end is behind the last of the first occurrences; held are those shingles by
    which the template differs from one that is nearly the same.

    Exact, whatever the template's length and alignment: of a template's m shingles a place lacks at
    most m - m * ``percent`` / 100, so it holds one of any more than that; texts that hold none of
    each template's so many rarest go no further.  A shingle that was last before at q and stands at p
    counts for the starts after q and p - reach up to p; the counts of all starts are the running sum of that.
    """
    known = templates_of(docs.sparkSession, templates, percent)
    listed = [r["template"] for r in known.collect()]  # as many as the templates have
    often = Counter(h for x in listed for h in x)
    seeds = sorted({h for x in listed for h in sorted(x, key=lambda h: (often[h], h))
                    [:len(x) - -(-len(x) * percent // 100) + 1]})
    marks = _rivals(known, percent).select("t", F.explode(F.flatten("apart")).alias("h")).distinct().withColumn("mark", F.lit(True))
    postings = known.withColumn("h", F.explode("template")).drop("template", "letters").join(F.broadcast(marks), ["t", "h"], "left")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"),
                        shingles(words(F.col("text"))).alias("s")).where(F.arrays_overlap("s", F.lit(seeds)))
    of_shingle = Window.partitionBy("row", "t", "h").orderBy("at")
    hits = materialize(
        texts.select("doc_id", "row", F.posexplode("s").alias("at", "h")).join(F.broadcast(postings), "h")
        .repartition("row", "t").withColumn("before", F.coalesce(F.lag("at").over(of_shingle), F.lit(-1))), "table")

    counts = F.array(F.struct(F.greatest(F.col("before") + 1, F.col("at") - F.col("reach") + 1).alias("at"), F.lit(1).alias("d")),
                     F.struct((F.col("at") + 1).alias("at"), F.lit(-1).alias("d")))
    key, by_start = ["doc_id", "row", "t", "license", "n_shingles", "reach"], Window.partitionBy("row", "t").orderBy("at")
    places = (hits.select(*key, F.inline(counts)).groupBy(*key, "at").agg(F.sum("d").alias("d"), F.min("d").alias("least"))
              .select(*key, F.sum("d").over(by_start).alias("n_found"), (F.lead("at").over(by_start) - 1).alias("start"),
                      (F.lead("least").over(by_start) < 0).alias("here"))
              .where("here and n_found * 100 >= n_shingles * %d" % percent))
    part = places.withColumn("part", F.explode(F.expr("array(start div reach, start div reach + 1)")))
    held = hits.select("row", "t", "h", "mark", "at", "before", F.expr("at div reach").alias("part"))
    return (part.join(held, ["row", "t", "part"]).where("at >= start and at < start + reach and before < start")
            .groupBy("doc_id", "row", "t", "license", "start", "n_found", "n_shingles")
            .agg((F.max("at") + 1).alias("end"), F.collect_set(F.when(F.col("mark"), F.col("h"))).alias("held")))


def best_places(places: DataFrame, rivals: DataFrame) -> DataFrame:
    """Of ``places`` (doc_id, row, t, license, start, end, n_found, n_shingles, held) those that count, per
    document row and license: doc_id, license, n_places, n_found, n_shingles, sure; see ``license_matches``."""
    told = F.coalesce(F.forall("apart", lambda a: F.arrays_overlap(a, "held")), F.lit(True))
    in_text = Window.partitionBy("row").orderBy("start", "end", "t")
    before = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    chains = (places.join(F.broadcast(rivals), "t", "left").withColumn("told", told)
              .withColumn("new", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
              .withColumn("chain", F.sum("new").over(in_text)).groupBy("doc_id", "row", "chain")
              .agg(F.array_sort(F.collect_list(F.struct(
                  (-F.col("n_found")).alias("less"), F.col("n_shingles").alias("m"), (F.col("end") - F.col("start")).alias("n"),
                  "start", "end", "license", "told"))).alias("places")))
    both = "greatest(0, least(k.end, x.end) - greatest(k.start, x.start))"
    other = "k.license <> x.license and (k.less <> x.less or k.m <> x.m)"
    kept = F.expr(f"""aggregate(places, slice(places, 1, 0), (kept, x) -> if(
        exists(kept, k -> k.license = x.license and {both} > 0 or {other} and 2 * {both} >= least(k.n, x.n))
        or 2 * aggregate(kept, 0, (n, k) -> n + if({other}, {both}, 0)) >= x.n, kept, array_append(kept, x)))""")
    sure = F.expr(f"x.told and not exists(kept, k -> k.license <> x.license and 2 * {both} >= least(k.n, x.n))")
    best = F.max(F.struct((-F.col("x.less")).alias("n_found"), (-F.col("x.m")).alias("m")))
    return (chains.withColumn("kept", kept).select("doc_id", "row", "kept", F.explode("kept").alias("x"))
            .groupBy("doc_id", "row", F.col("x.license").alias("license"))
            .agg(F.count("*").alias("n_places"), best.alias("b"), F.max(sure).alias("sure"))
            .select("doc_id", "license", "n_places", F.col("b.n_found").cast("long").alias("n_found"),
                    (-F.col("b.m")).cast("long").alias("n_shingles"), "sure"))


def license_matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
                    percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) and license found: doc_id, license, n_places, n_found (most
    shingles of a template at one place), n_shingles (of that template), sure.

    See ``license_places``.  Of places that overlap, the one that holds the most shingles counts, among
    equals that of the template with the fewest, then the shortest: a place goes when it overlaps one of
    its own license that counts, or lies by half (of the shorter one) in others.  What is still equal
    (a GPL notice without its version) comes back for each license, not ``sure``; nor is a place
    ``sure`` that has no shingle by which the template differs from one that is nearly the same ('CC BY-ND
    4.0', of which there is no template, holds four of the five shingles of CC-BY-4.0).

    Null and empty texts have no words and give no row.  Equal rows are one document; rows with
    equal or null doc_id and other texts are judged each.  Extra columns are ignored.
    """
    rivals = _rivals(templates_of(docs.sparkSession, templates, percent), percent)
    return best_places(license_places(docs, templates, percent), rivals)


def length_classes(rows: list, percent: int, miss: float) -> dict[int, tuple[int, int]]:
    """t -> (half, bands) of the templates' ``rows`` (t, template, reach): half a window is the reach,
    rounded up by at most a quarter; bands are those of the class's least similar template."""
    half = {}
    for r in rows:
        h = 2
        while h < r["reach"]:
            h = -(-h * 5 // 4)
        half[r["t"]] = h
    bands = Counter()
    for r in rows:
        m, h = len(r["template"]), half[r["t"]]
        need = -(-m * percent // 100)
        bands[h] = max(bands[h], math.ceil(math.log(miss) / math.log1p(-need / (2 * h + m - need))))
    return {t: (h, bands[h]) for t, h in half.items()}


def window_places(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT,
                  miss: float = MISS) -> DataFrame:
    """As ``license_places``, for the windows that MinHash bands retrieve; held are all shingles found.

    A place belongs to the window in whose first half it starts.
    """
    known = templates_of(docs.sparkSession, templates, percent)
    rows = known.collect()  # as many as the templates
    classes = length_classes(rows, percent, miss)
    often = Counter(h for r in rows for h in r["template"])
    first = {}  # (half, bands) -> shingles, one of which every place of the class holds
    for r in rows:
        m, letters = len(r["template"]), dict(zip(r["template"], r["letters"]))
        rare = sorted(letters, key=lambda h: (-letters[h], often[h], h))  # long words are rare ones
        first.setdefault(classes[r["t"]], set()).update(rare[:m - -(-m * percent // 100) + 1])
    spark = docs.sparkSession
    one = spark.range(1)
    seeds = one.select(F.inline(F.array(*[
        F.struct(F.lit(h).alias("half"), F.lit(b).alias("bands"), F.lit(sorted(x)).cast("array<int>").alias("hs"))
        for (h, b), x in first.items()]))).select("half", "bands", F.explode("hs").alias("h")) if rows else \
        one.where("false").selectExpr("0 AS half", "0 AS bands", "0 AS h")
    sized = known.join(F.broadcast(one.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("t"), F.lit(h).alias("half"), F.lit(b).alias("bands")) for t, (h, b) in classes.items()])))), "t") \
        if rows else known.withColumns({"half": F.lit(0), "bands": F.lit(0)})

    def minhashes(s: str) -> Column:
        """(band, value) rows of an array of shingles."""
        value = lambda j: F.array_min(F.transform(s, lambda h: F.hash(h, j)))
        return F.explode(F.transform(F.sequence(F.lit(1), F.col("bands")), lambda j: F.struct(j.alias("band"), value(j).alias("value"))))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row"),
                        shingles(words(F.col("text"))).alias("s"))
    key = ["doc_id", "row", "half", "window", "part"]
    windows = (texts.select("doc_id", "row", "s", F.posexplode("s").alias("at", "h")).join(F.broadcast(seeds), "h")
               .select("doc_id", "row", "s", "half", "bands", F.expr("explode(array(at div half, at div half - 1))").alias("window"))
               .where("window >= 0").select("doc_id", "row", "half", "bands", "window", F.slice(
                   "s", (F.col("window") * F.col("half") + 1).cast("int"), F.col("half") * 2).alias("part")).distinct())
    bands = sized.select("t", "half", minhashes("template").alias("b")).select("t", "half", "b.*")
    retrieved = (windows.select(*key, minhashes("part").alias("b")).select(*key, "b.*")
                 .join(F.broadcast(bands), ["half", "band", "value"]).select(*key, "t").distinct())
    ahead = F.slice("part", F.col("p") + 1, F.col("reach"))
    return (retrieved.join(F.broadcast(known), "t")
            .select(*key, "t", "license", "template", "n_shingles", "reach",
                    F.posexplode(F.slice("part", F.lit(1), F.col("half"))).alias("p", "h"))
            .where(F.array_contains("template", F.col("h"))).withColumn("ahead", ahead)
            .withColumn("held", F.array_intersect("template", "ahead")).withColumn("n_found", F.size("held").cast("long"))
            .where(F.col("n_found") * 100 >= F.col("n_shingles") * percent)
            .withColumn("start", (F.col("window") * F.col("half") + F.col("p")).cast("int"))
            .withColumn("last", F.array_max(F.transform("held", lambda h: F.array_position("ahead", h))))
            .select("doc_id", "row", "t", "license", "start", (F.col("start") + F.col("last")).cast("int").alias("end"),
                    "n_found", "n_shingles", "held"))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = PERCENT,
                 miss: float = MISS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text) and license found: doc_id, license, n_places, n_found (most
    shingles of a template at one place), n_shingles (of that template), sure.

    Words are lower-cased runs of letters and digits, a shingle is two neighbouring words (one word
    alone is one).  A template is at a place that holds ``percent`` of its distinct shingles; windows
    are retrieved by MinHash bands and verified at every start position.  Which of overlapping places
    count, and what is ``sure``, is said at ``license_matches``.  The templates are a parameter of the
    scan and travel as literals; those without words are at no place.

    Null and empty texts have no words and give no row.  Equal rows are one document; rows with
    equal or null doc_id and other texts are judged each.  Extra columns are ignored.
    """
    rivals = _rivals(templates_of(docs.sparkSession, templates, percent), percent)
    return best_places(window_places(docs, templates, percent, miss), rivals)
