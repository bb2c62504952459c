r"""Licence scan (operator 6), DataFrame functions only.

Text is normalised (lower case, runs of characters outside a-z and 0-9 to one
space) and compared with licence templates by the Dice coefficient over sets
of word bigrams, 2 |A and B| / (|A| + |B|). Every line, every paragraph (lines
between blank lines, where there are some) and the whole text are compared, so
a one-line notice in a long text and a full licence file are both found. Notices
laid out otherwise are found as passages: windows of words, across lines and
paragraphs, of the text that no matching piece covers. A passage begins and
ends with a bigram of its template; of passages that overlap, the best counts
(then the longest, the alphabetically first licence and the leftmost).
A template of b bigrams can reach a coefficient of s only with texts of
between b s / (2 - s) and b (2 - s) / s bigrams; others are not compared. Passages are searched only in
texts that hold b s / (2 - s) bigrams of a template, without which none can
reach s.

Not covered: the full texts of Apache-2.0, GPL-2.0, GPL-3.0 and MPL-2.0 have no
template of their own (they are found by the notices that they quote), CC texts
neither; BSD-3-Clause, LGPL and AGPL have none and are found, if at all, as the
template they resemble (BSD-2-Clause, GPL-3.0-header).

Bigrams are held as 64-bit hashes of their two words. All work is done row by
row without a shuffle; templates are literals of the plan (a fixed, small
set; pass others as a dict of name -> text).

Defined cases: null and empty texts match nothing; pieces of fewer than two
words have no bigrams. On a tie the alphabetically first licence counts.
Repeated rows are scanned one by one. Input columns named like an output are
replaced. An empty table gives an empty table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from abundance.llm.common import drop_clashes

# Notices and licence texts as published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
        "above copyright notice and this permission notice appear in all copies."),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}
THRESHOLD = 0.8
UNITS = ("line", "paragraph", "text", "passage")


def words_of(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def template_bigrams(text: str) -> list[int]:
    """Distinct bigram hashes of a template, as Spark's xxhash64(a, b)."""
    import xxhash

    w = words_of(text)
    found = {xxhash.xxh64_intdigest(b, xxhash.xxh64_intdigest(a, 42)) for a, b in zip(w, w[1:])}
    return sorted(x - (1 << 64) if x >> 63 else x for x in found)


def bigrams(piece: Column) -> Column:
    """array<array<long>>, one set of bigram hashes per normalised piece."""
    words = F.array_remove(F.split(piece, "[ \n]+", -1), "")
    # The words are held in a one-element array, so that they are made once.
    return F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1))))).otherwise(F.array().cast("array<bigint>"))), 1)


def passages(lines: Column, grams: Column, wanted: Column, threshold: float) -> Column:
    """array<struct<score,license,unit,piece>> (license: number in ``grams``)
    of the passages in lines (null: covered) for the wanted templates."""
    words = F.array_remove(F.split(F.array_join(lines, "\n", " | "), "[ \n\f]+", -1), "")
    gap = F.lit(0).cast("bigint")
    # One-element arrays hold values that would be made again at each use.
    hold = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)
    g = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.when(
        (F.get(w, i) == "|") | (F.get(w, i + 1) == "|"), gap).otherwise(F.xxhash64(F.get(w, i), F.get(w, i + 1))))

    def of_template(b, k):
        t = F.element_at(grams, k + 1)
        least = F.ceil(F.size(t) * threshold / (2 - threshold) - 1e-9).cast("int")
        most = F.floor(F.size(t) * (2 - threshold) / threshold + 1e-9).cast("int")

        def window(at, end):
            def score(a):
                dice = 2.0 * F.size(F.array_intersect(a, t)) / (F.size(a) + F.size(t))
                return F.when(F.array_contains(a, gap), 0.0).otherwise(dice)

            return F.struct(hold(F.array_distinct(F.slice(b, at + 1, end - at + 1)), score).alias("score"), (end - at).alias("length"),
                            (-k).alias("k"), (-at).alias("at"))

        def from_start(p):
            def best(at, i):
                ends = F.filter(F.slice(p, i + least, F.lit(most)), lambda e: e - at < most)
                return F.array_max(F.transform(ends, lambda e: window(at, e)))

            return F.transform(p, best)

        at = F.filter(F.transform(b, lambda x, i: F.when(F.array_contains(t, x), i)), lambda i: i.isNotNull())
        return F.filter(hold(at, from_start), lambda x: x["score"] >= threshold - 1e-12)

    found = hold(F.when(F.size(words) > 1, hold(words, g)).otherwise(F.array().cast("array<bigint>")), lambda b: F.flatten(
        F.transform(wanted, lambda k: of_template(b, k))))
    none = F.array().cast("array<struct<score:double,length:int,k:int,at:int>>")
    apart = lambda x, y: (-x["at"] + x["length"] < -y["at"]) | (-y["at"] + y["length"] < -x["at"])
    kept = F.aggregate(F.sort_array(found, False), none, lambda a, x: F.when(F.forall(a, lambda y: apart(x, y)), F.concat(a, F.array(x))).otherwise(a))
    ordered = F.array_sort(kept, lambda x, y: y["at"] - x["at"])
    return F.transform(ordered, lambda x, i: F.struct(x["score"].alias("score"), (-x["k"]).alias("license"), F.lit(3).alias("unit"), i.alias("piece")))


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``licenses``: array<struct<score,license,unit,piece>> of all pieces
    that reach the threshold for their best template (piece: number within its
    unit, from 0), and ``license`` and ``license_score``, the best of them."""
    known = sorted((templates or TEMPLATES).items())
    body = F.lower(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    d = drop_clashes(docs, [n for n in ("licenses", "license", "license_score") if n != text])
    own = [F.col(f"`{c}`") for c in d.columns]
    # Blank lines are marked before white space is normalised.
    d = d.select(*own, F.regexp_replace(F.regexp_replace(body, r"\n[ \t\r]*\n\s*", "\n\f"), "[^a-z0-9\n\f]+", " ").alias("__n"))
    flat = F.replace(F.col("__n"), F.lit("\f"), F.lit(" "))
    paragraphs = F.when(F.contains(F.col("__n"), F.lit("\f")), F.split("__n", "\f", -1)).otherwise(F.array().cast("array<string>"))

    def unit(pieces, u):
        return F.transform(pieces, lambda p, i: F.struct(F.lit(u).alias("unit"), i.alias("piece"), p.alias("body")))

    whole = F.when(F.contains(flat, F.lit("\n")), F.array(flat)).otherwise(F.array().cast("array<string>"))
    d = d.select(*own, "__n", F.concat(unit(F.split(flat, "\n", -1), 0), unit(paragraphs, 1), unit(whole, 2)).alias("__p"))
    d = d.select(*own, "__n", F.transform("__p", lambda p: F.struct(p["unit"].alias("unit"), p["piece"].alias("piece"), bigrams(p["body"]).alias("b"))).alias("__b"))

    def best(p):
        scores = []
        for k, (_, t) in enumerate(known):
            grams = template_bigrams(t)
            low, high = len(grams) * threshold / (2 - threshold), len(grams) * (2 - threshold) / threshold
            n = F.size(p["b"])
            dice = 2.0 * F.size(F.array_intersect(p["b"], F.lit(grams))) / (n + len(grams))
            scores.append(F.struct(F.when((n >= low) & (n <= high), dice).otherwise(0.0).alias("score"), F.lit(-k).alias("k")))
        return F.greatest(*scores)

    names = F.array(*[F.lit(n) for n, _ in known])
    smallest, largest = (f(len(template_bigrams(t)) for _, t in known) for f in (min, max))
    in_bounds = lambda p: F.size(p["b"]).between(smallest * threshold / (2 - threshold), largest * (2 - threshold) / threshold)
    scored = F.transform(F.filter("__b", in_bounds), lambda p: F.struct(best(p).alias("top"), p["unit"].alias("unit"), p["piece"].alias("piece")))
    hits = F.transform(F.filter(scored, lambda s: s["top"]["score"] >= threshold - 1e-12), lambda s: F.struct(
        s["top"]["score"].alias("score"), F.element_at(names, 1 - s["top"]["k"]).alias("license"),
        F.element_at(F.array(*map(F.lit, UNITS)), s["unit"] + 1).alias("unit"), s["piece"].alias("piece")))
    # The whole text's bigrams, of which only those of some template matter.
    several = F.contains(F.col("__n"), F.lit("\n"))
    total = F.element_at("__b", F.when(several, -1).otherwise(1))["b"]
    sets = [template_bigrams(t) for _, t in known]
    d = d.select(*own, "__n", hits.alias("__hits"), F.array_intersect(total, F.lit(sorted(set().union(*sets)))).alias("__g"))
    grams = F.array(*map(F.lit, sets))
    enough = F.filter(F.sequence(F.lit(0), F.lit(len(sets) - 1)), lambda k: F.size(F.array_intersect("__g", F.element_at(grams, k + 1))) >= F.size(
        F.element_at(grams, k + 1)) * threshold / (2 - threshold) - 1e-9)
    some = F.size("__g") >= smallest * threshold / (2 - threshold) - 1e-9
    d = d.select(*own, "__n", "__hits", F.when(some, enough).otherwise(F.array().cast("array<int>")).alias("__k"))
    hit = lambda u, i: F.exists("__hits", lambda h: (h["unit"] == UNITS[u]) & (h["piece"] == i))
    pages = F.split("__n", "\f", -1)
    # Lines with the number of the first line of their paragraph; a paragraph ends with its last line's end.
    starts = F.aggregate(pages, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.size(F.split(x, "\n", -1)) - 1)))
    bare = F.element_at(F.transform(F.array(starts), lambda first: F.flatten(F.transform(pages, lambda page, j: F.transform(
        F.split(page, "\n", -1), lambda line, i: F.when(~hit(1, j) & ~hit(0, F.get(first, j) + i), line))))), 1)
    more = F.when((F.size("__k") > 0) & ~hit(2, F.lit(0)), passages(bare, grams, F.col("__k"), threshold))
    name = F.transform(more, lambda h: F.struct(h["score"].alias("score"), F.element_at(names, h["license"] + 1).alias("license"),
                                                F.element_at(F.array(*map(F.lit, UNITS)), h["unit"] + 1).alias("unit"), h["piece"].alias("piece")))
    d = d.select(*own, F.when(F.size("__k") > 0, F.concat("__hits", F.coalesce(name, F.array().cast(d.schema["__hits"].dataType)))).otherwise(
        F.col("__hits")).alias("licenses"))
    top = F.aggregate("licenses", F.struct(F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("license")), lambda a, x: F.when(
        (x["score"] > a["score"]) | (x["score"] == a["score"]) & (x["license"] < a["license"]),
        F.struct(x["score"].alias("score"), x["license"].alias("license"))).otherwise(a))
    return d.withColumn("__top", top).select(*own, "licenses", F.col("__top.license").alias("license"),
                                             F.when(F.col("__top.license").isNotNull(), F.col("__top.score")).alias("license_score"))
