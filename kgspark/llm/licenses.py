"""Licence scan: Dice coefficient of word bigrams, in DataFrame functions only."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm._common import let

#: Wordings of notices, by licence.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related rights to this work.",),
}
#: Whole texts and longer notices, met by windows only.
TEXTS = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
}
THRESHOLD = 0.8
#: Most wordings that are sent to the tasks.
MAX_TEMPLATES = 10_000


def words_in(text: Column) -> Column:
    """Words of the normalised text: lower case, everything but letters and digits a blank."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), "")


def all_bigrams(text: Column) -> Column:
    """Pairs of neighbouring words of the normalised text, in order."""
    pairs = lambda w: F.when(F.size(w) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return let(words_in(text), pairs)


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring words of the normalised text."""
    return F.array_distinct(all_bigrams(text))


def once(value: Column) -> Column:
    """A column of its own, which filters on it don't compute again."""
    return F.explode(F.array(value))


def telling_words(form: list[str], needed: int) -> list[str]:
    """Words of which a text must hold one to hold ``needed`` of the bigrams."""
    left, out = set(form), []
    while len(form) - len(left) < len(form) - needed + 1:
        own = Counter(w for pair in left for w in set(pair.split(" ")))
        out.append(max(own, key=lambda w: (own[w] * len(w) ** 2, w)))
        left = {pair for pair in left if out[-1] not in pair.split(" ")}
    return out


def windows(pairs: Column, form: Column, m: Column, longest: Column, threshold: float) -> Column:
    """Windows that show a wording, from left to right without overlaps: dice, begin, end.

    Only windows from one bigram of the wording to another can be best.  A
    bigram counts once in a window: if it occurred last before its begin.
    """
    back = lambda b, x, i: F.array_position(F.reverse(F.slice(b, F.greatest(i - longest, F.lit(0)) + 1, F.least(i, longest))), x).cast("int")
    last = lambda b: F.transform(b, lambda x, i: let(back(b, x, i), lambda p: F.struct(F.when(p > 0, i - p).otherwise(-1).alias("last"), F.array_contains(form, x).alias("hit"), i.alias("at"))))

    def grown(acc: Column, x: Column, begin: Column) -> Column:
        new = (x["last"] < begin).cast("int")
        n, hits = acc["n"] + new, acc["hits"] + F.when(x["hit"], new).otherwise(0)
        dice = hits * F.lit(2.0) / (n + m)
        better = dice > acc["dice"]
        return F.struct(n.alias("n"), hits.alias("hits"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, x["at"]).otherwise(acc["end"]).alias("end"))

    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hits"), F.lit(0.0).alias("dice"), F.lit(-1).alias("end"))

    def found(cells: Column) -> Column:
        begins = F.filter(cells, lambda c: c["hit"])
        best = F.transform(begins, lambda c: F.aggregate(F.slice(cells, c["at"] + 1, longest), nothing, lambda acc, x: grown(acc, x, c["at"]), lambda acc: F.struct(acc["dice"].alias("dice"), c["at"].alias("begin"), acc["end"].alias("end"))))
        good = F.filter(best, lambda w: w["dice"] >= threshold)
        none = F.slice(good, 1, 0)
        # Of windows that overlap, the best of those that begin in the first one.
        joined = lambda out, w: F.when((F.size(out) > 0) & (w["begin"] <= F.element_at(out, -1)["end"]), F.when(w["dice"] > F.element_at(out, -1)["dice"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(w))).otherwise(out)).otherwise(F.concat(out, F.array(w)))
        return F.aggregate(good, none, joined)

    return let(let(pairs, last), found)


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, *, threshold: float = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licences found per document: key, license, score, n_passages.

    Passages are a document's lines and its whole text, equal ones once.  A
    passage shows a licence if the Dice coefficient of its word bigrams with
    those of one of the licence's wordings is at least ``threshold``; ``score``
    is the best one.  The sizes that can reach it are listed for each wording,
    so a passage meets only wordings of a fitting size.  For licences that no
    line and no whole text shows, the passages are all windows of words of the
    text, over lines or within them, up to the greatest fitting length of a
    wording; of overlapping ones one counts.  These meet ``TEXTS`` too, unless
    ``templates`` are given.  Texts that are null, empty or without a fitting
    passage give no row.  Rows with equal keys are one document, and so are
    those with null keys.
    """
    given = TEMPLATES if templates is None else templates
    wordings = [(name, w, True) for name, ws in sorted(given.items()) for w in ws]
    if templates is None:
        wordings += [(name, w, False) for name, ws in sorted(TEXTS.items()) for w in ws]
    if len(wordings) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    spark = docs.sparkSession
    forms = spark.createDataFrame(wordings, "license string, wording string, line boolean").select("license", "line", bigrams(F.col("wording")).alias("form"), F.size(all_bigrams(F.col("wording"))).alias("length"))
    forms = forms.withColumn("m", F.size("form")).where("m > 0")
    low, high = F.ceil(F.col("m") * threshold / (2 - threshold) - 1e-9), F.floor(F.col("m") * (2 - threshold) / threshold + 1e-9)
    # A window holds as many bigrams of a wording as the smallest that shows it.
    forms = forms.withColumns({"low": low.cast("int"), "high": high.cast("int"), "longest": F.floor(F.col("length") * (2 - threshold) / threshold + 1e-9).cast("int")})
    sized = forms.where("line").select("license", "form", "m", F.explode(F.sequence("low", "high")).alias("n"))
    whole = F.coalesce(F.col(text), F.lit(""))
    passages = docs.select(F.col(key).alias(key), F.explode(F.array_distinct(F.concat(F.split(whole, "\n"), F.array(whole)))).alias("passage"))
    sets = passages.select(key, once(bigrams(F.col("passage"))).alias("pairs")).withColumn("n", F.size("pairs")).where("n > 0")
    dice = F.size(F.array_intersect("pairs", "form")) * 2.0 / (F.col("n") + F.col("m"))
    # The wordings are bounded by MAX_TEMPLATES.
    met = sets.join(F.broadcast(sized), "n").withColumn("dice", dice).where(F.col("dice") >= threshold)
    met = met.select(key, "license", "dice", "pairs", F.lit(False).alias("window"))

    known = forms.select("form", "low").collect()
    telling = sorted({w for f in known for w in telling_words(f["form"], f["low"])})
    telling = [w for w in telling if not any(v != w and v in w for v in telling)]
    texts = docs.select(F.col(key).alias(key), F.col(text).alias("passage"), once(F.lower(text)).alias("lower"))
    texts = texts.where(reduce(or_, [F.contains("lower", F.lit(w)) for w in telling], F.lit(False)))
    vocabulary = forms.agg(F.array_distinct(F.flatten(F.collect_list("form"))).alias("vocabulary"))
    texts = texts.crossJoin(F.broadcast(vocabulary)).select(key, "passage", once(F.array_intersect(bigrams(F.col("passage")), "vocabulary")).alias("hits"))
    may = texts.join(F.broadcast(forms), (F.size("hits") >= F.col("low")) & (F.size(F.array_intersect("hits", "form")) >= F.col("low")))
    may = may.select(key, "license", "form", "m", "longest", once(all_bigrams(F.col("passage"))).alias("all"))
    shown = may.select(key, "license", "all", F.explode(windows(F.col("all"), F.col("form"), F.col("m"), F.col("longest"), threshold)).alias("w"))
    shown = shown.select(key, "license", F.col("w.dice").alias("dice"), F.array_distinct(F.slice("all", F.col("w.begin") + 1, F.col("w.end") - F.col("w.begin") + 1)).alias("pairs"), F.lit(True).alias("window"))

    of = lambda c, window: F.when(F.col("window") == window, F.col(c))
    found = met.unionByName(shown).groupBy(key, "license").agg(*(f(of(c, window)).alias(f"{c}_{window}") for window in (False, True) for f, c in ((F.max, "dice"), (F.countDistinct, "pairs"))))
    n_passages = F.when(F.col("dice_False").isNull(), F.col("pairs_True")).otherwise(F.col("pairs_False"))
    return found.select(key, "license", F.coalesce("dice_False", "dice_True").alias("score"), n_passages.alias("n_passages"))
