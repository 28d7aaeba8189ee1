"""Licence scan: a trained paragraph classifier on sparse word n-grams, with DataFrame functions alone.

``train`` fits a multinomial logistic regression on variants of the templates below and on paragraphs of the corpus (class unknown);
its features are word n-grams of one to three words that hold a key word, a template word outside ``COMMON``. A temperature fitted on
variants kept aside calibrates the chances. ``scan`` gates rows by the key words, which loses nothing, as a paragraph without one has no feature and
is unknown; it splits the rest at blank lines (comment leaders alone are blank) into paragraphs. A paragraph is read line by line and, where it has
several lines, with its lines joined, in overlapping windows of ``WINDOW`` words that cover all of it; the n-grams of each reading are joined to the
weights and summed. A prediction is confirmed when a reading holds enough of a template's n-grams; a paragraph gives each family once.
A reading may hold several notices: beside its likeliest family it names every other one of which it holds enough of a template after the n-grams that the likeliest
family's templates share are taken away, if the model gives that family on its template's n-grams alone.

Training sees at most ``PLAIN`` lines, drawn from the whole of at most ``SAMPLE`` corpus texts (least hash first). The weights and templates are bounded by the template list and
may be broadcast. Edge cases: null and empty texts have no licence; repeated rows give equal results; the columns added get an underscore
where the input has their names; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaykit.llm.common import cut, free_name, hash_sample, text_key

# Notices by which texts name a licence, by family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC0-1.0": ["Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "redistribute it and/or modify it under the terms of the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "redistribute it and/or modify it under the terms of the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
}
COMMON = frozenset("the of this is a an any and or to in into for by with without it you may not use be are as on that from at version work file form forms terms software source code library free public general open style copy person charge fee purpose permission subject governed except hereby identifier".split())
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
SAMPLE, PLAIN, UNKNOWN, NGRAM = 200, 800, "unknown", 3
#: Words of a window over joined lines, and of the overlap of two: more than any template has.
WINDOW, OVERLAP = 64, 32
BLANK = r"\n[^\p{L}\p{N}]*\n"
#: Comment leaders that would count as words, and line ends within a hyphenated word.
LEADER, HYPHEN = r"(?im)^[^\p{L}\p{N}\n]*(?:dnl|@?rem)(?=\s)", r"(?<=\p{L})-\r?\n[^\p{L}\p{N}\n]*(?=\p{L})"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(words: list[str]) -> set[str]:
    """N-grams with a key word."""
    return {" ".join(g) for n in range(1, NGRAM + 1) for i in range(len(words) - n + 1) if not COMMON.issuperset(g := words[i : i + n])}


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]
    templates: list[tuple[str, list[str]]]

    @property
    def gate(self) -> str:
        words = sorted({w for g in self.weights for w in g.split(" ") if w not in COMMON}, key=lambda w: (-len(w), w))
        return "(?iu)(?<![\\p{L}\\p{N}])(?:" + "|".join(re.escape(w) for w in words) + ")(?![\\p{L}\\p{N}])"


    @property
    def rivals(self) -> list[tuple[str, str, list[str], list[str]]]:
        """(family, rival, n-grams of one of the rival's templates, those of them that no template of the family has)."""
        own: dict[str, set[str]] = {}
        for f, grams in self.templates:
            own.setdefault(f, set()).update(grams)
        return [(f, g, grams, apart) for f in own for g, grams in self.templates if g != f and (apart := sorted(set(grams) - own[f]))]


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def train(docs: DataFrame, seed: int = 7, steps: int = 400) -> Model:
    """Fits on the driver, on a bounded sample."""
    rng = random.Random(seed)
    rows = hash_sample(docs.where("text is not null"), F.xxhash64("text"), F.col("text"), SAMPLE)
    known = [" ".join(words_of(t)) for ts in TEMPLATES.values() for t in ts]
    plain = [p for t in rows for p in t.split("\n") if (w := " ".join(words_of(p))) and not any(k in w for k in known)]
    plain = rng.sample(plain, min(len(plain), PLAIN))
    filler = [w for p in plain for w in words_of(p)] or ["lorem"]
    families = [*TEMPLATES, UNKNOWN]
    examples: list[tuple[list[str], int]] = []
    for k, texts in enumerate(TEMPLATES.values()):
        for text in texts:
            base = words_of(text)
            for v in range(12):  # whole, among other words, or short of a word
                words = list(base)
                if v % 3 == 2 and len(words) > 4:
                    words.pop(rng.randrange(len(words)))
                if v % 3:
                    words = rng.choices(filler, k=rng.randint(1, 12)) + words + rng.choices(filler, k=rng.randint(0, 12))
                examples.append((words, k))
    keys = sorted({w for ws, _ in examples for w in ws} - COMMON - set(filler))
    examples += [(words_of(p), len(families) - 1) for p in plain]
    for _ in range(300):  # single key words among others are no licence
        examples.append((rng.choices(filler, k=rng.randint(3, 20)) + [rng.choice(keys)] + rng.choices(filler, k=3), len(families) - 1))
    names = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams_of(words_of(t))})
    place = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(examples), len(names)))
    for i, (ws, _) in enumerate(examples):
        for g in grams_of(ws):
            if g in place:
                x[i, place[g]] = 1
    y = np.array([k for _, k in examples])
    aside = np.arange(len(y)) % 4 == 0
    one = np.eye(len(families))
    w, b = np.zeros((len(names), len(families))), np.zeros(len(families))
    xt, yt = x[~aside], one[y[~aside]]
    for _ in range(steps):
        d = (_softmax(xt @ w + b) - yt) / len(xt)
        w -= 8.0 * (xt.T @ d + 1e-4 * w)
        b -= 8.0 * d.sum(0)
    z, best = x[aside] @ w + b, (np.inf, 1.0)
    for t in (0.5, 0.7, 1.0, 1.4, 2.0, 3.0):
        p = _softmax(z / t)
        best = min(best, (-np.log(p[np.arange(len(p)), y[aside]] + 1e-12).mean(), t))
    w, b = w / best[1], b / best[1]
    templates = [(f, sorted(grams_of(words_of(t)))) for f, ts in TEMPLATES.items() for t in ts]
    return Model(families, {g: [round(float(v), 6) for v in w[i]] for g, i in place.items()}, [float(v) for v in b], templates)


def _grams(words: Column) -> Column:
    """The n-grams of an array of words, once each."""
    def runs(n: int) -> Column:
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(words, *[runs(n) for n in range(2, NGRAM + 1)]))


def _readings(body: Column) -> Column:
    """The lines of a paragraph; if there are several, then its windows of joined lines."""
    lines = F.split(body, "\n")
    words = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(body, LEADER, ""), HYPHEN, "-"), F.lit(WORD), F.lit(0))
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - OVERLAP, F.lit(1)), F.lit(WINDOW - OVERLAP))
    # the words are extracted once, as the element of an array of one
    windows = F.flatten(F.transform(F.array(words), lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, WINDOW), " "))))
    return F.when(F.size(lines) > 1, F.concat(lines, windows)).otherwise(lines)


def paragraphs(docs: DataFrame, model: Model, key: str, chance: float = 0.5, overlap: float = 0.6) -> DataFrame:
    """key, paragraph (its number), at, family, p, confirmed: the families of each paragraph that is no unknown text, by their first reading ``at``.

    Rows are told apart by ``key``.
    """
    spark = docs.sparkSession
    n = len(model.families)
    weights = spark.createDataFrame(list(model.weights.items()), "gram string, w array<double>")
    templates = spark.createDataFrame([(f, g) for f, g in model.templates], "family string, grams array<string>")
    templates = templates.groupBy("family").agg(F.collect_list("grams").alias("templates"))
    rows = docs.where(F.col("text").rlike(model.gate)).select(F.col(key).alias("key"), F.posexplode(F.split("text", BLANK)).alias("paragraph", "body"))
    rows = rows.where(F.col("body").rlike(model.gate)).select("key", "paragraph", F.posexplode(_readings(F.col("body"))).alias("at", "body"))
    rows = rows.where(F.col("body").rlike(model.gate))
    found = F.regexp_extract_all(F.lower("body"), F.lit(WORD), F.lit(0))
    grams = rows.select("key", "paragraph", "at", found.alias("words")).select("key", "paragraph", "at", F.explode(_grams(F.col("words"))).alias("gram"))
    sums = grams.join(F.broadcast(weights), "gram").groupBy("key", "paragraph", "at").agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(n)], F.collect_set("gram").alias("held"))
    # few rows of many readings; both branches below start from them
    scored = cut(_decide(sums, model).where((F.col("family") != UNKNOWN) & (F.col("p") >= chance)))
    match = F.exists("templates", lambda t: F.size(F.array_intersect(t, F.col("held"))) >= overlap * F.size(t))
    place = ["key", "paragraph", "at"]
    named = scored.join(F.broadcast(templates), "family").select(*place, "family", "p", match.alias("confirmed"))
    # other notices of the same reading, by what their templates have apart from the likeliest family's
    rivals = F.broadcast(spark.createDataFrame(model.rivals, "family string, rival string, whole array<string>, apart array<string>"))
    shows = F.size(F.array_intersect("apart", "held")) >= overlap * F.size("apart")
    fits = scored.join(rivals, "family").where(shows).select(*place, "rival", F.array_intersect("whole", "held").alias("rest"))
    alone = fits.groupBy(*place, "rival").agg(F.array_distinct(F.flatten(F.collect_list("rest"))).alias("rest"))
    again = alone.select(*place, "rival", F.explode("rest").alias("gram")).join(F.broadcast(weights), "gram").groupBy(*place, "rival").agg(*[F.sum(F.col("w")[i]).alias(f"s{i}") for i in range(n)], F.collect_set("gram").alias("held"))
    others = _decide(again, model, "rival").where((F.col("family") == F.col("rival")) & (F.col("p") >= chance)).select(*place, "family", "p", F.lit(True).alias("confirmed"))
    best = F.max(F.struct("confirmed", "p")).alias("best")
    return named.unionByName(others).groupBy("key", "paragraph", "family").agg(best, F.min("at").alias("at")).select("key", "paragraph", "at", "family", "best.p", "best.confirmed")


def _decide(sums: DataFrame, model: Model, *extra: str) -> DataFrame:
    """The likeliest family and its chance, from sums of weights s0, s1, ..."""
    logit = F.array(*[F.round(F.col(f"s{i}") + b, 6) for i, b in enumerate(model.bias)])
    columns = ["key", "paragraph", "at", *extra, "held"]
    scored = sums.select(*columns, logit.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    family = F.element_at(F.array(*map(F.lit, model.families)), F.array_position("z", F.col("top")).cast("int"))
    return scored.select(*columns, family.alias("family"), F.round(1 / total, 6).alias("p"))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with licences: array of (paragraph, family, p, confirmed), by paragraph; empty where there are none."""
    name, h1, h2 = (free_name(docs.columns, c) for c in ("licences", "h1", "h2"))
    gate = F.coalesce(F.col("text").rlike(model.gate), F.lit(False))
    kind = "array<struct<paragraph: int, family: string, p: double, confirmed: boolean>>"
    gated = docs.where(gate).withColumns(dict(zip((h1, h2), text_key(F.col("text")), strict=True)))
    texts = gated.groupBy(h1, h2).agg(F.first("text").alias("text")).select(F.struct(h1, h2).alias("key"), "text")
    order = F.array_sort(F.collect_list(F.struct("paragraph", "at", "family", "p", "confirmed")))
    found = paragraphs(texts, model, "key").groupBy("key").agg(F.transform(order, lambda x: F.struct(*[x[c].alias(c) for c in ("paragraph", "family", "p", "confirmed")])).cast(kind).alias(name))
    hit = gated.join(found.select(F.col(f"key.{h1}").alias(h1), F.col(f"key.{h2}").alias(h2), name), [h1, h2], "left")
    none = F.array().cast(kind)
    return hit.select(*docs.columns, F.coalesce(name, none).alias(name)).unionByName(docs.where(~gate).withColumn(name, none))
