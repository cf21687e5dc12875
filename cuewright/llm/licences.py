"""Licence scan: a trained paragraph classifier, as column expressions.

A text's paragraphs end at blank lines, and their units are lines. Lines of more than LONGEST words, and those of which
several sentences may be notices, are cut into sentences, and those into pieces of UNIT words. Each unit alone, and each run of units that may hold a notice wrapped over them, is classified: from any unit on until LONGEST
words follow it, as no template has more. Runs are classified by multinomial logistic regression over the sparse words and
word pairs of the templates. The classes are licence families and `unknown`; the model is trained here on variants of the
templates (words lost, other words around), on sentences that only sound alike and on notices of families without a class.
Probabilities are calibrated by a temperature and a threshold chosen on held-out variants and on notices of other such
families: below it a run is unknown. A prediction counts only if a template of the family confirms it: CONFIRM of the
template's words and word pairs must be in the run, its name must be, and no word that makes another licence of it. Where
templates of several families confirm a run, each is classified without what tells of the others, so all notices of a line
count. Of confirmed runs that share a word of their names, the one with the highest overlap counts, the shortest of these.

What no template can confirm (its words aren't there) isn't classified, unless it holds an anchor, a word of notices of all
kinds: paragraphs with an anchor and no confirmed run are unknown.

All of it is a function of one row: no shuffle, no Python on the executors, any skew. Weights and templates are literals
of a fixed size. Null and empty texts have no paragraphs. Repeated rows give the same; other columns stay, whatever their names.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.llm.common import own_name, table

#: Notices of licence families; fixed values.
TEMPLATES = {
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "GNU AGPL v3", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "licensed under Apache 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License.", "Use of this source code is governed by a BSD-style license", "BSD 2-Clause License", "BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution", "Licensed under the Eclipse Public License", "SPDX-License-Identifier: EPL-2.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "GNU GPL v2", "GNU GPL v3", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "GNU LGPL v2.1", "SPDX-License-Identifier: LGPL-3.0"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "The MIT License (MIT)", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "mpl-1.1": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: MPL-1.1"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "This work is dedicated to the public domain under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: Unlicense", "SPDX-License-Identifier: CC0-1.0"],
    "reserved": ["Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."],
}
#: Words that a family's notices are known by: those of a template must stand in a paragraph that it confirms. Fixed values.
NAMES = {
    "agpl": ["affero", "agpl"], "apache-2.0": ["apache", "2.0"], "bsd": ["bsd", "redistribution", "binary"], "cc-by": ["cc", "creative", "commons", "attribution"], "cc-by-nc": ["cc", "nc", "creative", "commons", "noncommercial"], "cc-by-sa": ["cc", "sa", "creative", "commons", "sharealike"], "epl": ["eclipse", "epl"], "gpl": ["gnu", "gpl", "general", "public"],
    "isc": ["isc", "fee"], "lgpl": ["lesser", "lgpl"], "mit": ["mit", "obtaining", "charge"], "mpl-1.1": ["mozilla", "mpl", "1.1"], "mpl-2.0": ["mozilla", "mpl", "2.0"], "public-domain": ["unencumbered", "domain", "waived", "unlicense", "cc0"], "reserved": ["reserved", "rights", "all"],
}
#: Words that make another licence of one of the same name: a template without them confirms no paragraph with them. Fixed.
GNU, COMMONS = ["affero", "agpl", "lesser", "lgpl", "documentation", "gfdl"], ["nc", "noncommercial", "sa", "sharealike", "nd", "noderivatives", "noderivs"]
OTHERWISE = {"agpl": GNU, "gpl": GNU, "lgpl": GNU, "cc-by": COMMONS, "cc-by-nc": COMMONS, "cc-by-sa": COMMONS}
#: Sentences that sound alike and aren't notices; fixed values.
OTHERS = [
    "Her driving license expired in version two of the story.", "The Apache helicopter landed under the bridge.", "Researchers at MIT released a new study.", "Copyright law is a complex field.", "He asked for permission to leave the room.", "The warranty covers parts and work.", "All rights come with duties.", "The general public may visit the work.", "Free software is discussed in this chapter.", "Redistribution of wealth is a matter of debate.", "The file is subject to review.", "A licensed doctor works here under the new terms.", "The license plate was found near the public library.", "The board released the report without permission.", "They granted a person free entry.", "Creative work is common in this house.", "The source of the river is in the public park.",
]
#: Notices of families that have no class: the first ones teach `unknown`, the others are held out for the threshold. Fixed values.
UNLISTED = [
    "Distributed under the Boost Software License, Version 1.0.", "Licensed under the European Union Public Licence, version 1.2.", "This program is distributed under the Artistic License 2.0.", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License", "This file is subject to the terms of the Common Development and Distribution License", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Use of this software is subject to the terms of a proprietary license agreement.",
    "Licensed under the Academic Free License version 3.0", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the zlib License.", "Licensed under the Open Software License version 3.0", "This software is licensed under the Business Source License 1.1", "Licensed under the Elastic License 2.0", "Released under the Python Software Foundation License version 2.",
]
ANCHORS = ["licen", "copyright", "permission", "redistribut", "public domain", "rights reserved", "gpl"]
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)*"
VARIANTS, EPOCHS, CONFIRM, FALSE_SHARE = 15, 120, 0.6, 0.005
#: Words of a piece of a sentence at most, and words marked in one number.
UNIT, WORD = 20, 60
CLASSES = ("unknown", *TEMPLATES)
LONGEST = max(len(re.findall(TOKEN, t.lower())) for own in TEMPLATES.values() for t in own)
BLANK = r"\n[\x20\x09-\x0D]*\n"
#: Ends of lines, ends of sentences, and the words of a piece with what is around them.
BREAK, STOP = r"[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]", r"(?<=[.!?;])[\x20\x09]+"
PIECE = r"(?:[^a-z0-9]*+[a-z0-9]++(?:\.[0-9]++)*+){1,%d}+" % UNIT


def grams_of(text: str) -> list[str]:
    w = re.findall(TOKEN, text.lower())
    return list(dict.fromkeys([*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]))


VOCABULARY = sorted({g for own in TEMPLATES.values() for t in own for g in grams_of(t)} | {*GNU, *COMMONS} | {g for t in UNLISTED[: len(UNLISTED) // 2] for g in grams_of(t)})


PLACE = {g: i for i, g in enumerate(VOCABULARY)}
#: The vocabulary by hash, as Spark's xxhash64 gives it, so that a gram is compared with few others.
SLOTS = 1024


def slots() -> list[list[dict]]:
    out = [[] for _ in range(SLOTS)]
    for g, i in PLACE.items():
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        out[(h - (h >> 63 << 64)) % SLOTS].append({"g": g, "i": i})
    return out


def confirms(family: str) -> list[dict]:
    """What a family's templates confirm by: their grams, the names among them, and the words that mustn't be there, as places in
    the vocabulary."""
    own, at = [grams_of(t) for t in TEMPLATES.get(family, [])], lambda words: [PLACE[w] for w in words]
    return [{"grams": at(g), "names": at(x for x in NAMES[family] if x in g), "others": at(x for x in OTHERWISE.get(family, []) if x not in g)} for g in own]


def needed() -> dict[str, list[list[str]]]:
    """For each family the sets of names of its templates: one set must be in all that a template confirms."""
    return {c: sorted({tuple(sorted(set(NAMES[c]) & set(grams_of(t)))) for t in own}) for c, own in TEMPLATES.items()}


def signs(families) -> list[str]:
    """Of each of those sets the longest name."""
    return sorted({max(names, key=len) for c in families for names in needed()[c]})


def variants(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Presence of each gram of the vocabulary, and class, of variants of templates and other sentences."""
    rng, place = np.random.default_rng(seed), PLACE
    loose = sorted({w for s in OTHERS for w in s.lower().split()})
    x, y = [], []
    half = len(UNLISTED) // 2
    none = OTHERS * 2 + {1: UNLISTED[:half], 2: UNLISTED[half:]}.get(seed, []) * 3
    texts = [(t, k) for k, c in enumerate(CLASSES) if k for t in TEMPLATES[c]] + [(s, 0) for s in none]
    # A part of a short notice may be a notice itself.
    long = [t for t, k in texts if k and len(t.split()) > 8]
    for text, k in texts:
        for _ in range(VARIANTS):
            words = [w for w in text.split() if rng.random() > rng.choice([0, 0.05, 0.15])]
            if not k and rng.random() < 0.5:  # the words of a notice in no order, or a small part of one
                words = list(rng.permutation(long[rng.integers(len(long))].split()))[: rng.integers(1, 6)] + words
            around = [loose[i] for i in rng.integers(0, len(loose), rng.integers(0, 12))]
            cut = rng.integers(0, len(around) + 1)
            row = np.zeros(len(VOCABULARY))
            row[[place[g] for g in grams_of(" ".join([*around[:cut], *words, *around[cut:]])) if g in place]] = 1
            x.append(row)
            y.append(k)
    return np.array(x), np.array(y)


def trained() -> tuple[np.ndarray, np.ndarray, float]:
    """(classes, vocabulary) weights and biases, divided by the temperature, and the threshold."""
    x, y = variants(1)
    w, b, hot = np.zeros((len(CLASSES), x.shape[1])), np.zeros(len(CLASSES)), np.eye(len(CLASSES))[y]
    seen = np.full_like(w, 1e-8)
    for _ in range(EPOCHS):
        z = x @ w.T + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - hot).T @ x / len(y) + 2e-4 * w
        seen += g * g
        w -= 0.3 * g / np.sqrt(seen)
        b -= 0.5 * (p - hot).mean(0)
    x, y = variants(2)
    z = x @ w.T + b

    def chance(t):
        e = np.exp((z - z.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    heat = min(np.linspace(0.5, 3, 26), key=lambda t: -np.log(chance(t)[np.arange(len(y)), y] + 1e-12).mean())
    # Of the held-out paragraphs without a class, those count that a template would confirm.
    likely = chance(heat)
    best = likely[:, 1:].max(1) * [confirmed(CLASSES[1 + k], set(np.flatnonzero(row))) for k, row in zip(likely[:, 1:].argmax(1), x, strict=True)]
    return np.round(w / heat, 6), np.round(b / heat, 6), float(round(max(0.5, np.quantile(best[y == 0], 1 - FALSE_SHARE)), 6))


def confirmed(family: str, grams: set[int]) -> bool:
    return any(grams >= set(t["names"]) and not grams & set(t["others"]) and len(grams & set(t["grams"])) >= CONFIRM * len(t["grams"]) for t in confirms(family))


def literal(value, kind: str) -> Column:
    """A constant array; Spark folds it into one literal before it runs."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def words_of(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit(TOKEN), F.lit(0))


def bound(value: Column, body) -> Column:
    """body of value, which is computed once: a one-element array gives it a name."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strange() -> list[list[list[int]]]:
    """For each class and other class the places of the other's grams, and of grams with a name of it, that no template of
    the class has."""
    named = lambda c: {i for g, i in PLACE.items() if set(g.split()) & set(NAMES.get(c, []))}
    own = lambda c: {PLACE[g] for t in TEMPLATES.get(c, []) for g in grams_of(t)}
    return [[sorted((named(o) | own(o)) - own(c)) for o in CLASSES] for c in CLASSES]


def judged(run: Column, weights: np.ndarray, bias: np.ndarray, threshold: float) -> Column:
    """array of struct(family, probability, overlap): the families that count in a run, or unknown."""
    pairs = lambda w: F.transform(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(F.size(w), F.lit(1))).alias("b")), lambda x: F.concat_ws(" ", x["a"], x["b"]))
    found = lambda g: F.get(F.filter(F.element_at(literal(slots(), "array<array<struct<g:string,i:int>>>"), (F.pmod(F.xxhash64(g), F.lit(SLOTS)) + 1).cast("int")), lambda e: e["g"] == g), F.lit(0))["i"]
    grams = bound(words_of(run), lambda w: F.filter(F.transform(F.array_distinct(F.concat(w, pairs(w))), found), lambda i: i.isNotNull()))

    def scores(g: Column) -> Column:
        return F.transform(literal(np.column_stack([bias, weights]).tolist(), "array<array<double>>"), lambda w: F.aggregate(g, F.element_at(w, 1), lambda acc, i: acc + F.element_at(w, i + 2)))

    def overlaps(g: Column) -> Column:
        # Templates of families without a sign in the run needn't be looked at.
        likely = lambda own: F.when(F.arrays_overlap(own["signs"], g), own["templates"])
        good = lambda own: F.filter(own, lambda t: (F.size(F.array_except(t["names"], g)) == 0) & ~F.arrays_overlap(t["others"], g))
        share = lambda own: F.coalesce(F.array_max(F.transform(good(likely(own)), lambda t: F.size(F.array_intersect(g, t["grams"])) / F.size(t["grams"]))), F.lit(0.0))
        families = [{"signs": [PLACE[n] for n in signs([c] if c in TEMPLATES else [])], "templates": confirms(c)} for c in CLASSES]
        return F.transform(literal(families, "array<struct<signs:array<int>,templates:array<struct<grams:array<int>,names:array<int>,others:array<int>>>>>"), share)

    def result(x: Column, family: Column, z: Column) -> Column:
        """The class that z gives the highest chance, whether it counts as the family, and its figures."""
        top = F.array_max(z)
        sure = F.round(1 / F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp(v - top)), 6)
        best = F.array_position(z, top).cast("int")
        counts = (best == family) & (sure >= threshold)
        name = F.when(counts, F.element_at(literal(list(CLASSES), "array<string>"), best)).otherwise("unknown")
        return F.struct(name.alias("family"), sure.alias("probability"), F.round(F.element_at(x["over"], best), 6).alias("overlap"))

    def judge(x: Column, likely: Column) -> Column:
        others = lambda c: F.flatten(F.transform(F.filter(likely, lambda o: o != c), lambda o: F.element_at(F.element_at(literal(strange(), "array<array<array<int>>>"), c), o)))
        alone = lambda c: F.when(F.size(likely) > 1, scores(F.array_except(x["g"], others(c)))).otherwise(x["z"])
        each = F.transform(likely, lambda c: bound(alone(c), lambda z: result(x, c, z)))
        return bound(F.filter(each, lambda y: y["family"] != "unknown"), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(result(x, F.lit(0), x["z"]))))

    families = F.sequence(F.lit(1), F.lit(len(CLASSES)))
    scored = lambda g: F.struct(g.alias("g"), scores(g).alias("z"), overlaps(g).alias("over"))
    return bound(grams, lambda g: bound(scored(g), lambda x: bound(F.filter(families, lambda c: F.element_at(x["over"], c) >= CONFIRM), lambda likely: judge(x, likely))))


def anchored(x: Column) -> Column:
    """Whether x holds an anchor, with anything but letters and digits between its words."""
    low, between = F.lower(x), "[^a-z0-9]+"
    has = lambda a: F.contains(low, F.lit(a))
    return reduce(Column.__or__, (has(a) if " " not in a else reduce(Column.__and__, [*map(has, a.split()), low.rlike(a.replace(" ", between))]) for a in ANCHORS))


def signed(low: Column) -> Column:
    """Whether a sign of some family is a word of the lower-cased text."""
    return low.rlike("(?<![a-z0-9])(?:" + "|".join(map(re.escape, signs(TEMPLATES))) + ")(?![a-z0-9])")


def hopeful(text: Column) -> Column:
    """Whether the letters of all names of some template are in the text, and a sign as a word."""
    low = F.lower(text)
    return reduce(Column.__or__, (reduce(Column.__and__, (F.contains(low, F.lit(n)) for n in names)) for names in sorted({n for own in needed().values() for n in own}))) & signed(low)


def possible(words: Column) -> Column:
    """Whether a template may confirm a text of these words: all its names, and words of enough of its grams."""
    grams = [(c, grams_of(t)) for c, own in TEMPLATES.items() for t in own]
    known = sorted({w for _, own in grams for g in own for w in g.split()})
    tests = [{"names": [n for n in NAMES[c] if n in own], "grams": [g.split() for g in own]} for c, own in grams]
    has = lambda words, k: F.size(F.array_except(words, k)) == 0
    enough = lambda t, k: F.size(F.filter(t["grams"], lambda g: has(g, k))) >= CONFIRM * F.size(t["grams"])
    return bound(F.array_intersect(literal(known, "array<string>"), words), lambda k: F.exists(literal(tests, "array<struct<names:array<string>,grams:array<array<string>>>>"), lambda t: has(t["names"], k) & enough(t, k)))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def units(paragraph: Column) -> Column:
    """text of each unit, its number of words, and whether a notice may have its sign or a part of an anchor here."""
    parts = sorted({x for a in ANCHORS for x in a.split()})
    marked = lambda x: reduce(Column.__or__, (F.contains(x, F.lit(a)) for a in parts)) | signed(x)
    sentences = lambda x: F.split(x, STOP)
    several = lambda x: (F.size(sentences(x)) > 1) & signed(x) & (F.size(F.filter(sentences(x), lambda y: signed(y) & possible(words_of(y)))) > 1)
    pieces = lambda x: F.flatten(F.transform(sentences(x), lambda y: F.regexp_extract_all(y, F.lit(PIECE), F.lit(0))))
    cut = lambda x: F.when((F.size(words_of(x)) > LONGEST) | several(x), pieces(x)).otherwise(F.array(x))
    unit = lambda x: F.struct(x.alias("text"), F.size(words_of(x)).alias("n"), marked(x).alias("marked"))
    return F.filter(F.transform(F.flatten(F.transform(F.split(F.lower(paragraph), BREAK), cut)), unit), lambda x: x["n"] > 0)


def runs(lines: Column) -> Column:
    """first, last and text of the runs of units that hold an anchor or that a template may confirm."""
    # Each unit has a word, so none beyond LONGEST units can be reached.
    ends = lambda i: F.sequence(i, F.least(i + LONGEST + 1, F.size(lines) - 1))
    # slice() would read the whole array each time.
    between = lambda i, j: F.when(j > i + 1, F.aggregate(F.sequence(i + 1, F.greatest(j - 1, i + 1)), F.lit(0), lambda acc, k: acc + F.get(lines, k)["n"])).otherwise(0)
    text = lambda i, j: F.array_join(F.transform(F.sequence(i, j), lambda k: F.get(lines, k)["text"]), " ")
    hold = lambda i, j: F.exists(F.sequence(i, j), lambda k: F.get(lines, k)["marked"])
    from_ = lambda i: F.transform(F.filter(ends(i), lambda j: hold(i, j) & (between(i, j) < LONGEST)), lambda j: F.struct(i.alias("first"), j.alias("last"), text(i, j).alias("text")))
    # No run from a unit on reaches a marked one if the next LONGEST + 2 units aren't.
    near = lambda i: F.exists(ends(i), lambda k: F.get(lines, k)["marked"])
    every = F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), near), from_))
    return F.when(F.size(lines) > 0, F.filter(every, lambda x: anchored(x["text"]) | possible(words_of(x["text"])))).otherwise(F.array().cast("array<struct<first:int,last:int,text:string>>"))


def entries(lines: Column, weights: np.ndarray, bias: np.ndarray, threshold: float) -> Column:
    """first, last, family, probability, overlap and marks (places of the family's names) of what counts in each run."""
    names = lambda family: F.element_at(literal([[], *(NAMES[c] for c in TEMPLATES)], "array<array<string>>"), F.array_position(literal(list(CLASSES), "array<string>"), family).cast("int"))
    at = lambda k, own: F.filter(F.transform(words_of(F.get(lines, k)["text"]), lambda w, p: F.when(F.array_contains(own, w), k * LONGEST + p)), lambda m: m.isNotNull())
    marks = lambda x, family: bound(names(family), lambda own: F.flatten(F.transform(F.sequence(x["first"], x["last"]), lambda k: at(k, own))))
    entry = lambda x, y: F.struct(x["first"].alias("first"), x["last"].alias("last"), *(y[c].alias(c) for c in ("family", "probability", "overlap")), F.when(y["family"] != "unknown", marks(x, y["family"])).otherwise(F.array().cast("array<int>")).alias("marks"))
    return F.flatten(F.transform(runs(lines), lambda x: F.transform(judged(x["text"], weights, bias, threshold), lambda y: entry(x, y))))


def chosen(found: Column) -> Column:
    """The confirmed entries that share no word of their names with a better one; without any the best of the unknown."""
    order = F.sort_array(F.transform(found, lambda x: F.struct((x["family"] == "unknown").alias("a"), (-x["overlap"]).alias("b"), (x["last"] - x["first"]).alias("c"), x["first"].alias("d"), x.alias("x"))))

    def pick(best: Column) -> Column:
        """Words that an entry takes are marked, WORD of them to a number, so each looks at the numbers of its own words only."""
        known = F.filter(best, lambda x: x["family"] != "unknown")
        # Places of entries are gathered, not entries: small numbers are cheap to carry along.
        placed = F.transform(known, lambda x, i: F.struct(x["marks"].alias("marks"), i.alias("i")))
        last = F.coalesce(F.array_max(F.transform(known, lambda x: x["last"])), F.lit(-1))
        bit = lambda m: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(m, F.lit(WORD)).cast("int"))
        word = lambda m: F.floor(m / WORD).cast("int")
        taken = lambda acc, x: F.exists(x["marks"], lambda m: F.get(acc["taken"], word(m)).bitwiseAND(bit(m)) != 0)
        state = lambda marks, out: F.struct(marks.alias("taken"), out.alias("out"))
        more = lambda x, v, k: F.aggregate(F.filter(x["marks"], lambda m: word(m) == k), v, lambda acc, m: acc.bitwiseOR(bit(m)))
        reached = lambda x, k: (k >= word(F.element_at(x["marks"], 1))) & (k <= word(F.element_at(x["marks"], -1)))
        marked = lambda acc, x: F.transform(acc["taken"], lambda v, k: F.when(reached(x, k), more(x, v, k)).otherwise(v))
        add = lambda acc, x: F.when(taken(acc, x), acc).otherwise(state(marked(acc, x), F.concat(acc["out"], F.array(x["i"]))))
        none = state(F.array_repeat(F.lit(0).cast("long"), word((last + 1) * LONGEST) + 1), F.array().cast("array<int>"))
        picked = F.aggregate(placed, none, add, lambda acc: acc["out"])
        free = bound(known, lambda k: F.transform(picked, lambda i: F.get(k, i)))
        return F.when(F.size(known) > 0, F.array_sort(free)).otherwise(F.slice(best, 1, 1))

    return bound(F.transform(order, lambda x: x["x"]), pick)


def scanned(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column name: array of struct(paragraph, family, probability, overlap), one for each notice of a paragraph,
    or one unknown if it has an anchor or words of a template only; paragraph counts paragraphs with a word from 0. Null
    where the text is null."""
    weights, bias, threshold = trained()
    numbered = F.filter(F.transform(paragraphs(F.col("text")), lambda x, i: F.struct(i.alias("paragraph"), x.alias("text"))), lambda x: anchored(x["text"]) | possible(words_of(x["text"])))
    kept = F.transform(numbered, lambda x: F.struct(x["paragraph"].alias("paragraph"), bound(units(x["text"]), lambda u: chosen(entries(u, weights, bias, threshold))).alias("k")))
    out = F.flatten(F.transform(kept, lambda x: F.transform(x["k"], lambda y: F.struct(x["paragraph"].alias("paragraph"), *(y[c].alias(c) for c in ("family", "probability", "overlap"))))))
    # Most texts can hold no notice at all; one look at the whole text spares the rest.
    return docs.withColumn(name, F.when(anchored(F.col("text")) | hopeful(F.col("text")), out).when(F.col("text").isNotNull(), F.array().cast("array<struct<paragraph:int,family:string,probability:double,overlap:double>>")))


def op1_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_paragraphs, n_anchored, n_licences, families (sorted, comma-joined), probability (the highest of the
    confirmed ones, 0 if none) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    name = own_name(docs, "scan")
    known = F.filter(F.coalesce(name, F.array().cast("array<struct<paragraph:int,family:string,probability:double,overlap:double>>")), lambda x: x["family"] != "unknown")
    words = F.size(paragraphs(F.col("text")))
    rows = scanned(docs, name).select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(words).cast("long").alias("n_paragraphs"), F.coalesce(F.size(F.array_distinct(F.transform(name, lambda x: x["paragraph"]))), F.lit(0)).cast("long").alias("n_anchored"), known.alias("known"))
    return rows.select("doc_id", "n_paragraphs", F.greatest("n_anchored", F.lit(0)).alias("n_anchored"), F.size("known").cast("long").alias("n_licences"), F.array_join(F.array_sort(F.array_distinct(F.transform("known", lambda x: x["family"]))), ",").alias("families"), F.coalesce(F.array_max(F.transform("known", lambda x: x["probability"])), F.lit(0.0)).alias("probability"))
