"""License scan by a trained paragraph classifier, in DataFrame operations only.

Paragraphs are lines, cut further at sentence ends, and passages of several lines between blank lines and sentence ends. Their
lower-case word unigrams and bigrams (presence) feed a multinomial logistic regression over licence families and an unknown class. It is trained on the driver from the public templates below,
varied by a seeded augmentation, and unlike sentences; a temperature and a threshold, fitted on held-out variants, calibrate
it. A prediction stands only if a template of its family confirms it by shared words. The weights (one vector for every unigram
and bigram of the templates and unlike sentences) go into the plan as a literal; a text without a distinctive word costs one regular-expression search.

Looked at are lines with a trigger word, and all lines and passages that share enough words with any template to be confirmed.
To be confirmed, a paragraph has to hold one of the distinctive words of a template: so many of its longest ones that the rest
are too few to confirm it. A passage is left out if one of its lines tells the same family.

Defined results: null and empty texts have no licence; a paragraph not looked at is unknown; repeated rows are scanned
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Usual wordings of licence notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache 2.0 license.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.", "Released under the GPL v3.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.", "Released under the GPL v2.", "SPDX-License-Identifier: GPL-2.0-only",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version",
    ),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 3.", "Released under the LGPL license.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL v3 license.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": (
        "Released under the BSD License.", "Licensed under the 3-clause BSD license.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "ISC": (
        "Released under the ISC License.", "Licensed under the ISC license.", "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC0": ("To the extent possible under law, the author has waived all copyright, released under CC0.", "Dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "proprietary": ("Copyright, all rights reserved.", "All rights reserved. No part of this publication may be reproduced without permission.", "Proprietary and confidential, unauthorized copying is prohibited, copyright reserved."),
}
UNLIKE = (
    "He renewed his driving license last week.", "A licensed plumber came to the house.", "The licence fee was raised by the government.", "They quarrelled about copyright for years.",
    "The pilot lost the license after the accident.", "Apache helicopters flew over the town.", "She studied physics at MIT in Boston.", "The general public was not admitted.",
    "Permission to enter was granted by the office.", "The bar applied for a liquor license.", "Version 3 of the plan was better than version 2.", "The creative director left the commons.",
    "Poetic license explains the ending.", "The fishing licence costs ten pounds.", "The reserved seats were free of charge.", "The Mozilla browser opened the page.",
)
UNKNOWN = "unknown"
TRIGGER = r"(?i)licen[cs]e|copyright|\bgpl|spdx|\bcc0|\bcc by|creative commons|public domain|rights reserved|permission is hereby|is hereby granted|redistribution and use|free software foundation"
# Repeated groups are possessive: a dotted word of any length is matched without recursion.
_WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*+"
_BREAK = r"[\n\r]+|(?<=[.!?])[ \t]+(?=[A-Z])"
# Blank lines, and sentence ends with the line ends and comment marks behind them.
_MARKS = r"[ \t*#;/%>|-]*"
_PASSAGE = rf"(?:\r\n?+|\n){_MARKS}(?:\r\n?+|\n)|(?<=[.!?])(?=[ \t\n\r])[ \t]*+(?:[\n\r]++{_MARKS}+)*+(?=[A-Z])"
# The Creative Commons licences are also written with a dash: "CC-BY-SA 4.0" has the words of "CC BY-SA 4.0".
_DASHED = r"(?<![a-z0-9])cc-(by(?:-(?:sa|nc|nd))*+)(?![a-z0-9])(?![.+-][a-z0-9])"
CONFIRM = 0.6


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def distinctive_words(confirm: float = CONFIRM) -> list[str]:
    """Of every template so many of its longest words that a paragraph with none of them holds too few to be confirmed."""
    out: set[str] = set()
    for sentence in (s for sentences in TEMPLATES.values() for s in sentences):
        words = sorted(set(words_of(sentence)), key=lambda w: (-len(w), w))
        need = next(n for n in range(1, len(words) + 1) if n / len(words) >= confirm)
        out |= set(words[: len(words) - need + 1])
    return sorted(out)


def _prefilter(words: list[str]) -> str:
    """An expression for texts in lower case that hold any of ``words``."""
    by_first: dict[str, list[str]] = {}
    for w in words:
        by_first.setdefault(w[0], []).append(re.escape(w[1:]))
    return "(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items())) + ")(?![a-z0-9])"


def grams(text: str) -> set[str]:
    words = words_of(text)
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def _variants(seed: int, each: int) -> tuple[list[set[str]], list[int]]:
    r = random.Random(seed)
    noise = lambda k: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(k)]
    xs, ys = [], []
    for label, sentences in enumerate([*TEMPLATES.values(), UNLIKE]):
        for sentence in sentences:
            for i in range(each if label < len(TEMPLATES) else each // 2):
                words = sentence.split()
                if i:
                    words = [w for w in words if r.random() > 0.06] or words
                    words = noise(r.randint(0, 4)) + words + noise(r.randint(0, 4))
                xs.append(grams(" ".join(words)))
                ys.append(label)
    common = ["license", "licensed", "under", "the", "version", "copyright", "released", "work", "this", "is", "rights", "terms", "of"]
    for _ in range(each * 6):
        words = noise(r.randint(2, 20))
        for w in r.sample(common, r.randint(0, 4)):
            words.insert(r.randint(0, len(words)), w)
        xs.append(grams(" ".join(words)))
        ys.append(len(TEMPLATES))
    return xs, ys


class LicenceModel:
    """Sparse multinomial logistic regression with a temperature and an unknown threshold."""

    def __init__(self, seed: int = 8):
        xs, ys = _variants(seed, 24)
        vocabulary = {g for sentences in TEMPLATES.values() for s in sentences for g in grams(s)} | {g for s in UNLIKE for g in grams(s)}
        seen = Counter(g for x in xs for g in x if g in vocabulary)
        self.features = sorted(seen)
        self.classes = [*TEMPLATES, UNKNOWN]
        x, y = self._matrix(xs), np.array(ys)
        w, b, k = np.zeros((x.shape[1], len(self.classes))), np.zeros(len(self.classes)), len(self.classes)
        hot = np.eye(k)[y]
        for _ in range(400):
            z = x @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - hot) / len(y)
            w -= 4.0 * (x.T @ g + 1e-5 * w)
            b -= 4.0 * g.sum(0)
        held_x, held_y = _variants(seed + 1, 8)
        z, hy = self._matrix(held_x) @ w + b, np.array(held_y)

        def nll(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(hy)), hy]).mean())

        self.temperature = min((0.4, 0.5, 0.6, 0.8, 1.0, 1.25, 1.6, 2.0), key=nll)
        p = np.exp((z - z.max(1, keepdims=True)) / self.temperature)
        p /= p.sum(1, keepdims=True)
        top = p[:, :-1].max(1)
        wrong = (p[:, :-1].argmax(1) != hy) & (p.argmax(1) != k - 1)
        self.threshold = float(max(0.5, np.quantile(top[wrong], 0.9) if wrong.any() else 0.5))
        self.weights, self.bias = w, b

    def _matrix(self, xs: list[set[str]]) -> np.ndarray:
        at = {g: i for i, g in enumerate(self.features)}
        out = np.zeros((len(xs), len(at)))
        for row, x in enumerate(xs):
            out[row, [at[g] for g in x if g in at]] = 1
        return out


def _constant(value: list, kind: str) -> Column:
    """A table as one literal of the plan, however many entries it has."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _words(paragraph: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.lower(paragraph), _DASHED, "cc $1"), F.lit(f"({_WORD})"), 1)


def _confirmable(paragraph: Column, confirm: float = CONFIRM) -> Column:
    """Whether the paragraph holds enough words of any template."""
    every = _constant([sorted(set(words_of(s))) for sentences in TEMPLATES.values() for s in sentences], "array<array<string>>")
    # bound, so that the words are cut out once
    return F.exists(F.array(_words(paragraph)), lambda words: F.exists(every, lambda t: F.size(F.array_intersect(t, words)) / F.size(t) >= confirm))


def classify(paragraph: Column, model: LicenceModel, confirm: float = CONFIRM) -> Column:
    """struct<family, score, confirmed> of one paragraph."""
    words = _words(paragraph)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    mine = F.array_distinct(F.concat(words, pairs))
    names = _constant(model.features, "array<string>")
    table = _constant(model.weights.tolist(), "array<array<double>>")
    places = F.filter(F.transform(mine, lambda g: F.array_position(names, g)), lambda i: i > 0)
    logits = F.aggregate(places, _constant(model.bias.tolist(), "array<double>"), lambda acc, i: F.zip_with(acc, F.element_at(table, i.cast("int")), lambda a, b: a + b))
    families = _constant(model.classes, "array<string>")
    templates = _constant([[sorted(set(words_of(t))) for t in TEMPLATES[c]] if c in TEMPLATES else [[""]] for c in model.classes], "array<array<array<string>>>")

    def settled(z: Column) -> Column:
        top = F.array_max(z)
        best = F.array_position(z, top).cast("int")
        share = 1 / F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp((v - top) / model.temperature))
        overlap = F.array_max(F.transform(F.element_at(templates, best), lambda t: F.size(F.array_intersect(t, words)) / F.size(t)))
        family = F.when(share >= model.threshold, F.element_at(families, best)).otherwise(UNKNOWN)
        return F.struct(family.alias("family"), share.alias("score"), ((family != UNKNOWN) & (overlap >= confirm)).alias("confirmed"))

    return F.transform(F.array(logits), settled)[0]


def find_licences(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """``docs`` (all columns) with ``licences``: array of (paragraph, family, score, confirmed) for the paragraphs looked at."""
    model = model or LicenceModel()
    text = F.col("text")
    near = _prefilter(distinctive_words())
    # the words of "cc-by 4.0" are not all in the text as it stands
    held = lambda c: F.regexp_replace(F.lower(c), _DASHED, "cc $1").rlike(near)
    lines = F.filter(F.split(text, _BREAK), lambda u: u.rlike(TRIGGER) | (held(u) & _confirmable(u)))
    passages = F.filter(F.split(text, _PASSAGE), lambda u: F.trim(u).rlike(r"[^\n\r][\n\r]+[^\n\r]") & held(u) & _confirmable(u))
    none = F.array().cast("array<struct<paragraph:string,family:string,score:double,confirmed:boolean>>")

    def rated(units: Column) -> Column:
        both = F.transform(units, lambda u: F.struct(u.alias("paragraph"), classify(u, model).alias("c")))
        return F.transform(both, lambda r: F.struct(r["paragraph"].alias("paragraph"), r["c"]["family"].alias("family"), r["c"]["score"].alias("score"), r["c"]["confirmed"].alias("confirmed")))

    looked = F.when(text.rlike(TRIGGER) | held(text), F.struct(lines.alias("lines"), passages.alias("passages")))
    found = docs.withColumn("_units", looked).withColumn("_lines", F.when(F.size("_units.lines") > 0, rated(F.col("_units.lines"))).otherwise(none))
    found = found.withColumn("_passages", F.when(F.size("_units.passages") > 0, rated(F.col("_units.passages"))).otherwise(none))
    told = lambda p: F.exists("_lines", lambda l: l["confirmed"] & (l["family"] == p["family"]) & p["paragraph"].contains(l["paragraph"]))
    return found.withColumn("licences", F.concat("_lines", F.filter("_passages", lambda p: ~told(p)))).drop("_units", "_lines", "_passages")


def licence_digest(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """doc_id, number of paragraphs looked at, of confirmed ones, the confirmed families in order, and their best score."""
    found = find_licences(docs.select("doc_id", "text"), model)
    sure = F.filter("licences", lambda l: l["confirmed"])
    return found.select(
        F.col("doc_id").cast("long"), F.size("licences").cast("long").alias("n_candidates"), F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda l: l["family"]))), ",").alias("families"),
        F.round(F.array_max(F.transform(sure, lambda l: l["score"])), 6).alias("best_score"),
    )
