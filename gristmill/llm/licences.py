"""Licence scan: a trained classifier of paragraphs, confirmed against templates, in DataFrame operations only.

A softmax regression on word n-grams is trained on paragraphs made from the templates below, with classes for each
family, for other licences and for none. Whether a named family is believed depends on its share among families and on
how much of one of its templates the paragraph holds; how much of each is needed is fitted on families that models
trained without them were shown. What isn't believed is of an unknown licence.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by which public licences are given or named, by family.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Unless required by applicable law or agreed to in writing, software",
        "distributed under the License is distributed on an \"AS IS\" BASIS,",
        "SPDX-License-Identifier: Apache-2.0",
        "Available under Apache-2.0.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Available under the MIT licence.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL, version 2 or later.",
        "Licensed under the GPLv2 or later.",
        "Released under the GPLv3.",
        "Distributed under GPLv3 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "Licensed under the LGPL, version 3.",
        "Licensed under the LGPLv3 or later.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "bsd": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz.",
        "Cette œuvre est mise à disposition selon les termes de la Licence Creative Commons Attribution 4.0 International.",
        "Esta obra está bajo una Licencia Creative Commons Atribución 4.0 Internacional.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "public-domain": [
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "proprietary": [
        "Copyright. All rights reserved.",
        "No part of this publication may be reproduced.",
        "Alle Rechte vorbehalten.",
        "Tous droits réservés.",
        "Todos los derechos reservados.",
        "All rights reserved. No part of this publication may be reproduced or distributed without the prior written permission of the publisher.",
        "This software is confidential and proprietary; unauthorized copying is prohibited.",
    ],
}
#: Notices of licences outside these families.
OTHER_LICENCES = [
    "Licensed under the Artistic License 2.0.", "Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: ISC", "Licensed under the Eclipse Public License, Version 2.0.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Licensed under the European Union Public Licence, version 1.2.", "This font software is licensed under the SIL Open Font License, Version 1.1.", "Licensed under the Microsoft Public License.",
    "This program is licensed under the GNU Affero General Public License, version 3.", "Subject to the Common Development and Distribution License, Version 1.0.", "Released under the Do What The Fuck You Want To Public License.",
    "Licensed under the Open Database License.", "This work is licensed under the GNU Free Documentation License, version 1.3.", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: AGPL-3.0-only",
]
#: Sentences that speak of licences without giving one.
OTHERS = [
    "He lost his driving license on the way to the airport.", "The license fee for the television rises next year.", "The bar applied for a new license to sell beer.",
    "The general public was not allowed to enter the building.", "A warranty of two years covers all parts of the machine.", "The software was written in the spring and tested in the summer.",
    "Permission to land was granted at noon.", "The foundation published a report on free speech.", "Common sense is creative, and attribution matters.",
    "The copyright office moved to another town.", "They reserved two rooms under the name of the company.", "The apache tribe lived in the south.", "A version of the story was released to the press.",
    "The work of the public library is known far and wide.", "The terms of the contract were changed without notice.", "The fishing license costs ten and is sold in every shop.",
]
#: Frequent words of running text, which by themselves name no licence (German has the word "mit").
COMMON = "mit der die das und von zu den ein ist auf nicht sich que los las para con por una del se en le la les des et un une est dans pour sur au qui this that the of to and in is it or as by at an are was be for with not from you may any no all".split()
#: Words of any text that occur in notices; by themselves they are no reason to look at a paragraph.
GENERIC = frozenset(COMMON) | frozenset(
    "a above agreed all alle any appear are arising as associated authors bajo basis both can charge common conditions copy database deal dedicated development do documentation either einer esta está event except express fee files following font "
    "for form forms governed held implied in into kind later law library liable los made may met microsoft mise modify no obra on open or out part person prior program project provided public published publication purpose released required restriction selon "
    "source code subject termes terms that this to tous todos under union universal use v version want what will with without work werk writing written international 1 2 3 4 1.0 1.1 1.2 1.3 2.0 2.1 3.0 4.0 à œuvre de software free domain order distributed".split()
)
WORD = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"
NONE, UNKNOWN = "none", "unknown"
#: A line break within a sentence: lines that were wrapped are read as one paragraph.
WRAPPED = r"(?<![\s.!?:;\"])[ \t]*\r?\n[ \t]*(?=\p{Ll})"


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.+-][^\W_]+)*", text.lower())


@dataclass(frozen=True)
class Model:
    """weights: by n-gram, one for each class (families, unknown, none); least: the probability of any licence from which on there is one; belief: of a constant, the log odds of a family among families and the similarity."""

    classes: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    least: float
    belief: tuple[float, float, float]
    templates: dict[str, tuple[dict[str, float], ...]]

    def probabilities(self, text: str) -> list[float]:
        found = [self.weights[g] for g in grams(words_of(text)) if g in self.weights]
        scores = [b + sum(w[i] for w in found) for i, b in enumerate(self.bias)]
        e = [math.exp(s - max(scores)) for s in scores]
        return [x / sum(e) for x in e]

    def evidence(self, text: str) -> tuple[str, float, float, float]:
        """family (the likeliest), probability of any licence, log odds of the family among licences, similarity."""
        p, have = self.probabilities(text), grams(words_of(text))
        best = max(range(len(self.classes) - 2), key=lambda i: p[i])
        licence = sum(p[:-1])
        share = min(max(p[best] / licence, 1e-6), 1 - 1e-6)
        return self.classes[best], licence, math.log(share / (1 - share)), max(sum(x for g, x in t.items() if g in have) for t in self.templates[self.classes[best]])

    def family(self, text: str) -> str:
        name, licence, odds, similarity = self.evidence(text)
        believed = self.belief[0] + self.belief[1] * odds + self.belief[2] * similarity >= 0
        return NONE if licence < self.least else name if believed else UNKNOWN

    @property
    def telling(self) -> list[str]:
        """Words of which a text with a licence has one: all n-grams without them can't add up to a licence."""
        w, b = np.array(list(self.weights.values())), np.array(self.bias)
        gain, start = np.maximum(w[:, :-1] - w[:, -1:], 0), b[:-1] - b[-1]
        words = [g.split(" ") for g in self.weights]
        left, out = np.ones(len(words), bool), []
        while np.exp(start + gain[left].sum(axis=0)).sum() >= self.least:
            weight: dict[str, float] = {}
            for i in np.flatnonzero(left):
                for x in set(words[i]) - GENERIC:
                    weight[x] = weight.get(x, 0.0) + float(gain[i].max())
            if not weight:
                return []  # even a text without any would count as one: all are scored
            out.append(max(sorted(weight), key=weight.__getitem__))
            left &= np.array([out[-1] not in x for x in words])
        return out


def examples(seed: int, copies: int) -> list[tuple[str, str]]:
    """Paragraphs of each family: its templates, whole or a line's length of them, with words left out or put in, and with other words around them.

    Those of no family are of other sentences' words and of common words, short and long.
    """
    draw = random.Random(seed)
    filler = [w for s in OTHERS for w in words_of(s)] + ["zu", "der", "que", "les", "para"]
    out = []
    for family, notices in [*TEMPLATES.items(), (UNKNOWN, OTHER_LICENCES), (NONE, OTHERS)]:
        for notice in notices:
            for _ in range(copies if family != NONE else copies // 2):
                words = words_of(notice)
                if family != NONE and len(words) > 12 and draw.random() < 0.3:
                    at = draw.randrange(len(words) - 7)
                    words = words[at : at + draw.randrange(8, 13)]
                words = [w for w in words if draw.random() > 0.06] or words
                for _ in range(draw.choice((0, 0, 1, 2))):
                    words.insert(draw.randrange(len(words) + 1), draw.choice(filler))
                around = [draw.choice(filler) for _ in range(draw.choice((0, 0, 3, 8)))]
                out.append((family, " ".join(around + words if draw.random() < 0.5 else words + around)))
    for k in range(copies * 24):
        known = (filler, COMMON + filler[:40], COMMON)[k % 3]
        out.append((NONE, " ".join(draw.choice(known) for _ in range(draw.choice((draw.randrange(1, 4), draw.randrange(3, 20), draw.randrange(20, 150)))))))
    out += [(NONE, " ".join(["mit"] * k)) for k in (1, 2) for _ in range(copies)]
    draw.shuffle(out)
    return out


def vectors(texts: list[str], known: dict[str, int]) -> np.ndarray:
    out = np.zeros((len(texts), len(known) + 1), np.float32)
    out[:, -1] = 1
    for i, t in enumerate(texts):
        out[i, [known[g] for g in grams(words_of(t)) if g in known]] = 1
    return out


def fit(x: np.ndarray, y: np.ndarray, classes: int, ridge: float = 3e-4, rounds: int = 400, rate: float = 0.1) -> np.ndarray:
    """Softmax regression (columns of x by classes) by gradient steps with momentum and a scale for each weight."""
    w = np.zeros((x.shape[1], classes), np.float32)
    m, v, want = np.zeros_like(w), np.zeros_like(w), np.eye(classes, dtype=np.float32)[y]
    for k in range(1, rounds + 1):
        e = x @ w
        p = np.exp(e - e.max(axis=1, keepdims=True))
        step = x.T @ (p / p.sum(axis=1, keepdims=True) - want) / len(x) + ridge * w
        m, v = 0.9 * m + 0.1 * step, 0.99 * v + 0.01 * step**2
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return w


def trained(rows: list[tuple[str, str]], without: str | None = None) -> Model:
    """A model of rows(family, paragraph) but for one family; its thresholds aren't set."""
    classes = (*(f for f in TEMPLATES if f != without), UNKNOWN, NONE)
    known = {g: i for i, g in enumerate(sorted({g for f, ns in [*TEMPLATES.items(), (UNKNOWN, OTHER_LICENCES)] if f != without for n in ns for g in grams(words_of(n)) if naming(set(g.split()))}))}
    rows = [r for r in rows if r[0] != without]
    w = fit(vectors([t for _, t in rows], known), np.array([classes.index(f) for f, _ in rows]), len(classes))
    return Model(classes, {g: tuple(round(float(x), 4) for x in w[i]) for g, i in known.items()}, tuple(round(float(x), 4) for x in w[-1]), 0.5, (0.0, 0.0, 0.0), weighted_templates(without))


def weighted_templates(without: str | None = None) -> dict[str, tuple[dict[str, float], ...]]:
    """Of each family's notices the n-grams, those that no other class has at ten times the weight; a notice's weights add up to one."""
    has = {f: {g for n in ns for g in grams(words_of(n))} for f, ns in [*TEMPLATES.items(), (UNKNOWN, OTHER_LICENCES), (NONE, OTHERS)] if f != without}
    weight = lambda g: 1.0 if sum(g in x for x in has.values()) == 1 else 0.1
    out = {}
    for f in has:
        if f in TEMPLATES:
            out[f] = tuple({g: round(weight(g) / sum(map(weight, gs)), 5) for g in gs} for gs in (sorted(grams(words_of(n))) for n in TEMPLATES[f]))
    return out


def naming(words: set[str]) -> bool:
    """Whether an n-gram of these words is one that the model looks at: not if all are words of any text."""
    return not words <= GENERIC


@lru_cache(maxsize=1)
def train(seed: int = 3, copies: int = 16, without: str | None = None) -> Model:
    """Fitted on a bounded set of made paragraphs; thresholds come from another such set.

    least: no more than 1 % of the other set's paragraphs without a licence have that probability of one. belief: a
    logistic regression that tells paragraphs of known families from those of other licences, and of each family as
    models see them that were trained without it.
    """
    rows, others = examples(seed, copies), examples(seed + 1, copies // 2)
    model = trained(rows, without)
    wrong = sorted((sum(model.probabilities(t)[:-1]) for f, t in others if f == NONE), reverse=True)
    least = min(max(0.3, round(wrong[len(wrong) // 100], 4)), 0.9)
    seen = [(*model.evidence(t), f) for f, t in others if f not in (NONE, without)]
    for left in TEMPLATES:
        if left != without:
            blind = trained([r for r in rows if r[0] != without], left)
            seen += [(*blind.evidence(t), UNKNOWN) for f, t in others if f == left]
    used = [(1.0, odds, similarity, name == f) for name, licence, odds, similarity, f in seen if licence >= least]
    x, y = np.array([u[:3] for u in used], np.float32), np.array([u[3] for u in used], int)
    w = fit(x, y, 2, 1e-4, 1500, 0.05)
    belief = tuple(round(float(v), 4) for v in w[:, 1] - w[:, 0])
    return Model(model.classes, model.weights, model.bias, least, belief, model.templates)


def classify_paragraph(paragraph: Column, model: Model) -> Column:
    """struct(family, probability, similarity, confirmed) of a paragraph. probability: of the family, or of any licence, or of none."""
    families = model.classes[:-2]
    number = {g: i for i, g in enumerate(model.weights)}
    table = F.create_map(*(x for g, w in model.weights.items() for x in (F.lit(g), F.array(*map(F.lit, w)))))
    words = F.regexp_extract_all(F.lower(paragraph), F.lit(f"({WORD})"), F.lit(1))
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(words, pairs))
    known = F.array(*map(F.lit, number))
    scores = lambda have: F.aggregate(F.array_intersect(have, known), F.array(*map(F.lit, model.bias)), lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))

    def similarity(have: Column, best: Column) -> Column:
        of = [F.array(*(F.create_map(*(x for g, v in t.items() for x in (F.lit(g), F.lit(v)))) for t in model.templates[f])) for f in families]
        some = F.element_at(F.array(*of), best)
        return F.array_max(F.transform(some, lambda t: F.aggregate(have, F.lit(0.0), lambda acc, g: acc + F.coalesce(F.try_element_at(t, g), F.lit(0.0)))))

    def scored(have: Column) -> Column:
        return F.struct(have.alias("found"), scores(have).alias("scores"))

    def judged(s: Column) -> Column:
        return F.struct(s["found"].alias("found"), F.transform(s["scores"], lambda x: F.exp(x - F.array_max(s["scores"]))).alias("e"))

    def measured(s: Column) -> Column:
        total = F.aggregate(s["e"], F.lit(0.0), lambda acc, x: acc + x)
        top = F.array_max(F.slice(s["e"], 1, len(families)))
        licence = 1 - F.element_at(s["e"], -1) / total
        best = F.array_position(s["e"], top).cast("int")
        best = F.when(best > len(families), 1).otherwise(best)
        return F.struct(best.alias("best"), (top / total).alias("p"), licence.alias("licence"), similarity(s["found"], best).alias("similarity"))

    def decided(s: Column) -> Column:
        share = F.least(F.greatest(s["p"] / F.greatest(s["licence"], F.lit(1e-9)), F.lit(1e-6)), F.lit(1 - 1e-6))
        believed = model.belief[0] + model.belief[1] * F.ln(share / (1 - share)) + model.belief[2] * s["similarity"] >= 0
        none = s["licence"] < model.least
        family = F.when(none, NONE).when(believed, F.element_at(F.array(*map(F.lit, families)), s["best"])).otherwise(UNKNOWN)
        chance = F.when(none, 1 - s["licence"]).when(believed, s["p"]).otherwise(s["licence"])
        return F.struct(family.alias("family"), chance.alias("probability"), F.when(none, 0.0).otherwise(s["similarity"]).alias("similarity"), (~none & believed & (s["similarity"] >= 0.5)).alias("confirmed"))

    # one-element arrays keep Spark from copying what is computed once into every place it is used at
    steps = F.array(every)
    for f in (scored, judged, measured, decided):
        steps = F.transform(steps, f)
    return F.element_at(steps, 1)


def paragraphs(text: Column) -> Column:
    """Lines, those that were wrapped within a sentence joined."""
    return F.split(F.regexp_replace(text, WRAPPED, " "), r"\r?\n")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Per row: key, n_paragraphs, n_licences, families (distinct, sorted, joined by commas) and licences.

    licences is an array of (paragraph, text, family, probability, similarity, confirmed), one for each paragraph
    that names a licence, of a known family or unknown. Paragraphs are lines, wrapped ones joined; a null or empty
    text has none. All of a text is read. Texts and paragraphs without any of the model's telling words are of no
    licence whatever else they hold, so only the others are scored. No shuffle; repeated rows are scanned again.
    """
    model = model or train()
    telling = model.telling
    may = (lambda c: F.rlike(F.lower(c), F.lit(r"(?<![\p{L}\p{N}])(?:" + "|".join(sorted(map(re.escape, telling))) + r")(?![\p{L}\p{N}])"))) if telling else (lambda c: F.lit(True))
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(F.filter(F.transform(paragraphs(body), lambda x, i: F.struct((i + 1).alias("paragraph"), x.alias("text"))), lambda x: may(x["text"])), lambda x: F.struct(x["paragraph"], x["text"], classify_paragraph(x["text"], model).alias("c")))
    named = F.transform(F.filter(lines, lambda x: x["c"]["family"] != NONE), lambda x: F.struct(x["paragraph"], x["text"], *(x["c"][c].alias(c) for c in ("family", "probability", "similarity", "confirmed"))))
    rows = docs.select(F.col(key), F.size(F.filter(paragraphs(body), lambda x: F.trim(x) != "")).alias("n_paragraphs"), F.when(may(body), named).alias("licences"))
    rows = rows.withColumn("licences", F.coalesce("licences", F.array().cast(rows.schema["licences"].dataType)))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",")
    return rows.select(key, "n_paragraphs", F.size("licences").alias("n_licences"), families.alias("families"), "licences")
