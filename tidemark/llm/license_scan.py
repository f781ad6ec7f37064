"""Licence scan: a trained paragraph classifier, confirmed by template comparison, with DataFrame functions only.

Paragraphs are single lines, and all lines between blank ones joined, since notices are often wrapped. They are sparse bags of
word 1- and 2-grams. A multinomial logistic regression over those n-grams, made sparse by a penalty on absolute weights, gives
each licence family a probability, with ``unknown`` a class of its own. Unknown is learned from ordinary sentences, from notices
of licences outside the families, and from notices that name licences that do not exist, so that "licensed under the ...
license" alone says nothing. Probabilities are calibrated by one temperature, fitted on paragraphs held out of the fit, which
hold the notices of other licences than the fit saw, so that the cut below which a family is called unknown means what it says.

A paragraph without any n-gram that has a weight gets the intercept's verdict, which is unknown; trained() makes sure of that.
Such paragraphs are found by one pattern over the model's own n-grams and leave before n-grams are made, which changes no
result.

A predicted family is confirmed if the paragraph's n-grams cover ``CONFIRM`` of one of the family's templates, and as much of
those n-grams of the template that no other family and no licence outside of them has.

The training paragraphs are the notices below with words dropped, changed and added by a fixed rule, and counter-examples;
their number is fixed, so the fit runs on the driver and the model is a bounded literal of the plan.

Defined results: a null or empty text has no paragraphs; equal paragraphs are reported each; of families that are equally
likely the first in order is taken; a very long paragraph is judged whole; repeated rows are each reported; an empty table
gives an empty result; ids of any type are kept as they are; further columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"

#: Share of a template's n-grams that a paragraph must hold, and least calibrated probability of a family.
CONFIRM, CERTAIN = 0.6, 0.5

# The customary notices of public licences, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "This code is licensed under the Apache 2.0 license.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ),
    "LGPL": ("This library is licensed under the GNU Lesser General Public License.",),
    "AGPL": ("This program is licensed under the GNU Affero General Public License.",),
    "BSD": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0": ("Released under CC0 1.0 Universal, dedicated to the public domain.", "Released under CC0 1.0."),
    "proprietary": ("All rights reserved.", "Copyright, all rights reserved. No part of this publication may be reproduced without permission."),
}

# Sentences that share words with licences but grant none.
OTHERS: tuple[str, ...] = (
    "You need a driving licence to rent a car here.",
    "The restaurant lost its license to serve wine.",
    "He asked the committee for permission to speak.",
    "The public library opens at nine and is free for all.",
    "All seats are reserved for members of the club.",
    "Human rights are a matter of public law.",
    "The software comes with a new version of the manual.",
    "A general warranty covers the engine for two years.",
    "The copyright debate went on for years in parliament.",
    "The terms of the contract were published last week.",
    "The creative team met in the common room for this work.",
    "The source of the river lies in the free state, under the hills.",
    "Every person may use the copy in the office without charge.",
    "The Mozilla browser and the Apache helicopter have little in common.",
    "She studied at MIT before she founded the company.",
    "The following conditions were met in the first round.",
)

# Customary notices of licences outside the families. The first are in the fit, the last in its calibration.
OUTSIDE: tuple[str, ...] = (
    "Licensed under the ISC license.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This software is provided as-is under the zlib license.",
    "Made available under the terms of the Eclipse Public License, version 2.0.",
    "Licensed under the Eclipse license, Version 2.0.",
    "Licensed under CC BY-ND 4.0.",
    "Licensed under CC BY-NC-SA 4.0.",
    "Licensed under CC BY-NC-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "Some rights reserved.",
    "Licensed under the Artistic License 2.0.",
    "Licensed under the Academic Free License version 3.0.",
    "Released under the Unlicense.",
    "Licensed under the Ruby license.",
)
OUTSIDE_HELD: tuple[str, ...] = (
    "Licensed under the Python Software Foundation License Version 2.",
    "Released under the PostgreSQL License.",
    "Licensed under the Common Development and Distribution License, version 1.1.",
    "This font is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Reserved rights of the owner stay as they are.",
)

# How a notice names its licence.
NAMING: tuple[str, ...] = ("Licensed under the {} license.", "Released under the {} License.", "Licensed under the {} License, Version 2.0.", "This work is licensed under the {} License, version 3.", "This program is licensed under the {} Public License.", "Licensed under {} 4.0.")

_WORD = r"[a-z0-9]+"


def ngrams_of(text: str) -> list[str]:
    """Distinct word 1- and 2-grams, the form that the plan computes too."""
    words = re.findall(_WORD, text.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


def _variants(text: str, rnd: random.Random, n: int) -> list[str]:
    words, out = text.split(), [text]
    for _ in range(n):
        w = [x for x in words if rnd.random() > 0.08] or words
        for _ in range(rnd.randint(0, 2)):
            w.insert(rnd.randint(0, len(w)), rnd.choice(["project", "2024", "see", "file", "our", "docs", "and", "team", "code", "here"]))
        out.append(" ".join(w))
    return out


def _invented(rnd: random.Random, n: int) -> list[str]:
    """Notices that name licences that do not exist."""

    def name() -> str:
        return "".join(rnd.choice(["ka", "lo", "mi", "ru", "te", "vo", "zan", "per", "dix"]) for _ in range(rnd.randint(2, 3))).title()

    return [NAMING[k % len(NAMING)].format(" ".join(name() for _ in range(1 + k % 2))) for k in range(n)]


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]  # the last is unknown
    weights: dict[str, tuple[float, ...]]
    intercept: tuple[float, ...]
    temperature: float

    def probabilities(self, text: str) -> dict[str, float]:
        """What the plan computes, for one paragraph in Python."""
        logits = list(self.intercept)
        for g in ngrams_of(text):
            logits = [a + b for a, b in zip(logits, self.weights.get(g, [0.0] * len(logits)), strict=True)]
        e = [math.exp((x - max(logits)) / self.temperature) for x in logits]
        return dict(zip(self.families, (x / sum(e) for x in e), strict=True))

    def pattern(self) -> str:
        """A pattern that finds the texts with one of the model's n-grams, as a tree of their letters."""
        tree: dict = {}
        for gram in self.weights:
            if " " in gram and any(w in self.weights for w in gram.split()):
                continue  # found by its word
            node = tree
            for c in gram:
                node = node.setdefault(c, {})
            node[""] = {}

        def written(node: dict) -> str:
            parts = [(r"(?![a-z0-9])" if c == "" else ("[^a-z0-9]+" if c == " " else c) + written(below)) for c, below in sorted(node.items())]
            return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"

        return "(?i)(?<![a-z0-9])" + written(tree)


def _bags(texts: list[str], vocabulary: dict[str, int]) -> np.ndarray:
    x = np.zeros((len(texts), len(vocabulary)))
    for r, text in enumerate(texts):
        for g in ngrams_of(text):
            if g in vocabulary:
                x[r, vocabulary[g]] = 1
    return x


@cache
def trained(seed: int = 3, rounds: int = 600, rate: float = 2.0, sparsity: float = 2e-4) -> Model:
    """Proximal gradient descent on the n-grams of the training paragraphs, then one temperature on the held-out ones."""
    rnd = random.Random(seed)
    families = (*TEMPLATES, UNKNOWN)
    unknown = len(families) - 1
    rows = [(x, k) for k, f in enumerate(TEMPLATES) for t in TEMPLATES[f] for x in _variants(t, rnd, 24)]
    rows += [(x, unknown) for t in OTHERS for x in _variants(t, rnd, 14)]
    rows += [(x, unknown) for t in OUTSIDE for x in _variants(t, rnd, 24)]
    rows += [(x, unknown) for x in _invented(rnd, 400)]
    held = [r for k, r in enumerate(rows) if k % 5 == 0] + [(x, unknown) for t in OUTSIDE_HELD for x in _variants(t, rnd, 8)]
    rows = [r for k, r in enumerate(rows) if k % 5]
    plain = {w for t in OTHERS for w in re.findall(_WORD, t.lower())} | _FUNCTION_WORDS
    pairs = {g for ts in (*TEMPLATES.values(), OUTSIDE) for t in ts for g in ngrams_of(t) if " " in g}
    named = {w for t in (*OUTSIDE, *(t for ts in TEMPLATES.values() for t in ts)) for w in re.findall(_WORD, t.lower())} | _LICENCE_WORDS
    seen: dict[str, int] = {}
    for x, _ in rows:
        for g in ngrams_of(x):
            if (g in named and (g in _LICENCE_WORDS or g not in plain and len(g) > 2)) or g in pairs and not set(g.split()) <= _FUNCTION_WORDS:
                seen[g] = seen.get(g, 0) + 1
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= 3))}
    x = np.concatenate([_bags([t for t, _ in rows], vocabulary), np.zeros((60, len(vocabulary)))])  # and paragraphs of ordinary text
    y = np.eye(len(families))[[k for _, k in rows] + [unknown] * 60]
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    for _ in range(rounds):
        g = (_softmax(x @ w + b) - y) / len(x)
        w -= rate * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparsity, 0)  # what the penalty takes is nought from here on
        b -= rate * g.sum(0)
    logits = _bags([t for t, _ in held], vocabulary) @ w + b
    truth = np.eye(len(families))[[k for _, k in held]]

    def loss(t: float) -> float:
        return -float(np.log(np.maximum((_softmax(logits / t) * truth).sum(1), 1e-12)).mean())

    temperature = min((0.25 + 0.05 * k for k in range(60)), key=loss)
    weights = {g: tuple(round(float(v), 5) for v in w[i]) for g, i in vocabulary.items() if np.abs(w[i]).max() >= 1e-5}
    if int(np.argmax(b)) != unknown:
        raise ValueError("a paragraph without n-grams of the model has to be unknown")
    return Model(families, weights, tuple(round(float(v), 5) for v in b), temperature)


@cache
def distinguishing(template: str, family: str) -> tuple[str, ...]:
    """The template's n-grams that no other family's template and no notice outside the families has; all if there is none."""
    others = {g for f, ts in TEMPLATES.items() if f != family for t in ts for g in ngrams_of(t)} | {g for t in OUTSIDE for g in ngrams_of(t)}
    grams = ngrams_of(template)
    return tuple(g for g in grams if g not in others) or tuple(grams)


#: Words that are features though ordinary sentences use them too.
_LICENCE_WORDS = frozenset("license licence licensed rights copyright mit apache mozilla permission cc cc0 bsd isc".split())
_FUNCTION_WORDS = frozenset("and are for may not that the this with you your can its any following under work".split())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def judged(paragraph: Column, model: Model) -> Column:
    """struct<family, probability, similarity> of a paragraph; null if it has no feature or is unknown."""
    known = F.array(*[F.lit(g) for g in model.weights])
    weights = F.create_map(*[x for g, w in model.weights.items() for x in (F.lit(g), F.array(*map(F.lit, w)))])
    start = F.array(*[F.lit(b) for b in model.intercept])
    families = F.array(*[F.lit(f) for f in model.families])
    templates = F.create_map(*[x for f, ts in TEMPLATES.items() for x in (F.lit(f), F.array(*[F.struct(F.array(*map(F.lit, ngrams_of(t))).alias("all"), F.array(*map(F.lit, distinguishing(t, f))).alias("own")) for t in ts]))])

    def of_words(words: Column) -> Column:
        pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, k: F.concat(F.get(words, k), F.lit(" "), w))
        return _let(F.array_distinct(F.concat(words, pairs)), of_grams)

    def of_grams(grams: Column) -> Column:
        found = F.array_intersect(grams, known)
        logits = F.aggregate(found, start, lambda acc, g: F.zip_with(acc, F.element_at(weights, g), lambda a, b: a + b))
        shifted = _let(logits, lambda z: _let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp((x - top) / F.lit(model.temperature)))))
        return _let(shifted, lambda e: of_scores(grams, e))

    def of_scores(grams: Column, e: Column) -> Column:
        family = F.element_at(families, F.array_position(e, F.array_max(e)).cast("int"))

        def cover(part: Column) -> Column:
            return F.size(F.array_intersect(part, grams)) / F.size(part)

        near = F.array_max(F.transform(F.element_at(templates, family), lambda t: F.least(cover(t["all"]), cover(t["own"]))))
        found = F.struct(family.alias("family"), F.round(F.array_max(e) / F.aggregate(e, F.lit(0.0), lambda a, b: a + b), 4).alias("probability"), F.round(near, 4).alias("similarity"))
        return F.when(family != UNKNOWN, found)

    return _let(F.regexp_extract_all(F.lower(paragraph), F.lit(_WORD), F.lit(0)), of_words)


def _blocks(lines: Column) -> Column:
    """array<struct<first, lines>>: the runs of lines that are not blank, and the number of the first line of each."""
    every = F.sequence(F.lit(0), F.size(lines) - 1)

    def solid(k: Column) -> Column:
        return F.coalesce(F.get(lines, k).rlike(r"\S"), F.lit(False))

    first = F.filter(every, lambda k: solid(k) & ~solid(k - 1))
    last = F.filter(every, lambda k: solid(k) & ~solid(k + 1))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), F.slice(lines, a + 1, b - a + 1).alias("lines")))


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", certain: float = CERTAIN, confirm: float = CONFIRM) -> DataFrame:
    """A row for each line that the model takes for a licence, or would if it were surer, and one for the lines between two
    blank ones if these are confirmed together for a family that none of them is confirmed for alone.

    ``id_col``, ``line_no``, ``paragraph``, ``family`` (``unknown`` below ``certain``), ``probability`` of the likeliest
    family, ``similarity`` to its nearest template (the lesser of the shares of all its n-grams and of its distinguishing ones)
    and ``confirmed``. Narrow: there is no shuffle.
    """
    model = model or trained()
    wanted = model.pattern()
    lines = docs.where(F.col("text").rlike(wanted)).select(id_col, F.split("text", "\n", -1).alias("lines__"))
    blocks = lines.select(id_col, F.explode(_blocks(F.col("lines__"))).alias("b__")).where(F.array_join("b__.lines", " ").rlike(wanted))

    def rows(paragraphs: Column) -> Column:
        """Verdicts of the paragraphs (no, paragraph), without those that are null."""
        seen = F.filter(paragraphs, lambda p: p["paragraph"].rlike(wanted))
        found = F.transform(seen, lambda p: F.struct(p["no"].alias("no"), p["paragraph"].alias("paragraph"), judged(p["paragraph"], model).alias("j")))
        return F.filter(found, lambda r: r["j"].isNotNull())

    def agreed(r: Column) -> Column:
        return (r["j"]["probability"] >= certain) & (r["j"]["similarity"] >= confirm)

    def with_whole(alone: Column, whole: Column) -> Column:
        return F.concat(alone, F.filter(whole, lambda r: agreed(r) & ~F.exists(alone, lambda a: agreed(a) & (a["j"]["family"] == r["j"]["family"]))))

    each = F.transform(F.col("b__.lines"), lambda x, k: F.struct((F.col("b__.first") + k).alias("no"), x.alias("paragraph")))
    joined = F.filter(F.array(F.struct(F.col("b__.first").alias("no"), F.array_join("b__.lines", "\n").alias("paragraph"))), lambda _: F.size("b__.lines") > 1)
    # the verdict passes through a generator, below which no filter on it can be pushed and repeat its work
    lines = blocks.select(id_col, F.explode(_let(rows(each), lambda alone: with_whole(alone, rows(joined)))).alias("r__"))
    lines = lines.select(id_col, F.col("r__.no").alias("line_no"), F.col("r__.paragraph").alias("paragraph"), F.col("r__.j").alias("j__"))
    sure = F.col("j__.probability") >= certain
    return lines.select(
        id_col,
        "line_no",
        "paragraph",
        F.when(sure, F.col("j__.family")).otherwise(F.lit(UNKNOWN)).alias("family"),
        F.col("j__.probability").alias("probability"),
        F.col("j__.similarity").alias("similarity"),
        (sure & (F.col("j__.similarity") >= confirm)).alias("confirmed"),
    )
