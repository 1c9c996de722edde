"""Licence scans of paragraphs, in DataFrame functions only.

A paragraph is a non-blank line. Its features are the word one-, two- and three-grams of
`[a-z0-9]+` in its lower-case form. A multinomial logistic regression with an L1 penalty,
fitted on statements of licences, variants made of them by rule, and sentences that are
none, gives sparse weights; a quarter of the examples is set aside, on which a
temperature is fitted, and the threshold of the class unknown: a paragraph that is not
`none`, but whose calibrated probability for a family is below what `kept` of the
set-aside licence statements reach, is `unknown`. A prediction is confirmed if a template
of the family shares enough of its two-grams with the paragraph; unconfirmed ones are
`unknown` too.

Scanning is one projection over the whole text, without a shuffle. A paragraph without
any word that carries weight has the scores of an empty one and is not looked at
further; the model, a few hundred weights, is part of the plan.

Defined results: a null text has no paragraphs. Repeated rows give repeated results;
other columns pass through, and columns that bear the names of results are replaced.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MADE = ("n_paragraphs", "licences")
# Statements by which texts name their licence, by family.
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial-ShareAlike License.",
        "Available under the CC0 1.0 Universal Public Domain Dedication.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Released under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright 2021 Example Company. All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential."],
}
# Sentences near the subject that state no licence.
NONE = [
    "", "The driver must show a license at the border.", "She renewed her fishing license in the spring.", "A license plate was found near the road.", "The general spoke to the public about the version of events.",
    "He reserved a table for four.", "All rights and duties were explained to the visitors.", "Permission to enter the park is free of charge on Sundays.", "The creative team met the common council.", "This work took three years to complete.",
    "The film was released under a new title.", "The software runs on any machine.", "They found a source of water and a code carved in stone.", "The library is open to the public.", "Use this version of the map.", "The foundation published its annual report.",
    "An apache helicopter flew over the valley.", "Students at MIT built a robot.", "The gnu is a large antelope of the savanna.", "The terms of the agreement were discussed.", "Copies of the book are sold here.", "No warranty can replace good care.",
    "The conditions on the mountain were hard.", "The international meeting took place in May.", "A person of any kind may attend.", "The company changed its name.", "It is subject to change without notice.", "The universal joint failed at 4.0 bars.",
    "Er geht mit dem Hund und mit der Katze spazieren.", "Das Haus mit dem Garten ist alt.", "Wasser mit Salz.", "Sie kam mit ihm.", "La licence de chasse est valable un an.", "Todos los derechos y deberes del alumno.", "Il faut une source de lumière.",
]
# Words too common to carry weight alone.
STOP = ["a", "an", "and", "any", "are", "as", "be", "by", "can", "for", "from", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with", "you", "your"]
CLASSES = sorted(TEMPLATES) + ["none"]
WORDS = "[a-z0-9]+"


def grams(text: str) -> list[str]:
    w = re.findall(WORDS, text.lower())
    return sorted({g for n in (1, 2, 3) for g in (" ".join(w[i : i + n]) for i in range(len(w) - n + 1)) if not all(x in STOP for x in g.split())})


def examples() -> list[tuple[str, str]]:
    """(class, paragraph): templates with variants made by rule, and sentences that are none."""
    out = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            w = t.split()
            variants = [t, t.rstrip("."), f"Copyright (c) 2020 the authors. {t}", f"{t} See the file for details.", f"The text below is given as follows: {t}", f"// {t}", f"{t} {t}"]
            if len(w) > 12:
                variants += [" ".join(w[: 2 * len(w) // 3]), " ".join(w[len(w) // 3 :])]
            out += [(family, v) for v in variants]
    for t in NONE:
        out += [("none", v) for v in (t, f"{t} {t}", f"As they say: {t}", f"{t} And so it went on for a long time.", "")]
    return out


@lru_cache(maxsize=1)
def _vocabulary() -> list[str]:
    return sorted({g for _, t in examples() for g in grams(t)})


class Model:
    """Weights by gram (one for each class), intercepts, temperature and threshold."""

    def __init__(self, weights: dict[str, list[float]], intercept: list[float]):
        self.weights, self.intercept = weights, intercept
        self.temperature, self.threshold = 1.0, 0.5

    def logits(self, text: str) -> list[float]:
        rows = [self.weights[g] for g in grams(text) if g in self.weights]
        return [b + sum(r[c] for r in rows) for c, b in enumerate(self.intercept)]

    def probabilities(self, text: str) -> list[float]:
        z = [x / self.temperature for x in self.logits(text)]
        e = [math.exp(x - max(z)) for x in z]
        return [x / sum(e) for x in e]


def train(spark: SparkSession, penalty: float = 2e-3, kept: float = 0.98) -> Model:
    """Fit on three quarters of the examples, calibrate on the last quarter."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    every, place = examples(), {g: i for i, g in enumerate(_vocabulary())}
    fit = [x for i, x in enumerate(every) if i % 4]
    aside = [x for i, x in enumerate(every) if not i % 4]
    rows = [(float(CLASSES.index(c)), Vectors.sparse(len(place), {place[g]: 1.0 for g in grams(t) if g in place})) for c, t in fit]
    found = LogisticRegression(family="multinomial", regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=60).fit(spark.createDataFrame(rows, ["label", "features"]).coalesce(1))
    matrix = found.coefficientMatrix.toArray()
    weights = {g: [float(round(x, 9)) for x in matrix[:, i]] for g, i in place.items() if abs(matrix[:, i]).max() > 1e-6}
    model = Model(weights, [float(x) for x in found.interceptVector.toArray()])

    def loss(t: float) -> float:
        model.temperature = t
        return -sum(math.log(max(1e-12, model.probabilities(x)[CLASSES.index(c)])) for c, x in aside)

    model.temperature = min((0.1 * 1.25**k for k in range(20)), key=loss)
    reached = sorted(model.probabilities(x)[CLASSES.index(c)] for c, x in aside if c != "none")
    model.threshold = max(0.3, min(0.9, reached[int((1 - kept) * len(reached))]))
    return model


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strings(items: list[str]) -> str:
    return f"array({','.join(map(_quoted, items))})"


def scan(docs: DataFrame, model: Model, text_col: str = "text", overlap: float = 0.5) -> DataFrame:
    """`docs` with n_paragraphs (long) and licences: array of (paragraph, family, probability, confirmed)."""
    keep = [c for c in docs.columns if c.lower() not in MADE]
    weights = F.expr(f"map_from_arrays({_strings(list(model.weights))}, array({','.join('array(' + ','.join(f'{x!r}D' for x in w) + ')' for w in model.weights.values())}))")
    pairs = {f: [sorted({" ".join(p) for p in zip(w, w[1:])}) for w in (re.findall(WORDS, t.lower()) for t in texts)] for f, texts in TEMPLATES.items()}
    templates = F.expr(f"map_from_arrays({_strings(list(pairs))}, array({','.join('array(' + ','.join(map(_strings, p)) + ')' for p in pairs.values())}))")
    carriers = sorted({w for g in model.weights for w in g.split() if w not in STOP})
    none = CLASSES.index("none")

    # each step reads the array of the step before several times, so that it is computed once
    paragraphs = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1), lambda p: p.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.select(*keep, paragraphs.alias("_l_p"))
    words = F.transform("_l_p", lambda p, i: F.struct(i.alias("paragraph"), F.regexp_extract_all(F.lower(p), F.lit(WORDS), F.lit(0)).alias("w")))
    some = F.filter(words, lambda s: F.exists(s["w"], lambda w: w.isin(carriers)))
    out = out.select(*keep, F.size("_l_p").cast("long").alias(MADE[0]), some.alias("_l_s"))

    def two(w: Column) -> Column:
        return F.array_distinct(F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))

    def three(w: Column) -> Column:
        n = F.greatest(F.size(w) - 2, F.lit(0))
        return F.zip_with(F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b)), F.slice(w, 3, n), lambda a, b: F.concat_ws(" ", a, b))

    def scored(s: Column) -> Column:
        every = F.array_distinct(F.concat(s["w"], two(s["w"]), three(s["w"])))
        rows = F.filter(F.transform(every, lambda g: F.try_element_at(weights, g)), lambda r: r.isNotNull())
        start = F.array(*(F.lit(b) for b in model.intercept))
        z = F.aggregate(rows, start, lambda acc, r: F.zip_with(acc, r, lambda a, b: a + b))
        return F.struct(s["paragraph"].alias("paragraph"), two(s["w"]).alias("two"), z.alias("z"))

    out = out.select(*keep, MADE[0], F.transform("_l_s", scored).alias("_l_z"))

    def shares(s: Column) -> Column:
        top = F.array_max(s["z"])
        e = F.transform(s["z"], lambda x: F.exp((x - top) / model.temperature))
        return F.struct(s["paragraph"].alias("paragraph"), s["two"].alias("two"), F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)).alias("p"))

    out = out.select(*keep, MADE[0], F.filter(F.transform("_l_z", shares), lambda s: F.get(s["p"], F.lit(none)) < 0.5).alias("_l_f"))
    names = F.array(*map(F.lit, CLASSES[:none]))

    def finding(s: Column) -> Column:
        p = F.slice(s["p"], 1, none)
        family, best = F.element_at(names, F.array_position(p, F.array_max(p)).cast("int")), F.array_max(p)
        sure = F.exists(F.element_at(templates, family), lambda t: F.size(F.array_intersect(t, s["two"])) >= overlap * F.least(F.size(t), F.greatest(F.size(s["two"]), F.lit(1))))
        known = sure & (best >= model.threshold)
        return F.struct(s["paragraph"].cast("long").alias("paragraph"), F.when(known, family).otherwise(F.lit("unknown")).alias("family"), best.alias("probability"), sure.alias("confirmed"))

    return out.select(*keep, MADE[0], F.transform("_l_f", finding).alias(MADE[1]))
