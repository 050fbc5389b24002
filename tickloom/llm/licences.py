"""Licence scans with a trained paragraph classifier, in DataFrame functions only.

Paragraphs are lines. A sparse logistic regression on word 1- and 2-grams scores every
licence family, ``unknown`` (licence wording of no known family) and ``none``; soft
thresholding leaves few weights. Probabilities are calibrated by a temperature on
held-out paragraphs. A family that is not clear enough turns ``unknown`` or ``none``,
whichever is likelier; how clear it must be is calibrated by leaving out whole families in turn, so that licences never fitted on are
measured. A family is confirmed if the paragraph has enough of one of its templates' word
2- and 3-grams, and a name of the family wherever the template has one.

The model is fitted on the driver from the templates and a bounded sample of documents
(``sample``). Scoring is one expression per row: no join, no shuffle, no Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.frames import few_by_hash, pick

SAMPLE_DOCUMENTS = 400
SAMPLE_BYTES = 65_536
CLEAR = 0.5  # least probability of a family, before calibration raises it
COVER = 0.5
NONE, UNKNOWN = "none", "unknown"
PROSE = "prose"  # in the fit, ``none`` with licence words: weighs as much as all the background

# Notices of each family as authors write them
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 License.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Licensed under the GPL, version 2.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public_domain": (
        "This is free and unencumbered software released into the public domain.",
        "This work is dedicated to the public domain.",
        "Released under the Unlicense.",
        "Licensed under CC0 1.0 Universal, dedicated to the public domain.",
    ),
    "proprietary": (
        "All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced or distributed without prior written permission.",
    ),
}
# Licence wording of no family, with a place for any name
GENERIC = (
    "Licensed under the {} License.",
    "Licensed under the {} License, version {}.",
    "Released under the {} License.",
    "This work is licensed under the {} License.",
    "Distributed under the terms of the {} Licence.",
    "The licence of this work is {}.",
    "You may use this software under the {} license.",
    "Licensed under the {} {}.0.",
    "Licensed under {} {}.",
    "Released under the {}.",
    "SPDX-License-Identifier: {}-{}.0",
)
# Words and word pairs that name a family
NAMES: dict[str, tuple[str, ...]] = {
    "apache": ("apache",),
    "bsd": ("bsd",),
    "cc": ("cc by", "creative commons"),
    "gpl": ("gpl", "lgpl", "agpl", "gnu general", "gnu lesser", "gnu affero"),
    "mit": ("mit",),
    "mpl": ("mozilla public", "mpl"),
    "public_domain": ("public domain", "unlicense", "cc0"),
    "proprietary": (),
}
# Ordinary sentences with words that licences use too
ORDINARY = (
    "She got her driving licence in the spring and lost her license a year later.",
    "A license to practice medicine is issued by the board of the state.",
    "The bar had no liquor license, and the owner was fined.",
    "The film was released to the public in May under a new title.",
    "Version 2 of the game was released under the terms of the agreement with the studio.",
    "The general public had the right to use the work of the library free of charge.",
    "The source of the river lies in the commons near the northern domain of the abbey.",
    "All seats were reserved for guests, and all rights of way were closed.",
    "Permission was granted to any person who asked for the file in writing.",
    "The following conditions are met in most places: rain, wind and cold.",
    "He copied the file without permission and distributed it in source form.",
    "The copyright of the novel expired, and the law was changed.",
    "They were licensed to sell tickets and subject to the rules of the city.",
    "No part of the building may be used prior to the opening of the new wing.",
)
APART = r"[^\p{L}\p{N}]+"


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_+", text.lower()) if w]


def grams_of(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def ordered_grams(words: list[str]) -> list[str]:
    """Runs of two and three words: what templates are compared by."""
    return sorted({" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)})


def named(family: str, words: list[str]) -> bool:
    return bool(set(NAMES[family]) & set(grams_of(words)))


@dataclass(frozen=True)
class LicenceModel:
    classes: tuple[str, ...]  # families, unknown, none
    weights: dict[str, tuple[float, ...]]  # gram -> one weight a class; a gram without a word of ``anchors`` is left out
    bias: tuple[float, ...]
    temperature: float
    anchors: tuple[str, ...]  # words with a weight of their own
    clear: float  # a family less probable than this is unknown
    known: float  # share of held-out paragraphs of the families that get theirs
    unseen: float  # share of paragraphs of a family left out of the fit that get none of the others


def examples(r: np.random.Generator, background: list[str], marks: list[str]) -> tuple[list[list[str]], list[str]]:
    """Training paragraphs: notices whole, cut and set in other text; generic wording with made-up names; background,
    ordinary sentences that use licence words, and background with such words (``marks``) strewn in without their order."""
    pool = [w for line in background for w in words_of(line)][:20_000] or ["lorem", "ipsum"]
    some = lambda n: [pool[i] for i in r.integers(0, len(pool), n)]
    texts, labels = [], []
    for family, notices in TEMPLATES.items():
        for notice in notices:
            w = words_of(notice)
            for n in range(24):
                cut = w if n % 3 else w[: max(3, int(len(w) * r.uniform(0.6, 1.0)))]
                texts.append(some(r.integers(0, 12) if n % 2 else 0) + cut + some(r.integers(0, 12) if n % 4 > 1 else 0))
                labels.append(family if named(family, cut) or not named(family, w) else UNKNOWN)
    for form in GENERIC:
        for _ in range(40):
            texts.append(words_of(form.format(" ".join(some(r.integers(1, 3))), int(r.integers(1, 9)))) + some(r.integers(0, 6)))
            labels.append(UNKNOWN)
    for line in background:
        texts.append(words_of(line))
        labels.append(NONE)
    for line in ORDINARY:
        w = words_of(line)
        for n in range(24):
            texts.append(some(r.integers(0, 12) if n % 2 else 0) + (w if n % 3 else w[: max(4, int(len(w) * r.uniform(0.5, 1.0)))]))
            labels.append(PROSE)
    for notice in (n for notices in TEMPLATES.values() for n in notices):
        for _ in range(12):  # the words of a notice without their order, some of them with others between
            w = [str(v) for v in r.permutation(words_of(notice))]
            for _ in range(int(r.integers(0, len(w) + 1))):
                w.insert(int(r.integers(0, len(w) + 1)), some(1)[0])
            texts.append(w)
            labels.append(PROSE)
    for _ in range(600):
        w = some(r.integers(6, 30))
        for mark in r.choice(marks, r.integers(1, 5)):
            w.insert(int(r.integers(0, len(w) + 1)), str(mark))
        texts.append(w)
        labels.append(PROSE)
    return texts, labels


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _regression(x: np.ndarray, group: np.ndarray, n: int, steps: int, sparse: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of ``n`` classes by proximal gradient steps; groups weigh alike, soft thresholds make it sparse.

    Groups are the classes, and one more that is of the last class but weighs as one of its own.
    Equal rows of a group are one row of their number's weight.
    """
    _, at, times = np.unique(np.c_[np.packbits(x > 0, axis=1), group.astype(np.uint8)], axis=0, return_index=True, return_counts=True)
    weight = (times / np.bincount(group)[group[at]])[:, None].astype(np.float32) / n
    x, y = x[at], np.minimum(group[at], n - 1)
    hot = np.eye(n, dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], n), dtype=np.float32), np.zeros(n, dtype=np.float32)
    b[-1] = 1.0
    rate = 2.0
    for _ in range(steps):
        d = weight * (_soft(x @ w + b) - hot)
        w = w - rate * (x.T @ d)
        b = b - rate * 0.2 * d.sum(0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse, 0)
    return w, b


def _clearness(known: np.ndarray, right: np.ndarray, strange: np.ndarray) -> tuple[float, float, float]:
    """The least probability of a family that best parts ``known`` paragraphs (``right``: the family is theirs) from
    ``strange`` ones of families left out of the fit (the highest of equal ones), and the shares of both judged rightly by it."""
    levels = np.linspace(CLEAR, 0.98, 49)
    kept = np.array([(right & (known >= a)).mean() for a in levels])
    unseen = np.array([(strange < a).mean() for a in levels])
    best = np.round(kept + unseen, 9)
    at = int(np.flatnonzero(best == best.max())[-1])
    return float(levels[at]), float(kept[at]), float(unseen[at])


def fit(background: list[str], seed: int = 3, steps: int = 300, sparse: float = 2e-4) -> LicenceModel:
    """Multinomial logistic regression; temperature and clearness from paragraphs and whole families held out."""
    r = np.random.default_rng(seed)
    marks = {w for notices in TEMPLATES.values() for n in notices for w in words_of(n)} | {w for f in GENERIC for w in words_of(f)}
    background = [line for line in background if len(set(words_of(line)) & {"license", "licensed", "licence", "copyright", "spdx"}) == 0]
    texts, labels = examples(r, background, sorted(marks))
    classes = (*sorted(TEMPLATES), UNKNOWN, NONE)
    plain = [set(words_of(line)) for line in background]
    common = {w for w in marks if sum(w in t for t in plain) > 0.02 * len(plain)}  # words of ordinary text mark nothing alone
    seen = {g for t, y in zip(texts, labels) if y != NONE for g in grams_of(t)} | marks
    vocabulary = sorted(g for g in seen if all(w in marks for w in g.split()) and not all(w in common for w in g.split()))
    slot = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(texts), len(vocabulary)), dtype=np.float32)
    for i, t in enumerate(texts):
        x[i, [slot[g] for g in set(grams_of(t)) if g in slot]] = 1
    group = np.array([(*classes, PROSE).index(a) for a in labels])
    y = np.minimum(group, len(classes) - 1)
    held = r.random(len(y)) < 0.2
    w, b = _regression(x[~held], group[~held], len(classes), steps, sparse)
    anchors = tuple(g for i, g in enumerate(vocabulary) if " " not in g and np.abs(w[i]).max() > 0)
    kept = [i for i, g in enumerate(vocabulary) if np.abs(w[i]).max() > 0 and any(v in anchors for v in g.split())]
    z = x[held][:, kept] @ w[kept] + b
    true = y[held]
    heats = np.linspace(0.05, 3.0, 60)
    loss = [-np.log(np.maximum(_soft(z / t)[np.arange(len(true)), true], 1e-12)).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])

    def family(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class and its probability, 0 where the class is no family."""
        p = _soft(z / heat)
        best = p.argmax(axis=1)
        return best, np.where(best < len(TEMPLATES), p.max(axis=1), 0.0)

    ours = true < len(TEMPLATES)
    named_, known = family(z[ours])
    strange = []
    for out in range(len(TEMPLATES)):
        rest = ~held & (y != out)
        w_, b_ = _regression(x[rest], group[rest], len(classes), steps, sparse)
        strange.append(family(x[y == out] @ w_ + b_)[1])
    clear, right, unseen = _clearness(known, named_ == true[ours], np.concatenate(strange))
    weights = {vocabulary[i]: tuple(float(v) for v in np.round(w[i], 5)) for i in kept}
    return LicenceModel(classes, weights, tuple(float(v) for v in np.round(b, 5)), heat, anchors, clear, right, unseen)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_DOCUMENTS) -> LicenceModel:
    """Fit with the lines of at most ``sample`` documents as background, chosen by a hash of the row."""
    docs = pick(df, doc_id=id_col, text=text_col).where(F.length("text") > 0).where(F.octet_length("text") <= SAMPLE_BYTES)
    few = few_by_hash(docs, "doc_id", "text", count=sample).collect()
    return fit([line for r in few for line in r["text"].split("\n")][: 20 * sample])


def _paragraph_verdicts(marked: Column, model: LicenceModel) -> Column:
    """Array of struct(licensed, probability, licence, cover, paragraph), one per struct(paragraph, words)."""
    known = F.create_map(*[c for g, ws in model.weights.items() for c in (F.lit(g), F.array(*[F.lit(v) for v in ws]))])
    n = len(model.classes)

    def graded(ws: Column) -> Column:
        pairs = F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        two = F.slice(pairs, 1, F.greatest(F.size(ws) - 1, F.lit(0)))
        three = F.zip_with(two, F.slice(ws, 3, F.greatest(F.size(ws) - 2, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        runs = F.concat(two, F.slice(three, 1, F.greatest(F.size(ws) - 2, F.lit(0))))
        return F.struct(F.array_distinct(F.concat(ws, two)).alias("g"), F.array_distinct(runs).alias("runs"))

    def scored(grams: Column) -> Column:
        hits = F.filter(grams, lambda g: g.isin(*model.weights))
        start = F.array(*[F.lit(v) for v in model.bias])
        z = F.aggregate(hits, start, lambda acc, g: F.zip_with(acc, known[g], lambda a, b: a + b))
        heated = F.transform(z, lambda v: v / model.temperature)
        top = F.array_max(heated)
        e = F.transform(heated, lambda v: F.exp(v - top))
        total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
        return F.transform(e, lambda v: v / total)

    def cover(grams: Column, runs: Column, family: str) -> Column:
        """The largest share of a template's runs; templates that name the family count where the paragraph names it."""
        told = F.exists(grams, lambda g: g.isin(*NAMES[family])) if NAMES[family] else F.lit(False)
        shares = [F.lit(0.0)]
        for words in map(words_of, TEMPLATES[family]):
            of = ordered_grams(words)
            share = F.size(F.array_intersect(runs, F.array(*map(F.lit, of)))) / len(of)
            shares.append(F.when(told, share).otherwise(0.0) if named(family, words) else share)
        return F.greatest(*shares, F.lit(0.0))

    def verdict(grams: Column, runs: Column, p: Column, paragraph: Column) -> Column:
        best = F.array_max(p)
        name = F.lit(NONE)
        for i, c in reversed(list(enumerate(model.classes))):
            name = F.when(p[i] == best, F.lit(c)).otherwise(name)
        other = F.when(p[n - 1] > p[n - 2], F.lit(NONE)).otherwise(F.lit(UNKNOWN))
        name = F.when((best < model.clear) & ~name.isin(UNKNOWN, NONE), other).otherwise(name)
        covered = F.lit(0.0)
        for family in TEMPLATES:
            covered = F.when(name == family, cover(grams, runs, family)).otherwise(covered)
        return F.struct((1 - p[n - 1]).alias("licensed"), best.alias("probability"), name.alias("licence"), covered.alias("cover"), paragraph.alias("paragraph"))

    grams = F.transform(marked, lambda m: F.struct(graded(m["words"]).alias("of"), m["paragraph"].alias("at")))
    found = F.transform(grams, lambda x: F.struct(x["of"].alias("of"), scored(x["of"]["g"]).alias("p"), x["at"].alias("at")))
    return F.transform(found, lambda x: verdict(x["of"]["g"], x["of"]["runs"], x["p"], x["at"]))


def _named(df: DataFrame, model: LicenceModel, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_paragraphs, named: the verdicts on all paragraphs that hold licence wording, in their order."""
    docs = pick(df, doc_id=id_col, text=text_col)
    filled = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "\n"), lambda p: p.rlike(r"\S"))
    split = F.transform("lines", lambda p, i: F.struct((i + 1).alias("paragraph"), F.filter(F.split(p, APART), lambda w: w != "").alias("words")))
    marked = F.filter(split, lambda m: F.exists(m["words"], lambda w: w.isin(*model.anchors)))
    # each step is used twice by the next, so the optimizer keeps the steps apart and computes them once
    lines = docs.select("doc_id", filled.alias("lines"))
    words = lines.select("doc_id", F.size("lines").cast("long").alias("n_paragraphs"), marked.alias("marked"))
    named = F.filter(_paragraph_verdicts(F.col("marked"), model), lambda v: v["licence"] != NONE)
    return words.select("doc_id", "n_paragraphs", named.alias("named"))


def _told(v: Column) -> list[Column]:
    """What is said of a verdict, rounded."""
    return [
        v["licence"].alias("licence"),
        F.round(v["probability"], 6).alias("probability"),
        F.round(v["cover"], 6).alias("cover"),
        (v["cover"] >= COVER).alias("confirmed"),
    ]


def licence_paragraphs(df: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph with licence wording: doc_id, paragraph, licence, probability, cover, confirmed.

    Paragraphs that are not blank count from 1. Texts without licence wording give no row.
    """
    told = _named(df, model, id_col, text_col).select("doc_id", F.explode("named").alias("v"))
    return told.select("doc_id", F.col("v.paragraph").alias("paragraph"), *_told(F.col("v")))


def licence_scan(df: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_paragraphs, n_licensed, licence, probability, cover, confirmed, licences.

    licences holds every family found (and ``unknown``, if found) once, in order of first
    appearance: struct(licence, paragraph, probability, cover, confirmed) of the family's
    surest paragraph; paragraphs that are not blank count from 1. licence is that of the
    surest of all: a family, ``unknown`` or ``none``; probability is that of the paragraph
    that speaks for the text (0 without any), cover the share of its best template's runs of two
    and three words (0 if the template names the family and the paragraph does not), confirmed
    whether that reaches a half. A paragraph has one verdict. Null, empty and
    blank texts have no paragraph; null ids stay; repeated rows repeat; an empty table gives
    no rows; only id and text are read.
    """
    nothing = F.struct(F.lit(0.0).alias("licensed"), F.lit(0.0).alias("probability"), F.lit(NONE).alias("licence"), F.lit(0.0).alias("cover"), F.lit(0).alias("paragraph"))

    def surest(verdicts: Column) -> Column:
        """The paragraph surest to hold licence wording; the first wins a tie."""
        return F.aggregate(verdicts, nothing, lambda a, v: F.when(v["licensed"] > a["licensed"], v).otherwise(a))

    def entry(v: Column) -> Column:
        licence, *more = _told(v)
        return F.struct(licence, v["paragraph"].alias("paragraph"), *more)

    graded = _named(df, model, id_col, text_col)
    families = F.array_distinct(F.transform("named", lambda v: v["licence"]))
    each = F.transform(families, lambda f: surest(F.filter("named", lambda v: v["licence"] == f)))
    spoken = graded.select("doc_id", "n_paragraphs", F.size("named").cast("long").alias("n_licensed"), surest(F.col("named")).alias("best"), each.alias("each"))
    return spoken.select("doc_id", "n_paragraphs", "n_licensed", *_told(F.col("best")), F.transform("each", entry).alias("licences"))
