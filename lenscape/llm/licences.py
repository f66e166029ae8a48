"""Licence scans: a paragraph classifier over sparse word n-grams, with templates to confirm.

A text's paragraphs are classified into licence families, or unknown, by multinomial logistic regression over
the one- to three-word sequences that occur in the templates below. A line that is a licence's is a paragraph of its own;
lines between such lines and blank ones, two or more, are read as one wrapped paragraph, and this is a licence's only if
its words as a whole are. It is trained on the templates' sentences and neighbours, with words dropped and foreign words
mixed in, and, for the unknown class, on paragraphs of the corpus (a bounded sample, chosen by a hash) that match no
template. Whole licence texts, by family, can be given in addition: their paragraphs become templates. A temperature calibrates the probabilities; it is fitted on
paragraphs and altered sentences that the weights were not learned from. A family that is predicted with at least `threshold` is confirmed if a template of it has enough of its
words, in order, in common with the paragraph (similarity 0.8 of the shorter one's three-word sequences); a wrapped
paragraph, which may hold several templates, needs 0.8 of its own in the family's templates together. A paragraph whose
prediction no template confirms is unknown. Of equally probable families the first of the list below is taken.

Null and empty texts have no paragraphs. Letters are lower-cased and words are runs of letters, digits and inner dots.
A very long text or line is read whole, a paragraph at a time. Repeated rows give repeated results. With no documents the unknown class is learned from its bias alone. Extra columns
are not read.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import hash_sample, on_workers

UNKNOWN = "unknown"
#: Paragraphs of the corpus to learn from, at most, and words of one that are used in the fit.
SAMPLE = 4_000
SAMPLE_WORDS = 400
#: One of so many paragraphs of the corpus is held back from the fit, for the temperature.
HELD_BACK = 5
COPIES = 24
STEPS = 150
PENALTY = 1e-4
THRESHOLD = 0.6
SIMILARITY = 0.8

# Sentences by which the licence families name themselves, and sentences of their texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
        "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "Unlicense": (
        "SPDX-License-Identifier: Unlicense",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain.",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
        "work.",
        "Released under CC0 1.0 Universal.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-ND": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "Proprietary": (
        "All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "This software is confidential and proprietary information; unauthorized copying is strictly prohibited.",
    ),
}

_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
_LINE = re.compile(r"[^\n]+")


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(own: list[str]) -> set[str]:
    return {*own, *(" ".join(p) for p in zip(own, own[1:])), *(" ".join(p) for p in zip(own, own[1:], own[2:]))}


def shingles(own: list[str], size: int = 3) -> set[tuple[str, ...]]:
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))} if own else set()


#: Paragraphs of whole licence texts that have fewer words (headings, mostly) are no templates.
SHORT = 8


def with_texts(texts: Mapping[str, str]) -> dict[str, tuple[str, ...]]:
    """The templates, and the paragraphs (between blank lines) of whole licence texts by family, which may be a new one.
    Paragraphs that several families have tell nothing and are left out."""
    parts = {f: {" ".join(words(p)): p for p in re.split(r"\n\s*\n", t)} for f, t in texts.items()}
    holders = Counter(k for own in parts.values() for k in own)
    out = dict(TEMPLATES)
    for family, own in parts.items():
        out[family] = out.get(family, ()) + tuple(p for k, p in own.items() if holders[k] == 1 and k.count(" ") + 1 >= SHORT)
    return out


class Known:
    """Templates by the three-word sequences that they hold."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]]):
        self.families: list[str] = []
        self.sizes: list[int] = []
        self.holders: dict[tuple[str, ...], list[int]] = {}
        for family, texts in templates.items():
            for own in map(shingles, map(words, texts)):
                for w in own:
                    self.holders.setdefault(w, []).append(len(self.sizes))
                self.families.append(family)
                self.sizes.append(len(own))

    def compared(self, own: list[str], family: str | None = None) -> float:
        """Largest similarity to a template (of a family): shared three-word sequences by those of the template, or of
        the paragraph if that is a part of at least eight words."""
        mine = shingles(own)
        both = Counter(i for w in mine for i in self.holders.get(w, ()) if family in (None, self.families[i]))
        return max((n / (min(self.sizes[i], len(mine)) if len(own) >= SHORT else self.sizes[i]) for i, n in both.items()), default=0.0)

    def covered(self, own: list[str], family: str) -> float:
        """The share of a paragraph's three-word sequences that templates of a family hold."""
        mine = shingles(own)
        return sum(any(self.families[i] == family for i in self.holders.get(w, ())) for w in mine) / max(len(mine), 1)

    def may_cover(self, own: list[str], share: float = SIMILARITY) -> bool:
        """False if more sequences are in no template than `share` allows, which ordinary text shows after some of its
        words: its different sequences are no more than its places, and the known ones no more than the templates'."""
        most = (1 - share) * min(len(own) - 2, len(self.holders) / share) + 1e-9
        strange = set()
        for w in zip(own, own[1:], own[2:]):
            if w not in self.holders:
                strange.add(w)
                if len(strange) > most:
                    return False
        return True


BUILT_IN = Known(TEMPLATES)


class Model:
    """Families (the last is unknown), numbers of n-grams, weights by family, biases, the temperature and the templates."""

    def __init__(self, families: list[str], ids: dict[str, int], weights: np.ndarray, bias: np.ndarray, temperature: float, known: Known = BUILT_IN):
        self.known = known
        self.families, self.ids, self.weights, self.bias, self.temperature = families, ids, weights, bias, temperature
        gain = weights[:, :-1] - weights[:, -1:]
        #: n-grams that make a family likelier than unknown
        self.telling = {g for g, i in ids.items() if gain[i].max() > 0}
        self.first = {g.split(" ")[0] for g in self.telling}
        #: without any of them unknown is the most probable, so other paragraphs need no scores
        self.skips = bool((bias[:-1] < bias[-1]).all())

    def probabilities(self, found: list[int]) -> np.ndarray:
        z = self.bias + (self.weights[found].sum(axis=0) / np.sqrt(len(found)) if found else 0.0)
        z = z / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def classify(self, paragraph: str, threshold: float = THRESHOLD) -> tuple[str, float, float]:
        """Family, its probability and similarity; unknown if not likely enough or not confirmed."""
        return self.classify_words(words(paragraph), threshold)

    def classify_words(self, own: list[str], threshold: float = THRESHOLD, wrapped: bool = False) -> tuple[str, float, float]:
        if not own or (wrapped and not self.known.may_cover(own)) or (self.skips and self.first.isdisjoint(own)):
            return UNKNOWN, 1.0, 0.0
        found = [self.ids[g] for g in sorted(grams(own)) if g in self.ids]
        p = self.probabilities(found)
        best = int(p.argmax())
        family = self.families[best]
        if family == UNKNOWN or p[best] < threshold:
            return UNKNOWN, float(p[-1]), 0.0
        similar = self.known.covered(own, family) if wrapped else self.known.compared(own, family)
        return (family, float(p[best]), similar) if similar >= SIMILARITY else (UNKNOWN, float(p[-1]), similar)


def examples(seed: int, copies: int, foreign: list[str], templates: Mapping[str, tuple[str, ...]] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """Template sentences as they are, and with words dropped, cut short or among foreign words."""
    rng = random.Random(seed)
    out = []
    for family, texts in templates.items():
        for text in texts:
            own = words(text)
            out.append((family, own))
            for _ in range(copies - 1):
                some = [w for w in own if rng.random() > 0.08] or own
                if len(some) > 12 and rng.random() < 0.3:
                    a = rng.randrange(len(some) - 8)
                    some = some[a : a + rng.randint(8, len(some))]
                if foreign and rng.random() < 0.5:
                    extra = [rng.choice(foreign) for _ in range(rng.randint(1, 6))]
                    some = extra + some if rng.random() < 0.5 else some + extra
                out.append((family, some))
    return out


def fit(corpus: list[str], texts: Mapping[str, str] | None = None) -> Model:
    """corpus: paragraphs of documents; those that match a template are left out. texts: whole licence texts by family."""
    templates = with_texts(texts) if texts else TEMPLATES
    known = Known(templates) if texts else BUILT_IN
    rest = sorted({tuple(words(p)[:SAMPLE_WORDS]) for p in corpus})
    rest = [list(w) for w in rest if w and known.compared(list(w)) < SIMILARITY / 2]
    foreign = sorted({w for p in rest[:200] for w in p[:5]})
    families = [*templates, UNKNOWN]
    ids: dict[str, int] = {}
    for own in templates.values():
        for t in own:
            for g in sorted(grams(words(t))):
                ids.setdefault(g, len(ids))
    place = {f: i for i, f in enumerate(families)}
    # parts of licence sentences that are no licence, and an empty paragraph
    fillers = [[w] for w in sorted({w for ts in templates.values() for t in ts for w in words(t)})]
    train = [(place[f], w) for f, w in examples(1, COPIES, foreign, templates)]
    unknown = [(place[UNKNOWN], w) for w in [[], *fillers, *(w for i, w in enumerate(rest) if i % HELD_BACK)]]
    seen = {(y, tuple(w)) for y, w in train + unknown}
    held = [(place[f], w) for f, w in examples(2, 4, foreign, templates)] + [(place[UNKNOWN], w) for w in rest[::HELD_BACK]]
    held = [(y, w) for y, w in held if (y, tuple(w)) not in seen]
    weights, bias = _logistic(train + unknown, ids, len(families))
    model = Model(families, ids, weights, bias, 1.0, known)
    scores = [(y, [ids[g] for g in sorted(grams(w)) if g in ids]) for y, w in held]
    is_unknown = np.array([y == place[UNKNOWN] for y, _ in scores], bool)
    grid = np.exp(np.linspace(-1.5, 1.5, 31))
    losses = []
    for t in grid:
        model.temperature = t
        lost = np.array([-np.log(model.probabilities(f)[y] + 1e-12) for y, f in scores])
        # families together and unknown weigh alike, as in the fit
        losses.append(sum(lost[part].mean() for part in (is_unknown, ~is_unknown) if part.any()))
    model.temperature = float(grid[int(np.argmin(losses))])
    return model


def _logistic(rows: list[tuple[int, list[str]]], ids: dict[str, int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Families weigh alike, however many examples they have; unknown weighs as all others together."""
    label = np.array([y for y, _ in rows])
    at, cols, vals = [], [], []
    for i, (_, w) in enumerate(rows):
        own = [ids[g] for g in sorted(grams(w)) if g in ids]
        at += [i] * len(own)
        cols += own
        vals += [1 / np.sqrt(max(len(own), 1))] * len(own)
    at, cols, vals = np.array(at, np.int64), np.array(cols, np.int64), np.array(vals)
    counts = np.bincount(label, minlength=k)
    share = np.full(k, 0.5 / (k - 1))
    share[-1] = 0.5
    weight = (share / np.maximum(counts, 1))[label]
    truth = np.eye(k)[label]
    w, b = np.zeros((len(ids), k)), np.zeros(k)
    first, second = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, STEPS + 1):
        z = b + np.stack([np.bincount(at, vals * w[cols, j], len(rows)) for j in range(k)], axis=1)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (truth - p) * weight[:, None]
        g = np.stack([np.bincount(cols, vals * d[at, j], len(ids)) for j in range(k)], axis=1)
        for x, grad, m, v in zip((w, b), (g - PENALTY * w, d.sum(axis=0)), first, second, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            x += 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w, b


def trained(docs: DataFrame, sample: int = SAMPLE, texts: Mapping[str, str] | None = None) -> Model:
    """Takes one paragraph of each of `sample` documents at most, those of the smallest hashes. texts: whole licence texts
    by family, in addition to the templates."""
    one = docs.where("length(text) > 0").select(
        F.xxhash64("doc_id", "text").alias("h"), F.split("text", "\n").alias("lines")
    ).select("h", F.element_at("lines", (F.pmod("h", F.size("lines")) + 1).cast("int")).alias("line"))
    rows = hash_sample(one.select("h", F.substring_index("line", " ", SAMPLE_WORDS).alias("line")), sample, docs.count())
    return fit([r.line for r in rows], texts)


FOUND = "doc_id long, licences array<struct<family: string, start: int, end: int, probability: double, similarity: double>>"
_FOUND = pa.list_(
    pa.struct([("family", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64()), ("similarity", pa.float64())])
)


def scan(text: str | None, model: Model) -> list[dict]:
    """The licence paragraphs of a text, in order: family, place (code points), probability and similarity."""
    out: list[dict] = []
    run: list[tuple[int, int, list[str]]] = []  # lines since the last one that is blank or a licence's

    def add(found: tuple[str, float, float], start: int, end: int) -> None:
        if found[0] != UNKNOWN:
            out.append({"family": found[0], "start": start, "end": end, "probability": found[1], "similarity": found[2]})

    def flush() -> None:
        if len(run) > 1:
            add(model.classify_words([w for _, _, own in run for w in own], wrapped=True), run[0][0], run[-1][1])
        run.clear()

    for m in _LINE.finditer(text or ""):
        own = words(m.group())
        found = model.classify_words(own)
        if found[0] != UNKNOWN or m.group().isspace() or (run and m.start() > run[-1][1] + 1):
            flush()
        if found[0] != UNKNOWN:
            add(found, m.start(), m.end())
        elif not m.group().isspace():
            run.append((m.start(), m.end(), own))
    flush()
    return out


def scanned(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and licences of every document."""
    on_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan(t.as_py(), shared.value) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _FOUND)], names=["doc_id", "licences"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FOUND)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: licence paragraphs of all whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scanned(docs, trained(docs))
    return found.select(
        "doc_id",
        F.size("licences").cast("long").alias("n_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])), ",").alias("spans"),
        F.round(F.array_min(F.transform("licences", lambda x: x["probability"])), 4).alias("least_probability"),
    )
