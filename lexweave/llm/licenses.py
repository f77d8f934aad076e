"""License scans with a trained paragraph classifier.

A unit is a line of a text or a paragraph of several lines, up to a blank one; of
those above ``WINDOW`` words, each window of that many words at half that stride.
A paragraph tells of a family what its lines don't: where a line in it has a row of
the family, it has one only if its other words are confirmed. Its row names the
line and word where the unit begins. Multinomial logistic regression over sparse
word 1-, 2- and 3-grams gives each unit a probability for each licence family and
for ``unknown``; a temperature fitted on held-out units calibrates them, so that
``unknown`` is as probable as it says. Where a family wins with MIN_PROBABILITY,
the unit is compared with the family's templates: the share of a template's word
pairs that the unit holds must reach MIN_SIMILARITY for the prediction to be
``confirmed``. Any other family more probable than ``unknown`` has a row too where
it is confirmed, also by the pairs that only its templates have.

Training is on the templates, varied by seeded edits, against units of the corpus
and mixed-up templates as ``unknown``. Bounded on purpose, as a parameter: at most
``max_unknown`` units are drawn from the corpus, those with the smallest hash of
their document's id and their words, from anywhere in a text. Every unit of every
text is scanned.

Defined results: rows without id are left out; null and empty texts have no unit;
very long texts are scanned whole; repeated rows give their rows again; ties between families go to the first by
name; an empty table gives an empty result; other columns are not read, whatever their
names.
"""

from __future__ import annotations

import random
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm._words import Words, lean, mix, slices, words
from lexweave.session import cut, ship

WINDOW = 60
MIN_PROBABILITY = 0.5
MIN_SIMILARITY = 0.6
MAX_UNKNOWN = 2000
SEED = 11

#: Notices, and of longer texts the sentences that tell them apart, none of over half a window, so that some window holds it whole.
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software under the terms of the GNU Affero General Public License", "SPDX-License-Identifier: AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"],
    "bsd": ["Released under the 3-Clause BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted", "SPDX-License-Identifier: BSD-3-Clause", "Use of this source code is governed by a BSD-style license", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "cc0": ["Released into the public domain under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright (CC0).", "SPDX-License-Identifier: CC0-1.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2 or later.", "You can redistribute it and/or modify it under the terms of the GNU General Public License", "SPDX-License-Identifier: GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program."],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose is hereby granted", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License", "SPDX-License-Identifier: LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mpl": ["Subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"],
    "proprietary": ["All rights reserved.", "Confidential and proprietary. Unauthorized copying is strictly prohibited.", "No part of this publication may be reproduced without prior written permission."],
    "unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"],
    "zlib": ["Licensed under the zlib License.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.", "SPDX-License-Identifier: Zlib"],
}
UNKNOWN = "unknown"
#: Words around a notice, and sentences that only look like one.
AROUND = "copyright c 2019 2021 2023 the authors and contributors see file for details project version author by inc".split()
LOOKALIKES = ["The driver must carry a valid license at all times.", "The license of the restaurant was renewed last year.", "Public transport is free of charge on Sunday.", "He reserved the rights to the film in version two.", "The software is distributed to any person in the office.", "General terms of the public contract were published.", "All seats are reserved.", "A copy of the report is available under the heading notes.", "Version 2.0 of the program was released in April.", "The apache helicopter and the creative director of the commons."]


def _windows(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and last word + 1 of the windows over each run of words; new: where a run begins."""
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(new))
    half = WINDOW // 2
    n = np.where(z - a <= WINDOW, 1, -(-(z - a - WINDOW) // half) + 1)
    first = np.repeat(a, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * half
    return first, np.minimum(first + WINDOW, np.repeat(z, n))


def _units(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word + 1, text and line number of each unit of the batch."""
    breaks = np.flatnonzero(w.data == 10)
    line = np.searchsorted(breaks, w.start)
    if not len(w.hash):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    inked = np.concatenate([np.zeros(1, np.int64), np.cumsum(w.data > 32)])
    blank = inked[np.append(breaks, len(w.data))] == inked[np.append(0, breaks + 1)]
    paragraph = np.cumsum(blank)[line]
    other = w.doc[1:] != w.doc[:-1]
    first, last = _windows(np.r_[True, (line[1:] != line[:-1]) | other])
    a, z = _windows(np.r_[True, (paragraph[1:] != paragraph[:-1]) | other])
    over = line[a] < line[z - 1]
    first, last = np.concatenate([first, a[over]]), np.concatenate([last, z[over]])
    order = np.lexsort((last, first))
    first, last = first[order], last[order]
    doc = w.doc[first]
    return first, last, doc, line[first] - np.searchsorted(breaks, w.offsets[doc])


def _keys(w: Words) -> list[np.ndarray]:
    """Keys of the 1-, 2- and 3-grams that start at each word (units cut those that reach over their end)."""
    h = w.hash
    pair, triple = h.copy(), h.copy()
    pair[:-1] = mix(h[:-1] * np.uint64(3) + h[1:])
    triple[:-2] = mix(mix(h[:-2] * np.uint64(5) + h[1:-1]) * np.uint64(7) + h[2:])
    return [h, pair, triple]


def _fresh(key: np.ndarray) -> np.ndarray:
    """Where a gram isn't that of the word before: an echoed word counts once."""
    out = np.ones(len(key), bool)
    out[1:] = key[1:] != key[:-1]
    return out


class Model:
    """Weights (features x classes) of the sorted feature keys, bias and temperature; the last class is unknown."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0):
        self.keys, self.weights, self.bias, self.temperature = keys, weights, bias, temperature
        self.names = [*sorted(TEMPLATES), UNKNOWN]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def scores(self, w: Words, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Linear scores (units x classes)."""
        out = np.tile(self.bias, (len(first), 1))
        for n, key in enumerate(_keys(w), 1):
            spot = np.flatnonzero(self.maybe[(key & np.uint64(0xFFFF)).astype(np.int64)] & _fresh(key))
            at = np.searchsorted(self.keys, key[spot])
            at[at == len(self.keys)] = 0
            good = self.keys[at] == key[spot]
            spot, at = spot[good], at[good]
            run = np.zeros((len(spot) + 1, self.weights.shape[1]))
            np.cumsum(self.weights[at], axis=0, out=run[1:])
            lo = np.searchsorted(spot, first)
            hi = np.maximum(lo, np.searchsorted(spot, last - n + 1))
            out += run[hi] - run[lo]
        return out

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        s = scores / self.temperature
        s = np.exp(s - s.max(1, keepdims=True))
        return s / s.sum(1, keepdims=True)


def _pairs(w: Words, a: int, z: int, told: Iterable[tuple[int, int]] = ()) -> set[int]:
    """Keys of the word pairs from a to z but those inside the units told."""
    h = w.hash[a:z]
    if len(h) < 2:
        return set(h.tolist())
    left = np.ones(len(h) - 1, bool)
    for b, e in told:
        left[max(b - a, 0) : max(e - 1 - a, 0)] = False
    return set(mix(h[:-1] * np.uint64(3) + h[1:])[left].tolist())


_templates: dict[str, list[set[int]]] = {}


def _of(family: str) -> list[set[int]]:
    if family not in _templates:
        t = [words(pa.array([x])) for x in TEMPLATES[family]]
        _templates[family] = [_pairs(x, 0, len(x.hash)) for x in t]
    return _templates[family]


_own: dict[str, list[set[int]]] = {}


def _own_of(family: str) -> list[set[int]]:
    """Of each template the pairs that no other family's have."""
    if family not in _own:
        others = set().union(*(t for k in TEMPLATES if k != family for t in _of(k)))
        _own[family] = [t - others for t in _of(family)]
    return _own[family]


def similarity(family: str, w: Words, a: int, z: int, told: Iterable[tuple[int, int]] = ()) -> float:
    """Best share of a template's word pairs that the unit holds outside the units told, one of its own among them if it has any."""
    mine = _pairs(w, a, z, told)
    return max(len(t & mine) / len(t) if not own or own & mine else 0.0 for t, own in zip(_of(family), _own_of(family)))


def own_similarity(family: str, w: Words, a: int, z: int, told: Iterable[tuple[int, int]] = ()) -> float:
    """The same over templates of whose own pairs, too, the unit holds the share MIN_SIMILARITY; else 0."""
    mine = _pairs(w, a, z, told)
    return max((len(t & mine) / len(t) for t, own in zip(_of(family), _own_of(family)) if own and len(own & mine) >= MIN_SIMILARITY * len(own)), default=0.0)


def examples(unknown: list[str], seed: int = SEED, each: int = 60) -> list[tuple[str, str]]:
    """(class, text): varied templates, and the unknown ones."""
    rng = random.Random(seed)
    out = []
    for family, texts in sorted(TEMPLATES.items()):
        for i in range(each):
            t = texts[i % len(texts)].split()
            if i >= len(texts):
                if len(t) > 5 and rng.random() < 0.4:
                    t.pop(rng.randrange(len(t)))
                head = [rng.choice(AROUND) for _ in range(rng.choice([0, 0, 2, 5]))]
                tail = [rng.choice(AROUND) for _ in range(rng.choice([0, 0, 2, 5]))]
                if unknown and rng.random() < 0.3:
                    tail += rng.choice(unknown).split()[: rng.randint(3, 25)]
                t = head + t + tail
            out.append((family, " ".join(t)))
    every = [w for ts in TEMPLATES.values() for t in ts for w in t.split()]
    mixed = [" ".join(rng.choice(every) for _ in range(rng.randint(3, 14))) for _ in range(each * 4)]
    around = [" ".join(rng.choice(AROUND) for _ in range(rng.randint(3, 12))) for _ in range(each)]
    echoes = [" ".join([rng.choice(every)] * rng.randint(2, 60)) for _ in range(each * 4)]
    out += [(UNKNOWN, t) for t in unknown + mixed + around + echoes + LOOKALIKES * 6]
    return out


def train(unknown: list[str], rounds: int = 300) -> Model:
    """Fit on four fifths of the examples, calibrate on the rest."""
    rows = examples(unknown)
    random.Random(SEED).shuffle(rows)
    names = [*sorted(TEMPLATES), UNKNOWN]
    w = words(pa.array([t.replace("\n", " ") for _, t in rows]))
    y = np.array([names.index(c) for c, _ in rows])
    doc = [w.doc, w.doc, w.doc]
    grams = _keys(w)
    inside = [np.ones(len(w.hash), bool), np.r_[w.doc[1:] == w.doc[:-1], False], np.r_[w.doc[2:] == w.doc[:-2], False, False]]
    positive = np.unique(np.concatenate([g[i & (y[d] < len(names) - 1)] for g, i, d in zip(grams, inside, doc)]))
    t = words(pa.array([x for ts in TEMPLATES.values() for x in ts] + [" ".join(AROUND)]))
    own = np.isin(positive, np.concatenate([g for g in _keys(t)]))
    positive = positive[own]
    x = np.zeros((len(rows), len(positive)))
    for g, i, d in zip(grams, inside, doc):
        at = np.searchsorted(positive, g)
        at[at == len(positive)] = 0
        ok = i & (positive[at] == g) & _fresh(g)
        np.add.at(x, (d[ok], at[ok]), 1)
    cut = len(rows) * 4 // 5
    xs, ys = x[:cut], np.eye(len(names))[y[:cut]]
    weights, bias = np.zeros((len(positive), len(names))), np.zeros(len(names))
    step_w, step_b = np.full_like(weights, 1e-6), np.full_like(bias, 1e-6)
    for _ in range(rounds):
        s = xs @ weights + bias
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = xs.T @ (p - ys) / cut + 1e-4 * weights
        b = (p - ys).mean(0)
        step_w += g * g
        step_b += b * b
        weights -= 0.5 * g / np.sqrt(step_w)
        bias -= 0.5 * b / np.sqrt(step_b)
    model = Model(positive, weights, bias)
    held, truth = x[cut:] @ weights + bias, y[cut:]

    def loss(t: float) -> float:
        model.temperature = t
        return -np.log(np.maximum(model.probabilities(held)[np.arange(len(truth)), truth], 1e-12)).mean() if len(truth) else t

    model.temperature = float(min(np.geomspace(0.5, 8, 25), key=loss))
    return model


def find(model: Model, texts: pa.Array) -> list[tuple[int, int, int, str, float, float]]:
    """(text, line, words before the unit, family, probability, similarity) of the units that a family wins, and of the other families confirmed there."""
    out = []
    for i, j in slices(texts, 2 << 20):
        w = words(texts[i:j])
        first, last, doc, number = _units(w)
        if not len(first):
            continue
        p = model.probabilities(model.scores(w, first, last))
        best = p.argmax(1)
        wins = p.max(1) >= MIN_PROBABILITY
        line = np.searchsorted(np.flatnonzero(w.data == 10), w.start)
        over = line[first] < line[last - 1]
        units, families = np.nonzero(p[:, :-1] > p[:, -1:])
        order = np.argsort(over[units], kind="stable")
        told: dict[str, list[tuple[int, int, bool]]] = defaultdict(list)
        rows = []
        for u, f in zip(units[order].tolist(), families[order].tolist()):
            family, a, z, first_choice = model.names[f], int(first[u]), int(last[u]), bool(wins[u] and best[u] == f)
            t = told[family]
            within = [x for x in t[bisect_left(t, (a - WINDOW,)) : bisect_left(t, (z,))] if x[1] > a] if over[u] else []
            s = (similarity if first_choice else own_similarity)(family, w, a, z, [x[:2] for x in within if x[2]])
            if s < MIN_SIMILARITY and (within or not first_choice):
                continue
            if not over[u]:
                t.append((a, z, s >= MIN_SIMILARITY))
            rows.append((u, (int(doc[u]) + i, int(number[u]), a - int(w.first[doc[u]]), family, round(float(p[u, f]), 6), round(s, 6))))
        out += [r for _, r in sorted(rows)]
    return out


def _draw(most: int):
    """A task's units with the smallest hashes, as many as all of them together give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names = np.zeros(0, np.uint64), np.zeros(0, object)
        for b in batches:
            for i, j in slices(b.column(1), 2 << 20):
                w = words(b.column(1)[i:j])
                first, last, doc, _ = _units(w)
                if not len(first):
                    continue
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hash)])
                ids = b.column(0)[i:j].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)[doc]
                h = mix((total[last] - total[first]) ^ mix(ids + np.uint64(SEED))) >> np.uint64(1)
                near = np.argsort(h, kind="stable")[:most]
                text = [w.data[w.start[a] : w.end[z - 1]].tobytes().decode("utf-8", "replace") for a, z in zip(first[near].tolist(), last[near].tolist())]
                h, text = np.concatenate([held, h[near]]), np.concatenate([names, np.array(text, object)])
                best = np.argsort(h, kind="stable")[:most]
                held, names = h[best], text[best]
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(names.tolist(), pa.string())], ["h", "unit"])

    return run


def _scan(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = find(model, b.column(1))
            if rows:
                text, line, word, family, p, s = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(line, pa.int64()), pa.array(word, pa.int64()), pa.array(family), pa.array(p), pa.array(s), pa.array([v >= MIN_SIMILARITY for v in s])], ["doc_id", "line", "word", "family", "probability", "similarity", "confirmed"])

    return run


def scan(docs: DataFrame, max_unknown: int = MAX_UNKNOWN) -> DataFrame:
    """Rows (doc_id, line, word, family, probability, similarity, confirmed); line and word count from 0."""
    ship(docs.sparkSession)
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    drawn = cut(rows.mapInArrow(lean(_draw(max_unknown)), "h bigint, unit string"), "license-units")
    held = drawn.count()
    if held > 4 * max_unknown:
        # only units up to a quantile of the hashes go further: three times as many as are wanted, with the quantile's error
        level = drawn.agg(F.percentile_approx("h", F.lit(3 * max_unknown / held), F.lit(max(10_000, 2 * held // max_unknown)))).first()[0]
        drawn = drawn.filter(F.col("h") <= level)
    drawn = drawn.orderBy("h", "unit").limit(max_unknown).select("unit").collect()
    known = {k: [words(pa.array([t])) for t in ts] for k, ts in TEMPLATES.items()}
    unknown = []
    for r in drawn:
        w = words(pa.array([r.unit]))
        if len(w.hash) and max(similarity(k, w, 0, len(w.hash)) for k in known) < 0.3:
            unknown.append(r.unit)
    return rows.mapInArrow(lean(_scan(train(unknown))), "doc_id bigint, line bigint, word bigint, family string, probability double, similarity double, confirmed boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over the whole documents table."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
