import random

import pyarrow as pa
import pytest

from lexweave.llm import licenses
from lexweave.llm._words import words

FILLER = "the river bends slowly around a quiet village where boats rest on warm sand every evening".split()


def filler(rng, n):
    return " ".join(rng.choice(FILLER) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    return licenses.train([filler(rng, rng.randint(3, 60)) for _ in range(300)])


def test_held_out_accuracy(model):
    rng = random.Random(99)
    right = total = false = 0
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            for _ in range(5):
                w = t.split()
                if len(w) > 6:
                    w.pop(rng.randrange(len(w)))
                line = f"{filler(rng, rng.randint(0, 4))} {' '.join(w)} {filler(rng, rng.randint(0, 4))}"
                found = licenses.find(model, pa.array([line]))
                right += any(f[3] == family for f in found)
                total += 1
    assert right / total > 0.95
    for _ in range(400):
        false += len(licenses.find(model, pa.array([filler(rng, rng.randint(1, 200))])))
    assert false == 0


def test_probabilities_are_calibrated(model):
    rng = random.Random(5)
    rows = licenses.examples([filler(rng, 20) for _ in range(300)], seed=77)
    w = words(pa.array([t.replace("\n", " ") for _, t in rows]))
    p = model.probabilities(model.scores(w, w.first[:-1], w.first[1:]))
    sure, hit = p.max(1), [model.names[k] == c for k, (c, _) in zip(p.argmax(1), rows)]
    assert abs(sure.mean() - sum(hit) / len(hit)) < 0.05


def test_units_cover_whole_texts():
    text = "a b\n\n" + "w " * 500 + "\nlast"
    w = words(pa.array([text, "", None, "x"]))
    first, last, doc, line = licenses._units(w)
    seen = set()
    for a, z in zip(first.tolist(), last.tolist()):
        assert 0 < z - a <= licenses.WINDOW
        seen |= set(range(a, z))
    assert seen == set(range(len(w.hash)))
    assert line[0] == 0 and line[1] == 2 and doc.tolist()[-1] == 3 and line[-1] == 0


def test_scores_equal_a_plain_sum(model):
    rng = random.Random(6)
    texts = [f"{filler(rng, 5)} Licensed under the MIT License. {filler(rng, 80)}\nReleased under the 3-Clause BSD License."]
    w = words(pa.array(texts))
    first, last, _, _ = licenses._units(w)
    got = model.scores(w, first, last)
    at = {int(k): i for i, k in enumerate(model.keys)}
    keys = licenses._keys(w)
    for u, (a, z) in enumerate(zip(first.tolist(), last.tolist())):
        want = model.bias.copy()
        for n, key in enumerate(keys, 1):
            for i in range(a, z - n + 1):
                if int(key[i]) in at and (i == 0 or key[i] != key[i - 1]):
                    want += model.weights[at[int(key[i])]]
        assert got[u] == pytest.approx(want)


def confirmed(model, text):
    return [(f[1], f[3]) for f in licenses.find(model, pa.array([text])) if f[5] >= licenses.MIN_SIMILARITY]


def test_notices_wrapped_at_every_word(model):
    rng = random.Random(8)
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            w = t.split()
            assert (0, family) in confirmed(model, t)
            wraps = [["\n".join([" ".join(w[:i]), " ".join(w[i:])])] for i in range(1, len(w))]
            for (wrapped,) in [*wraps, ["\n# ".join(w)], ["\r\n".join(w)], [" \n * ".join(w)]]:
                assert family in {f for _, f in confirmed(model, wrapped)}, wrapped
                around = f"{filler(rng, 9)}\n\n{filler(rng, 12)}\n \n{wrapped}\n\t\n{filler(rng, 9)}"
                assert family in {f for _, f in confirmed(model, around)}, around


def test_a_paragraph_repeats_no_line_and_ends_at_blank_ones(model):
    notice = "Licensed under the MIT License."
    assert confirmed(model, f"{FILLER[1]}\n{notice}\n{FILLER[2]}") == [(1, "mit")]
    assert confirmed(model, "Licensed under\n\nthe MIT\n \t\nLicense.") == []
    assert confirmed(model, f"{notice}\n{FILLER[1]}\nLicensed under the\nMIT License.") == [(0, "mit"), (0, "mit")]
    assert ("mit" in {f for _, f in confirmed(model, "\n".join([filler(random.Random(3), 8)] * 20 + ["Released under the", "MIT License."]))})


def test_every_licence_of_a_unit_is_named(model):
    for a, b, text in (
        ("apache", "mit", "Licensed under the MIT License or the Apache License, Version 2.0."),
        ("gpl", "mit", "Released under the MIT License. Licensed under the GNU General Public License, version 2 or later."),
        ("bsd", "mpl", "Released under the 3-Clause BSD License. Licensed under the Mozilla Public License, version 2.0."),
    ):
        w = text.split()
        for i in range(len(w)):
            assert {f for _, f in confirmed(model, " ".join(w[:i]) + "\n" * (i > 0) + " ".join(w[i:]))} == {a, b}
    for family, texts in licenses.TEMPLATES.items():
        for t in texts:
            assert confirmed(model, t) == [(0, family)]


NOTICES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "apache": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


@pytest.mark.parametrize("family", NOTICES)
def test_standard_notices_as_they_are_shipped(model, family):
    import textwrap

    for width in (30, 72, 100):
        lines = textwrap.wrap(NOTICES[family], width)
        for mark in ("", "# ", "// ", " * ", "-- "):
            assert {f for _, f in confirmed(model, "Copyright (c) 2020 A B\n\n" + "\n".join(mark + x for x in lines))} == {family}, (width, mark)


def plain_units(text):
    """(words, line, word number) of the units of a text, by its lines and paragraphs."""
    import re

    units, paragraph, at = [], [], 0

    def windows(run):
        step = licenses.WINDOW // 2
        n = 1 if len(run) <= licenses.WINDOW else -(-(len(run) - licenses.WINDOW) // step) + 1
        return [run[i * step : i * step + licenses.WINDOW] for i in range(n)]

    def close():
        if paragraph:
            units.extend(u for u in windows(paragraph) if u[0][1] < u[-1][1])
            paragraph.clear()

    for number, line in enumerate(text.split("\n")):
        if not line.strip():
            close()
            continue
        here = []
        for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", line.lower()):
            here.append((w, number, at))
            at += 1
        if here:
            units += windows(here)
        paragraph += here
    close()
    return {(tuple(w for w, _, _ in u), u[0][1], u[0][2]) for u in units}


def test_units_and_similarities_equal_plain_python(model):
    rng = random.Random(12)
    pairs = lambda w: {*zip(w, w[1:])} if len(w) > 1 else set(w)
    norm = lambda t: licenses_words(t)
    for _ in range(20):
        blocks = [filler(rng, rng.choice([3, 20, 150])), rng.choice(list(NOTICES.values())), rng.choice([t for ts in licenses.TEMPLATES.values() for t in ts])]
        rng.shuffle(blocks)
        text = rng.choice(["\n", "\n\n", "\n \n"]).join("\n".join(b.split(". ")) for b in blocks)
        w = words(pa.array([text]))
        first, last, _, line = licenses._units(w)
        raw = w.data.tobytes()
        got = {(tuple(raw[w.start[k] : w.end[k]].decode() for k in range(a, z)), n, a) for a, z, n in zip(first.tolist(), last.tolist(), line.tolist())}
        assert got == plain_units(text)
        for f in licenses.find(model, pa.array([text])):
            mine = next(u for u in got if u[1:] == (f[1], f[2]))[0]
            best = max(len(pairs(norm(t)) & pairs(list(u[0]))) / len(pairs(norm(t))) for t in licenses.TEMPLATES[f[3]] for u in got if u[1:] == (f[1], f[2]))
            assert f[5] <= round(best, 6) + 1e-9 and mine
            assert (f[5] >= licenses.MIN_SIMILARITY) <= (best >= licenses.MIN_SIMILARITY)


def licenses_words(text):
    from tests.llm import brute

    return brute.words(text)


def test_the_unknown_units_are_those_of_the_smallest_hashes(spark, monkeypatch):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "\n".join(filler(rng, 6) for _ in range(20))) for i in range(60)], "doc_id long, text string").repartition(6)
    seen = []
    train = licenses.train
    monkeypatch.setattr(licenses, "train", lambda units: seen.append(units) or train(units[:20]))
    licenses.scan(df, 40)
    every = df.mapInArrow(licenses._draw(10**6), "h bigint, unit string").orderBy("h", "unit").limit(40).collect()
    assert seen == [[r.unit for r in every]]


def test_query_finds_planted_lines_and_leaves_the_rest(spark, sf_dir):
    found = licenses.query(spark, sf_dir).filter("confirmed").collect()
    assert found
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in found:
        assert any(s in texts[r.doc_id].split("\n")[r.line].lower() for s in ("licen", "rights reserved", "copyright", "permission", "public domain", "copying"))


def test_edges(spark):
    notice = "Licensed under the MIT License."
    docs = [(1, notice, 0.5), (1, notice, 0.5), (2, None, 1.0), (3, "", 1.0), (None, notice, 1.0), (4, "x " * 200_000 + "\n" + notice, 1.0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, probability double")
    rows = sorted((r.doc_id, r.line, r.family, r.confirmed) for r in licenses.scan(df).filter("confirmed").collect())
    assert rows == [(1, 0, "mit", True), (1, 0, "mit", True), (4, 1, "mit", True)]
    assert licenses.scan(df.limit(0)).count() == 0
