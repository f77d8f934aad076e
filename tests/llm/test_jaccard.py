import random

import numpy as np
import pytest

from lexweave.llm import jaccard
from tests.llm import brute


def random_texts(seed):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(1, 40))] for _ in range(12)]
    docs = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("klmnop")
        docs.append((i, " ".join(w)))
    return docs


def rows(df):
    return {(r.doc_a, r.doc_b, r.jaccard) for r in df.collect()}


#: Ways to cut the join: as in production, all in blocks, blocks and pairs, heavy n-grams as well.
CUTS = {"production": {}, "blocks": {"hot": 0, "block": 3}, "both": {"hot": 3, "block": 4}, "heavy": {"hot": 3, "block": 4, "share": 0.02, "seen": 2}, "heavy pairs": {"hot": 10**6, "share": 0.02, "seen": 2}}


def check(docs, df, n, threshold, **cuts):
    pairs = brute.jaccard_rows(docs, n, threshold)
    assert pairs
    assert rows(jaccard.near(df, n, threshold, **cuts)) == pairs
    assert {tuple(r) for r in jaccard.classes(df, n, threshold, **cuts).collect()} == brute.jaccard_classes(docs, n, threshold)


def test_join_equals_brute_force_on_a_corpus(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    check(docs, df, jaccard.N, jaccard.THRESHOLD)


@pytest.mark.parametrize("n,threshold,name", [*((2, 0.3, c) for c in CUTS), (3, 0.7, "both")])
def test_every_cut_equals_brute_force_on_random_texts(spark, n, threshold, name):
    docs = random_texts(n)
    check(docs, spark.createDataFrame(docs, "doc_id long, text string"), n, threshold, **CUTS[name])


def test_all_pairs_are_read_off_the_rows(spark):
    docs = random_texts(4) + [(200 + i, "a b c d e f") for i in range(4)] + [(300, "a b c d e g"), (301, "a b c d e g")]
    got = {(r.doc_a, r.doc_b) for r in jaccard.expand(jaccard.near(spark.createDataFrame(docs, "doc_id long, text string"), 2, 0.5)).collect()}
    sets = [(i, brute.grams(t, 2)) for i, t in docs]
    assert got == {(i, j) for i, a in sets for j, b in sets if i < j and a and len(a & b) >= 0.5 * len(a | b)}


def test_overlaps_equal_intersections():
    rng = np.random.default_rng(3)
    a, b = [[set(rng.integers(0, 5000, rng.integers(0, 200)).tolist()) | ({7, 8, 9} if i % 2 else set()) for i in range(k)] for k in (40, 30)]
    flat = lambda s: (np.array([x for t in s for x in sorted(t)], np.uint64), np.repeat(np.arange(len(s)), [len(t) for t in s]), len(s))
    assert jaccard.overlaps(*flat(a), *flat(b)).tolist() == [[len(x & y) for y in b] for x in a]


def test_nulls_empty_repeats_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, "one two three four five six", "x"), (1, "one two three four five six", "x"), (2, "One, two three FOUR five six!", "y"), (3, None, None), (4, "", "z"), (5, "...", "z"), (None, "one two three four five six", "n"), (6, "Hi", "s"), (7, "hi", "s"), (8, long, "l"), (9, long + " end", "l")]
    df = spark.createDataFrame(docs, "doc_id long, text string, sig string").withColumnRenamed("sig", "frag")
    assert rows(jaccard.near(df)) == {(1, 2, 1.0), (6, 7, 1.0), (8, 9, round(29996 / 29997, 6))}
    assert sorted(tuple(r) for r in jaccard.classes(df).collect()) == [(1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 6, 0), (8, 8, 1), (9, 8, 1)]
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 1, 3, 4, 5, 6, 8]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near(df).count() == 0
    assert jaccard.classes(df).count() == 0
    assert jaccard.keep_one(df).count() == 0


def test_groups_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 105)], "doc_a long, doc_b long")
    got = {r.doc_id: r.group_id for r in jaccard.groups(pairs).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 105: 100}


def test_rows_of_one_id_with_several_texts(spark):
    one, two = "a b c d e f g h", "q r s t u v w x"
    docs = [(1, one), (5, one), (5, two), (2, two), (9, "z y z y z y"), (9, one + " i")]
    got = {r.doc_id: r.class_id for r in jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 9: 1}
