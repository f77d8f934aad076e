import random

from lexweave.llm import decontaminate as d
from tests.llm import brute


def rows(df):
    return {tuple(r) for r in df.collect()}


def want(docs, items, ngram=d.NGRAM, share=d.SHARE, slack=d.SLACK):
    out = set()
    for i, t in docs:
        for k, q in items:
            if i is None or k is None:
                continue
            out |= {(i, k, "exact", p, n) for p, n in brute.exact_runs(t, q, ngram)}
            s = brute.near_stretch(t, q, share, slack)
            if s:
                out.add((i, k, "proximity", *s))
    return out


def test_corpus_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    expected = want(docs, items)
    assert expected
    assert rows(d.query(spark, sf_dir)) == expected


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(5)
    v = [f"w{i}" for i in range(14)]
    items = [(k, " ".join(rng.choice(v) for _ in range(rng.randint(1, 12)))) for k in range(12)]
    docs = []
    for i in range(60):
        t = [rng.choice(v) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            t += rng.choice(items)[1].split()
        docs.append((i, " ".join(t)))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    options = dict(ngram=4, share=0.7, slack=1.3)
    expected = want(docs, items, **options)
    assert rows(d.match(d.build(a), b, **options)) == expected
    assert rows(d.match(d.build(a), b, **options, max_item_words=20)) == expected


def test_edges(spark):
    words = " ".join(f"t{i}" for i in range(20))
    docs = [(1, words, "a"), (1, words, "a"), (2, None, None), (3, "", "b"), (None, words, "c"), (4, "x " * 200_000 + words, "d"), (5, "clean text", "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, words.upper(), 1), (7, words.upper(), 1), (8, None, 1), (None, words, 1), (9, "", 1)], "item_id long, text string, doc_id long")
    assert rows(d.match(d.build(df), items)) == {(1, 7, "exact", 0, 20), (1, 7, "proximity", 0, 20), (4, 7, "exact", 200_000, 20), (4, 7, "proximity", 200_000, 20)}
    kept = d.clean(df, items)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 2, 3, 5]
    assert d.match(d.build(df.limit(0)), items).count() == 0
    assert d.match(d.build(df), items.limit(0)).count() == 0
