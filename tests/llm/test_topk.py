import random
from collections import Counter
from math import log

from lexweave.llm import topk
from tests.llm.brute import words


def brute(docs, queries, k):
    docs = [(i, words(t)) for i, t in docs if i is not None]
    n, total = len(docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for q, text in sorted({(q, t) for q, t in queries if q is not None and t is not None}):
        scored = []
        for i, w in docs:
            tf, s = Counter(w), 0
            for t, c in Counter(words(text)).items():
                if tf[t]:
                    s += c * log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (topk.K1 + 1) / (tf[t] + topk.K1 * (1 - topk.B + topk.B * len(w) / (total / n)))
            if round(s, 6) > 0:
                scored.append((-round(s, 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_search_equals_brute_force(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)]
    docs += docs[:20] + [(200, None), (201, ""), (None, "a b c"), (202, "a " * 100_000)]
    queries = [(q, text(rng.randint(1, 8))) for q in range(30)] + [(3, "a b"), (3, "a b"), (None, "a"), (50, None), (51, "..."), (52, "nowhere")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    for k in (1, 5, 500):
        assert sorted(tuple(r) for r in topk.search(a.repartition(5), b, k).collect()) == brute(docs, queries, k)
    assert sorted(tuple(r) for r in topk.search(a, b, 5, max_query_words=20).collect()) == brute(docs, queries, 5)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "x y", 1.0, 2)], "doc_id long, text string, score double, rank int")
    queries = spark.createDataFrame([(1, "x")], "item_id long, text string")
    assert topk.search(docs, queries).count() == 1
    assert topk.search(docs.limit(0), queries).count() == 0
    assert topk.search(docs, queries.limit(0)).count() == 0


def test_documents_as_queries_equal_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({topk.SQL_BY_DOCUMENT})").fetchall()
    got = [tuple(r) for r in topk.query_by_document(spark, sf_dir).collect()]
    key = lambda r: (r[0], r[1])
    assert [r[:3] for r in sorted(got, key=key)] == [r[:3] for r in sorted(want, key=key)]
    assert all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(sorted(got, key=key), sorted(want, key=key)))
    assert {r[0] for r in got} == {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter(f"doc_id % {topk.EVERY} = 0 and text rlike '[A-Za-z0-9]'").collect()}
