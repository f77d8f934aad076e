import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexweave.functions import text
from lexweave.operators import chunks, index as ix, layers, ranks, store
from lexweave.plans import pruning, search

DOCS = [(0, "a b a"), (1, "b c"), (2, "A-b é c"), (3, ""), (4, None)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_tokens_split_at_everything_but_ascii(corpus):
    assert rows(text.tokens(corpus), "doc_id", "position", "term") == [(0, 0, "a"), (0, 1, "b"), (0, 2, "a"), (1, 0, "b"), (1, 1, "c"), (2, 0, "a"), (2, 1, "b"), (2, 2, "c")]


def test_index_tables(corpus):
    i = ix.build(corpus, positions=True)
    assert rows(i.postings, "term", "doc_id", "tf", F.col("positions").cast("string")) == [("a", 0, 2, "[0, 2]"), ("a", 2, 1, "[0]"), ("b", 0, 1, "[1]"), ("b", 1, 1, "[0]"), ("b", 2, 1, "[1]"), ("c", 1, 1, "[1]"), ("c", 2, 1, "[2]")]
    assert rows(i.lexicon, "term", "df", "cf") == [("a", 2, 3), ("b", 3, 3), ("c", 2, 2)]
    assert rows(i.docs, "doc_id", "doc_len") == [(0, 3), (1, 2), (2, 3), (3, 0), (4, 0)]


def test_bm25_by_hand(corpus):
    i = ix.build(corpus)
    n, avgdl = 5, max(1, 8 // 5)
    part = lambda df, tf, length: math.log10(1 + (n - df + 0.5) / (df + 0.5)) * tf * 3 / (tf + 0.5 + 1.5 / avgdl * length)
    got = {(r.term, r.doc_id): r.score for r in i.scored().collect()}
    assert got[("a", 0)] == pytest.approx(part(2, 2, 3))
    assert got[("c", 1)] == pytest.approx(part(2, 1, 2))


@pytest.fixture(scope="module")
def big(spark):
    """A corpus with lists of many lengths and ties in score."""
    rows = [(i, " ".join(f"t{k}" for k in range(1, 40) if i % k == 0) + " x" * (i % 3)) for i in range(700)]
    return ix.build(spark.createDataFrame(rows, "doc_id long, text string"))


QUERIES = [(1, "t1 t7 t9"), (2, "t3 t5"), (3, "t39 x"), (4, "nowhere"), (5, "t2 t2 T4"), (6, "t1 nowhere")]


@pytest.fixture(scope="module")
def asked(spark):
    return search.query_terms(spark.createDataFrame(QUERIES, "qid long, query string"))


@pytest.mark.parametrize("plan", [pruning.wand, pruning.max_score, pruning.chunk_skip, pruning.dual_wand, pruning.dual_max_score, pruning.multi_or, pruning.multi_max_score, search.taat_or])
def test_pruned_disjunctions_equal_the_plain_one(big, asked, plan):
    assert rows(plan(big, asked, 7), "qid", "rank", "doc_id", "score") == rows(search.daat_or(big, asked, 7), "qid", "rank", "doc_id", "score")


@pytest.mark.parametrize("plan", [pruning.dual_and, pruning.dual_merge_and])
def test_layered_conjunctions_equal_the_plain_one(big, asked, plan):
    assert rows(plan(big, asked, 7), "qid", "rank", "doc_id", "score") == rows(search.daat_and(big, asked, 7), "qid", "rank", "doc_id", "score")


@pytest.mark.parametrize("name", ["equal_2", "equal_8", "percentage_2", "percentage_4", "exponential_4"])
def test_layers_partition_each_list(big, name):
    scored = big.scored()
    got = layers.layerify(scored, name).select("term", "doc_id", "layer", F.round("score", 6).alias("score")).cache()
    assert rows(got, "term", "doc_id") == rows(scored, "term", "doc_id")
    bounds = {}
    for r in got.collect():
        lo, hi = bounds.get((r.term, r.layer), (9e9, -1))
        bounds[r.term, r.layer] = (min(lo, r.score), max(hi, r.score))
    for (term, layer), (lo, hi) in bounds.items():
        if (term, layer + 1) in bounds:
            assert hi > bounds[term, layer + 1][1] and lo >= bounds[term, layer + 1][1]
    got.unpersist()


def test_chunks_and_seeks(spark, big):
    stats = chunks.chunk_stats(big.scored(), 8).filter("term = 't7'").collect()
    docs = sorted(r.doc_id for r in big.postings.filter("term = 't7'").collect())
    assert [(r.first_doc, r.last_doc) for r in sorted(stats, key=lambda r: r.chunk_no)] == [(docs[i], docs[min(i + 7, len(docs) - 1)]) for i in range(0, len(docs), 8)]
    seeks = spark.createDataFrame([("t7", t) for t in (0, 1, 14, 693, 694)], "term string, target long")
    assert {r.target: r.doc_id for r in chunks.next_geq(big.postings, seeks).collect()} == {0: 0, 1: 7, 14: 14, 693: 693, 694: None}


def test_merge_of_parts_is_the_whole(spark, corpus):
    whole = ix.build(corpus)
    parts = [ix.build(corpus.filter(f"doc_id % 2 = {k}")) for k in (0, 1)]
    merged = ix.merge(parts)
    assert rows(merged.postings, "term", "doc_id", "tf") == rows(whole.postings, "term", "doc_id", "tf")
    assert rows(merged.stats) == rows(whole.stats)
    assert ix.overlapping_documents(parts).count() == 0


def test_remap_and_back_is_the_identity(spark, corpus):
    i = ix.build(corpus)
    there = spark.createDataFrame([(k, 10 - k) for k in range(5)], "old_doc_id long, new_doc_id long")
    back = there.select(F.col("new_doc_id").alias("old_doc_id"), F.col("old_doc_id").alias("new_doc_id"))
    assert rows(ix.remap(ix.remap(i, there), back).postings, "term", "doc_id", "tf") == rows(i.postings, "term", "doc_id", "tf")


def test_gaps_round_trip(big):
    number = F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))
    gapped = ix.with_gaps(big.postings).withColumn("doc_no", number).drop("doc_id")
    back = ix.without_gaps(gapped)
    assert rows(back, "term", "doc_id") == rows(big.postings, "term", "doc_id")


def test_save_and_load(spark, corpus, tmp_path):
    i = ix.build(corpus)
    i.save(str(tmp_path / "i"))
    again = ix.Index.load(spark, str(tmp_path / "i"))
    assert rows(again.postings, "term", "doc_id", "tf") == rows(i.postings, "term", "doc_id", "tf")
    assert rows(again.stats) == rows(i.stats)


@pytest.fixture(scope="module")
def stored(big, tmp_path_factory):
    return store.write(big, str(tmp_path_factory.mktemp("store") / "i"))


@pytest.mark.parametrize("plan", [pruning.wand, pruning.max_score, pruning.chunk_skip])
def test_plans_over_a_stored_index(big, stored, asked, plan):
    for k in (1, 7, 900):
        assert rows(plan(stored, asked, k)) == rows(search.daat_or(big, asked, k))


def test_a_term_filter_reaches_the_scan(stored):
    plan = stored.term("t7")._jdf.queryExecution().toString()
    assert "EqualTo(term,t7)" in plan.split("PushedFilters")[1]
    few = search.lists(stored, stored.docs.sparkSession.createDataFrame([(1, 2, "t7"), (1, 2, "t9")], "qid long, n_terms int, term string"))
    assert "In(term, [t7,t9])" in few._jdf.queryExecution().toString()


def test_layers_end_early_where_the_best_are_decided(spark, tmp_path):
    # a rare term decides the k best at once; the long list can't lift any other document among them
    docs = [(i, ("rare " * (30 - i) if i < 3 else "") + "common " * (1 + i % 5) + "x " * (20 + i % 50)) for i in range(3000)]
    i = ix.build(spark.createDataFrame(docs, "doc_id long, text string"))
    asked = search.query_terms(spark.createDataFrame([(1, "rare common"), (2, "nowhere"), (3, "common")], "qid long, query string"))
    s = store.write(i, str(tmp_path / "i"), "percentage_8")
    assert rows(pruning.layered_taat(s, asked, 2)) == rows(search.daat_or(i, asked, 2))
    read = {r.qid: r for r in pruning.taat_steps(s, asked, 2)[2].collect()}
    assert read[1].early_terminated and read[1].layers < 8 and read[1].postings < 3003
    assert read[2].postings == 0


def test_numbers_of_long_lists_go_on_over_ranges(spark):
    values = [("a" if i % 7 else f"z{i % 11}", i * 37 % 5003) for i in range(5000)]
    df = spark.createDataFrame(values, "term string, v long")
    want, held = {}, {}
    for t, v in sorted(values):
        seen = held.setdefault(t, [])
        want[t, v] = (len(seen), seen[-1] if seen else None, sum(seen) + v)
        seen.append(v)
    got = ranks.numbered(df, "term", ["v"], rank="r", lag=("before", "v"), total=("sum", "v")).collect()
    assert {(r.term, r.v): (r.r, r.before, r.sum) for r in got} == want
    assert ranks.numbered(df.limit(0), "term", ["v"], rank="r").count() == 0


def test_legacy_layerings(spark, big):
    for name in ("percentage-lower-upper-bounded", "exponentially-increasing", layers.Strategy(3, (10.0, 20.0, 70.0), most=(150, 0, 0))):
        got = layers.layerify(big.scored(), name)
        assert got.count() == big.postings.count()
    sizes = {r.layer: r["count"] for r in got.filter("term = 't1'").groupBy("layer").count().collect()}
    assert sum(sizes.values()) == 700 and sizes[0] >= layers.LEAST


@pytest.mark.parametrize("parts,block,name", [(1, 50, "percentage_8"), (5, 1 << 17, "exponential_2"), (13, 100, layers.Strategy(4, least=(130,) * 4, steps=(64, 140)))])
def test_layers_within_ranges_equal_those_of_ranks(spark, big, parts, block, name, monkeypatch):
    want = rows(layers.layerify(big.scored(), name, overlapping=parts == 5), "term", "layer", "doc_id", "tf")
    monkeypatch.setattr(layers, "BLOCK", block)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    whole = []
    monkeypatch.setattr(layers, "cut", lambda df, n, cut=layers.cut: whole.append(cut(df, n)) or whole[-1])
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert rows(layers.layers_of(big, name, parts == 5), "term", "layer", "doc_id", "tf") == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    # most lists need no rank over all ranges
    assert whole[1].filter("layer < 0").select("term").distinct().count() <= 2 * parts
