import pytest
from pyspark.sql import functions as F

from lexweave.operators import asked, index as ix, store
from lexweave.plans import by_document, pruning, search

QUERIES = [(1, "t1 t7 t9"), (2, "t3 t5"), (3, "t38 x"), (4, "nowhere"), (5, "t2 t2 T4"), (6, "t1 nowhere"), (9, "t1")]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def docs(spark):
    """Lists of many lengths, ties in score, copies, and texts without any asked term."""
    made = [(i, " ".join(f"t{k}" for k in range(1, 40) if i % 7 and i % 70 % k == 0) + " x" * (i % 3)) for i in range(700)]
    return spark.createDataFrame([*made, (700, ""), (701, None), (None, "t1 t7")], "doc_id int, text string").repartition(5)


@pytest.fixture(scope="module")
def terms(spark):
    return search.query_terms(spark.createDataFrame(QUERIES, "qid long, query string"))


@pytest.fixture(scope="module")
def both(docs, terms):
    return ix.build(docs), asked.read(docs, [r.term for r in terms.collect()])


def test_asked_lists_are_those_of_the_whole_index(both, terms):
    plain, some = both
    want = plain.lookup(terms.select("term"))
    assert rows(some.postings) == rows(want.select("term", "doc_id", "tf", "doc_len")) and some.postings.count() > 1000
    assert rows(some.stats) == rows(plain.stats)
    assert rows(some.lexicon) == rows(asked_lexicon(plain, terms))
    pick = lambda i, p: rows(i.scored(p).select("term", "doc_id", "df", F.round("score", 9)))
    assert pick(some, None) == [r for r in pick(plain, None) if r[0] in some.names]


def asked_lexicon(plain, terms):
    return plain.lexicon.join(terms.select("term").distinct(), "term", "left_semi")


@pytest.mark.parametrize("plan", [search.daat_or, search.taat_or, search.daat_and, pruning.wand, pruning.max_score])
@pytest.mark.parametrize("k,cells", [(1, 2 << 20), (7, 50), (900, 2 << 20)])
def test_searches_by_document_equal_the_joins(both, terms, plan, k, cells, monkeypatch):
    plain, some = both
    monkeypatch.setattr(by_document, "CELLS", cells)
    want = (search.daat_and if plan is search.daat_and else search.daat_or)(plain, terms, k)
    assert rows(plan(some, terms, k)) == rows(want)


def test_counts_and_kth_scores_by_document(both, terms, monkeypatch):
    plain, some = both
    for mode in ("or", "and"):
        assert rows(search.match_counts(some, terms, mode)) == rows(search.match_counts(plain, terms, mode))
    assert rows(pruning.kth_scores(some, terms, 3)) == rows(pruning.kth_scores(plain, terms, 3))
    monkeypatch.setattr(by_document, "PAIRS", 3)  # too many to send: the joins
    assert not by_document.fits(some, terms)
    assert rows(search.daat_or(some, terms, 5)) == rows(search.daat_or(plain, terms, 5))


def test_only_the_best_of_a_task_are_shuffled(both, terms):
    _, some = both
    plan = search.daat_or(some, terms, 5)._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    assert by_document.candidates(some, terms, 5).count() < search.union_docids(some, terms).count() / 2


def test_no_terms_and_no_documents(spark, docs, terms):
    none = asked.read(docs.limit(0), ["t1", "t7", "t9", "t3", "t5", "t38", "x", "nowhere", "t2", "t4"])
    assert search.daat_or(none, terms).count() == pruning.wand(none, terms).count() == pruning.max_score(none, terms).count() == 0
    some = asked.read(docs, [])
    assert some.n_docs == 702 and search.daat_or(some, terms.limit(0)).count() == search.match_counts(some, terms.limit(0)).count() == 0


def test_searches_make_no_whole_index(spark, sf_dir):
    from lexweave import queries

    store._BUILT.clear()
    for name in ("daat_or_batch", "wand", "kth_score", "retrieve_docids", "multi_layered_max_score"):
        assert queries.QUERIES[name](spark, sf_dir).count() > 0
    assert store._BUILT and all(("documents",) not in key for key in store._BUILT)


def test_layers_by_document_are_those_of_ranks(both):
    from lexweave.operators import asked_layers, layers

    plain, some = both
    for name in ("percentage_2", "percentage_8", "equal_4"):
        got = asked_layers.layered(some, name)
        posted = got.forward.select("doc_id", F.explode(F.arrays_zip("nos", "layers")).alias("p")).collect()
        want = layers.layerify(some.scored(), name).select("term", "doc_id", "layer")
        assert sorted((got.names[r.p.nos], r.doc_id, r.p.layers) for r in posted) == rows(want)
        stats = {(r.term, r.layer): r["count"] for r in want.groupBy("term", "layer").count().collect()}
        assert {(got.names[no], layer): got.n[layer, no] for layer in range(len(got.n)) for no in range(len(got.names)) if got.n[layer, no]} == stats
    with pytest.raises(ValueError):
        asked_layers.layered(some, "exponential_2")


@pytest.mark.parametrize("k,cells", [(1, 2 << 20), (7, 300), (900, 2 << 20)])
def test_layered_searches_by_document_equal_the_joins(both, terms, k, cells, monkeypatch):
    from lexweave.operators import asked_layers

    plain, some = both
    monkeypatch.setattr(by_document, "CELLS", cells)
    want = rows(search.daat_or(plain, terms, k))
    two, eight = asked_layers.layered(some, "percentage_2"), asked_layers.layered(some, "percentage_8")
    assert rows(pruning.dual_wand(two, terms, k)) == rows(pruning.dual_max_score(two, terms, k)) == want
    assert rows(pruning.multi_or(eight, terms, k)) == rows(pruning.multi_max_score(eight, terms, k)) == rows(pruning.layered_taat(eight, terms, k)) == want


def test_early_termination_by_document_reads_what_the_joins_read(spark, both, terms, tmp_path):
    from lexweave.operators import asked_layers

    docs = spark.createDataFrame([(i, ("rare " * (30 - i) if i < 3 else "") + "common " * (1 + i % 5) + "x " * (20 + i % 50)) for i in range(3000)], "doc_id long, text string").repartition(4)
    log = search.query_terms(spark.createDataFrame([(1, "rare common"), (2, "nowhere"), (3, "common"), (4, "rare"), (5, "rare x")], "qid long, query string"))
    some = asked.read(docs, [r.term for r in log.collect()])
    for n, (index, asks, ks) in enumerate(((some, log, (2,)), (both[1], terms, (2,)))):
        stored = store.write(index, str(tmp_path / str(n)), "percentage_8")
        eight = asked_layers.layered(index, "percentage_8")
        for k in ks:
            _, left, read = pruning.taat_steps(stored, asks, k)
            _, left_too, read_too = pruning.taat_steps(eight, asks, k)
            assert rows(read_too) == rows(read) and rows(left_too) == rows(left)
            assert rows(pruning.layered_taat(eight, asks, k)) == rows(search.daat_or(index, asks, k))
        if n == 0:
            assert any(r.early_terminated for r in read_too.collect())
