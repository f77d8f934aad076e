import pytest

from lexweave import toolkit
from lexweave.config import Config
from lexweave.functions import text
from lexweave.operators import index as ix
from lexweave.plans import search
from lexweave.streaming import runs


@pytest.fixture(scope="module")
def corpus(spark):
    docs = [(0, "a b a", "http://x.org/0"), (1, "b c", "http://x.org/1"), (2, "a c d", None)]
    return ix.build(spark.createDataFrame(docs, "doc_id long, text string, url string"), url="url", positions=True)


def test_choose_refuses_what_does_not_fit():
    assert search.choose("default") == "daat-and"
    assert search.choose("default", layers=8) == "layered-taat-or-early-terminated"
    assert search.choose("default", layers=2, overlapping=True) == "daat-and"
    assert search.choose("dual-layered-wand", 2, True) == "dual-layered-wand"
    assert search.choose("daat-and-top-positions", positions=True) == "daat-and-top-positions"
    for args in (("nothing",), ("dual-layered-wand", 1, True), ("dual-layered-wand", 2, False), ("multi-layered-daat-or", 1), ("multi-layered-daat-or", 2, True), ("daat-or", 4), ("daat-and-top-positions",)):
        with pytest.raises(ValueError):
            search.choose(*args)


@pytest.mark.parametrize("algorithm,layering,overlapping", [("daat-or", None, False), ("wand", None, False), ("dual-layered-max-score", "percentage_2", True), ("multi-layered-daat-or", "equal_4", False)])
def test_search_by_name(spark, corpus, algorithm, layering, overlapping):
    queries = spark.createDataFrame([(1, "a c")], "qid long, query string")
    want = [tuple(r) for r in search.daat_or(corpus, search.query_terms(queries)).collect()]
    got = search.search(corpus, queries, algorithm, layering=layering, overlapping=overlapping).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) == 3


def test_result_formats(spark, corpus):
    results = search.daat_or(corpus, search.query_terms(spark.createDataFrame([(1, "b")], "qid long, query string")))
    assert search.format_results(results, corpus, "discard").count() == 0
    urls = {r.line.split("\t")[2] for r in search.format_results(results, corpus).collect()}
    assert urls == {"http://x.org/0", "http://x.org/1"}
    with pytest.raises(ValueError):
        search.format_results(results, corpus, "other")


def test_times_of_a_search(corpus):
    told = search.bench_search(lambda: corpus.docs, warm_ups=1, repeats=2)
    assert told["runs"] == 2 and 0 < told["best_s"] <= told["mean_s"] <= told["total_s"]


def test_stop_words_and_strict_headings(spark):
    assert text.read_stop_words(" The of\nAND\t") == ["the", "of", "and"]
    pages = spark.createDataFrame([(1, "<h2>a</h2><h1 id=x>b</h1><b>c</b>")], "page_id long, html string")
    bits = lambda strict: {r.term: r.context for r in text.html_contexts(pages, strict_headings=strict).collect()}
    assert bits(False) == {"a": text.CONTEXTS["H"], "b": 0, "c": text.CONTEXTS["B"]}
    assert bits(True)["a"] == 0 and bits(True)["b"] == text.CONTEXTS["H"]


def test_tokens_of_odd_texts(spark):
    texts = ["", None, "é", "A1b-C", "x" * 100_000, "é" * 3 + "q", " z", "end", "w " * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    got = {}
    for r in text.tokens(df).collect():
        got.setdefault(r.doc_id, []).append((r.position, r.term))
    assert got[3] == [(0, "a1b"), (1, "c")] and got[4] == [(0, "x" * 100_000)] and got[5] == [(0, "q")] and got[6] == [(0, "z")] and got[7] == [(0, "end")]
    assert set(got) == {3, 4, 5, 6, 7, 8} and got[8] == [(i, "w") for i in range(300_000)]
    p = ix.build(df, positions=True).postings
    assert p.schema["doc_id"].dataType.simpleString() == "int"
    row = p.filter("doc_id = 8").first()
    assert row.tf == row.doc_len == 300_000 and row.positions == list(range(text.POSITIONS))


def test_runs_are_compacted(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string").write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    runs.append_runs(stream, str(tmp_path / "runs"), str(tmp_path / "check")).awaitTermination(120)
    runs.compact(spark, str(tmp_path / "runs"), str(tmp_path / "out"))
    assert {(r.term, r.df) for r in ix.Index.load(spark, str(tmp_path / "out")).lexicon.collect()} == {("a", 1), ("b", 2), ("c", 1)}


def test_options_reach_the_operators(spark, tmp_path):
    docs = spark.createDataFrame([(0, "<b>a b</b> the"), (1, "b the the"), (2, "c")], "doc_id long, text string")
    (tmp_path / "stop").write_text("the\nof")
    config = Config().override(f"document_collection_format=html;include_positions=true;query_algorithm=daat-or;max_number_results=1;result_format=trec;stop_words_list_filename={tmp_path / 'stop'}")
    index = toolkit.build(docs, config)
    assert "positions" in index.postings.columns and index.lexicon.count() == 4
    queries = spark.createDataFrame([(7, "the b"), (8, "the")], "qid long, query string")
    lines = [r.line.split("\t") for r in toolkit.run(index, queries, config, "r1").collect()]
    assert [(x[0], x[3], x[5]) for x in lines] == [("7", "0", "r1")]
    layered = toolkit.layer(index, str(tmp_path / "l"), config.override("layering_strategy=equal_4;num_layers=4"))
    many = toolkit.run(layered, queries, config.override("query_algorithm=multi-layered-daat-or;result_format=normal"))
    assert many.count() == 1
    assert toolkit.run(index, queries, config.override("query_algorithm=default;use_positions=true")).count() == 1
    with pytest.raises(ValueError):
        toolkit.layer(index, str(tmp_path / "x"), config.override("num_layers=3"))


def test_working_tables_are_dropped_and_made_anew(spark, sf_dir):
    from lexweave import queries, session

    first = queries.QUERIES["stored_term"](spark, sf_dir).count()
    path = session.work_path(spark, "x")
    session.cut(spark.range(3), "some")
    session.drop_working_tables(spark)
    import os

    assert not os.path.exists(os.path.dirname(path).removeprefix("file://"))
    assert queries.QUERIES["stored_term"](spark, sf_dir).count() == first > 0


def test_a_cluster_must_name_a_shared_folder(spark):
    from types import SimpleNamespace

    from lexweave import session

    conf = SimpleNamespace(get=lambda k, d=None: None)
    with pytest.raises(RuntimeError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", applicationId="a")))
    named = SimpleNamespace(get=lambda k, d=None: "hdfs:///shared/")
    assert session.shared_dir(SimpleNamespace(conf=named)) == "hdfs:///shared"
    assert session.small(spark.range(3), 10, 8, 80) is not None
