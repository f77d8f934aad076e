import gzip
import zlib

import pytest

from lexweave.config import Config, parse_index_name, parse_overrides, parse_pairs
from lexweave.plans import search
from lexweave.sources import collections as col
from lexweave.sources import querylog
from lexweave.streaming import runs

TREC = "<DOC>\n<DOCNO> D-{0} </DOCNO>\n<DOCHDR>\nhttp://x.org/{0}\nHTTP/1.1 200 OK\n</DOCHDR>\n<p>body {0}</p>\n</DOC>\n"
WARC = "WARC/0.18\nWARC-Type: response\nWARC-Target-URI: http://x.org/{0}\nWARC-TREC-ID: D-{0}\nContent-Length: {1}\n\n{2}\n"


def test_trec_bundles_plain_and_compressed(spark, tmp_path):
    (tmp_path / "a.trec").write_text(TREC.format(1) + TREC.format(2))
    (tmp_path / "b.bin").write_bytes(gzip.compress(TREC.format(3).encode()))
    (tmp_path / "c.bin").write_bytes(zlib.compress(TREC.format(4).encode()))
    (tmp_path / "d.trec").write_text("")
    got = col.read_collection(spark, [str(tmp_path / n) for n in ("a.trec", "b.bin", "c.bin", "d.trec")], "trec").orderBy("doc_id").collect()
    assert [(r.doc_id, r.docno, r.url) for r in got] == [(i - 1, f"D-{i}", f"http://x.org/{i}") for i in (1, 2, 3, 4)]
    assert "<p>body 1</p>" in got[0].html


def test_warc_bundles(spark, tmp_path):
    bodies = ["<p>één</p>", "x\n\nWARC/0.18 inside"]
    (tmp_path / "a.warc").write_text(col.WARC_INFO + "".join(WARC.format(i, len(b.encode()), b) for i, b in enumerate(bodies)))
    got = col.read_collection(spark, [str(tmp_path / "a.warc")], "warc").orderBy("doc_id").collect()
    assert [(r.docno, r.url, r.html) for r in got] == [(f"D-{i}", f"http://x.org/{i}", b) for i, b in enumerate(bodies)]


def test_text_files_and_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two")
    assert [r.text for r in col.read_collection(spark, [str(tmp_path / "a.txt")], "text").collect()] == ["one two"]
    assert col.paths_of(" a\n\nb \n") == ["a", "b"]
    with pytest.raises(ValueError):
        col.collection_format("pdf")


def test_query_logs_and_topics(spark):
    lines = spark.createDataFrame([("12:new york",), ("plain words",)], "value string")
    assert [tuple(r) for r in querylog.read_queries(lines).orderBy("qid").collect()] == [(0, "plain words"), (12, "new york")]
    topic = "<top>\n<num> Number: NP601\n<title> Turkey: Iraq's water\n<desc> x\n</top>\n<top>\n<num> Number: 602\n<title> Czech\n</top>"
    assert [tuple(r) for r in querylog.topics(spark.createDataFrame([(topic,)], "value string")).orderBy("qid").collect()] == [(601, "turkey iraq s water"), (602, "czech")]
    raw = spark.createDataFrame([("7:café & bar",), (None,)], "value string")
    assert sorted(str(r[0]) for r in querylog.preprocess(raw).collect()) == ["None", "cafe   bar"]


def test_options():
    c = Config().override("max_number_results=3;include_positions=true;unknown=1;")
    assert (c.max_number_results, c.include_positions) == (3, True)
    assert parse_pairs("a = 1 # x\n# b = 2\nc=d") == {"a": "1", "c": "d"}
    assert parse_overrides("k=v;;x=1") == {"k": "v", "x": "1"}
    assert parse_index_name("index:1.2") == ("index", 1, 2) and parse_index_name("index") == ("index", None, None)
    with pytest.raises(ValueError):
        Config().override({"use_positions": "maybe"})


def test_streamed_runs_equal_the_batch_index(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    runs.append_runs(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination(120)
    grown = runs.load_runs(spark, str(tmp_path / "ix"))
    from lexweave.operators import index as ix

    whole = ix.build(docs)
    assert sorted(map(tuple, grown.stats.collect())) == sorted(map(tuple, whole.stats.collect()))
    terms = search.query_terms(spark.createDataFrame([(1, "the that ertion")], "qid long, query string"))
    assert search.daat_or(grown, terms).collect() == search.daat_or(whole, terms).collect()
