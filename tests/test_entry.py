import os
import re

import duckdb
import pytest

import __spark_entry__ as e
from lexweave import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same(spark, con, name, sf_dir):
    df, want = e.queries()[name](spark, sf_dir), con.sql(e.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(repr(plain(list(r))) for r in df.select(columns).collect())
    assert got == sorted(repr(plain(list(r))) for r in want.select(*(f'"{c}"' for c in columns)).fetchall())


@pytest.mark.parametrize("name", ["tokenize_documents", "postings_tf", "daat_or_batch", "daat_and_top_positions", "layers_percentage_4", "html_contexts", "index_diff", "remap_roundtrip_topk", "trec_parse_roundtrip", "warc_parse_roundtrip", "codec_rice_size", "result_trec_format"])
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    same(spark, duck, name, sf_dir)


@pytest.mark.parametrize("name", ["wand", "max_score_chunk_skip", "multi_layered_max_score", "layered_taat", "dual_layered_merge_and", "union_docids", "next_geq", "next_greater_block_score", "layers_exponential_8_low", "stored_layers", "merge_groups", "index_diff_positions", "index_contexts", "dgap_roundtrip"])
def test_queries_of_the_stored_index_equal_their_sql(spark, duck, sf_dir, name):
    same(spark, duck, name, sf_dir)


def test_the_long_logs_hold_every_term(spark, sf_dir):
    terms = {w for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() for w in re.findall("[0-9a-z]+", r.text.lower())}
    assert {r.term for r in e.queries()["next_geq"](spark, sf_dir).collect()} == terms


def test_entry_and_names(spark):
    assert e.entry(spark).columns == ["qid", "rank", "doc_id", "score"]
    assert set(core.QUERIES) - set(core.SQL) == {"taat_layers_read"}
    assert set(e.oracle_sql()) <= set(e.queries())
