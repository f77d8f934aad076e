import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.functions import codecs


@pytest.mark.parametrize("name", sorted(codecs.CODECS))
@settings(max_examples=60, deadline=None)
@given(values=st.one_of(st.lists(st.integers(0, 300), min_size=1, max_size=300), st.lists(st.integers(0, codecs.LIMIT - 1), min_size=1, max_size=140)))
def test_round_trip(name, values):
    if name in ("rice", "turbo-rice") and max(values) > 1000 * (sum(values) / len(values) + 1):
        values = [v % 5000 for v in values]
    assert codecs.decode(name, codecs.encode(name, values), len(values)).tolist() == values


@pytest.mark.parametrize("name", sorted(codecs.CODECS))
@pytest.mark.parametrize("size", [1, 31, 32, 64, 95, 96, 127, 128, 129, 256, 1000])
def test_growing_ranges(name, size):
    rng = np.random.default_rng(size)
    for top in (1, 2, 129, 1025, 70_000, codecs.LIMIT):
        v = rng.integers(0, top, size)
        assert (codecs.decode(name, codecs.encode(name, v), size) == v).all()


@pytest.mark.parametrize("name", sorted(codecs.CODECS))
def test_zeros_equal_values_and_an_outlier(name):
    for v in ([0] * 128, [7] * 128, [0] * 100 + [100_000] + [0] * 27, [codecs.LIMIT - 1] * 3, list((1, 0) * 32)):
        assert codecs.decode(name, codecs.encode(name, v), len(v)).tolist() == v
    assert codecs.demo(name)["same"]


def test_dense_words():
    assert len(codecs.encode("s9", [1] * 28)) == 1
    assert len(codecs.encode("s16", [3] * 7 + [1] * 14)) == 1
    assert len(codecs.encode("s16", [2] * 14)) == 1
    with pytest.raises(ValueError):
        codecs.encode("s9", [codecs.LIMIT])


@pytest.mark.parametrize("text", ["s16", "vbyte", "pfor:128:s16:96", "turbo-rice:128:rice:96"])
@pytest.mark.parametrize("n", [0, 1, 95, 96, 127, 128, 129, 300])
def test_policies(text, n):
    p = codecs.Policy.parse(text, "doc_id")
    v = np.random.default_rng(n).integers(0, 500, n)
    assert (p.decode(p.encode(v), n) == v).all()


@pytest.mark.parametrize("text", ["pfor", "nope", "s9:128:s16:96", "pfor:128:turbo-rice:96", "pfor:0:s9:1", "pfor:64:s9:1", "a:b"])
def test_bad_policies(text):
    with pytest.raises(ValueError):
        codecs.Policy.parse(text, "doc_id")


def test_sizes_equal_encoded_lengths(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    rows = [(i, rng.integers(0, top, n).tolist()) for i, (top, n) in enumerate((t, n) for t in (1, 2, 100, 30_000, 2_000_000, codecs.LIMIT) for n in (1, 31, 128))]
    df = spark.createDataFrame(rows, "i long, v array<bigint>")
    names = ["null", "vbyte", "rice", "turbo-rice"]
    for r in df.select("v", *[codecs.size_of(n, F.col("v")).alias(n) for n in names]).collect():
        assert [r[n] for n in names] == [len(codecs.encode(n, r.v)) for n in names]


def test_chunks_of_gaps_go_on_over_ranges_and_batches(spark, tmp_path):
    from lexweave.operators import ranks

    ids = {"all": list(range(3, 4000, 2)), "one": [7], "z": list(range(0, 512 * 9, 9)), **{f"t{k}": list(range(k, 900, k)) for k in range(1, 30)}}
    want = {}
    for t, docs in ids.items():
        gaps = [b - a for a, b in zip([0, *docs], docs)]
        want |= {(t, i // 128): gaps[i : i + 128] for i in range(0, len(gaps), 128)}
    spark.createDataFrame([(t, i) for t, docs in ids.items() for i in reversed(docs)], "term string, doc_id int").write.parquet(str(tmp_path / "p"))
    rows = spark.read.parquet(str(tmp_path / "p"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        for parts, batch in ((1, 100), (1, 10_000), (4, 128), (13, 33), (60, 1)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = ranks.chunked(rows, "term", "doc_id", 128).collect()
            assert {(r.term, r.chunk_no): r.v for r in got} == want and len(got) == len(want)
        assert ranks.chunked(rows.limit(0), "term", "doc_id", 128).count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_sizes_and_checksums_are_counted_a_batch_at_once(spark):
    """Neither goes through Spark's lambdas, which cost microseconds a value."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, [5, 1]), (2, []), (3, None), (4, [1 << 27] * 200), (5, [0])], "i long, v array<bigint>")
    out = df.select("i", *[codecs.size_of(n, F.col("v")).alias(n.replace("-", "_")) for n in codecs.CLOSED], codecs.checksum(F.col("v")).alias("sum"))
    assert "lambda" not in out._jdf.queryExecution().toString()
    want = 0
    for _ in range(200):
        want = (want * 31 + (1 << 27)) % 1000003
    assert {r.i: r.sum for r in out.collect()} == {1: 156, 2: 0, 3: None, 4: want, 5: 0}
    assert {r.i: (r.null, r.vbyte, r.rice, r.turbo_rice) for r in out.filter("i <> 4").collect()} == {1: (2, 1, 2, 3), 2: (0, 0, 0, 0), 3: (None,) * 4, 5: (1, 1, 2, 2)}
    with pytest.raises(ValueError):
        codecs.size_of("s9", F.col("v"))


def test_rice_of_many_arrays_is_that_of_each(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    arrays = [rng.integers(0, top, n).astype(np.int64) for top in (1, 2, 100, 70_000, codecs.LIMIT) for n in (0, 1, 2, 31, 128, 300)]
    arrays += [np.array(x, np.int64) for x in ([0] * 128, [codecs.LIMIT - 1] * 3, [0] * 100 + [100_000])]
    v, n = np.concatenate(arrays), np.array([len(a) for a in arrays])
    words, many = codecs.rice_encode_many(v, n)
    each = [codecs.encode("rice", a) for a in arrays]
    assert many.tolist() == [len(w) for w in each] and (words == np.concatenate(each)).all()
    assert (codecs.rice_decode_many(words, many, n) == v).all()
    df = spark.createDataFrame([(1, [5, 1]), (2, []), (3, None), (4, [9] * 200)], "i long, v array<bigint>")
    back = codecs.decoded("rice", codecs.encoded("rice", F.col("v")), F.size("v"))
    assert {r.i: r.b for r in df.select("i", back.alias("b")).collect()} == {1: [5, 1], 2: [], 3: None, 4: [9] * 200}
