import numpy as np
import pytest

import corpus_pipeline
from lexweave.llm import jaccard, mixing
from tests.llm import brute
from tests.llm.test_decontaminate import want as leaks
from tests.llm.test_language import plain_verdicts
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_quality import plain_model


def survivors(pairs, ids):
    """The smallest id of each connected group."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, _ in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i for i in ids if find(i) == i}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_every_stage_equals_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "ngram_jaccard", "benchmark_decontamination", "source_mixing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        held = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        texts = [(i, r.text) for i, r in held.items()]
        if name == "language_id":
            kept = {i for i, (_, _, ok) in plain_verdicts([(i, r.text, r.lang, r.source) for i, r in held.items()]).items() if ok}
        elif name == "quality_classifier":
            score, threshold = plain_model(spark, texts, {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()})
            kept = {i for i in held if score[i] >= threshold - 1e-6}
        elif name == "ngram_jaccard":
            kept = survivors(brute.jaccard_rows(texts, jaccard.N, jaccard.THRESHOLD), list(held))
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            kept = set(held) - {i for i, *_ in leaks(texts, items)}
        else:
            want = mixed([(i, r.text, r.lang, r.source) for i, r in held.items()], mixing.DOMAINS, mixing.OTHER, mixing.WEIGHTS, mixing.FRACTION, mixing.MAX_EPOCHS, mixing.SEED)
            assert sorted(tuple(r) for r in out.collect()) == want and want
            break
        assert out.columns == columns
        assert rows(out) == sorted((tuple(held[i]) for i in kept), key=str)
        assert kept
        docs = out
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_any_rows(spark, sf_dir, name, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, bucket string, score double"
    long = " ".join(np.random.default_rng(1).permutation([f"wort{i}" for i in range(30_000)]))
    some = [(1, "the dog runs in the garden", "en", "src0", 3, "b", 1.0)] * 2 + [(2, None, None, None, None, None, None), (3, "", "de", "src1", 0, "b", 0.0), (None, "the cat sleeps in the house", "en", "src0", 5, "c", 2.0), (4, long, "de", "src2", 9, "d", 0.0)]
    for rows_ in (some, []):
        out = stage(spark, spark.createDataFrame(rows_, schema), sf_dir)
        assert out.count() <= len(rows_) * 4
        if name != "source_mixing":
            assert out.columns == [c.split()[0] for c in schema.split(", ")]
