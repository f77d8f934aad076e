import math

import numpy as np
import pyarrow as pa

from lexweave.llm import quality
from tests.llm import brute


def test_features_by_definition():
    text = "Hello hello WORLD 42 | $$ a,b\nx"
    f = dict(zip(quality.NAMES, quality.features(pa.array([text]))[0]))
    w = ["hello", "hello", "world", "42", "a", "b", "x"]
    assert np.isclose(f["log_words"], np.log1p(len(w)))
    assert np.isclose(f["word_length"], sum(map(len, w)) / len(w))
    assert np.isclose(f["repeats"], 1 / 7) and np.isclose(f["top_word"], 2 / 7)
    assert np.isclose(f["distinct_words"], 6 / np.sqrt(7))
    assert np.isclose(f["upper"], 6 / len(text)) and np.isclose(f["pipes"], 1 / 7) and np.isclose(f["lines"], 1 / 7)


def plain_features(text):
    """The features of one text by loops over its characters and words."""
    text = text or ""
    raw, w = text.encode(), brute.words(text)
    size = [len(x.encode()) for x in w]
    n, chars = max(len(w), 1), max(len(raw), 1)
    count = lambda kinds: sum(chr(b) in kinds for b in raw)
    symbols = "#$%&*+/<=>@[\\]^_`{}~!"
    upper, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    tally = {x: w.count(x) for x in set(w)}
    return [
        math.log1p(len(w)), sum(size) / n, sum(k > 14 for k in size) / n, len(tally) / math.sqrt(n), sum(a == b for a, b in zip(w, w[1:])) / n,
        count(upper) / chars, count(digits) / chars, count(symbols) / chars, sum(a == b and chr(a) in symbols for a, b in zip(raw, raw[1:])) / n,
        count(".,;:'\"?-()") / n, count("|") / n, count("\n") / n, sum(k <= 3 for k in size) / n, max(tally.values(), default=0) / n,
    ]


def plain_model(spark, docs, labels):
    """Scores of all texts and the threshold: pairs, pairwise loss by plain descent, quantile and guard. docs: (id, text); labels: {id: quality}."""
    order = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in labels], "i long").selectExpr("i", "xxhash64(i)").collect()}
    f = {i: np.array(plain_features(t)) for i, t in docs}
    ids = lambda q: sorted((i for i in f if labels.get(i) == q), key=lambda i: (order[i], i))
    good, bad = ids(1), ids(0)
    fit = np.array([f[i] for i in good[: quality.MAX_LABELLED] + bad[: quality.MAX_LABELLED]])
    mean, scale = fit.mean(0), np.maximum(fit.std(0), 1e-6)
    z = {i: np.clip((x - mean) / scale, -8, 8) for i, x in f.items()}
    rows = max(len(bad), math.ceil(len(good) / quality.PAIRS))
    pick = np.random.default_rng(7).integers(0, len(good), (rows, quality.PAIRS))
    d = np.array([z[good[g]] - z[bad[r % len(bad)]] for r in range(rows) for g in pick[r]])
    w = np.zeros(d.shape[1])
    step = 1 / (0.25 * np.linalg.norm(d, 2) ** 2 + quality.RIDGE)
    last = w
    for k in range(60_000):  # accelerated descent on the convex loss
        y = w + k / (k + 3) * (w - last)
        grad = quality.RIDGE * y - d.T @ (1 / (1 + np.exp(d @ y)))
        last, w = w, y - step * grad
        if np.abs(grad).max() < 1e-9:
            break
    score = {i: float(x @ w) for i, x in z.items()}
    at = lambda v, q: sorted(v)[max(math.ceil(q * len(v)) - 1, 0)]
    level = len(bad) / (len(good) + len(bad))
    return score, min(at(score.values(), level), at([score[i] for i in good], quality.GUARD))


def test_features_scores_threshold_and_verdicts_equal_plain_python(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got_f = quality.features(pa.array([t for _, t in docs]))
    for (_, t), row in zip(docs, got_f):
        assert np.allclose(plain_features(t), row)
    score, threshold = plain_model(spark, docs, {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()})
    got = quality.query(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        assert abs(r.score - score[r.doc_id]) < 1e-4 and abs(r.threshold - threshold) < 1e-4
        assert r.kept == (r.score >= r.threshold)
        assert r.kept == (score[r.doc_id] >= threshold) or abs(score[r.doc_id] - threshold) < 2e-4


def test_features_don_t_depend_on_the_batch():
    texts = ["a b c", "", None, "é " * 2_000_000, "$$$ 12 $", "$ 1", "#", "#"]
    together = quality.features(pa.array(texts))
    for t, row in zip(texts, together):
        assert np.allclose(quality.features(pa.array([t], pa.string()))[0], row)
    assert not together[1].any() and not together[2].any()


def test_learning_follows_the_pairwise_loss():
    rng = np.random.default_rng(0)
    better, worse = rng.normal(0.5, 1, (400, 3)), rng.normal(-0.5, 1, (400, 3))
    w = quality.learn(better, worse)
    loss = lambda v: np.log1p(np.exp(-(better - worse) @ v)).sum() + quality.RIDGE * (v @ v) / 2
    assert all(loss(w) <= loss(w + d) for d in rng.normal(0, 0.01, (50, 3)))


def test_held_out_accuracy_and_clean_documents(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model, scores = quality.fit(docs, labels.filter("doc_id % 2 = 0"))
    held = labels.filter("doc_id % 2 = 1").join(scores, "doc_id").select("quality", "score").toPandas()
    good, bad = held.score[held.quality == 1].to_numpy(), held.score[held.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    kept = quality.keep(docs, labels)
    truth = {r.doc_id for r in labels.filter("quality = 1").join(docs, "doc_id").collect()}
    assert len(truth - {r.doc_id for r in kept.collect()}) <= 0.01 * len(truth) + 1


def test_the_guard_covers_all_labelled_good_documents(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = labels.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality", "toxic")  # classes that overlap: the guard is the smaller value
    model, scores = quality.fit(docs, mixed, max_labelled=8, guard=0.2)
    good = sorted(r.score for r in scores.join(mixed.filter("quality = 1").select("doc_id"), "doc_id").collect())
    assert len(good) > 20
    assert model.threshold == good[int(np.ceil(0.2 * len(good))) - 1]


def test_edges(spark):
    docs = spark.createDataFrame([(1, "good text here", 5), (1, "good text here", 5), (2, None, 6), (3, "", 7), (None, "$$ || 00", 8)], "doc_id long, text string, score int")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality long, toxic long")
    for rows in ([], [(1, 1, 0)], [(None, 1, 0), (1, None, 0), (77, 0, 0)]):
        kept = quality.keep(docs, labels(rows))
        assert kept.columns == docs.columns and kept.count() == 5
    assert quality.keep(docs.limit(0), labels([(1, 1, 0), (3, 0, 0)])).count() == 0
    assert quality.keep(docs, labels([(1, 1, 0), (3, 0, 0)])).filter("doc_id = 1").count() == 2
