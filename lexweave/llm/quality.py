"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of text features. The weights are learnt
from preference pairs (a document labelled good, one labelled bad) by logistic
loss on the difference of their features, as in the Bradley-Terry model, where
the odds that one is preferred are the exponential of the score difference. A
document is kept when its score reaches a quantile of all scores.

The level of the quantile is the share of bad documents among the labelled ones,
lowered where that would reject labelled good documents: the threshold is never
above the ``guard`` quantile of the labelled good documents' scores.

Defined results: a null or empty text has all features 0 and is judged like any
other; a very long text is measured whole; a score that ties with the threshold is
kept; rows without id and repeated rows are judged by their text; labels that
are null, or that name no document, are ignored; where one of the two classes has
no labelled document, nothing can be learnt and every document is kept with score
0; an empty table gives an empty result; other columns pass through ``keep``
untouched, whatever their names.

Bounded on purpose, as a parameter: at most ``max_labelled`` labelled documents
of each class are fitted on (those with the smallest hash of their id). Features,
scores and the quantile cover every document, the guard every labelled good one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lexweave.llm._words import buffers, slices, trim, words
from lexweave.session import cut, ship

MAX_LABELLED = 4000
GUARD = 0.005
#: Pairs that each labelled bad document enters.
PAIRS = 16
RIDGE = 1.0
#: Relative rank error of the quantile is one over this.
ACCURACY = 100_000
NAMES = ("log_words", "word_length", "long_words", "distinct_words", "repeats", "upper", "digits", "symbols", "symbol_runs", "commas_stops", "pipes", "lines", "short_share", "top_word")

_KIND = np.zeros(256, np.uint8)
_KIND[ord("A") : ord("Z") + 1] = 1
_KIND[ord("0") : ord("9") + 1] = 2
for _c in b"#$%&*+/<=>@[\\]^_`{}~!":
    _KIND[_c] = 3
for _c in b".,;:'\"?-()":
    _KIND[_c] = 4
_KIND[ord("|")] = 5
_KIND[ord("\n")] = 6


def features(texts: pa.Array) -> np.ndarray:
    """One row of features for each text, whole texts."""
    out = np.zeros((len(texts), len(NAMES)))
    for i, j in slices(texts):
        out[i:j] = _features(texts[i:j])
    trim()
    return out


def _features(texts: pa.Array) -> np.ndarray:
    n = len(texts)
    out = np.zeros((n, len(NAMES)))
    low = words(texts)
    data, offsets = buffers(texts)
    kind = _KIND[data]
    size = np.diff(offsets)
    some = size > 0
    at = offsets[:-1][some]

    def total(mask: np.ndarray) -> np.ndarray:
        r = np.zeros(n)
        if some.any():
            r[some] = np.add.reduceat(mask.view(np.uint8), at, dtype=np.int64)
        return r

    count = np.diff(low.first).astype(float)
    length = (low.end - low.start).astype(float)
    csum = lambda x: np.concatenate([[0.0], np.cumsum(x)])[low.first]
    letters = np.diff(csum(length))
    w, chars = np.maximum(count, 1), np.maximum(size, 1)
    symbol = kind == 3
    out[:, 0] = np.log1p(count)
    out[:, 1] = letters / w
    out[:, 2] = np.diff(csum(length > 14)) / w
    same = np.zeros(len(low.hash), bool)
    same[1:] = (low.hash[1:] == low.hash[:-1]) & (low.doc[1:] == low.doc[:-1])
    out[:, 4] = np.diff(csum(same)) / w
    out[:, 5] = total(kind == 1) / chars
    out[:, 6] = total(kind == 2) / chars
    out[:, 7] = total(symbol) / chars
    doubled = np.zeros(len(data), bool)
    doubled[1:] = symbol[1:] & (data[1:] == data[:-1])
    doubled[at] = False
    out[:, 8] = total(doubled) / w
    out[:, 9] = total(kind == 4) / w
    out[:, 10] = total(kind == 5) / w
    out[:, 11] = total(kind == 6) / w
    out[:, 12] = np.diff(csum(length <= 3)) / w
    for i in np.flatnonzero(count > 0).tolist():
        _, c = np.unique(low.hash[low.first[i] : low.first[i + 1]], return_counts=True)
        out[i, 3] = len(c) / np.sqrt(count[i])
        out[i, 13] = c.max() / count[i]
    return out


def _sample(labelled: DataFrame, good: int, most: int) -> np.ndarray:
    rows = labelled.filter(F.col("quality") == good).orderBy(F.xxhash64("doc_id"), "doc_id", "f").limit(most)
    return np.array([r.f for r in rows.select("f").collect()], float).reshape(-1, len(NAMES))


def learn(better: np.ndarray, worse: np.ndarray, ridge: float = RIDGE, rounds: int = 50) -> np.ndarray:
    """Weights by Newton steps on sum(log(1 + exp(-(better - worse) w))) + ridge |w|^2 / 2."""
    d = better - worse
    w = np.zeros(d.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -35, 35)))
        step = np.linalg.solve((d.T * (p * (1 - p))) @ d + ridge * np.eye(len(w)), d.T @ p - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Weights on standardised features, and the least score that is kept."""

    def __init__(self, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray, threshold: float):
        self.weights, self.mean, self.scale, self.threshold = weights, mean, scale, threshold

    def of(self, f: np.ndarray) -> np.ndarray:
        return np.round(np.clip((f - self.mean) / self.scale, -8, 8) @ self.weights, 9)

    def column(self, text: Column) -> Column:
        """The score as a column expression: one Arrow call per batch, no join."""
        weights, mean, scale = self.weights, self.mean, self.scale

        @arrow_udf("double")
        def score(t: pa.Array) -> pa.Array:
            return pa.array(np.round(np.clip((features(t) - mean) / scale, -8, 8) @ weights, 9))

        return score(text)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, guard: float = GUARD) -> tuple[Model, DataFrame]:
    """The model, and a written table (doc_id, score) of all documents."""
    spark = docs.sparkSession
    ship(spark)

    @arrow_udf("array<double>")
    def feature_column(t: pa.Array) -> pa.Array:
        f = features(t)
        return pa.ListArray.from_arrays(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32), pa.array(f.ravel()))

    table = cut(docs.select("doc_id", feature_column("text").alias("f")), "quality-features")
    known = labels.filter("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).dropDuplicates()
    labelled = cut(table.join(known, "doc_id"), "quality-labelled")
    shares = {r.quality: r.n for r in labelled.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    good, bad = _sample(labelled, 1, max_labelled), _sample(labelled, 0, max_labelled)
    k = len(NAMES)
    if not len(good) or not len(bad):
        model = Model(np.zeros(k), np.zeros(k), np.ones(k), -np.inf)
    else:
        both = np.concatenate([good, bad])
        model = Model(np.zeros(k), both.mean(0), np.maximum(both.std(0), 1e-6), -np.inf)
        g, b = (np.clip((x - model.mean) / model.scale, -8, 8) for x in (good, bad))
        pick = np.random.default_rng(7).integers(0, len(g), (max(len(b), -(-len(g) // PAIRS)), PAIRS))
        model.weights = learn(g[pick.ravel()], b[np.repeat(np.arange(len(pick)) % len(b), PAIRS)])
    weights, mean, scale = model.weights, model.mean, model.scale

    @arrow_udf("double")
    def score(f: pa.Array) -> pa.Array:
        x = f.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return pa.array(np.round(np.clip((x - mean) / scale, -8, 8) @ weights, 9))

    scores = table.select("doc_id", score("f").alias("score"))
    if len(good) and len(bad):
        level = shares[0] / (shares[0] + shares[1])
        quantile = lambda rows, q: rows.agg(F.percentile_approx(score("f"), F.lit(q), F.lit(ACCURACY))).first()[0]
        model.threshold = float(min(quantile(table, level), quantile(labelled.filter("quality = 1"), guard)))
    return model, scores


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that reach the threshold, with the columns they came with."""
    model, _ = fit(docs, labels, **options)
    return docs.filter(model.column(docs["text"]) >= F.lit(model.threshold))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over the whole documents table: (doc_id, score, threshold, kept)."""
    model, scores = fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.select("doc_id", "score", F.lit(model.threshold).alias("threshold"), (F.col("score") >= model.threshold).alias("kept"))
