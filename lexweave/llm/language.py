"""Language identification by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior over the known languages:

* the text: naive Bayes over hashed byte trigrams of the lower-cased letters,
  tempered, as overlapping trigrams of one text are no independent witnesses;
* the declared markup language, by how often texts of each language declare it;
* the address suffix (last label of the host), in the same way;
* the host, by a prior that is smoothed hierarchically: a host's counts lean on
  its domain's, and a domain's on those of the whole corpus.

The last three are counted by grouped aggregation over all rows whose text is like
a known language: each counts for every language by the posterior of its text alone,
so that short and mixed texts tell what they know. A row is accepted unless its text
has no letters, is unlike every known language, or leaves the posterior below
``MIN_CONFIDENCE``; its language is then ``und``.

Defined results: a null or empty text has no letters and is rejected; a very long
text is read whole; null or unknown declarations, suffixes and hosts are no evidence; a null id and repeated
rows are judged like any other row; of two languages that tie the first by name
wins; where no row names a language nothing can be learnt and every row with
letters is accepted as ``und``; an empty table gives an empty result; other
columns pass through ``keep`` untouched, whatever their names.

Bounded on purpose, as a parameter: the trigram model is fitted on at most
``max_labelled`` rows of each language, those with the smallest hash of their id.
Counts, priors and decisions cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from lexweave.llm._words import buffers, lean, slices, trim
from lexweave.session import cut, ship, small

MAX_LABELLED = 1000
MIN_CONFIDENCE = 0.5
#: Trigrams of a text count as this many independent ones at most, each at a third.
EFFECTIVE = 600
#: Weight of the parent's distribution, in rows.
LEAN = 20.0
#: A text is unlike all languages at so many nats a trigram below the usual, with so many usual ones added to it.
UNLIKE, USUAL = 1.5, 16
#: Parts in which a row's posteriors are counted: whole numbers, so that sums don't depend on their order.
PARTS = 10_000
BITS = 16

_LETTER = np.full(256, 32, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTER[128:] = np.arange(128, 256)


def trigrams(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: first text, last text + 1, trigram codes, offsets of the texts in them.

    A code counts where its middle byte is a letter; the rest have the code 2**BITS.
    """
    for i, j in slices(texts, 2 << 20):
        data, off = buffers(pc.utf8_lower(texts[i:j]))
        part = _LETTER[data]
        wide = np.full(len(part) + 2, 32, np.uint8)
        wide[1:-1] = part
        left, mid, right = wide[:-2].astype(np.uint32), wide[1:-1].astype(np.uint32), wide[2:].astype(np.uint32)
        inner = off[(off > 0) & (off < len(part))]
        left[inner], right[inner - 1] = 32, 32
        code = ((left << np.uint32(16)) | (mid << np.uint32(8)) | right) * np.uint32(2654435761)
        code >>= np.uint32(32 - BITS)
        code[mid == 32] = 1 << BITS
        yield i, j, code, off


def _sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1)
    some = np.diff(off) > 0
    if some.any():
        out[some] = np.add.reduceat(values, off[:-1][some], dtype=np.float64)
    return out


def likelihoods(texts: pa.Array, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed log likelihoods (texts x languages) and trigrams counted, whole texts."""
    ll, count = np.zeros((len(texts), len(tables))), np.zeros(len(texts))
    for i, j, code, off in trigrams(texts):
        count[i:j] = _sums(code < (1 << BITS), off)
        for k, t in enumerate(tables):
            ll[i:j, k] = _sums(t[code], off)
    return np.round(ll, 4), count


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        names = np.array(b.column(0).to_pylist(), object)
        for i, j, code, off in trigrams(b.column(1)):
            for k in range(i, j):
                c = code[off[k - i] : off[k - i + 1]]
                t = total.setdefault(names[k], np.zeros(1 << BITS, np.int64))
                t += np.bincount(c, minlength=(1 << BITS) + 1)[: 1 << BITS]
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([t.tobytes() for t in total.values()])], ["lang", "counts"])


VERDICT = "struct<lang:string,confidence:double,accepted:boolean>"


class Model:
    """Trigram tables of the known languages, ``usual`` nats a trigram, and the evidence tables."""

    def __init__(self, langs: list[str], tables: np.ndarray, usual: np.ndarray):
        self.langs, self.tables, self.usual = langs, tables, usual
        self.evidence: dict[str, DataFrame] = {}
        self.rows: dict[str, int] = {}

    def _score(self, t: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tempered log likelihoods, trigrams, and whether the text is like some known language."""
        ll, n = likelihoods(t, self.tables)
        if len(self.langs):
            near = ((ll + USUAL * self.usual) / (n + USUAL)[:, None] >= self.usual - UNLIKE).any(1)
        else:
            near = np.ones(len(n), bool)
        return np.round(ll / 3 * np.minimum(1, EFFECTIVE / np.maximum(n, 1))[:, None], 6), n, near

    def shares(self, scored: Column) -> Column:
        """Posterior of each language by the text alone, in whole PARTS."""

        @arrow_udf("array<bigint>")
        def share(s: pa.Array) -> pa.Array:
            ll = s.field("ll").flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1)
            p = np.exp(ll - ll.max(1, keepdims=True))
            p = np.rint(p / p.sum(1, keepdims=True) * PARTS).astype(np.int64)
            return pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))

        return share(scored)

    def _fuse(self, total: np.ndarray, n: np.ndarray, near: np.ndarray, logs: tuple[pa.Array, ...]) -> pa.Array:
        langs, names = self.langs, ["lang", "confidence", "accepted"]
        if not langs:
            return pa.StructArray.from_arrays([pa.array(["und"] * len(n), pa.string()), pa.array(np.zeros(len(n))), pa.array(n > 0)], names)
        total = total.copy()
        for r in logs:
            known = ~np.asarray(r.is_null())
            if known.any():
                total[known] += r.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))
        total -= total.max(1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(1, keepdims=True)
        best = np.array(langs, object)[p.argmax(1)]
        sure = np.round(p.max(1), 6)
        ok = (n > 0) & near & (sure >= MIN_CONFIDENCE)
        best[~ok] = "und"
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(sure), pa.array(ok)], names)

    def plain(self) -> Model:
        """The model without its evidence tables, as workers get it."""
        return Model(self.langs, self.tables, self.usual)

    def column(self, text: Column) -> Column:
        """Struct (ll: tempered log likelihoods, n: trigrams, near: like some known language)."""
        model, k = self.plain(), len(self.langs)

        @arrow_udf("struct<ll:array<double>,n:bigint,near:boolean>")
        def score(t: pa.Array) -> pa.Array:
            ll, n, near = model._score(t)
            lists = pa.ListArray.from_arrays(np.arange(0, len(n) * k + 1, k, dtype=np.int32) if k else np.zeros(len(n) + 1, np.int32), pa.array(ll.ravel()))
            trim()
            return pa.StructArray.from_arrays([lists, pa.array(n.astype(np.int64)), pa.array(near)], ["ll", "n", "near"])

        return score(text)

    def verdict(self, scored: Column, *more: Column) -> Column:
        """Struct (lang, confidence, accepted) from the text's struct and log evidence arrays that may be null."""
        model = self.plain()

        @arrow_udf(VERDICT)
        def fuse(s: pa.Array, *rest: pa.Array) -> pa.Array:
            ll = s.field("ll").flatten().to_numpy(zero_copy_only=False).reshape(len(s), len(model.langs))
            return model._fuse(ll, s.field("n").to_numpy(zero_copy_only=False), s.field("near").to_numpy(zero_copy_only=False).astype(bool), rest)

        return fuse(scored, *more)

    def verdict_of(self, text: Column, *more: Column) -> Column:
        """The same from the text itself, in one call."""
        model = self.plain()

        @arrow_udf(VERDICT)
        def both(t: pa.Array, *rest: pa.Array) -> pa.Array:
            out = model._fuse(*model._score(t), rest)
            trim()
            return out

        return both(text, *more)


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """The trigram model from rows (id, lang, text)."""
    spark = labelled.sparkSession
    ship(spark)
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = labelled.filter("lang is not null and id is not null").select("id", "lang").withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= max_labelled).select("id", "lang")
    ids = cut(ids, "language-sample")
    some = labelled.join(small(ids, ids.count(), 48), ["id", "lang"]).select("lang", F.coalesce("text", F.lit("")).alias("text"))
    rows = some.repartition(8).mapInArrow(lean(_counts), "lang string, counts binary").collect()
    total: dict[str, np.ndarray] = {}
    for r in rows:
        total[r.lang] = total.get(r.lang, 0) + np.frombuffer(bytes(r.counts), np.int64)
    langs = sorted(k for k, v in total.items() if v.sum() > 0)
    tables = np.zeros((len(langs), (1 << BITS) + 1), np.float32)
    usual = np.zeros(len(langs))
    for i, k in enumerate(langs):
        p = (total[k] + 0.05) / (total[k].sum() + 0.05 * (1 << BITS))
        tables[i, :-1] = np.log(p)
        usual[i] = (total[k] * np.log(p)).sum() / total[k].sum()
    return Model(langs, tables, usual)


def _logs(counts: DataFrame, langs: list[str], base: np.ndarray, lean: float) -> Column:
    """log((count + lean * base) / (all + lean)) for each language."""
    n = sum(F.col(f"c{i}") for i in range(len(langs)))
    return F.array(*[F.log((F.col(f"c{i}") + F.lit(lean * float(base[i]))) / (n + F.lit(lean))) for i in range(len(langs))])


def gather(model: Model, rows: DataFrame) -> None:
    """Count the evidence of rows (declared, suffix, domain, host, scored) into tables of log evidence."""
    langs = model.langs
    if not langs:
        return
    plain = rows.filter(F.col("scored.near") & (F.col("scored.n") > 0)).withColumn("p", model.shares(F.col("scored")))
    counts = plain.groupBy("declared", "suffix", "domain", "host").agg(*[F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(len(langs))])
    counts = cut(counts.select("declared", "suffix", "domain", "host", *[(F.col(f"c{i}") / PARTS).alias(f"c{i}") for i in range(len(langs))]), "language-counts")
    totals = counts.agg(*[F.round(F.coalesce(F.sum(f"c{i}"), F.lit(0.0)), 4).alias(f"c{i}") for i in range(len(langs))]).first()
    every = np.array(list(totals), float)
    base = (every + 1) / (every.sum() + len(langs))
    c = [F.round(F.sum(f"c{i}"), 4).alias(f"c{i}") for i in range(len(langs))]
    for key in ("declared", "suffix"):
        t = counts.filter(F.col(key).isNotNull()).groupBy(key).agg(*c)
        kinds = t.count() + 1
        # P(value | language): counts down the columns, one more of each value
        t = t.select(key, F.array(*[F.log((F.col(f"c{i}") + 1.0) / F.lit(float(every[i]) + kinds)) for i in range(len(langs))]).alias(f"{key}_log"))
        model.evidence[key] = cut(t, f"language-{key}")
        model.rows[key] = kinds
    by_domain = counts.filter("domain is not null").groupBy("domain").agg(*c)
    by_domain = by_domain.select("domain", F.transform(_logs(by_domain, langs, base, LEAN), F.exp).alias("parent"))
    by_host = counts.filter("host is not null").groupBy("domain", "host").agg(*c).join(by_domain, "domain", "left")
    n = sum(F.col(f"c{i}") for i in range(len(langs)))
    logs = F.array(*[F.log((F.col(f"c{i}") + LEAN * F.coalesce(F.col("parent")[i], F.lit(float(base[i])))) / (n + LEAN)) for i in range(len(langs))])
    # two spellings of a host's domain can't differ, as the domain is cut from the host
    model.evidence["host"] = cut(by_host.groupBy("host").agg(F.first(logs).alias("host_log")), "language-host")
    model.rows["host"] = model.evidence["host"].count()


def judge(model: Model, rows: DataFrame) -> DataFrame:
    """Adds the struct ``verdict`` to rows (declared, suffix, host, ...) with their text's struct ``scored``, or the text in ``row.text``."""
    logs = []
    for key in ("declared", "suffix", "host"):
        if key in model.evidence:
            rows = rows.join(small(model.evidence[key], model.rows[key], 64 + 8 * len(model.langs)), key, "left")
            logs.append(F.col(f"{key}_log"))
    return rows.withColumn("verdict", model.verdict(F.col("scored"), *logs) if "scored" in rows.columns else model.verdict_of(F.col("row.text"), *logs))


def _code(c: Column) -> Column:
    """Main part of a language tag, lower case; null where there is none."""
    code = F.regexp_extract(F.lower(c), "^[ ]*([a-z]{2,8})", 1)
    return F.when(code != "", code)


def _host_parts(host: Column) -> list[Column]:
    dotted = host.contains(".")
    return [F.when(dotted, F.regexp_extract(host, r"([^.]+)$", 1)).alias("suffix"), F.when(dotted, F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"), host.alias("host")]


def of_documents(docs: DataFrame, model: Model) -> DataFrame:
    return docs.select("doc_id", F.lit(None).cast("bigint").alias("page_id"), _code(F.col("lang")).alias("declared"), *_host_parts(F.col("source")), model.column(F.col("text")).alias("scored"))


def of_pages(pages: DataFrame, model: Model) -> DataFrame:
    text = F.regexp_replace("html", r"(?is)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1)
    host = F.when(host != "", host)
    return pages.select(F.lit(None).cast("bigint").alias("doc_id"), "page_id", _code(F.regexp_extract("html", r"(?is)<html[^>]*\blang=[\"']?([^\"'> ]+)", 1)).alias("declared"), *_host_parts(host), model.column(text).alias("scored"))


def _labelled(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("id"), _code(F.col("lang")).alias("lang"), "text")


def keep(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that are accepted, with the columns they came with."""
    model = train(_labelled(docs), max_labelled)
    gather(model, cut(of_documents(docs, model), "language-scores"))
    keys = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _code(docs["lang"]).alias("declared"), *_host_parts(docs["source"]))
    return judge(model, keys).filter("verdict.accepted").select("row.*")


def identify(docs: DataFrame, pages: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Rows (doc_id, page_id, lang, confidence, accepted) of documents and pages; the other id is null."""
    model = train(_labelled(docs), max_labelled)
    rows = cut(of_documents(docs, model).unionByName(of_pages(pages, model)), "language-scores")
    gather(model, rows)
    return judge(model, rows).select("doc_id", "page_id", "verdict.lang", "verdict.confidence", "verdict.accepted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10 over the whole documents and pages tables."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/pages.parquet"))
