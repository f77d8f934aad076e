"""The inverted index as DataFrames: build, store, look up, merge, remap, dump and compare.

``postings`` carries each document's length beside the frequency. Scoring then
needs no join with the documents, whose number grows with the corpus; urls and
names are joined to the final rows only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import bm25, text
from lexweave.operators.ranks import numbered

CHUNK = 128


@dataclass(frozen=True)
class Index:
    """postings (term, doc_id, tf, doc_len[, positions]), docs (doc_id, docno, url, doc_len)."""

    postings: DataFrame
    docs: DataFrame
    compat_avgdl: bool = False

    @property
    def stats(self) -> DataFrame:
        """One row: n_docs with empty ones, total_len, avgdl (whole number, 1 at least)."""
        length = F.greatest(F.col("doc_len") - 1, F.lit(0)) if self.compat_avgdl else F.col("doc_len")
        s = self.docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("bigint").alias("total_len"), F.coalesce(F.sum(length), F.lit(0)).alias("scored_len"))
        return s.select("n_docs", "total_len", F.greatest(F.lit(1.0), F.floor(F.col("scored_len") / F.greatest(F.col("n_docs"), F.lit(1))).cast("double")).alias("avgdl"))

    @property
    def lexicon(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))

    def lookup(self, terms: DataFrame) -> DataFrame:
        """Postings of the distinct terms of a one-column table."""
        return self.postings.join(terms.toDF("term").distinct(), "term", "left_semi")

    def term(self, term: str) -> DataFrame:
        """One list; on a stored index the filter reaches the scan, whose files are sorted by term."""
        return self.postings.filter(F.col("term") == term)

    def scored(self, postings: DataFrame | None = None) -> DataFrame:
        """Postings with df, idf and the partial score of each."""
        postings = self.postings if postings is None else postings
        return self.scored_with(postings, postings.groupBy("term").agg(F.count("*").alias("df")))

    def scored_with(self, postings: DataFrame, df: DataFrame) -> DataFrame:
        """The same with given document frequencies (term, df)."""
        rows = postings.join(df, "term").crossJoin(F.broadcast(self.stats))  # one row
        rows = rows.withColumn("idf", bm25.idf(F.col("df"), F.col("n_docs")))
        return rows.withColumn("score", bm25.partial(F.col("tf"), F.col("doc_len"), F.col("idf"), F.col("avgdl"))).drop("n_docs", "total_len")

    def save(self, path: str, codec: str = "zstd", partitions: int | None = None) -> None:
        """Write with lists in term order, so that a term's filter skips files and row groups."""
        by = ["term"] if partitions is None else [partitions, "term"]
        self.postings.repartitionByRange(*by).sortWithinPartitions("term", "doc_id").write.option("compression", codec).parquet(f"{path}/postings")
        self.docs.write.option("compression", codec).parquet(f"{path}/docs")

    @staticmethod
    def load(spark: SparkSession, path: str, compat_avgdl: bool = False) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/docs"), compat_avgdl)

    def persist(self, level=None) -> Index:
        """Keep both tables in memory, or at another storage level."""
        keep = (lambda d: d.persist(level)) if level else (lambda d: d.persist())
        return Index(keep(self.postings), keep(self.docs), self.compat_avgdl)


def build(df: DataFrame, key: str = "doc_id", body: str = "text", fmt: str = "text", url: str | None = None, docno: str | None = None, positions: bool = False, terms: DataFrame | None = None) -> Index:
    """Index the rows of a table; ``fmt`` is text or html.

    A document's postings are counted where it is read. With ``terms`` (one column)
    only theirs are kept. Lengths are those of whole documents.
    """
    if fmt not in ("text", "html"):
        raise ValueError(f"unknown format: {fmt!r}")
    plain = F.col(body) if fmt == "text" else text.html_text(F.col(body))
    named = [(F.col(docno) if docno else F.col(key).cast("string")).alias("docno"), (F.col(url) if url else F.lit(None).cast("string")).alias("url")]
    rows = df.filter(F.col(key).isNotNull())
    docs = rows.select(F.col(key).alias("doc_id"), *named, text.token_count(plain).alias("doc_len"))
    postings = text.postings(rows, key, plain, positions)
    if terms is not None:
        postings = postings.join(terms.toDF("term").distinct(), "term", "left_semi")
    return Index(postings, docs)


def context_postings(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows (term, doc_id, tf, positions, contexts) of HTML pages: the tags that are open at each of the first positions."""
    rows = text.html_contexts(pages, key, html)
    places = rows.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.slice(F.array_sort(F.collect_list(F.struct("position", "context"))), 1, text.POSITIONS).alias("p"))
    return places.select("term", "doc_id", "tf", F.col("p.position").alias("positions"), F.col("p.context").alias("contexts"))


def merge(indices: Sequence[Index]) -> Index:
    """Union of indices with distinct documents: one pass, whatever their number."""
    if not indices:
        raise ValueError("nothing to merge")
    union = lambda tables: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return Index(union([i.postings for i in indices]), union([i.docs for i in indices]), indices[0].compat_avgdl)


def merge_groups(spark: SparkSession, listing: str, codec: str = "zstd") -> list[str]:
    """Merge groups of stored indices: one path a line, the last of a group is the output, an empty line ends it."""
    done = []
    for group in (g.split() for g in listing.split("\n\n")):
        if len(group) >= 2:
            merge([Index.load(spark, p) for p in group[:-1]]).save(group[-1], codec)
            done.append(group[-1])
    return done


def overlapping_documents(indices: Sequence[Index]) -> DataFrame:
    """Documents that more than one index has, which a merge would count twice."""
    ids = reduce(DataFrame.unionByName, [i.docs.select("doc_id", F.lit(n).alias("source")) for n, i in enumerate(indices)])
    return ids.groupBy("doc_id").agg(F.countDistinct("source").alias("n")).filter("n > 1")


def remap(index: Index, mapping: DataFrame) -> Index:
    """Replace ids by a mapping (new_doc_id, old_doc_id); documents without a new id are dropped."""
    m = mapping.select(F.col("old_doc_id").alias("doc_id"), "new_doc_id")
    new = lambda d: d.join(m, "doc_id").withColumn("doc_id", F.col("new_doc_id")).drop("new_doc_id")
    return Index(new(index.postings).select(index.postings.columns), new(index.docs).select(index.docs.columns), index.compat_avgdl)


def url_sorted_mapping(df: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Rows (new_doc_id, old_doc_id, url): ids in byte order of the addresses without scheme.

    No single task holds all rows; see ``ranks``.
    """
    rows = df.select(F.col(key).cast("bigint").alias("old_doc_id"), text.strip_scheme(F.col(url)).alias("url"), F.lit("").alias("all"))
    return numbered(rows, "all", ["url", "old_doc_id"], rank="new_doc_id").select("new_doc_id", "old_doc_id", "url")


def with_gaps(postings: DataFrame) -> DataFrame:
    """Adds ``gap``, the distance to the document before in the list (the id itself, for the first)."""
    rows = numbered(postings.select("*", F.col("doc_id").cast("bigint").alias("__doc")), "term", ["doc_id"], lag=("__before", "__doc"))
    return rows.withColumn("gap", F.col("__doc") - F.coalesce("__before", F.lit(0))).drop("__doc", "__before")


def without_gaps(gapped: DataFrame, order: str = "doc_no") -> DataFrame:
    """Ids again from gaps that stand in the order of a column."""
    return numbered(gapped, "term", [order], total=("doc_id", "gap"))


def position_gaps(positions: Column) -> Column:
    """Gaps of the positions within a document."""
    return F.transform(positions, lambda p, i: F.when(i == 0, p).otherwise(p - F.element_at(positions, F.greatest(i, F.lit(1)))))


def _list_text(gaps: Column) -> Column:
    return F.concat(F.lit("<"), F.array_join(F.transform(gaps, lambda g: g.cast("string")), ", "), F.lit(">"))


def cat(index: Index, term: str | None = None) -> DataFrame:
    """Rows (term, doc_id, line) with line ``(doc, tf, <position gaps>)``, in list order for whoever sorts by term and doc_id."""
    p = index.term(term) if term is not None else index.postings
    gaps = _list_text(position_gaps(F.col("positions"))) if "positions" in p.columns else F.lit("<>")
    return p.select("term", "doc_id", F.concat(F.lit("("), F.col("doc_id").cast("string"), F.lit(", "), F.col("tf").cast("string"), F.lit(", "), gaps, F.lit(")")).alias("line"))


def diff(a: Index, b: Index, term: str | None = None) -> DataFrame:
    """Rows (term, doc_id, kind, tf_a, tf_b[, only_a, only_b]) where the indices differ.

    kind: first or second (only that one has the posting), frequency, positions.
    """
    x, y = (i.term(term) if term is not None else i.postings for i in (a, b))
    both = "positions" in x.columns and "positions" in y.columns
    pick = lambda p, n: p.select("term", "doc_id", F.col("tf").alias(f"tf_{n}"), *([F.col("positions").alias(f"p_{n}")] if both else []))
    j = pick(x, "a").join(pick(y, "b"), ["term", "doc_id"], "full_outer")
    kind = F.when(F.col("tf_b").isNull(), "first").when(F.col("tf_a").isNull(), "second").when(F.col("tf_a") != F.col("tf_b"), "frequency")
    if both:
        kind = kind.when(F.col("p_a") != F.col("p_b"), "positions")
        j = j.withColumn("only_a", F.array_except("p_a", "p_b")).withColumn("only_b", F.array_except("p_b", "p_a")).withColumn("kind", kind).drop("p_a", "p_b")
    else:
        j = j.withColumn("kind", kind)
    return j.filter("kind is not null")


def retrieve(index: Index, term: str, what: str) -> DataFrame:
    """Values of one list: doc_ids, frequencies or positions."""
    p = index.term(term)
    if what == "doc_ids":
        return p.select("doc_id")
    if what == "frequencies":
        return p.select("doc_id", "tf")
    if what == "positions":
        return p.select("doc_id", F.explode("positions").alias("position"))
    raise ValueError(f"unknown data: {what!r}")


def count_postings(index: Index, term: str | None = None) -> DataFrame:
    """One row: lists, postings, occurrences, and positions stored."""
    p = index.term(term) if term is not None else index.postings
    return p.agg(F.countDistinct("term").alias("n_terms"), F.count("*").alias("n_postings"), F.coalesce(F.sum("tf"), F.lit(0)).cast("bigint").alias("n_tokens"), F.coalesce(F.sum(F.least("tf", F.lit(text.POSITIONS))), F.lit(0)).cast("bigint").alias("n_positions"))


def docid_ranges(df: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    return df.groupBy(source).agg(F.min(key).alias("first_doc_id"), F.max(key).alias("last_doc_id"), F.count("*").alias("n_docs"))


def meta(index: Index) -> DataFrame:
    """One row of index statistics."""
    lists = index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.sum(F.least("tf", F.lit(text.POSITIONS))).alias("kept"))
    p = lists.agg(F.count("*").alias("unique_terms"), F.coalesce(F.sum("df"), F.lit(0)).cast("bigint").alias("postings"), F.coalesce(F.sum("cf"), F.lit(0)).cast("bigint").alias("tokens"), F.coalesce(F.sum("kept"), F.lit(0)).cast("bigint").alias("index_positions"), F.coalesce(F.sum(F.ceil(F.col("df") / CHUNK)), F.lit(0)).cast("bigint").alias("chunks"), F.coalesce(F.max("df"), F.lit(0)).alias("longest_list"))
    d = index.docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum((F.col("doc_len") > 0).cast("bigint")), F.lit(0)).cast("bigint").alias("unique_docs"), F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last_doc_id"), F.coalesce(F.sum("doc_len"), F.lit(0)).cast("bigint").alias("total_len"))
    return d.crossJoin(p)
