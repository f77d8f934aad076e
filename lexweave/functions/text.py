"""Tokenising, HTML and query text.

Whole tables are tokenised over Arrow buffers, a few array passes per byte; a
document is one row, so its postings are counted where it is read, without a shuffle.
All else is Catalyst expressions.

A token is a maximal run of ASCII letters and digits, in lower case; every other
character separates, so accented letters do, too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.session import ship

TOKEN = "[0-9A-Za-z]+"
#: A tag runs to the next ``>``; one that is never closed swallows the rest.
TAG_OR_TOKEN = "<[^>]*(?:>|$)|[0-9A-Za-z]+"
SCRIPT = "(?is)<script *>.*?(?:</script *>|$)"
POSITIONS = 64
CONTEXTS = {"B": 1, "H": 2, "I": 4, "T": 8, "U": 16}
_OPEN_TAGS = {"B": "(?:b|strong)", "I": "(?:i|em)", "H": "h[1-6]", "T": "title"}


def token_array(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_IS_TOKEN = np.zeros(256, bool)
for _a, _z in ("09", "AZ", "az"):
    _IS_TOKEN[ord(_a) : ord(_z) + 1] = True
#: Bytes of text that are tokenised in one go.
SLICE = 2 << 20


def runs(texts: pa.Array) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of an array of texts: first text, last + 1, all terms, each one's text and position, and the texts' lengths."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    off = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(texts):
        j = min(len(texts), max(i + 1, int(np.searchsorted(off, off[i] + SLICE, "right")) - 1))
        raw, edge = data[off[i] : off[j]], off[i : j + 1] - off[i]
        inside = _IS_TOKEN[raw]
        joint = np.zeros(len(raw) + 1, bool)  # whether a byte goes on with the token of the one before
        joint[1:-1] = inside[1:] & inside[:-1] if len(raw) else False
        joint[edge] = False
        start, end = np.flatnonzero(inside & ~joint[:-1]), np.flatnonzero(inside & ~joint[1:]) + 1
        offsets = np.zeros(len(start) + 1, np.int32)
        np.cumsum(end - start, out=offsets[1:])
        terms = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])])
        first = np.searchsorted(start, edge)
        length = np.diff(first)
        doc = np.repeat(np.arange(j - i), length)
        yield i, j, terms, doc, np.arange(len(start)) - first[doc], length
        i = j


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, j, terms, doc, position, _ in runs(b.column(1)):
            yield pa.RecordBatch.from_arrays([b.column(0)[i:j].take(pa.array(doc)), pa.array(position.astype(np.int32)), terms], ["doc_id", "position", "term"])


def _postings(positions: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, terms, doc, position, length in runs(b.column(1)):
                if not len(terms):
                    continue
                code = terms.dictionary_encode()
                key = doc * np.int64(len(code.dictionary)) + code.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(key, kind="stable")
                key = key[order]
                start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                tf = np.diff(np.append(start, len(key)))
                which, term = key[start] // len(code.dictionary), key[start] % len(code.dictionary)
                columns = [code.dictionary.take(pa.array(term)), b.column(0)[i:j].take(pa.array(which)), pa.array(tf), pa.array(length[which].astype(np.int64))]
                if positions:
                    place = np.arange(len(key)) - np.repeat(start, tf)
                    kept = np.concatenate([[0], np.cumsum(np.minimum(tf, POSITIONS))]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(kept), pa.array(position[order][place < POSITIONS].astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["term", "doc_id", "tf", "doc_len", *(["positions"] if positions else [])])

    return run


def _keyed(df: DataFrame, key: str, text: Column) -> tuple[DataFrame, str]:
    ship(df.sparkSession)
    return df.select(F.col(key).alias("doc_id"), text.cast("string").alias("text")), df.select(key).schema[0].dataType.simpleString()


def tokens(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, position from 0, term)."""
    rows, kind = _keyed(df, key, F.col(text))
    return rows.mapInArrow(_tokens, f"doc_id {kind}, position int, term string")


def postings(df: DataFrame, key: str, text: Column, positions: bool = False) -> DataFrame:
    """Rows (term, doc_id, tf, doc_len[, positions]), the first POSITIONS positions of each."""
    rows, kind = _keyed(df, key, text)
    return rows.mapInArrow(_postings(positions), f"term string, doc_id {kind}, tf bigint, doc_len bigint" + (", positions array<int>" if positions else ""))


def _frequencies(names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(names, pa.string())
        for b in batches:
            for i, j, terms, doc, _, length in runs(b.column(1)):
                no = pc.fill_null(pc.index_in(terms, asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                kept = no >= 0
                key, tf = np.unique(doc[kept] * len(names) + no[kept], return_counts=True)
                offsets = pa.array(np.searchsorted(key, np.arange(j - i + 1) * len(names)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (key % max(len(names), 1), tf)]
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(length.astype(np.int64)), *lists], ["doc_id", "doc_len", "nos", "tfs"])

    return run


def frequencies(df: DataFrame, key: str, text: Column, names: Sequence[str]) -> DataFrame:
    """Rows (doc_id, doc_len, nos, tfs), one a document: numbers of the named terms that it has, and how often."""
    rows, kind = _keyed(df, key, text)
    return rows.mapInArrow(_frequencies(names), f"doc_id {kind}, doc_len bigint, nos array<int>, tfs array<int>")


def html_items(html: Column) -> Column:
    """Tags and tokens in order, scripts removed."""
    return F.regexp_extract_all(F.regexp_replace(html, SCRIPT, " <script> "), F.lit(TAG_OR_TOKEN), F.lit(0))


def html_tokens(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows (doc_id, position, term) of the text outside tags and scripts."""
    words = F.filter(html_items(F.col(html)), lambda x: ~x.startswith("<"))
    return df.select(F.col(key).alias("doc_id"), F.posexplode(words).alias("position", "term")).withColumn("term", F.lower("term"))


def html_text(html: Column) -> Column:
    """The tokens of a page joined by blanks, for the plain-text operators."""
    return F.array_join(F.filter(html_items(html), lambda x: ~x.startswith("<")), " ")


def html_contexts(df: DataFrame, key: str = "page_id", html: str = "html", strict_headings: bool = False) -> DataFrame:
    """Rows (doc_id, position, term, context): bits of the tags that are open at each token.

    One fold over the items of a page holds a bit set and the positions; no window
    and no shuffle, as a page is one row. ``strict_headings`` takes h1 to h5 with at
    least one character after the digit only.
    """
    heading = "^</?h[1-5][^>][^>]* *>$" if strict_headings else "^</?h[1-6] *>$"
    bits = {k: (heading if k == "H" else f"^</?{t} *>$") for k, t in _OPEN_TAGS.items()}

    def step(acc: Column, item: Column) -> Column:
        state = acc["state"]
        low = F.lower(item)
        for name, pattern in bits.items():
            bit = CONTEXTS[name]
            hit = low.rlike(pattern)
            state = F.when(hit & low.startswith("</"), state.bitwiseAND(F.lit(31 - bit))).when(hit, state.bitwiseOR(F.lit(bit))).otherwise(state)
        return F.struct(F.when(item.startswith("<"), state).otherwise(acc["state"]).alias("state"), F.when(item.startswith("<"), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["state"]))).alias("out"))

    items = html_items(F.col(html))
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<int>").alias("out"))
    rows = df.select(F.col(key).alias("doc_id"), items.alias("items"))
    rows = rows.select("doc_id", F.filter("items", lambda x: ~x.startswith("<")).alias("w"), F.aggregate("items", start, step)["out"].alias("c"))
    return rows.select("doc_id", F.posexplode(F.arrays_zip("w", "c")).alias("position", "x")).select("doc_id", "position", F.lower("x.w").alias("term"), F.col("x.c").alias("context"))


def html_links(df: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Rows (doc_id, link_no, link): first quoted string of each tag that starts with a."""
    tags = F.regexp_extract_all(F.col(html), F.lit("</?[aA][^>]*>"), F.lit(0))
    links = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, "[\"']([^\"']*)[\"']", 1)), lambda x: x != "")
    return df.select(F.col(key).alias("doc_id"), F.posexplode(links).alias("link_no", "link"))


def strip_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "^https?://", "")


def normalise_query(query: Column, stop_words: Sequence[str] = ()) -> Column:
    """Sorted distinct terms: lower case, other characters to blanks, stop words out."""
    terms = F.filter(F.split(F.regexp_replace(F.lower(query), "[^0-9a-z ]", " "), " +"), lambda x: x != "")
    if stop_words:
        terms = F.array_except(terms, F.array(*[F.lit(w) for w in stop_words]))
    return F.array_sort(F.array_distinct(terms))


def read_stop_words(text: str) -> list[str]:
    """Words of a stop list, separated by white space."""
    return [w.lower() for w in text.split()]
