"""URL filters with a sorted digest array.

Blocked strings (hosts, domains, host and path prefixes, whole addresses) are kept
as one ascending array of their 64-bit xxhash keys, with the full strings beside
it in the same order. Workers map the files into memory, so all processes of a
machine share one copy, probe whole batches of keys by binary search, and compare
the stored string before they call a match, as keys can collide.

An address is probed under its host and each parent domain of two labels or more,
each alone, with each prefix of the path, and with the whole path and its query
string. Stored strings have the host's labels in reverse (``com:example/path``), so
that every key of an address is a prefix of it under one of its hosts and all keys
come from one running hash. Hosts of listed paths stand in the array too, marked as
such: an address whose hosts are not in the array needs no probe of its paths.
The work on an address grows with its length, and that of its paths with the number
of its hosts that are listed.

Addresses and entries are compared without scheme, user, port and fragment, the
host in lower case without ``www.``, and without a slash at the end.

Defined results: a null, empty or unparsable address matches nothing and is not
blocked; a very long address is probed whole; rows without id and repeated rows are
judged each; null and repeated entries don't matter; of several matching entries
the longest is reported, of equally long ones the first in order; an empty table
gives an empty result, an empty list blocks nothing; other columns are not read by
``match``, whatever their names.

A list of any size is cut by ranges of its keys into arrays of about ``ARRAY_BYTES``,
each sorted, written and mapped on its own; a key is searched in the one of its range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import ExitStack
from math import ceil
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import cut, ship, work_path

#: Bytes of entries and keys in one array.
ARRAY_BYTES = 1 << 28
#: Hosts with one of these words in their name go on the list of the query.
WORDS = ("casino", "bets", "poker", "adult", "porn", "xxx", "spam", "malware", "phish", "warez")
#: Further entries of the query's list: a domain's path, a host, and addresses that no page has.
FIXED = ("https://example.org/es/", "example.com/de", "http://blog.tionsh.example.net", "ads.example.com", "tracker.invalid/pixel?id=1")
#: Addresses with this in them are listed whole.
LISTING = "?page="


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and ``www.``; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), r"^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]+)", 1), r"^www\.", "")


def rest_of(url: Column) -> Column:
    """Path and query string, without fragment and final slash; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?[^/?#]*([^#]*)", 1), r"/$", "")


def canonical(url: Column) -> Column:
    return F.concat(host_of(url), rest_of(url))


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ":")


def listed(entries: DataFrame) -> DataFrame:
    """Rows (key, entry, kind) of a one-column table: kind 1 for an entry, 2 for the host of a listed path, 3 for both."""
    e = entries.toDF("entry").select(host_of(F.col("entry")).alias("host"), rest_of(F.col("entry")).alias("rest")).filter("host <> ''")
    stored = e.select(F.concat(reversed_host(F.col("host")), F.col("rest")).alias("entry"), F.lit(1).alias("kind"))
    hosts = e.filter("rest <> ''").select(reversed_host(F.col("host")).alias("entry"), F.lit(2).alias("kind"))
    return stored.unionByName(hosts).groupBy("entry").agg(F.bit_or("kind").alias("kind")).select(F.xxhash64("entry").alias("key"), "entry", "kind")


class DigestArray:
    """One range's array on disk: keys (uint64), offsets (int64), kinds (bytes) and strings (UTF-8), all in key order."""

    KINDS = {"keys": "<u8", "offsets": "<i8", "kinds": "u1", "strings": "u1"}

    def __init__(self, uri: str, n: int):
        self.uri, self.n = uri, n
        self.keys: np.ndarray | None = None

    def _map(self, name: str) -> np.ndarray:
        fs, path = pafs.FileSystem.from_uri(f"{self.uri}.{name}")
        if not isinstance(fs, pafs.LocalFileSystem):
            path = SparkFiles.get(path.rsplit("/", 1)[-1])
        return np.memmap(path, self.KINDS[name], "r")

    def probe(self, keys: np.ndarray, strings: Callable[[int], bytes]) -> np.ndarray:
        """Kind of each key's string, 0 where it isn't stored: binary search for all keys, then a comparison of the strings that are hit."""
        out = np.zeros(len(keys), np.uint8)
        if not self.n:
            return out
        if self.keys is None:
            self.keys, self.offsets, self.kinds, self.strings = (self._map(n) for n in self.KINDS)
        at = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero((at < self.n) & (self.keys[np.minimum(at, self.n - 1)] == keys)).tolist():
            want, k = strings(i), int(at[i])
            while k < self.n and self.keys[k] == keys[i]:
                if self.strings[self.offsets[k] : self.offsets[k + 1]].tobytes() == want:
                    out[i] = self.kinds[k]
                    break
                k += 1
        return out


class DigestArrays:
    """Arrays of equal ranges of the key space, in order."""

    def __init__(self, parts: list[DigestArray]):
        self.parts = parts

    def probe(self, keys: np.ndarray, strings: Callable[[int], bytes]) -> np.ndarray:
        out = np.zeros(len(keys), np.uint8)
        if len(keys) and self.parts:
            part = range_of(keys, len(self.parts))
            for r in np.unique(part).tolist():
                mine = np.flatnonzero(part == r)
                out[mine] = self.parts[r].probe(keys[mine], lambda i: strings(int(mine[i])))  # noqa: B023
        return out


def range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _write(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, at, n, part = f"{base}-{uuid4().hex}", 0, 0, None  # each attempt writes its own files; the one that counts names them
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with ExitStack() as files:
            out = {name: files.enter_context(fs.open_output_stream(f"{path}.{name}")) for name in DigestArray.KINDS}
            out["offsets"].write(np.zeros(1, "<i8").tobytes())
            for b in batches:
                if b.num_rows:
                    part = b.column(3)[0].as_py()
                    raw = b.column(1).cast(pa.binary())
                    out["keys"].write(b.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    ends = at + np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64))
                    out["offsets"].write(ends.astype("<i8").tobytes())
                    out["kinds"].write(b.column(2).to_numpy(zero_copy_only=False).astype("u1").tobytes())
                    out["strings"].write(b"".join(raw.to_pylist()))
                    at, n = int(ends[-1]), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([n])], ["part", "uri", "n"])

    return run


def build(entries: DataFrame, array_bytes: int = ARRAY_BYTES) -> DigestArrays:
    """Write the arrays of a one-column table of addresses into the shared folder."""
    spark = entries.sparkSession
    ship(spark)
    rows = cut(listed(entries), "digests-listed")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("entry") + 17), F.lit(0))).first()[0]
    ranges = max(1, ceil(size / array_bytes))
    # keys are compared as unsigned numbers; flipping the sign bit orders them so
    high = F.shiftrightunsigned("key", 32)
    rows = rows.withColumn("part", F.shiftrightunsigned(high * ranges, 32).cast("int"))
    order = F.expr("key ^ cast(-9223372036854775808 as bigint)")
    one = rows.repartitionById(ranges, "part").sortWithinPartitions(order, "entry")
    parts = [DigestArray("", 0)] * ranges
    for row in one.mapInArrow(_write(work_path(spark, "digests")), "part int, uri string, n bigint").collect():
        parts[row.part] = DigestArray(row.uri, row.n)
        if not row.uri.startswith("file:"):
            for name in DigestArray.KINDS:
                spark.sparkContext.addFile(f"{row.uri}.{name}")
    return DigestArrays(parts)


#: Seed of Spark's xxhash64.
_SEED = 42


def _hosts(host: str) -> Iterator[tuple[bytes, int, xxhash.xxh64]]:
    """The host and its parent domains of two labels or more: reversed host, the part's length, and its running hash."""
    pieces = [p.encode() for p in host.split(".")[::-1]]
    whole, state, end = b":".join(pieces), xxhash.xxh64(seed=_SEED), -1
    for i, piece in enumerate(pieces):
        state.update(b":" + piece if i else piece)
        end += len(piece) + 1
        if i or len(pieces) == 1:
            yield whole, end, state.copy()


def _tails(rest: bytes) -> Iterator[int]:
    """Ends of the path's prefixes at each slash, of the path, and of the path with its query string."""
    path = rest.find(b"?")
    path = len(rest) if path < 0 else path
    at = rest.find(b"/", 1, path)
    while at > 0:
        yield at
        at = rest.find(b"/", at + 1, path)
    if path:
        yield path
    if path < len(rest):
        yield len(rest)


def _probe(arrays: DigestArrays):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rests = b.column(3).to_pylist()
            hosts = [(i, *h) for i, host in enumerate(b.column(2).to_pylist()) if host for h in _hosts(host)]
            kind = arrays.probe(np.array([s.intdigest() for _, _, _, s in hosts], np.uint64), lambda k: hosts[k][1][: hosts[k][2]])
            found = [(hosts[k][0], hosts[k][1][: hosts[k][2]], b"") for k in np.flatnonzero(kind & 1).tolist()]
            keys, paths = [], []
            for k in np.flatnonzero(kind & 2).tolist():
                i, whole, end, state = hosts[k]
                rest, at = rests[i].encode(), 0
                for to in _tails(rest):
                    state.update(rest[at:to])
                    keys.append(state.intdigest())
                    paths.append((i, whole[:end], rest, to))
                    at = to
            kind = arrays.probe(np.array(keys, np.uint64), lambda k: paths[k][1] + paths[k][2][: paths[k][3]])
            found += [(paths[k][0], paths[k][1], paths[k][2][: paths[k][3]]) for k in np.flatnonzero(kind & 1).tolist()]
            best: list[str | None] = [None] * b.num_rows
            for i, host, tail in found:
                s = ".".join(host.decode().split(":")[::-1]) + tail.decode()
                if best[i] is None or (-len(s), s) < (-len(best[i]), best[i]):
                    best[i] = s
            entry = pa.array(best, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), entry, entry.is_valid()], ["page_id", "url", "entry", "blocked"])

    return run


def match(pages: DataFrame, entries: DataFrame, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """Rows (page_id, url, entry that blocks it, blocked), one for each page."""
    ship(pages.sparkSession)
    url = F.col("url")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host_of(url).alias("host"), F.coalesce(rest_of(url), F.lit("")).alias("rest"))
    return rows.mapInArrow(_probe(build(entries, array_bytes)), "page_id bigint, url string, entry string, blocked boolean")


def entries_of(pages: DataFrame, bad: tuple[str, ...] = WORDS, fixed: tuple[str, ...] = FIXED, listing: str = LISTING) -> DataFrame:
    """The query's list: hosts with a listed word in their name, whole addresses of listing pages, and the fixed entries."""
    url = F.col("url")
    hosts = pages.select(host_of(url).alias("entry")).filter(F.col("entry").rlike("|".join(bad)))
    whole = pages.filter(url.contains(listing)).select(url.alias("entry"))
    return hosts.unionByName(whole).unionByName(pages.sparkSession.createDataFrame([(e,) for e in fixed], "entry string")).distinct()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over the whole pages table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return match(pages, entries_of(pages))


def sql(bad: tuple[str, ...] = WORDS, fixed: tuple[str, ...] = FIXED, listing: str = LISTING) -> str:
    """DuckDB SQL of the query: every key of every address, joined with the list."""
    host = r"regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]+)', 1), '^www\.', '')"
    rest = r"regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?[^/?#]*([^#]*)', 1), '/$', '')"
    extra = ", ".join(f"('{e}')" for e in fixed)
    return f"""WITH p AS (SELECT row_number() OVER () AS n, page_id, url, {host} AS host, {rest} AS rest FROM pages),
b AS (SELECT DISTINCT host AS entry FROM p WHERE regexp_matches(host, '{"|".join(bad)}')
  UNION SELECT {host} || {rest} FROM (SELECT url FROM pages WHERE contains(url, '{listing}') UNION ALL SELECT * FROM (VALUES {extra}) v(url)) WHERE {host} <> ''),
s AS (SELECT n, host, rest, string_split(host, '.') AS labels, string_split(regexp_extract(rest, '^([^?]*)', 1), '/') AS steps FROM p WHERE host <> ''),
h AS (SELECT n, unnest(CASE WHEN len(labels) <= 2 THEN [host] ELSE list_transform(range(1, len(labels)), lambda i: array_to_string(labels[i:], '.')) END) AS host FROM s),
t AS (SELECT n, unnest(list_distinct(list_concat(list_transform(range(1, len(steps) + 1), lambda i: array_to_string(steps[1:i], '/')), [rest]))) AS tail FROM s),
k AS (SELECT h.n, b.entry, row_number() OVER (PARTITION BY h.n ORDER BY length(b.entry) DESC, b.entry) AS r FROM h JOIN t ON h.n = t.n JOIN b ON b.entry = h.host || t.tail)
SELECT page_id, url, entry, entry IS NOT NULL AS blocked FROM p LEFT JOIN k ON p.n = k.n AND k.r = 1"""


SQL = sql()
