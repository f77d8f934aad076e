import random

import numpy as np
import pytest

from lexweave.llm import urls


def brute(url, entries):
    """The longest entry that is a suffix of the host's labels with a prefix of the path."""
    import re

    if url is None:
        return None
    m = re.match(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#:@]+)", url)
    if not m:
        return None
    host = re.sub(r"^www\.", "", m[1].lower())
    rest = re.sub(r"/$", "", re.match(r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?[^/?#]*([^#]*)", url)[1])
    labels = host.split(".")
    hosts = [host] if len(labels) <= 2 else [".".join(labels[i:]) for i in range(len(labels) - 1)]
    path = rest.split("?")[0].split("/")
    tails = ["/".join(path[:i]) for i in range(1, len(path) + 1)] + [rest]
    hits = [h + t for h in hosts for t in tails if h + t in entries]
    return min(hits, key=lambda s: (-len(s), s)) if hits else None


@pytest.mark.parametrize("array_bytes", [urls.ARRAY_BYTES, 40])
def test_match_equals_brute_force(spark, array_bytes):
    rng = random.Random(2)
    hosts = ["a.com", "www.b.org", "x.y.a.com", "Bad.NET", "c.co.uk", "localhost"]
    paths = ["", "/", "/one", "/one/two", "/one/two?q=1", "/One/two/#frag", "?z=1"]
    pages = [(i, rng.choice(["https://", "http://", "//", "https://u:p@"]) + rng.choice(hosts) + rng.choice(["", ":80"]) + rng.choice(paths)) for i in range(200)]
    pages += [(500, None), (501, ""), (None, "http://a.com/one"), (502, "http://"), (7, pages[7][1]), (503, "http://a.com/" + "x/" * 300), (504, "http://one,b.org/one"), (505, "http://x:80?q=1"), (7, pages[7][1])]
    listed = ["a.com/one", "http://y.a.com", "bad.net/", "b.org/one/two?q=1", "co.uk", "x?q=1", "org,b", None, "", "a.com/one", "b.org/one"]
    entries = {"a.com/one", "y.a.com", "bad.net", "b.org/one/two?q=1", "co.uk", "b.org/one", "x?q=1", "org,b"}
    got = urls.match(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame([(e,) for e in listed], "e string"), array_bytes).collect()
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(((i, u, brute(u, entries), brute(u, entries) is not None) for i, u in pages), key=key)
    assert sorted((tuple(r) for r in got), key=key) == want


def test_long_addresses_cost_no_more_than_their_length(spark):
    path = "/".join(["seg"] * 100_000)
    pages = spark.createDataFrame([(1, f"http://a.com/{path}"), (2, f"http://{'x.' * 20_000}a.com/{path}?q"), (3, "http://b.com/" + "/" * 200_000)], "page_id long, url string")
    listed = spark.createDataFrame([("a.com/" + "/".join(["seg"] * 70_000),), ("a.com/seg",), ("b.com/x",)], "e string")
    assert {r.page_id: len(r.entry or "") for r in urls.match(pages, listed).collect()} == {1: 5 + 280_000, 2: 5 + 280_000, 3: 0}


def test_digests_are_those_of_the_stored_keys(spark):
    for host, rest in (("a.b.co.uk", "/x/yé?z"), ("localhost", ""), ("ü.de", "?q")):
        (whole, end, state) = list(urls._hosts(host))[-1]
        state.update(rest.encode())
        want = spark.sql(f"select xxhash64('{whole[:end].decode() + rest}')").first()[0]
        assert state.intdigest() == want % (1 << 64)


def test_collisions_are_told_apart():
    array = urls.DigestArray("x", 3)
    array.keys, array.offsets, array.kinds, array.strings = np.array([5, 5, 9], np.uint64), np.array([0, 1, 2, 3]), np.array([1, 3, 2], np.uint8), np.frombuffer(b"abc", np.uint8)
    names = [b"a", b"b", b"c", b"c", b"a", b"a"]
    assert array.probe(np.array([5, 5, 5, 9, 9, 2], np.uint64), names.__getitem__).tolist() == [1, 3, 0, 2, 0, 0]


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.com", 3)], "page_id long, url string, entry long")
    none = spark.createDataFrame([], "e string")
    assert [tuple(r) for r in urls.match(pages, none).collect()] == [(1, "http://a.com", None, False)]
    assert urls.match(pages.limit(0), spark.createDataFrame([("a.com",)], "e string")).count() == 0


def test_query_equals_its_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = con.sql(f"SELECT page_id, url, entry, blocked FROM ({urls.SQL})").fetchall()
    assert sorted(tuple(r) for r in urls.query(spark, sf_dir).collect()) == sorted(want, key=lambda r: r[0])
    assert {k for *_, k in want} == {True, False} and any("?page=" in (e or "") for _, _, e, _ in want)
