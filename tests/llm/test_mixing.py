import hashlib
import random
from math import floor, inf, nan

import duckdb
import pytest

from lexweave.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string"


def fill(given, children):
    """Budgets of (capacity, weight) children by raising the level until the budget is spent."""
    out, open_, left = [0] * len(children), list(range(len(children))), given
    while open_:
        total = sum(children[i][1] for i in open_)
        full = [i for i in open_ if children[i][0] * total <= left * children[i][1]]
        if not full:
            for i in open_:
                out[i] = floor(children[i][1] * left / total + 1e-6)
            return out
        for i in full:
            out[i] = children[i][0]
            left -= children[i][0]
            open_.remove(i)
    return out


def brute(docs, domains, other, weights, fraction, max_epochs, seed):
    rows = []
    for i, text, lang, source in docs:
        n = len((text or "").split())
        if i is not None and n:
            source = source or "unknown"
            rows.append((i, domains.get(source, other), lang or "unknown", source, n))
    held = {}
    for r in rows:
        held[r[1:4]] = held.get(r[1:4], 0) + r[4]
    given = {(): floor(sum(held.values()) * fraction)}
    held = {p: n for p, n in held.items() if all(weights.get(p[:d], 1) > 0 for d in (1, 2, 3))}
    for depth in (1, 2, 3):
        nodes = {}
        for path, n in held.items():
            nodes[path[:depth]] = nodes.get(path[:depth], 0) + n * max_epochs
        nxt = {}
        for parent, budget in given.items():
            kids = sorted(p for p in nodes if p[:-1] == parent)
            nxt |= dict(zip(kids, fill(budget, [(nodes[k], weights.get(k, 1)) for k in kids])))
        given = nxt
    out = []
    for leaf, budget in given.items():
        mine = [r for r in rows if r[1:4] == leaf]
        for epoch in range(budget // held[leaf] + 1):
            left = min(budget - epoch * held[leaf], held[leaf])
            for r in sorted(mine, key=lambda r: (hashlib.md5(f"{seed}:{epoch}:{r[0]}".encode()).hexdigest(), r[0], r[4])):
                if left <= 0:
                    break
                out.append((*r[:4], epoch, r[4], min(r[4], left)))
                left -= r[4]
    return sorted(out)


def test_mix_equals_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 40, 300]))), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(300)]
    docs += docs[:5] + [(None, "x y", "en", "a"), (900, None, "en", "a")]
    domains, weights = {"a": "crawl", "b": "crawl", "c": "news"}, {("news",): 50, ("crawl",): 3, ("crawl", "en"): 2, ("crawl", "en", "b"): 5}
    df = spark.createDataFrame(docs, SCHEMA)
    for fraction, epochs, seed in ((0.6, 4, 3), (0.05, 1, 4), (2.5, 3, 5)):
        got = sorted(tuple(r) for r in mixing.mix(df, domains, "rest", weights, fraction, epochs, seed).collect())
        assert got == brute(docs, domains, "rest", weights, fraction, epochs, seed)


def corpus(seed):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([1, 5, 40, 300]))), rng.choice(["en", "de"]), rng.choice("aabcd")) for i in range(200)]


DOMAINS = {"a": "crawl", "b": "crawl", "c": "news"}
WEIGHTS = {
    "shares": {("crawl",): 0.7, ("news",): 0.3, ("rest",): 0.05},
    "fractions above 1": {("crawl",): 1.5, ("news",): 3},
    "a leaf of 0": {("crawl", "en", "a"): 0, ("news",): 0.25},
    "a family of 0": {("crawl", "en"): 0.4, ("crawl", "en", "a"): 0, ("crawl", "en", "b"): 0.0},
    "a domain of 0": {("crawl",): 0, ("news",): 0.1, ("rest",): 0.2},
    "a domain of leaves of 0": {("news", "en", "c"): 0, ("news", "de", "c"): 0, ("crawl",): 0.5},
    "nothing": {("crawl",): 0, ("news",): 0, ("rest",): 0},
}


@pytest.mark.parametrize("name", WEIGHTS)
def test_weights_of_any_size_equal_brute_force_and_sql(spark, name):
    docs, weights = corpus(3), WEIGHTS[name]
    want = brute(docs, DOMAINS, "rest", weights, 0.5, 2, 9)
    df = spark.createDataFrame(docs, SCHEMA)
    assert sorted(tuple(r) for r in mixing.mix(df, DOMAINS, "rest", weights, 0.5, 2, 9).collect()) == want
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    columns = "doc_id, domain, lang, source, epoch, n_tokens, take_tokens"
    assert sorted(con.sql(f"SELECT {columns} FROM ({mixing.sql(DOMAINS, 'rest', weights, 0.5, 2, 9)})").fetchall()) == want
    # while there is an open leaf with room, what any leaf can't take is not lost
    total, held = sum(len(t.split()) for _, t, _, _ in docs), sum(r[-1] for r in want)
    assert held == 0 if name == "nothing" else held > 0.5 * total - 12


@pytest.mark.parametrize("weight", [-1, nan, inf])
def test_weights_that_mean_nothing_are_refused(spark, weight):
    with pytest.raises(ValueError):
        mixing.mix(spark.createDataFrame(corpus(1), SCHEMA), DOMAINS, "rest", {("crawl",): weight})


def test_a_very_long_text_is_counted_whole_and_cut_at_the_budget(spark):
    docs = [(1, "w " * 400_000, "en", "a"), (2, "w", "en", "a")]
    assert sum(r.take_tokens for r in mixing.mix(spark.createDataFrame(docs, SCHEMA), fraction=0.5).collect()) == 200_000


def test_shortage_goes_to_siblings_before_ancestors(spark):
    docs = [(1, "w " * 10, "en", "a"), (2, "w " * 500, "de", "a"), (3, "w " * 500, "en", "b")]
    leaves = mixing.mix(spark.createDataFrame(docs, SCHEMA), {"a": "x", "b": "y"}, "z", {}, 0.4, 1, 0)
    taken = {r.doc_id: r.take_tokens for r in leaves.collect()}
    # x has half of 404 tokens; its English part has only 10, so its German part takes the rest of x's half
    assert taken == {1: 10, 2: 192, 3: 202}


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "a b c d", None, None, 7, "k")], SCHEMA + ", epoch int, key string")
    rows = mixing.mix(clash).collect()
    assert [(r.doc_id, r.lang, r.source, r.take_tokens) for r in rows] == [(1, "unknown", "unknown", 2)]
