import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lexweave.llm import language

SCHEMA = "doc_id long, text string, lang string, source string"


def codes(text):
    """Trigrams of one text around each of its letters, by plain loops."""
    raw = pc.utf8_lower(pa.array([text]))[0].as_py().encode()
    raw = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in raw)
    wide = b" " + raw + b" "
    return [((wide[i] << 16 | wide[i + 1] << 8 | wide[i + 2]) * 2654435761 % (1 << 32)) >> (32 - language.BITS) for i in range(len(raw)) if raw[i] != 32]


def test_likelihoods_equal_plain_sums():
    rng = np.random.default_rng(1)
    tables = np.zeros((3, (1 << language.BITS) + 1), np.float32)
    tables[:, :-1] = -rng.random((3, 1 << language.BITS))
    texts = ["Hello, World 42", "", None, "Straße über größe", "a", "x " * 1_500_000]
    ll, n = language.likelihoods(pa.array(texts), tables)
    for t, row, count in zip(texts[:5], ll, n):
        c = codes(t or "")
        assert count == len(c)
        assert np.allclose(row, tables[:, c].sum(1), atol=1e-3)
    assert n[5] == 1_500_000


def test_languages_of_documents_whose_own_is_withheld(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    blind = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    got = {r.doc_id: r for r in language.identify(blind, spark.read.parquet(f"{sf_dir}/pages.parquet")).filter("doc_id is not null").collect()}
    assert set(got) == set(truth)
    held = [i for i in truth if i % 2]
    assert np.mean([got[i].lang == truth[i] for i in held if got[i].accepted]) > 0.95
    assert np.mean([got[i].accepted for i in truth]) > 0.95


def test_rows_equal_plain_python(spark, sf_dir):
    """Trigram tables, evidence counts, host prior, fusion and acceptance, by loops over the rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()
    rows = [(r.doc_id, r.text, r.lang, ["a.b.de", "c.b.de", "x.org", "plain", None][r.doc_id % 5]) for r in docs] + [(9001, "zz", None, "a.b.de"), (9002, "", "en", "x.org"), (9003, None, None, None), (9004, "q", "fr", "y.fr"), (9005, "\u4e00\u4e8c" * 60, None, "x.org")]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "page_id long, url string, html string")).collect()}
    want = plain_verdicts(rows)
    assert set(got) == set(want)
    for i, (lang, sure, ok) in want.items():
        assert got[i].accepted == ok and got[i].lang == lang, i
        assert got[i].confidence == pytest.approx(sure, abs=2e-3)


def plain_verdicts(rows):
    from collections import Counter
    from math import exp, log

    table, size = {}, 1 << language.BITS
    for _, text, lang, _ in rows:
        if lang:
            table.setdefault(lang, Counter()).update(codes(text or ""))
    table = {k: t for k, t in table.items() if t}
    total = {k: sum(t.values()) for k, t in table.items()}
    langs = sorted(table)
    p = {k: (lambda c, k=k: log((table[k][c] + 0.05) / (total[k] + 0.05 * size))) for k in langs}
    usual = {k: sum(n * p[k](c) for c, n in table[k].items()) / total[k] for k in langs}

    def soft(x):
        top = max(x.values())
        e = {k: exp(v - top) for k, v in x.items()}
        return {k: v / sum(e.values()) for k, v in e.items()}

    judged = {}
    for i, text, lang, source in rows:
        c = codes(text or "")
        ll = {k: sum(p[k](x) for x in c) for k in langs}
        near = any((ll[k] + language.USUAL * usual[k]) / (len(c) + language.USUAL) >= usual[k] - language.UNLIKE for k in langs)
        tempered = {k: ll[k] / 3 * min(1, language.EFFECTIVE / max(len(c), 1)) for k in langs}
        parts = source.split(".") if source and "." in source else []
        judged[i] = (tempered, len(c), near, lang, parts[-1] if parts else None, ".".join(parts[-2:]) if parts else None, source)
    counts = [{}, {}, {}, {}]
    every = dict.fromkeys(langs, 0.0)
    for t, n, near, *keys in judged.values():
        if n and near:
            for k, v in soft(t).items():
                every[k] += v
                for c, key in zip(counts, keys):
                    c.setdefault(key, dict.fromkeys(langs, 0.0))[k] += v
    base = {k: (every[k] + 1) / (sum(every.values()) + len(langs)) for k in langs}
    lean = lambda c, parent: {k: (c[k] + language.LEAN * parent[k]) / (sum(c.values()) + language.LEAN) for k in langs}
    out = {}
    for i, (t, n, near, declared, suffix, domain, host) in judged.items():
        x = dict(t)
        for c, key in ((counts[0], declared), (counts[1], suffix)):
            if key is not None and key in c:
                kinds = len([v for v in c if v is not None]) + 1
                x = {k: x[k] + log((c[key][k] + 1) / (every[k] + kinds)) for k in langs}
        if host is not None and host in counts[3]:
            parent = lean(counts[2][domain], base) if domain is not None and domain in counts[2] else base
            x = {k: x[k] + log(v) for k, v in lean(counts[3][host], parent).items()}
        post = soft(x)
        best = max(langs, key=lambda k: post[k])
        ok = n > 0 and near and post[best] >= language.MIN_CONFIDENCE
        out[i] = (best if ok else "und", post[best], ok)
    return out


def test_text_alone_on_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.train(language._labelled(docs.filter("doc_id % 2 = 0")))
    held = docs.filter("doc_id % 2 = 1 and length(text) > 60").select("lang", model.verdict(model.column(docs["text"])).alias("v")).collect()
    assert np.mean([r.v.lang == r.lang for r in held]) > 0.95


def test_evidence_decides_where_the_text_does_not(spark):
    rows = [(i, "der hund und die katze sind im garten " * 3, "de", "h.de") for i in range(40)] + [(100 + i, "the dog and the cat are in the garden " * 3, "en", "h.com") for i in range(40)]
    rows += [(500, "zz", "de", "h.de"), (501, "zz", "en", "h.com"), (502, "zz", None, "h.de"), (503, "zz", None, "x.com")]
    pages = spark.createDataFrame([(1, "http://h.de/a", "<html lang='de-AT'><p>zz</p>"), (2, "http://h.com/b", "<html lang=en><p>zz</p>")], "page_id long, url string, html string")
    got = language.identify(spark.createDataFrame(rows, SCHEMA), pages).collect()
    by = {r.doc_id if r.doc_id is not None else -r.page_id: r.lang for r in got}
    assert [by[k] for k in (500, 501, 502, 503, -1, -2)] == ["de", "en", "de", "en", "de", "en"]


def test_host_prior_leans_on_its_parents(spark):

    rows = [(i, "der hund und die katze " * 4, "de", "big.x.org") for i in range(60)] + [(100 + i, "the dog and the cat " * 4, "en", "small.x.org") for i in range(2)] + [(200 + i, "the dog and the cat " * 4, "en", "z.net") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = language.train(language._labelled(docs))
    language.gather(model, language.of_documents(docs, model))
    logs = {r.host: np.exp(r.host_log) for r in model.evidence["host"].collect()}
    every = np.array([60, 32])  # texts so clear that their posteriors are 1
    base = (every + 1) / (every.sum() + 2)
    parent = (np.array([60, 2]) + language.LEAN * base) / (62 + language.LEAN)
    assert model.langs == ["de", "en"]
    assert np.allclose(logs["small.x.org"], (np.array([0, 2]) + language.LEAN * parent) / (2 + language.LEAN), atol=2e-3)
    assert np.allclose([x.sum() for x in logs.values()], 1)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the dog", "en", "s", 1), (1, "the dog", "en", "s", 1), (None, "the cat", "en", None, 2), (2, None, "en", "s", 3), (3, "", None, None, 4), (4, "12 34 ...", "en", "s", 5), (5, "the dog " * 300_000, None, "s", 6)], SCHEMA + ", verdict int")
    kept = language.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1, 5]
    assert language.keep(docs.limit(0)).count() == 0
    nobody = docs.withColumn("lang", docs["source"].substr(1, 0))
    assert sorted(r.doc_id or -1 for r in language.keep(nobody).collect()) == [-1, 1, 1, 5]
    pages = spark.createDataFrame([(1, None, None), (None, "x", "<p>the dog")], "page_id long, url string, html string")
    assert language.identify(docs, pages).count() == 9
