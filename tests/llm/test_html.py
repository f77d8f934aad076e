from math import e, log

import pytest

from lexweave.llm import html


def density(node, body):
    """Composite density of an element by recursion over its tree, without the operator's running sums."""

    def chars(n):
        return sum(len(" ".join(p.split())) if isinstance(p, str) else chars(p) for p in n.parts)

    def tags(n):
        return sum(1 + tags(c) for c in n.children())

    def links(n):
        """Characters and tags of the outermost links in n, or all of n if it is a link."""
        if n.tag == "a":
            return chars(n), tags(n)
        got = [(links(c)[0], links(c)[1] + (c.tag == "a")) for c in n.children()]
        return sum(a for a, _ in got), sum(b for _, b in got)

    c, t = chars(node), max(tags(node), 1)
    lc, lt = links(node)
    if not c:
        return 0.0
    inner = c / max(c - lc, 1) * lc + links(body)[0] / max(chars(body), 1) * c + e
    return c / t * log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / max(log(log(inner)), html.LEAST)


def test_measures_equal_a_recursive_definition(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    for page in pages:
        _, nodes = html.parse(page)
        body = html.measure(nodes)
        for n in nodes:
            assert n.density == pytest.approx(density(n, body))
            assert n.total == pytest.approx(sum(density(c, body) for c in n.children()) if n.children() else n.density)
        inside = [n for n in nodes if any(x is body for x in up(n))]
        assert body.best.total == pytest.approx(max(n.total for n in inside))


def up(n):
    while n is not None:
        yield n
        n = n.parent


def plain_extract(page):
    """Text, path, sum and threshold of a page's content, from densities by recursion."""
    _, nodes = html.parse(page)
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    inside = [n for n in nodes if any(x is body for x in up(n))]
    d = {id(n): density(n, body) for n in inside}
    total = {id(n): sum(d[id(c)] for c in n.children()) if n.children() else d[id(n)] for n in inside}
    below = lambda n: [n, *(x for c in n.children() for x in below(c))]
    best = lambda n: max(below(n), key=lambda x: total[id(x)])  # noqa: E731 (the first of equal ones)
    top = best(body)
    path = [n for n in up(top) if n is body or any(x is body for x in up(n))]
    limit = min(d[id(n)] for n in path)
    dense = [n for n in inside if all(d[id(x)] >= limit for x in up(n) if any(y is body for y in up(x)))]
    chosen = [best(n) for n in dense if " ".join(words_of(n)).strip()]

    def lines(n, on):
        on = on or any(n is c for c in chosen)
        out = []
        for p in n.parts:
            out += ([p] if on else []) if isinstance(p, str) else lines(p, on)
        return ["\n", *out, "\n"] if n.tag in html.BLOCKS else out

    text = "".join(x if x == "\n" else " ".join(["", *x.split(), ""]) if x[:1].isspace() and x[-1:].isspace() else x for x in lines(body, False))
    return ["".join(x.split()) for x in text.split("\n") if x.strip()], "/".join(n.tag for n in reversed(path) if n.parent), total[id(top)], limit


def words_of(n):
    return [p if isinstance(p, str) else " ".join(words_of(p)) for p in n.parts]


def test_content_path_and_threshold_equal_a_recursive_definition(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        text, path, total, limit = html.extract(r.html)
        lines, want_path, want_total, want_limit = plain_extract(r.html)
        assert path == want_path and total == pytest.approx(want_total, abs=1e-5) and limit == pytest.approx(want_limit, abs=1e-5)
        # line by line, but for blanks
        assert "".join("".join(x.split()) for x in text.split("\n")) == "".join(lines)
        assert [x for x in text.split("\n") if x] == text.split("\n")


LONG = "This sentence is part of the story and carries quite a few words of running text. " * 6


def test_content_without_navigation():
    page = f"<html><head><title>t</title><script>var x = '<p>no</p>';</script></head><body><div id=nav><ul><li><a href=a>Home</a><li><a href=b>News</a><li><a href=c>Contact</a></ul></div><div id=main><h1>Story</h1><p>{LONG}<p>{LONG}</div><div><a href=z>Terms</a> <a href=y>Privacy</a></div></body></html>"
    text, path, total, limit = html.extract(page)
    assert "story and carries" in text and "Home" not in text and "Privacy" not in text and "var x" not in text
    assert path == "body/div" and total > limit > 0


@pytest.mark.parametrize("page", [None, "", "<html><body></body></html>", "<div><p></p></div>", "<!-- only -->"])
def test_pages_without_text(page):
    assert html.extract(page) == ("", "", 0.0, 0.0)


def test_broken_and_deep_pages():
    assert html.extract("<p>one<p>two</span></div><b>three")[0]
    assert html.extract("<div>" * 20_000 + "text")[0] == "text"
    assert html.extract("plain words only")[0] == "plain words only"
    assert html.extract("<body>a &lt; b &amp; c</body>")[0] == "a < b & c"
    assert len(html.extract("<p>" + "word " * 400_000)[0]) == 5 * 400_000 - 1


@pytest.mark.parametrize("page,text", [('<p title="a>b">x</p>', "x"), ("<p title='a>b' id=c>x</p>", "x"), ('<p title = "a>b"class=d>x', "x"), ("<p title=don't>it's</p>", "it's"), ('<p title="open>x</p>', "x"), ('<a href="?q=1&b>2">x</a>', "x"), ("<p " + 'a="b>" ' * 50_000 + ">x", "x"), ("<p " + "a=' " * 20_001 + ">x", "x")])
def test_quoted_attributes(page, text):
    assert html.extract(page)[0] == text


def test_edges(spark):
    rows = [(1, "u", "<p>x</p>", "c"), (1, "u", "<p>x</p>", "c"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, content string")
    assert sorted((r.page_id or -1, r.content) for r in html.contents(df).collect()) == [(-1, ""), (1, "x"), (1, "x")]
    assert html.contents(df.limit(0)).count() == 0
