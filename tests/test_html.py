from lexweave.functions import text

PAGE = "<h1>x</h1><b>y <script>z</script> w</b> a<b"


def test_tags_scripts_and_an_unclosed_tag(spark):
    df = spark.createDataFrame([(1, PAGE), (2, ""), (3, None)], "page_id long, html string")
    got = [(r.doc_id, r.position, r.term) for r in text.html_tokens(df).orderBy("doc_id", "position").collect()]
    assert got == [(1, 0, "x"), (1, 1, "y"), (1, 2, "w"), (1, 3, "a")]


def test_contexts_are_bits_of_the_open_tags(spark):
    df = spark.createDataFrame([(1, "<title>t</title><h2>h <i>hi</i></h2><b>b<strong>c</b>d</strong> e")], "page_id long, html string")
    c = text.CONTEXTS
    got = {r.term: r.context for r in text.html_contexts(df).collect()}
    assert got == {"t": c["T"], "h": c["H"], "hi": c["H"] | c["I"], "b": c["B"], "c": c["B"], "d": 0, "e": 0}


def test_links(spark):
    df = spark.createDataFrame([(1, "<a href=\"u1\">x</a><A class='k' href='u2'><p title='no'>")], "page_id long, html string")
    assert [(r.link_no, r.link) for r in text.html_links(df).orderBy("link_no").collect()] == [(0, "u1"), (1, "k")]
