from seamount.operators import graph


def test_links_in_every_form(spark):
    page = """<A HREF="/a">x</A> <a class='k' href='/b'>x</a><a href=/c>x</a><a\n  title="a > b" href = "/d">x</a><a data-href="/no" HREF="/e"/>
    <!-- <a href="/no">x</a> --><script>var s = '<a href="/no">';</script><style>a{}<a href="/no"></style><abbr href="/no">x</abbr>
    <a name="n">x</a><a href="">x</a><a class="x"href="/f?x='1'">x</a><!--><a href="/g">x</a>"""
    got = graph.links(spark.createDataFrame([(1, "https://h/p", page), (2, "u", None)], "page_id bigint, url string, html string"))
    assert [r.href for r in got.collect()] == ["/a", "/b", "/c", "/d", "/e", "", "/f?x='1'", "/g"]
    assert [r.url for r in got.collect()][:2] == ["https://h/a", "https://h/b"]
