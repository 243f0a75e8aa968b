from seamount.sources.pages import images, page_images

PAGE = """<html><h1 id="firstHeading"> Red <i>fox</i> </h1><!-- <figure><a href=x><img src=no.png></a></figure> -->
<table class="infobox biota"><tr><td><img src="../a.png" alt=" A "><img alt="without"></td></tr></table><b>x</b><p> Next <i>to</i> it </p>
<div id="bodyContent"><script>var no = "<p>";</script>One &amp; two
<div class="box thumb"><div class="thumbimage" alt=" alt " title="t"><a href=""><b><img src="//h/b.png"></b><img src="second.png"></a><a><img src="no.png"></a></div>
<div class="thumbcaption"> Cap <i>tion</i></div></div><p>Behind</p>
<p> before </p><figure><a href="/f"><img src="c.png" alt=" c " title="T"></a><figcaption>Fig</figcaption></figure>
<figure><a href="/g"><img src="d.png"></a></figure></div>
<div id="mw-normal-catlinks"><a href="#">Categories</a><ul><li><a>Foxes</a></li><li><a> Red </a></li></ul></div></html>"""


def test_forms():
    got = images("http://h.org/w/x/Fox", PAGE)
    assert {r[:3] == ("http://h.org/w/x/Fox", "Redfox", ["Foxes", "Red"]) for r in got} == {True}
    assert [(r[3], r[4], r[5], r[7], r[8]) for r in got] == [
        ("http://h.org/w/a.png", "A", "", "Nexttoit", "Infobox Image"),
        ("http://h/b.png", "alt", "t", "Behind", "Caption"),
        ("http://h.org/w/x/c.png", " c ", "T", " before  ", "Fig"),
        ("http://h.org/w/x/d.png", "", "", " before  ", "No caption available"),
    ]
    assert got[0][6] == "One & twoCaptionBehindbeforeFig"


def test_edges(spark):
    assert images("u", "<p>no body</p>") == [] and images(None, None) == []
    (bare,) = images(None, "<div id=bodyContent></i><figure><a href><img src='http://[x'>")
    assert bare == ("", "No title", [], "http://[x", "", "", "No body text", "No surrounding text", "No caption available")
    assert len(images("", "<div id=bodyContent>" + "<figure><a href><img src=x></a></figure>" * 20000)) == 20000
    rows = spark.createDataFrame([("http://h.org/w/x/Fox", PAGE, 1), ("u", None, 2), (None, "", 3)], "url string, html string, page_url int")
    assert [r.image_url for r in page_images(rows).collect()] == ["http://h.org/w/a.png", "http://h/b.png", "http://h.org/w/x/c.png", "http://h.org/w/x/d.png"]
    assert page_images(rows.limit(0)).count() == 0
