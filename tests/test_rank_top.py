"""The best documents of the language models are those of the whole list, and other small rules."""

from pyspark.sql import functions as F

from seamount.functions import text as T
from seamount.operators import graph
from seamount.operators import index as I
from seamount.operators import rank as R
from seamount.operators import results as O
from seamount.sources.files import score_lines


def test_language_model_top(spark):
    rows = [(i, " ".join(["a b", "c", "b b d", "", "e f g"][i % 5] for _ in range(1 + i % 3))) for i in range(60)] + [(60, None)]
    docs = I.tokenized(spark.createDataFrame(rows, "doc_id bigint, text string"))
    terms = I.query_terms(spark.createDataFrame([(1, "a b b"), (2, "zzz"), (3, "a b c d e f g"), (4, "d zzz")], "qid bigint, text string"))
    for smoothing in ("dirichlet", "jm"):
        want = R.top(R.language_model(docs, terms, smoothing), 7).select("qid", "doc_id", "score", "rank").collect()
        for head in (1, 100):
            got = R.language_model_top(docs, terms, 7, smoothing, head=head).select("qid", "doc_id", "score", "rank").collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 28
    none = I.tokenized(spark.createDataFrame([], "doc_id bigint, text string"))
    assert R.language_model_top(none, terms, 7).count() == 0


def test_page_bound_inside_a_level(spark):
    edges = spark.createDataFrame([("s", f"p{i}") for i in range(9)] + [("p0", "q")], "src string, dst string")
    seeds = spark.createDataFrame([("s",)], "url string")
    got = {r.url for r in graph.breadth_first(edges, seeds, 3, max_pages=3).collect()}
    assert got == {"s", "p0", "p1", "p2"}
    assert graph.breadth_first(edges, seeds, 3, max_pages=100).count() == 11


def test_dots_in_addresses(spark):
    cases = [("../x", "http://h/a/x"), ("../../../x?q=../y", "http://h/x?q=../y"), ("./x", "http://h/a/b/x"), ("..", "http://h/a/"), ("/a/./b/../c#f", "http://h/a/c#f"), ("x..y", "http://h/a/b/x..y")]
    rows = spark.createDataFrame([(c,) for c, _ in cases], "link string").select(T.absolute_url(F.lit("http://h/a/b/page"), "link").alias("u"))
    assert [r.u for r in rows.collect()] == [u for _, u in cases]


def test_long_names_of_measures_stay_whole(spark):
    rows = spark.createDataFrame([("prefs_num_prefs_ful_ret", "all", 3.0), ("map", "all", 0.25)], "measure string, qid string, value double")
    assert [r.line for r in score_lines(rows).collect()] == ["prefs_num_prefs_ful_ret\tall\t3", "map" + " " * 19 + "\tall\t0.2500"]


def test_page_links_and_fetchable(spark):
    rows = spark.createDataFrame([(1, 3), (8, 30), (30, 30), (1, 0)], "n bigint, p bigint")
    assert [r.x for r in rows.select(O.page_links(F.col("n"), F.col("p")).alias("x")).collect()] == [[1, 2, 3], list(range(3, 14)), list(range(25, 31)), []]
    images = spark.createDataFrame([("http://b", 2), ("ftp://a", 1), (None, 3), ("https://c", 4)], "image_url string, place bigint")
    assert {r.image_url for r in O.fetchable(images, "place").collect()} == {"http://b", "https://c"}
    assert [r.image_url for r in O.fetchable(images, "place", 2).collect()] == ["http://b"]
