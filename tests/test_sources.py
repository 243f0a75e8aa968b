import bz2
import gzip

import pytest

from seamount.sources import collections as C
from seamount.sources import files as S


def written(tmp_path, name, text, pack=lambda b: b):
    (tmp_path / name).write_bytes(pack(text.encode()))
    return str(tmp_path / name)


def test_judgments(spark, tmp_path):
    text = "# by hand\n1 0 d1 1\n1\t0  d2   -1\n2 0 d1 2x\n"
    for name, pack in (("q.txt", lambda b: b), ("q.gz", gzip.compress), ("q.bz2", bz2.compress)):
        rows = S.read_judgments(spark, written(tmp_path, name, text, pack)).collect()
        assert sorted(map(tuple, rows)) == [("1", "d1", 1), ("1", "d2", -1), ("2", "d1", 2)]
    for bad in ("1 0 d1\n", "1 0 d1 1 x\n", "\n"):
        with pytest.raises(Exception, match="not a line"):
            S.read_judgments(spark, written(tmp_path, "bad.txt", bad)).collect()


def test_groups_and_preferences(spark, tmp_path):
    path = written(tmp_path, "g", "1 u1 d1 1\n1 u2 d1 0\n")
    assert S.read_group_judgments(spark, path).count() == 2
    with pytest.raises(Exception, match="twice"):
        S.read_group_judgments(spark, written(tmp_path, "g2", "1 u1 d1 1\n1 u1 d1 0\n")).collect()
    assert tuple(S.read_preferences(spark, written(tmp_path, "p", "1 j s d1 1.5\n")).first()) == ("1", "j", "s", "d1", 1.5)
    assert tuple(S.judgments_as_preferences(spark, path).orderBy("jg").first()) == ("1", "u1", "0", "d1", 1.0)
    assert tuple(S.read_reference_scores(spark, written(tmp_path, "z", "1 map 0.5 0.1\n")).first()) == ("1", "map", 0.5, 0.1)


def test_runs(spark, tmp_path):
    rows = S.read_run(spark, written(tmp_path, "r", "# c\n1 Q0 d1 9 2.5 x\n\n1 Q0 d2 1 3.5 y more\n")).orderBy("docno").collect()
    assert [tuple(r) for r in rows] == [("1", "d1", 2.5, "y"), ("1", "d2", 3.5, "y")]
    run = spark.createDataFrame([("1", f"d{i}", i + 1, 9.0 - i) for i in range(3)], "qid string, docno string, rank int, sim double")
    S.write_run(run, str(tmp_path / "out"), depth=2)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1 Q0 d0 1 9.0 STANDARD", "1 Q0 d1 2 8.0 STANDARD"]


def test_markup(spark, tmp_path):
    doc = "<doc><docno> {} </docno><title>T &amp; t</title><author/><bib>b</bib><text>x\n &lt;y&gt;</text></doc>\n"
    written(tmp_path, "cran.all.1", doc.format(1) + doc.format(2).replace("<bib>b</bib>", ""))
    written(tmp_path, "other", doc.format(3))
    assert [tuple(r) for r in C.read_documents(spark, str(tmp_path)).collect()] == [("1", "T & t", "", "b", "x\n <y>")]
    with pytest.raises(ValueError):
        written(tmp_path, "empty.1", "")
        C.read_documents(spark, str(tmp_path), "empty")
    tops = C.read_queries(spark, written(tmp_path, "q.xml", "<xml><top><num>9</num><title>one</title></top><top><num>7</num><title>two</title></top></xml>"))
    assert [tuple(r) for r in tops.orderBy("qid").collect()] == [("1", "one"), ("2", "two")]


def test_crawl_and_index(spark, tmp_path):
    path = written(tmp_path, "c.json", '{"image_data": [{"image_url": "u", "categories": ["a"]}, {"page_url": "p"}], "visited_map": {}}')
    rows = {r.image_url: r for r in C.read_crawl(spark, path).collect()}
    assert rows["u"].categories == ["a"] and rows["u"].caption == "" and rows[""].categories == []
    from seamount.operators import index as I

    C.write_index(I.build(spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id bigint, text string")), str(tmp_path / "index"))
    index = C.read_index(spark, str(tmp_path / "index"))
    assert sorted(map(tuple, index["postings"].collect())) == [(1, "a", 2), (1, "b", 1)]
    assert tuple(index["corpus_stats"].first()) == (2, 3, 1.5)
