from seamount.sources import collections as C


def test_records_of_earlier_calls_stay(spark, tmp_path):
    path = str(tmp_path / "crawl")
    rows = lambda *r: spark.createDataFrame(r, "image_url string, caption string, categories array<string>")
    C.write_crawl(rows(("u", "old", ["a"]), ("v", "old", []), (None, "old", None)), path)
    C.write_crawl(rows(("w", "b", []), ("v", "new", ["c"]), ("w", "a", ["x"]), (None, "new", None)), path)
    got = spark.read.schema("image_url string, caption string, categories array<string>").json(path).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("u", "old", ["a"]), ("v", "new", ["c"]), ("w", "b", []), (None, "new", None)], key=str)
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["crawl"]
