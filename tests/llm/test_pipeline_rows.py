"""The stages of the pipeline decide by row: null and shared ids take no other document along, and one row of a group stays."""

import corpus_pipeline
from seamount.llm import decontaminate, near_dedup

SCHEMA = "doc_id bigint, text string, source string, key string"
LONG = " ".join(f"w{i}" for i in range(60))
NEAR = LONG + " more"
OTHER = " ".join(f"o{i}" for i in range(60))


def key(r):
    return tuple(str(x) for x in r)


def test_one_row_of_each_group(spark):
    rows = [
        (1, LONG, "a", "x"), (None, NEAR, "a", "x"), (None, OTHER, "a", "x"), (None, "alone and unlike", None, "x"),
        (5, LONG, "b", "x"), (5, "five with another text", "b", "x"), (7, "seven twice the same", None, "x"), (7, "seven twice the same", None, "x"),
        (None, "no id three times over", "b", "x"), (None, "no id three times over", "b", "x"), (None, "no id three times over", None, "b"),
        (8, "", "s", "x"), (8, "", "s", "x"), (9, None, "s", "x"),
    ]
    want = [rows[i] for i in (0, 2, 3, 5, 6, 11, 12, 13)]
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    last = [r for r in got if r[1] == rows[8][1]]
    assert len(last) == 1 and last[0] in rows
    assert sorted((r for r in got if r not in last), key=key) == sorted(want, key=key)
    again = near_dedup.one_of_each(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, again), key=key) == sorted(got, key=key)
    assert near_dedup.one_of_each(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clean_rows_of_a_hit_id(spark):
    items = spark.createDataFrame([(1, " ".join(LONG.split()[10:25]))], "item_id bigint, text string")
    rows = [(7, LONG, "a", "x"), (7, "other text", "a", "x"), (None, NEAR, "a", "x"), (None, OTHER, "a", "x"), (None, None, "a", "x"), (8, "", "a", "x"), (8, "", "a", "x")]
    got = decontaminate.clean_rows(spark.createDataFrame(rows, SCHEMA), items)
    assert got.columns == ["doc_id", "text", "source", "key"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted((r for r in rows if r[1] not in (LONG, NEAR)), key=key)
