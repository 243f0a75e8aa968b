"""The stems of whole tables are those of the column function."""

from pyspark.sql import functions as F

from seamount.functions import text as T


def test_stems_of_tables(spark):
    ends = ["", "s", "es", "ies", "sses", "ed", "eed", "ing", "y", "e", "ll", "ational", "ization", "iveness", "biliti", "icate", "ful", "ness", "ement", "ion", "tion", "ous", "bled", "izing", "at", "ator", "alli"]
    words = [a + b for a in ("", "a", "y", "yy", "b", "s", "st", "rel", "controll", "hopp", "fil", "tr", "Ÿ9", "generali", "happ", "cre", "sky", "toy", "𝒜b") for b in ends]
    d = spark.createDataFrame([(1, words), (2, []), (3, None), (4, words[::-1] * 3)], "doc_id bigint, words array<string>")
    got = {r.doc_id: r.words for r in T.with_stems(d).collect()}
    assert got == {r.doc_id: r.w for r in d.select("doc_id", T.stems("words").alias("w")).collect()} and got[3] is None


def test_a_word_is_stemmed_once(spark, monkeypatch):
    plan = T.with_stems(spark.range(1).select(F.array(F.lit("flies")).alias("words")))._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "transform(" not in plan
