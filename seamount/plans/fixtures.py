"""Inputs of the reference queries, made from whole tables, each beside the DuckDB SQL of the same relation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamount.operators import index as I
from seamount.sources.collections import table
from seamount.sources.shared import keep

WORD = r"[\p{L}\p{N}]+"

# Retrieval: documents are the corpus, the items of benchmark the queries


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def tokenized(spark: SparkSession, sf: str) -> DataFrame:
    return I.tokenized(documents(spark, sf))


def written(spark: SparkSession, sf: str) -> DataFrame:
    """The tokenized documents as a written table: rankers go over them more than once, the texts are cut once."""
    return keep(tokenized(spark, sf), "words")


def queries(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


def terms(spark: SparkSession, sf: str) -> DataFrame:
    return I.query_terms(queries(spark, sf))


CORPUS = rf"""
docs AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS words FROM documents),
lens AS (SELECT doc_id, len(words)::BIGINT AS len FROM docs),
posts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM docs) GROUP BY doc_id, term),
stats AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM posts GROUP BY term),
coll AS (SELECT count(*) AS n_docs, sum(len) AS total_terms, sum(len)::DOUBLE / count(*) AS avgdl, (SELECT count(*) FROM stats) AS vocab FROM lens),
terms AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{WORD}')) AS term FROM benchmark) GROUP BY item_id, term)"""

# Evaluation: a user's events are ranked by their value (whole numbers, so that there are ties); errors aren't retrieved
# and signups aren't judged. The level is that of the event's kind.

LEVELS = "CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'error' THEN 3 ELSE CASE WHEN value < 5 THEN -1 ELSE 0 END END"


def run(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").where("event_type <> 'error'")
    return events.select(F.col("user_id").cast("string").alias("qid"), F.col("event_id").cast("string").alias("docno"), F.floor("value").cast("double").alias("sim"), F.lit("events").alias("run_id"))


def judgments(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").where("event_type <> 'signup'")
    return events.select(F.col("user_id").cast("string").alias("qid"), F.col("event_id").cast("string").alias("docno"), F.expr(f"cast({LEVELS} AS bigint)").alias("rel"))


def group_judgments(spark: SparkSession, sf: str) -> DataFrame:
    """Two groups of judges: one by kind, one by value."""
    events = table(spark, sf, "events").where("event_type <> 'signup'")
    who = [F.col("user_id").cast("string").alias("qid"), F.col("event_id").cast("string").alias("docno")]
    by_kind = events.select(*who, F.lit("kind").alias("jg"), F.expr(f"cast({LEVELS} AS bigint)").alias("rel"))
    return by_kind.union(events.select(*who, F.lit("value").alias("jg"), F.expr("cast(value >= 30 AS bigint)").alias("rel")))


EVENTS = f"""
run AS (SELECT user_id::VARCHAR AS qid, event_id::VARCHAR AS docno, floor(value)::DOUBLE AS sim FROM events WHERE event_type <> 'error'),
qrels AS (SELECT user_id::VARCHAR AS qid, 'kind' AS jg, event_id::VARCHAR AS docno, ({LEVELS})::BIGINT AS rel FROM events WHERE event_type <> 'signup')"""

EVENT_GROUPS = f"""
run AS (SELECT user_id::VARCHAR AS qid, event_id::VARCHAR AS docno, floor(value)::DOUBLE AS sim FROM events WHERE event_type <> 'error'),
qrels AS (SELECT user_id::VARCHAR AS qid, 'kind' AS jg, event_id::VARCHAR AS docno, ({LEVELS})::BIGINT AS rel FROM events WHERE event_type <> 'signup'
          UNION ALL SELECT user_id::VARCHAR, 'value', event_id::VARCHAR, (value >= 30)::BIGINT FROM events WHERE event_type <> 'signup')"""

# Preferences: the turns of a conversation are ranked by length in hundreds of characters; short ones aren't retrieved.
# Group a judges all turns once, group b in two overlapping sub-groups, so that preferences follow from others.


def turn_run(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").where("length(text) >= 100")
    return turns.select(F.col("conv_id").cast("string").alias("qid"), F.col("turn").cast("string").alias("docno"), F.floor(F.length("text") / 100).cast("double").alias("sim"), F.lit("turns").alias("run_id"))


def turn_preferences(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("qid"), "turn", "role")
    who = ["qid", "jg", "jsg", F.col("turn").cast("string").alias("docno"), "rel_level"]
    a = turns.withColumns({"jg": F.lit("a"), "jsg": F.lit("0"), "rel_level": F.expr("CASE WHEN role = 'assistant' THEN cast(1 + turn % 3 AS double) ELSE 0D END")})
    b = turns.withColumns({"jg": F.lit("b"), "rel_level": F.col("turn").cast("double"), "jsg": F.explode(F.expr("CASE WHEN turn < 3 THEN array('u') WHEN turn = 3 THEN array('u', 'v') ELSE array('v') END"))})
    return a.select(*who).union(b.select(*who))


TURNS = """
run AS (SELECT conv_id::VARCHAR AS qid, turn::VARCHAR AS docno, floor(length(text) / 100)::DOUBLE AS sim FROM conversations WHERE length(text) >= 100),
prefs AS (SELECT conv_id::VARCHAR AS qid, 'a' AS jg, '0' AS jsg, turn::VARCHAR AS docno, CASE WHEN role = 'assistant' THEN 1 + turn % 3 ELSE 0 END::DOUBLE AS rel_level FROM conversations
          UNION ALL SELECT conv_id::VARCHAR, 'b', unnest(CASE WHEN turn < 3 THEN ['u'] WHEN turn = 3 THEN ['u', 'v'] ELSE ['v'] END), turn::VARCHAR, turn::DOUBLE FROM conversations)"""
