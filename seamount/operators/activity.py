"""What users do with results: views by query and document, dwell times, and a text log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BOOST = 0.1


def interactions(clicks: DataFrame) -> DataFrame:
    """query, doc_id, views and score_boost (0.1 a view) of click events (query, doc_id)."""
    return clicks.groupBy("query", "doc_id").agg(F.count("*").alias("views"), F.round(F.count("*") * BOOST, 6).alias("score_boost"))


def dwell(events: DataFrame) -> DataFrame:
    """Microseconds from each open event to the close of the same user and document that follows it directly.

    events: event_id, ts, user_id, doc_id, kind ('open' or 'close'). A close without an open is ignored.
    """
    w = Window.partitionBy("user_id", "doc_id").orderBy("ts", "event_id")
    following = events.withColumns({"next_kind": F.lead("kind").over(w), "closed": F.lead("ts").over(w)})
    return following.where("kind = 'open' AND next_kind = 'close'").select("event_id", "user_id", "doc_id", F.timestamp_diff("MICROSECOND", "ts", "closed").alias("dwell_us"))


def log_lines(events: DataFrame) -> DataFrame:
    """One line a search, click or close: time, kind, user and what it is about."""
    return events.select("event_id", F.format_string("%s %s user=%d %s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.upper("kind"), F.col("user_id"), F.coalesce("about", F.lit(""))).alias("line"))
