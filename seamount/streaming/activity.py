"""The activity operators on streams: counts in update mode, windowed counts with a watermark, dwell by join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamount.operators.activity import BOOST


def interaction_counts(clicks: DataFrame) -> DataFrame:
    """Running views and boost by query and document; for the update or complete output mode."""
    return clicks.groupBy("query", "doc_id").agg(F.count("*").alias("views")).withColumn("score_boost", F.round(F.col("views") * BOOST, 6))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by kind in tumbling windows; events later than the watermark are dropped from closed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def dwell(opens: DataFrame, closes: DataFrame, most: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Pairs of an open and a later close of the same user and document within a bound."""
    a = opens.withWatermark("ts", late).select(F.col("user_id"), F.col("doc_id"), F.col("ts").alias("opened"))
    b = closes.withWatermark("ts", late).select(F.col("user_id").alias("u"), F.col("doc_id").alias("d"), F.col("ts").alias("closed"))
    joined = a.join(b, F.expr(f"user_id = u AND doc_id = d AND closed >= opened AND closed <= opened + interval {most}"))
    return joined.select("user_id", "doc_id", "opened", F.timestamp_diff("MICROSECOND", "opened", "closed").alias("dwell_us"))


def latest(counts: DataFrame) -> DataFrame:
    """Runs a stream of complete results over what there is and returns the last result, as a table in the shared folder."""
    import uuid

    from seamount.sources.shared import folder

    spark = counts.sparkSession
    path = f"{folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result")

    query = counts.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{path}/state").foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{path}/result")
