"""A session with the settings the engine is written for; on a cluster the submitter's own settings win."""

from pyspark.sql import SparkSession


def get_session(name: str = "seamount", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    return builder.config(map=defaults | {k.replace("_", "."): v for k, v in settings.items()}).getOrCreate()
