"""Line formats: judgments, grouped judgments, preferences, runs and reference scores.

Fields are parted by white space. Compressed files (.gz, .bz2) are read by their endings. A line that doesn't
have the fields of its format stops the query with its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAP = r"[ \t\r\x0B\f]+"


def _whole(text: Column) -> Column:
    """The integer at the beginning of a text; 0 if there is none."""
    return F.coalesce(F.regexp_extract(text, r"^([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))


def _fields(lines: DataFrame, names: list[str], what: str, exact: bool = True) -> DataFrame:
    parts = F.split(F.trim(F.regexp_replace("value", GAP, " ")), " ")
    right = F.size("p") == len(names) if exact else F.size("p") >= len(names)
    checked = F.when(right & (F.col("p")[0] != ""), F.col("p")).otherwise(F.raise_error(F.concat(F.lit(f"not a line of {what}: "), "value")).cast("array<string>"))
    return lines.select("value", parts.alias("p")).select(checked.alias("p")).select(*[F.col("p")[i].alias(n) for i, n in enumerate(names)])


def unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """df; a key that occurs twice stops the query."""
    n = F.count("*").over(Window.partitionBy(*keys))
    wrong = F.raise_error(F.concat(F.lit(f"{what} twice: "), F.concat_ws(" ", *keys))).cast("boolean")
    return df.withColumn("_n", n).where(F.when(F.col("_n") > 1, wrong).otherwise(True)).drop("_n")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    """qid, docno, rel from lines ``qid iteration docno rel``; lines that begin with # are comments."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    return _fields(lines, ["qid", "iter", "docno", "rel"], "judgments").select("qid", "docno", _whole(F.col("rel")).alias("rel"))


def read_group_judgments(spark: SparkSession, path: str) -> DataFrame:
    """qid, jg, docno, rel: judgments by groups of judges, each document at most once in a group."""
    rows = _fields(spark.read.text(path), ["qid", "jg", "docno", "rel"], "group judgments").select("qid", "jg", "docno", _whole(F.col("rel")).alias("rel"))
    return unique(rows, ["qid", "jg", "docno"], "a judged document")


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """qid, jg, jsg, docno, rel_level: graded preferences within a sub-group of a judgment group."""
    rows = _fields(spark.read.text(path), ["qid", "jg", "jsg", "docno", "rel_level"], "preferences")
    return rows.withColumn("rel_level", F.col("rel_level").cast("double"))


def judgments_as_preferences(spark: SparkSession, path: str) -> DataFrame:
    """Judgments read as preferences: the iteration is the group, and there is one sub-group."""
    rows = _fields(spark.read.text(path).where(~F.col("value").startswith("#")), ["qid", "jg", "docno", "rel"], "judgments")
    return rows.select("qid", "jg", F.lit("0").alias("jsg"), "docno", F.col("rel").cast("double").alias("rel_level"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """qid, docno, sim, run_id from ``qid Q0 docno rank sim run_id``; the rank is ignored, the last line names the run."""
    lines = spark.read.text(path).where((F.trim(F.regexp_replace("value", GAP, " ")) != "") & ~F.col("value").startswith("#"))
    rows = _fields(lines.withColumn("_at", F.monotonically_increasing_id()), ["qid", "q0", "docno", "rank", "sim", "run_id"], "a run", exact=False)
    tag = rows.withColumn("_at", F.monotonically_increasing_id()).agg(F.max_by("run_id", "_at").alias("run_id"))
    return rows.select("qid", "docno", F.col("sim").cast("double").alias("sim")).crossJoin(F.broadcast(tag))  # one row


def read_reference_scores(spark: SparkSession, path: str) -> DataFrame:
    """qid, measure, mean, stddev."""
    rows = _fields(spark.read.text(path), ["qid", "measure", "mean", "stddev"], "reference scores")
    return rows.select("qid", "measure", F.col("mean").cast("double").alias("mean"), F.col("stddev").cast("double").alias("stddev"))


def run_lines(run: DataFrame, run_id: str = "STANDARD", depth: int = 100) -> DataFrame:
    """The lines of a run file: the first ``depth`` of each query by rank."""
    line = F.concat_ws(" ", "qid", F.lit("Q0"), "docno", F.col("rank").cast("string"), F.col("sim").cast("string"), F.lit(run_id))
    return run.where(F.col("rank") <= depth).select("qid", "rank", line.alias("line"))


def write_run(run: DataFrame, path: str, run_id: str = "STANDARD", depth: int = 100) -> None:
    run_lines(run, run_id, depth).repartitionByRange("qid").sortWithinPartitions("qid", "rank").select("line").write.mode("overwrite").text(path)


def score_lines(scores: DataFrame, z: bool = False) -> DataFrame:
    """``measure``, tab, ``qid``, tab, value with four decimals (counts without) for (measure, qid, value) rows."""
    counts = F.col("measure").isin("num_q", "num_ret", "num_rel", "num_rel_ret", "num_nonrel_judged_ret", "prefs_num_prefs_poss", "prefs_num_prefs_ful", "prefs_num_prefs_ful_ret")
    name = F.format_string("%-22s", F.concat(F.lit("Z" if z else ""), "measure"))  # longer names stay whole
    shown = F.when(counts & F.lit(not z), F.format_string("%d", F.col("value").cast("bigint"))).otherwise(F.format_string("%6.4f", "value"))
    return scores.select("measure", "qid", F.concat_ws("\t", name, "qid", shown).alias("line"))
