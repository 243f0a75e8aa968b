"""Long tables of values, their summaries over queries, and z-scores against reference runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamount.sources import files

from . import measures as M
from .judge import EvalParams

MISSING_Z = -1000000.0


def longer(values: DataFrame) -> DataFrame:
    """qid, measure, value of a wide table of numbers."""
    names = [c for c in values.columns if c != "qid" and dict(values.dtypes)[c] != "string"]
    return values.select("qid", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"`{n}`").cast("double").alias("value")) for n in names])).alias("m")).select("qid", "m.*")


def _kind(asked) -> dict[str, str]:
    p = EvalParams()
    return {k + m.suffix: m.summary for m, values in asked if m.kind != "prefs" for k in m.columns(p, *values)}


def summarize(values: DataFrame, names: list[str], p: EvalParams, all_queries: DataFrame | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
    """measure, qid ('all'), value: sums, means or geometric means of long values.

    all_queries (qid, any_rel): with p.complete, means are over all of these; a missing query's geometric value is that of
    the least allowed, and num_rel counts all levels over 0 in all judgments.
    """
    kinds = kinds or _kind([x for n in names for x in M.parse(n)])
    how = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    sums = values.groupBy("measure").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    if p.complete:
        every = all_queries.agg(F.count("*").alias("total"), F.sum("any_rel").cast("double").alias("rel_any"))
        sums = sums.crossJoin(F.broadcast(every))  # one row
    else:
        sums = sums.withColumn("total", F.col("n")).withColumn("rel_any", F.lit(None).cast("double"))
    kind = F.try_element_at(how, F.col("measure"))
    value = (
        F.when((F.col("measure") == "num_q") & F.lit(p.complete), F.col("total").cast("double"))
        .when((F.col("measure") == "num_rel") & F.lit(p.complete), F.col("rel_any"))
        .when(kind == M.SUM, F.col("s"))
        .when(kind == M.GEOMETRIC, F.exp((F.col("s") + (F.col("total") - F.col("n")) * F.ln(F.lit(M.LEAST))) / F.col("total")))
        .otherwise(F.col("s") / F.col("total"))
    )
    return sums.select("measure", F.lit("all").alias("qid"), value.alias("value"))


def evaluate(run: DataFrame, qrels: DataFrame, names: list[str], p: EvalParams = EvalParams(), z: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(values by query, summary), both (measure, qid, value). z: reference means and deviations, for z-scores.

    ValueError if no query has both a run and judgments.
    """
    if p.query is not None:
        run = run.where(F.col("qid") == p.query)
    common(run, qrels)
    values = longer(M.wide(run, qrels, names, p))
    if z is not None:
        values = z_scores(values, z)
    from .judge import topics

    facts = topics(run, qrels, p).select("qid", "any_rel") if p.complete else None
    return values.select("measure", "qid", "value"), summarize(values, names, p, facts)


def evaluate_groups(run: DataFrame, qrels: DataFrame, names: list[str], p: EvalParams = EvalParams()) -> tuple[DataFrame, DataFrame]:
    if p.query is not None:
        run = run.where(F.col("qid") == p.query)
    common(run, qrels)
    values = longer(M.wide_groups(run, qrels, names, p))
    return values.select("measure", "qid", "value"), summarize(values, names, p)


def common(run: DataFrame, qrels: DataFrame) -> None:
    """ValueError if no query has both a run and judgments; only the queries' ids are read, up to the first that has."""
    if run.select("qid").join(qrels.select("qid").distinct(), "qid", "left_semi").isEmpty():
        raise ValueError("no query has both a run and judgments")


def require_common(values: DataFrame) -> DataFrame:
    """values; ValueError if no query has both a run and judgments."""
    if values.isEmpty():
        raise ValueError("no query has both a run and judgments")
    return values


def z_scores(values: DataFrame, reference: DataFrame) -> DataFrame:
    """(value - mean) / deviation by query and measure (num_q stays); MISSING_Z without a reference, 0 at a deviation of 0 if equal."""
    both = values.join(reference, ["qid", "measure"], "left")
    z = (
        F.when(F.col("measure") == "num_q", F.col("value"))
        .when(F.col("mean").isNull(), MISSING_Z)
        .when(F.col("stddev") == 0, F.when(F.col("value") == F.col("mean"), 0.0).otherwise(MISSING_Z))
        .otherwise((F.col("value") - F.col("mean")) / F.col("stddev"))
    )
    return both.select("qid", "measure", z.alias("value"))


def z_reference(values: DataFrame) -> DataFrame:
    """qid, measure, mean and sample deviation over many runs' values."""
    return values.groupBy("qid", "measure").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stddev"))


def runid(run: DataFrame) -> DataFrame:
    return run.agg(F.max("run_id").alias("value")).select(F.lit("runid").alias("measure"), F.lit("all").alias("qid"), "value")


#: Measures whose values stand in summaries only.
SUMMARY_ONLY = ("num_q", "gm_map", "gm_bpref")


def _shown(name: str) -> dict[str, str]:
    """The columns of an asked measure, in order, each with its name in a report: parameters of single values follow it."""
    head, _, rest = name.partition(".")
    if head in M.SETS and not rest:
        return {k: v for n in M.SETS[head] for k, v in _shown(n).items()}
    ((m, values),) = M.parse(name)
    if m.kind == "run":
        return {head: head}
    columns = [k + m.suffix for k in m.columns(EvalParams(), *values)]
    if head == "relstring" and not rest:
        return {columns[0]: head}
    return {columns[0]: f"{head}_{rest}"} if rest and head in ("utility", "11pt_avg", "set_F") else {k: k for k in columns}


def report_lines(run: DataFrame, qrels: DataFrame, names: list[str], p: EvalParams = EvalParams(), by_query: bool = False, z: DataFrame | None = None) -> DataFrame:
    """part, qid, place, line of a report: values by query (part 0) if asked for, then the summary (part 1), measures in their order.

    runid is a line of the summary if it is asked for and the run has a run_id; relstring stands in the queries' parts.
    """
    shown = {k: v for n in names for k, v in _shown(n).items()}
    values, total = evaluate(run, qrels, names, p, z)
    renamed = F.create_map(*[F.lit(x) for kv in shown.items() for x in kv])
    place = F.create_map(*[F.lit(x) for kv in zip(shown.values(), range(len(shown))) for x in kv])

    def part(rows: DataFrame, number: int) -> DataFrame:
        rows = rows.withColumn("measure", F.try_element_at(renamed, F.col("measure")))
        return files.score_lines(rows, z is not None).withColumn("part", F.lit(number))

    def text(rows: DataFrame, name: str, column: str, number: int) -> DataFrame:
        line = F.concat_ws("\t", F.format_string("%-22s", F.lit(name)), "qid", f"`{column}`")
        return rows.select(F.lit(name).alias("measure"), "qid", line.alias("line"), F.lit(number).alias("part"))

    lines = part(total, 1)
    if by_query:
        lines = lines.unionByName(part(values.where(~F.col("measure").isin(*SUMMARY_ONLY)), 0))
        if first := [k for k in shown if k.startswith("relstring")]:
            own = run if p.query is None else run.where(F.col("qid") == p.query)
            strings = M.wide(own, qrels, [k.replace("_", ".") for k in first], p)
            for k in first:
                lines = lines.unionByName(text(strings, shown[k], k, 0))
    if "runid" in shown and "run_id" in run.columns:
        lines = lines.unionByName(text(runid(run), "runid", "value", 1))
    return lines.select("part", "qid", F.try_element_at(place, F.regexp_replace("measure", "^Z", "")).alias("place"), "line")


def explain(run: DataFrame, qrels: DataFrame, p: EvalParams = EvalParams()) -> DataFrame:
    """The judged ranking row by row, with running precision and recall at relevant documents."""
    from . import judge as J

    rows = J.counted(J.judge(run, qrels, p), J.topics(run, qrels, p).drop("in_run"), p)
    precision, recall = F.col("cr") / F.col("rank"), F.try_divide(F.col("cr"), F.col("n_rel"))
    return rows.select("qid", "rank", "docno", "rel", F.when(F.col("hit") == 1, precision).alias("precision"), F.when(F.col("hit") == 1, recall).alias("recall"))
