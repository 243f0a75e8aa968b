"""Judged rankings: a run joined to relevance judgments, with the running counts that the measures share.

The ranking of a query is by sim, then docno, both descending; ranks in the input are ignored. rel is the judged
level, -1 for a document without a judgment, -2 for one that was pooled but not judged (a negative level).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamount.sources.files import unique

NOT_POOLED, NOT_JUDGED = -1, -2


@dataclass(frozen=True)
class EvalParams:
    level: int = 1  #: a document is relevant from this level on
    depth: int | None = None  #: ranks beyond it are dropped before the judgments are joined
    judged_only: bool = False  #: drop documents without a judgment and rank again
    complete: bool = False  #: average over all judged queries, those without a result counting 0
    n_docs: int = 0  #: documents in the collection, for utility
    query: str | None = None  #: evaluate this query only
    gains: dict[int, float] = field(default_factory=dict)  #: gains by level, where they aren't the level itself

    def gain(self, rel: Column) -> Column:
        """The gain of a level; what isn't judged gains nothing."""
        out = F.greatest(rel, F.lit(0)).cast("double")
        for level, value in self.gains.items():
            out = F.when(rel == level, float(value)).otherwise(out)
        return F.when(rel < 0, 0.0).otherwise(out)

    def listed(self, most: Column) -> list[Column]:
        """The greatest gain of levels up to ``most`` that aren't overridden, and all that are given, documents or none."""
        plain = [F.when((most - i < 0) | (most - i).isin(*self.gains), 0.0).otherwise((most - i).cast("double")) for i in range(len(self.gains) + 1)] if self.gains else []
        return [F.lit(0.0), *plain, *[F.lit(float(x)) for x in self.gains.values()]]


def judge(run: DataFrame, qrels: DataFrame, p: EvalParams, *groups: str) -> DataFrame:
    """qid, docno, rank, rel (and the groups' columns) of queries that have a run and judgments.

    groups: further key columns of the judgments, such as judgment groups; each gets the whole ranking.
    A document that is retrieved or judged twice stops the query.
    """
    run = unique(run.select("qid", "docno", "sim"), ["qid", "docno"], "a retrieved document")
    if p.depth is not None:
        order = Window.partitionBy("qid").orderBy(F.desc("sim"), F.desc("docno"))
        run = run.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= p.depth).drop("_r")
    keys = ["qid", *groups]
    run = run.join(qrels.select(*keys).distinct(), "qid")
    rel = unique(qrels.select(*keys, "docno", F.col("rel").alias("_rel")), [*keys, "docno"], "a judged document")
    both = run.join(rel, [*keys, "docno"], "left")
    both = both.withColumn("rel", F.when(F.col("_rel").isNull(), NOT_POOLED).when(F.col("_rel") < 0, NOT_JUDGED).otherwise(F.col("_rel")))
    if p.judged_only:
        both = both.where("rel >= 0")
    order = Window.partitionBy(*keys).orderBy(F.desc("sim"), F.desc("docno"))
    return both.select(*keys, "docno", F.row_number().over(order).alias("rank"), "rel")


def topics(run: DataFrame, qrels: DataFrame, p: EvalParams, *groups: str) -> DataFrame:
    """Facts of each judged query: n_rel (relevant), n_nonrel (judged, not relevant), n_gain (positive gains), any_rel (over 0)."""
    keys = ["qid", *groups]
    gain = p.gain(F.col("rel"))
    facts = qrels.groupBy(*keys).agg(
        F.count_if(F.col("rel") >= p.level).alias("n_rel"),
        F.count_if((F.col("rel") >= 0) & (F.col("rel") < p.level)).alias("n_nonrel"),
        F.count_if(gain > 0).alias("n_gain"),
        F.greatest(F.max(gain), *p.listed(F.greatest(F.max("rel"), F.lit(0)))).alias("max_gain"),
        F.least(F.min(gain), F.lit(0.0), *[F.lit(float(x)) for x in p.gains.values()]).alias("min_gain"),
        F.sum(F.greatest(gain, F.lit(0.0))).alias("ideal_sum"),
        F.count_if(F.col("rel") > 0).alias("any_rel"),
    )
    found = run.select("qid").distinct().withColumn("_found", F.lit(True))
    return facts.join(found, "qid", "left").withColumn("in_run", F.coalesce("_found", F.lit(False))).drop("_found")


def counted(ranked: DataFrame, facts: DataFrame, p: EvalParams, *groups: str) -> DataFrame:
    """Adds hit (0 or 1), cr (hits up to the rank), and the counts before each rank: nonrel_before, unjudged_before; and the facts."""
    keys = ["qid", *groups]
    w = Window.partitionBy(*keys).orderBy("rank")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = ranked.withColumn("hit", (F.col("rel") >= p.level).cast("int"))
    nonrel = ((F.col("rel") >= 0) & (F.col("rel") < p.level)).cast("int")
    rows = rows.withColumns(
        {
            "cr": F.sum("hit").over(w.rowsBetween(Window.unboundedPreceding, 0)),
            "nonrel_before": F.coalesce(F.sum(nonrel).over(before), F.lit(0)),
            "unjudged_before": F.coalesce(F.sum((F.col("rel") == NOT_JUDGED).cast("int")).over(before), F.lit(0)),
        }
    )
    return rows.join(facts, keys)


def gained(ranked: DataFrame, qrels: DataFrame, facts: DataFrame, p: EvalParams) -> DataFrame:
    """The ranking beside the ideal one, rank by rank, whichever is longer.

    qid, rank, rel (null beyond the run), gain, ideal (0 beyond the positive gains), next_ideal, dcg, idcg, n; and the facts.
    """
    ideal = qrels.select("qid", "docno", p.gain(F.col("rel")).alias("ideal")).where("ideal > 0")
    ideal = ideal.select("qid", "ideal", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("ideal"), "docno")).alias("rank"))
    run = ranked.select("qid", "rank", "rel", p.gain(F.col("rel")).alias("gain"))
    both = run.join(ideal, ["qid", "rank"], "full").join(facts.where("in_run"), "qid")
    both = both.withColumn("gain", F.coalesce("gain", F.lit(0.0))).withColumn("ideal", F.coalesce("ideal", F.lit(0.0)))
    w = Window.partitionBy("qid").orderBy("rank")
    run_w = w.rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns(
        {
            "dcg": F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).over(run_w),
            "idcg": F.sum(F.col("ideal") / F.log2(F.col("rank") + 1.0)).over(run_w),
            "gain_sum": F.sum("gain").over(run_w),
            "cost": F.sum(F.greatest("ideal", F.lit(1.0))).over(run_w),
            "next_ideal": F.coalesce(F.lead("ideal").over(w), F.lit(0.0)),
            "n": F.count("rel").over(Window.partitionBy("qid")),
        }
    )
