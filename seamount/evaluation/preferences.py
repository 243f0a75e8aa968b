"""Preference judgments: pairs of documents, one preferred to the other, and how many of them a ranking fulfils.

Judgments (qid, jg, jsg, docno, rel_level) belong to a judgment group and a sub-group. Within a sub-group a document of
a higher level is preferred to one of a lower level. A group with one sub-group counts all its pairs; in a group with
more, equal pairs count once and what follows from two preferences is a preference as well.

Documents get a place among the judged ones of their query: those in the run by rank (sim descending, then docno
*ascending*), then the others by docno. A preference is fulfilled if the preferred document is in the run and has the
lesser place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamount.sources.shared import keep

from . import measures as M
from .judge import EvalParams

GROUP = ["qid", "jg"]


def placed(run: DataFrame, prefs: DataFrame, p: EvalParams = EvalParams()) -> DataFrame:
    """prefs with place (from 0), ret (whether the document is in the run) and n_jsg, of queries that have a run."""
    order = Window.partitionBy("qid").orderBy(F.desc("sim"), "docno")
    ranked = run.select("qid", "docno", F.row_number().over(order).alias("rank"))
    if p.depth is not None:
        ranked = ranked.where(F.col("rank") <= p.depth)
    judged = prefs.select("qid", "docno").distinct().join(run.select("qid").distinct(), "qid", "left_semi").join(ranked, ["qid", "docno"], "left")
    by = Window.partitionBy("qid").orderBy(F.col("rank").isNull(), "rank", "docno")
    places = judged.select("qid", "docno", (F.row_number().over(by) - 1).alias("place"), F.col("rank").isNotNull().alias("ret"))
    groups = prefs.groupBy(*GROUP).agg(F.countDistinct("jsg").alias("n_jsg"))
    return prefs.select(*GROUP, "jsg", "docno", "rel_level").join(places, ["qid", "docno"]).join(groups, GROUP)


def checked(rows: DataFrame) -> DataFrame:
    """rows; contradictions stop the query: two levels of a document in a group with one sub-group, or 0 and more than 0."""
    w = Window.partitionBy(*GROUP, "docno")
    low, high = F.min("rel_level").over(w), F.max("rel_level").over(w)
    wrong = ((F.col("n_jsg") == 1) & (low != high)) | ((low == 0) & (high > 0))
    rows = rows.withColumn("_wrong", wrong)
    said = F.raise_error(F.concat_ws(" ", F.lit("levels that contradict each other:"), *GROUP, "docno")).cast("boolean")
    return rows.where(F.when(F.col("_wrong"), said).otherwise(True)).drop("_wrong")


def _explicit(rows: DataFrame) -> DataFrame:
    """The pairs within sub-groups; a join on the sub-group, whose size is that of one judge's work on one query."""
    a = rows.select(*GROUP, "jsg", "n_jsg", F.col("rel_level").alias("la"), F.col("place").alias("a"), F.col("ret").alias("a_ret"))
    b = rows.select(*GROUP, "jsg", F.col("rel_level").alias("lb"), F.col("place").alias("b"), F.col("ret").alias("b_ret"))
    return a.join(b, [*GROUP, "jsg"]).where("la > lb")


def closure(edges: DataFrame) -> DataFrame:
    """All (qid, jg, a, b) that follow from the given ones; ends when a round of joins finds nothing new.

    A document that comes to be preferred to itself stops the query.
    """
    found = keep(edges.select(*GROUP, "a", "b").distinct(), "preferences")
    n = found.count()
    while n:
        step = found.alias("x").join(found.alias("y"), (F.col("x.qid") == F.col("y.qid")) & (F.col("x.jg") == F.col("y.jg")) & (F.col("x.b") == F.col("y.a")))
        found = keep(found.union(step.select("x.qid", "x.jg", "x.a", "y.b")).distinct(), "preferences")
        before, n = n, found.count()
        if n == before:
            break
    if found.where("a = b").limit(1).count():
        raise ValueError("preferences of a group run in a circle")
    return found


def pairs(rows: DataFrame) -> DataFrame:
    """qid, jg, a, b, a_ret, b_ret: each preference of a over b, by places."""
    explicit = _explicit(rows)
    one = explicit.where("n_jsg = 1").select(*GROUP, "a", "b", "a_ret", "b_ret")
    ret = rows.select("qid", "place", "ret").distinct()
    more = closure(explicit.where("n_jsg > 1"))
    more = more.join(ret.select("qid", F.col("place").alias("a"), F.col("ret").alias("a_ret")), ["qid", "a"])
    more = more.join(ret.select("qid", F.col("place").alias("b"), F.col("ret").alias("b_ret")), ["qid", "b"])
    return one.union(more.select(*GROUP, "a", "b", "a_ret", "b_ret"))


def _fulfilled() -> Column:
    return (F.col("a") < F.col("b")) & F.col("a_ret")


def group_counts(rows: DataFrame, prefs: DataFrame) -> DataFrame:
    """For each group: preferences fulfilled and possible with both, one and none retrieved; its documents."""
    both, one = F.col("a_ret") & F.col("b_ret"), F.col("a_ret") != F.col("b_ret")
    counts = prefs.groupBy(*GROUP).agg(
        F.count_if(both & _fulfilled()).alias("ful_ret"),
        F.count_if(both).alias("poss_ret"),
        F.count_if(one & _fulfilled()).alias("ful_imp"),
        F.count_if(one).alias("poss_imp"),
        F.count_if(~F.col("a_ret") & ~F.col("b_ret")).alias("poss_none"),
    )
    # with one sub-group each judgment counts, with more each document
    docs = rows.where("n_jsg = 1").select(*GROUP, "n_jsg", "rel_level", "ret")
    docs = docs.union(rows.where("n_jsg > 1").groupBy(*GROUP, "n_jsg", "place", "ret").agg(F.max("rel_level").alias("rel_level")).select(*GROUP, "n_jsg", "rel_level", "ret"))
    rel = F.col("rel_level") > 0
    non = F.when(F.col("n_jsg") == 1, ~rel).otherwise(F.col("rel_level") == 0)
    facts = docs.groupBy(*GROUP, "n_jsg").agg(F.count_if(rel).alias("rel"), F.count_if(rel & F.col("ret")).alias("rel_ret"), F.count_if(non).alias("non"), F.count_if(non & F.col("ret")).alias("non_ret"))
    return facts.join(counts, GROUP, "left").na.fill(0)


def _recounted(rows: DataFrame, prefs: DataFrame, counts: DataFrame, retrieved: bool) -> DataFrame:
    """qid, jg, ful, poss with no more nonrelevant documents than relevant ones, in groups that have more.

    With one sub-group the least level's first documents stay, and every document of the group, themselves included,
    is compared with them. With more sub-groups the first documents of level 0 stay.
    """
    big = counts.where("rel_ret < non_ret" if retrieved else "rel < non")
    rows = rows.join(big.select(*GROUP, "rel", "rel_ret"), GROUP)
    if retrieved:
        rows, prefs = rows.where("ret"), prefs.where("a_ret AND b_ret")
    one, many = rows.where("n_jsg = 1"), rows.where("n_jsg > 1")
    limit = F.col("rel_ret" if retrieved else "rel")
    nth = F.row_number().over(Window.partitionBy(*GROUP).orderBy("place"))
    last = one.where("rel_level = _low").withColumn("_n", nth).where(F.col("_n") <= limit).select(*GROUP, F.col("place").alias("b"))
    against = one.select(*GROUP, F.col("place").alias("a"), F.col("ret").alias("a_ret")).join(last, GROUP)
    upper = one.select(*GROUP, "rel_level", "_low", "place", "ret").where("rel_level > _low")
    a = upper.select(*GROUP, F.col("rel_level").alias("la"), F.col("place").alias("a"), F.col("ret").alias("a_ret"))
    b = upper.select(*GROUP, F.col("rel_level").alias("lb"), F.col("place").alias("b"))
    above = a.join(b, GROUP).where("la > lb")
    # groups with several sub-groups: documents of level 0 beyond the first ones leave with their pairs
    docs = many.groupBy(*GROUP, "place").agg(F.max("rel_level").alias("rel_level"), F.max("rel").alias("_most"))
    zero = docs.where("rel_level = 0").withColumn("_n", nth).where("_n > _most").select(*GROUP, "place")
    kept = prefs.join(many.select(*GROUP).distinct(), GROUP, "left_semi")
    for side in "ab":
        kept = kept.join(zero.select(*GROUP, F.col("place").alias(side)), [*GROUP, side], "left_anti")
    every = against.select(*GROUP, "a", "a_ret", "b").union(above.select(*GROUP, "a", "a_ret", "b")).union(kept.select(*GROUP, "a", "a_ret", "b"))
    found = every.groupBy(*GROUP).agg(F.count_if(_fulfilled()).alias("ful"), F.count("*").alias("poss"))
    return big.select(*GROUP).join(found, GROUP, "left").na.fill(0)


def _share(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def wide(run: DataFrame, prefs: DataFrame, p: EvalParams = EvalParams()) -> DataFrame:
    """A row for each query with a run and preferences, a column for each measure of preferences."""
    lowest = F.min("rel_level").over(Window.partitionBy(*GROUP))
    rows = keep(checked(placed(run, prefs, p)).withColumn("_low", lowest), "places")
    each = keep(pairs(rows), "pairs")
    counts = keep(group_counts(rows, each), "counts")
    c = F.col
    ful, poss = c("ful_ret") + c("ful_imp"), c("poss_ret") + c("poss_imp") + c("poss_none")

    def adjusted(n_rel: str, n_non: str, ful: Column, poss: Column, again: DataFrame, name: str) -> DataFrame:
        more = c(n_rel) - c(n_non)
        here = counts.where(more >= 0).select(*GROUP, (ful + c("rel_ret") * more).alias("ful"), (poss + c("rel") * more).alias("poss"))
        both = here.union(again.select(*GROUP, "ful", "poss")).select("qid", _share(c("ful"), c("poss")).alias("s"))
        # a group without any preference leaves its query without a value
        return both.groupBy("qid").agg(F.when(F.count_if(c("s").isNull()) == 0, F.avg("s")).alias(name))

    def mean(a: Column, b: Column) -> Column:
        return F.sum(F.coalesce(_share(a, b), F.lit(0.0))) / F.count("*")

    out = counts.groupBy("qid").agg(
        F.sum(poss).cast("double").alias("prefs_num_prefs_poss"),
        F.sum(ful).cast("double").alias("prefs_num_prefs_ful"),
        F.sum("ful_ret").cast("double").alias("prefs_num_prefs_ful_ret"),
        _share(F.sum(ful), F.sum(poss)).alias("prefs_simp"),
        _share(F.sum("ful_ret"), F.sum("poss_ret")).alias("prefs_simp_ret"),
        _share(F.sum(ful), F.sum(c("poss_ret") + c("poss_imp"))).alias("prefs_simp_imp"),
        mean(ful, poss).alias("prefs_avgjg"),
        mean(c("ful_ret"), c("poss_ret")).alias("prefs_avgjg_ret"),
        mean(ful, c("poss_ret") + c("poss_imp")).alias("prefs_avgjg_imp"),
    )
    met = each.groupBy("qid", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(
        F.count_if(c("a") < c("b")).alias("up"), F.count("*").alias("n"), F.max((c("a_ret") | c("b_ret")).cast("int")).alias("one"), F.max((c("a_ret") & c("b_ret")).cast("int")).alias("two")
    )
    ratio = c("up") / c("n")
    by_pair = met.groupBy("qid").agg(
        (F.sum(c("one") * ratio) / F.count("*")).alias("prefs_pair"),
        F.avg(F.when(c("two") == 1, ratio)).alias("prefs_pair_ret"),
        F.avg(F.when(c("one") == 1, ratio)).alias("prefs_pair_imp"),
    )
    whole = adjusted("rel", "non", ful, poss, _recounted(rows, each, counts, False), "prefs_avgjg_Rnonrel")
    top = adjusted("rel_ret", "non_ret", c("ful_ret"), c("poss_ret"), _recounted(rows, each, counts, True), "prefs_avgjg_Rnonrel_ret")
    out = out.join(by_pair, "qid", "left").join(whole, "qid", "left").join(top, "qid", "left")
    return out.na.fill(0.0)


def _registered(name: str, summary: str, doc: str) -> None:
    M.REGISTRY[name] = M.Measure(name, "prefs", summary, (), lambda p: {name: F.col(name)}, doc)


for _name, _summary, _doc in (
    ("prefs_num_prefs_poss", M.SUM, "Preferences."),
    ("prefs_num_prefs_ful", M.SUM, "Preferences that are fulfilled."),
    ("prefs_num_prefs_ful_ret", M.SUM, "Preferences between retrieved documents that are fulfilled."),
    ("prefs_simp", M.MEAN, "Share of the preferences that are fulfilled."),
    ("prefs_pair", M.MEAN, "Share of a pair's preferences that are fulfilled, averaged over pairs."),
    ("prefs_avgjg", M.MEAN, "Share of the preferences that are fulfilled, averaged over judgment groups."),
    ("prefs_avgjg_Rnonrel", M.MEAN, "prefs_avgjg with as many nonrelevant documents as relevant ones."),
    ("prefs_simp_ret", M.MEAN, "prefs_simp of retrieved documents."),
    ("prefs_pair_ret", M.MEAN, "prefs_pair of retrieved documents."),
    ("prefs_avgjg_ret", M.MEAN, "prefs_avgjg of retrieved documents."),
    ("prefs_avgjg_Rnonrel_ret", M.MEAN, "prefs_avgjg_Rnonrel of retrieved documents."),
    ("prefs_simp_imp", M.MEAN, "prefs_simp of pairs with a retrieved document."),
    ("prefs_pair_imp", M.MEAN, "prefs_pair of pairs with a retrieved document."),
    ("prefs_avgjg_imp", M.MEAN, "prefs_avgjg of pairs with a retrieved document."),
):
    _registered(_name, _summary, _doc)

NAMES = [n for n, m in M.REGISTRY.items() if m.kind == "prefs"]
M.SETS["prefs"] = ["runid", "num_q", *NAMES[:6]]  # counts, prefs_simp, prefs_pair and prefs_avgjg
M.SETS["all_prefs"] = ["runid", "num_q", *NAMES]


def evaluate(run: DataFrame, prefs: DataFrame, p: EvalParams = EvalParams()) -> tuple[DataFrame, DataFrame]:
    """(values by query, summary), both (measure, qid, value). ValueError if no query has both a run and preferences."""
    from .summary import common, longer, summarize

    if p.query is not None:
        run = run.where(F.col("qid") == p.query)
    common(run, prefs)
    values = longer(wide(run, prefs, p))
    return values.select("measure", "qid", "value"), summarize(values, NAMES, p, kinds={n: M.REGISTRY[n].summary for n in NAMES})
