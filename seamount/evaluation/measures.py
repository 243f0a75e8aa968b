"""The measures of a judged ranking, as aggregates of its rows, and the registry by which they are asked for.

A measure is a function from its parameters to named aggregate columns over the rows of a query. All measures
that are asked for run in one ``groupBy(qid).agg``. Users add measures with :func:`measure`.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import judge as J
from .judge import EvalParams

CUTS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)
RECALLS = tuple(i / 10 for i in range(11))
MULTIPLES = tuple(round(0.2 * i, 1) for i in range(1, 11))
LEAST = 1e-5

#: How a summary is made of the queries' values.
MEAN, SUM, GEOMETRIC, NONE = "mean", "sum", "geometric", "none"


@dataclass(frozen=True)
class Measure:
    name: str
    kind: str  #: the rows it aggregates: counted, gained, groups or prefs
    summary: str
    defaults: tuple
    columns: Callable[..., dict[str, Column]]
    doc: str
    gains: tuple[tuple[int, float], ...] = ()  #: gains by level that were asked for with the measure
    suffix: str = ""  #: pairs as they were asked for, behind the name of its column


REGISTRY: dict[str, Measure] = {}


def measure(name: str, kind: str = "counted", summary: str = MEAN, defaults: tuple = ()):
    """Registers a function (params, *values) -> {column name: aggregate}; values are the parameters or the defaults."""

    def add(f: Callable) -> Callable:
        REGISTRY[name] = Measure(name, kind, summary, defaults, f, (f.__doc__ or "").strip())
        return f

    return add




class _Rows:
    """Columns of the rows that measures aggregate, and what many measures share; made when asked for, in a session."""

    def __getattr__(self, name: str) -> Column:
        return F.col(name)

    @property
    def retrieved(self) -> Column:
        return F.count("*")

    @property
    def hits(self) -> Column:
        return F.sum("hit").cast("double")

    @property
    def precision(self) -> Column:
        return self.cr / self.rank

    @property
    def last_dcg(self) -> Column:
        return F.max_by("dcg", "rank")

    @property
    def last_idcg(self) -> Column:
        return F.max_by("idcg", "rank")


row = _Rows()



def _per_r(total: Column) -> Column:
    """Divided by the query's number of relevant documents; 0 if it has none."""
    return F.coalesce(F.try_divide(total, F.max("n_rel").cast("double")), F.lit(0.0))


def _when(condition: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("double")


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _hits(k: int | Column) -> Column:
    return _when(row.rank <= k, row.hit)


@measure("runid", "run", NONE)
def _runid(p):
    """The run's name, in summaries only."""
    return {}


@measure("num_q", summary=SUM)
def _num_q(p):
    """Queries."""
    return {"num_q": F.lit(1.0)}


@measure("num_ret", summary=SUM)
def _num_ret(p):
    """Documents retrieved."""
    return {"num_ret": row.retrieved.cast("double")}


@measure("num_rel", summary=SUM)
def _num_rel(p):
    """Relevant documents."""
    return {"num_rel": F.max("n_rel").cast("double")}


@measure("num_rel_ret", summary=SUM)
def _num_rel_ret(p):
    """Relevant documents retrieved."""
    return {"num_rel_ret": row.hits}


@measure("num_nonrel_judged_ret", summary=SUM)
def _num_nonrel(p):
    """Documents retrieved that were judged and aren't relevant."""
    return {"num_nonrel_judged_ret": F.count_if((F.col("rel") >= 0) & (row.hit == 0)).cast("double")}


def _ap() -> Column:
    return _per_r(_when(row.hit == 1, row.precision))


@measure("map")
def _map(p):
    """Mean of the precision at each relevant document; 0 at those not retrieved."""
    return {"map": _ap()}


@measure("gm_map", summary=GEOMETRIC)
def _gm_map(p):
    """Average precision, averaged geometrically."""
    return {"gm_map": F.ln(F.greatest(_ap(), F.lit(LEAST)))}


@measure("Rprec")
def _rprec(p):
    """Precision after R documents."""
    return {"Rprec": _per_r(_when(row.rank <= row.n_rel, row.hit))}


def _bpref() -> Column:
    each = F.when(F.col("nonrel_before") == 0, 1.0).otherwise(1.0 - F.least(F.col("nonrel_before"), row.n_rel) / F.least(row.n_nonrel, row.n_rel))
    return _per_r(_when(row.hit == 1, each))


@measure("bpref")
def _bpref_measure(p):
    """Share of the judged nonrelevant documents that stand behind each relevant one."""
    return {"bpref": _bpref()}


@measure("gm_bpref", summary=GEOMETRIC)
def _gm_bpref(p):
    """bpref, averaged geometrically."""
    return {"gm_bpref": F.ln(F.greatest(_bpref(), F.lit(LEAST)))}


@measure("recip_rank")
def _recip_rank(p):
    """One over the rank of the first relevant document."""
    return {"recip_rank": F.coalesce(1.0 / F.min(F.when(row.hit == 1, row.rank)), F.lit(0.0))}


def _interpolated(x: float) -> Column:
    return F.coalesce(F.max(F.when(row.cr >= F.floor(x * row.n_rel + 0.5), row.precision)), F.lit(0.0))


@measure("iprec_at_recall", defaults=RECALLS)
def _iprec(p, *points):
    """Greatest precision at or behind the rank where a recall is reached."""
    return {f"iprec_at_recall_{x:.2f}": _interpolated(x) for x in points}


@measure("11pt_avg", defaults=RECALLS)
def _eleven(p, *points):
    """Mean of the interpolated precisions."""
    return {"11pt_avg": sum((_interpolated(x) for x in points), F.lit(0.0)) / len(points)}


@measure("P", defaults=CUTS)
def _p(p, *cuts):
    """Precision after k documents; missing ones aren't relevant."""
    return {f"P_{k}": _hits(k) / k for k in cuts}


@measure("recall", defaults=CUTS)
def _recall(p, *cuts):
    """Recall after k documents."""
    return {f"recall_{k}": _per_r(_hits(k)) for k in cuts}


@measure("relative_P", defaults=CUTS)
def _relative(p, *cuts):
    """Precision after k documents over the best that could be."""
    return {f"relative_P_{k}": _share(_hits(k), F.least(F.max("n_rel"), F.lit(k))) for k in cuts}


@measure("success", defaults=(1, 5, 10))
def _success(p, *cuts):
    """Whether a relevant document is among the first k."""
    return {f"success_{k}": (_hits(k) > 0).cast("double") for k in cuts}


@measure("map_cut", defaults=CUTS)
def _map_cut(p, *cuts):
    """Average precision of the first k documents."""
    return {f"map_cut_{k}": _per_r(_when((row.hit == 1) & (row.rank <= k), row.precision)) for k in cuts}


def _multiple(x: float) -> Column:
    cut = F.floor(x * row.n_rel + 0.9)
    return _share(_when(row.rank <= cut, row.hit), F.max(cut))


@measure("Rprec_mult", defaults=MULTIPLES)
def _rprec_mult(p, *multiples):
    """Precision after multiples of R documents."""
    return {f"Rprec_mult_{x:.2f}": _multiple(x) for x in multiples}


@measure("relstring", summary=NONE, defaults=(10,))
def _relstring(p, n):
    """The levels of the first documents, a character each: - not pooled, . not judged, > over 9."""
    rel = F.col("rel")
    char = F.when(rel == J.NOT_POOLED, "-").when(rel == J.NOT_JUDGED, ".").when(rel > 9, ">").when(rel >= 0, rel.cast("string")).otherwise("<")
    first = F.array_sort(F.collect_list(F.when(row.rank <= n, F.struct("rank", char.alias("c")))))
    return {f"relstring_{n}": F.concat(F.lit("'"), F.array_join(F.transform(first, lambda x: x["c"]), ""), F.lit("'"))}


@measure("infAP")
def _inf_ap(p):
    """Average precision inferred where judgments are a sample."""
    e, j = 1e-5, (row.rank - 1).cast("double")
    b, u, nb = (row.cr - row.hit).cast("double"), F.col("unjudged_before").cast("double"), F.col("nonrel_before").cast("double")
    each = F.when(j == 0, 1.0).otherwise(1.0 / (j + 1) + (j / (j + 1)) * ((b + nb + u) / F.greatest(j, F.lit(1.0))) * ((b + e) / (b + nb + 2 * e)))
    return {"infAP": _per_r(_when(row.hit == 1, each))}


@measure("utility", defaults=(1.0, -1.0, 0.0, 0.0))
def _utility(p, a, b, c, d):
    """Weighted counts: relevant and nonrelevant retrieved, relevant and nonrelevant not retrieved."""
    total = F.max("n_rel")
    return {"utility": a * row.hits + b * (row.retrieved - row.hits) + c * (total - row.hits) + d * (p.n_docs + row.hits - row.retrieved - total)}


@measure("binG")
def _bin_g(p):
    """Relevant documents discounted by the nonrelevant ones before them."""
    return {"binG": _per_r(_when(row.hit == 1, 1.0 / F.log2(2.0 + row.rank - row.cr)))}


@measure("set_P")
def _set_p(p):
    """Precision of the whole set."""
    return {"set_P": _share(row.hits, row.retrieved)}


@measure("set_relative_P")
def _set_relative(p):
    """Precision of the whole set over the best that could be."""
    return {"set_relative_P": _share(row.hits, F.least(row.retrieved, F.max("n_rel")))}


@measure("set_recall")
def _set_recall(p):
    """Recall of the whole set."""
    return {"set_recall": _per_r(row.hits)}


@measure("set_map")
def _set_map(p):
    """Precision times recall of the whole set."""
    return {"set_map": _share(row.hits * row.hits, row.retrieved * F.max("n_rel"))}


@measure("set_F", defaults=(1.0,))
def _set_f(p, x):
    """F measure of the whole set."""
    pr, rc = _share(row.hits, row.retrieved), _per_r(row.hits)
    return {"set_F": F.when(row.hits > 0, (x + 1) * pr * rc / (x * pr + rc)).otherwise(0.0)}


@measure("yaap")
def _yaap(p):
    """A log odds form of average precision."""
    s = _when(row.hit == 1, row.precision)
    return {"yaap": F.when(F.max("n_rel") > 0, F.ln((1.0 + s) / (1.0 + F.max("n_rel") - s))).otherwise(0.0)}


@measure("rbp", defaults=(0.9,))
def _rbp(p, persistence):
    """Gain at each rank by the chance that a reader gets there; gains outside 0..1 are scaled."""
    low, high = F.col("min_gain"), F.col("max_gain")
    gain = F.when((low < 0) | (high > 1), F.try_divide(p.gain(F.col("rel")) - low, high - low)).otherwise(p.gain(F.col("rel")))
    gain = F.when(F.col("rel") < 0, 0.0).otherwise(gain)
    return {"rbp": (1 - persistence) * F.coalesce(F.sum(gain * F.pow(F.lit(persistence), row.rank - 1)), F.lit(0.0))}


@measure("rbp_resid", defaults=(0.9,))
def _rbp_resid(p, persistence):
    """What rbp could still gain from documents without a judgment."""
    missing = F.col("rel") < 0
    rest = F.pow(F.lit(persistence), F.count("*")) + (1 - persistence) * _when(missing, F.pow(F.lit(persistence), row.rank - 1))
    return {"rbp_resid": F.when(F.count_if(missing) > 0, rest).otherwise(0.0)}


@measure("unj", defaults=(5, 10, 20))
def _unj(p, *cuts):
    """Share of the first k documents without a judgment."""
    return {f"unj_{k}": F.count_if((F.col("rel") < 0) & (row.rank <= k)) / k for k in cuts}


# Measures of graded gains, over the ranking beside the ideal one


@measure("dcg", "gained")
def _dcg(p):
    """Discounted gain of the ranking."""
    return {"dcg": row.last_dcg}


@measure("ideal_dcg", "gained")
def _ideal(p):
    """Discounted gain of the ideal ranking."""
    return {"ideal_dcg": row.last_idcg}


@measure("ndcg", "gained")
def _ndcg(p):
    """Discounted gain over that of the ideal ranking."""
    return {"ndcg": _share(row.last_dcg, row.last_idcg)}


@measure("ndcg_cut", "gained", defaults=CUTS)
def _ndcg_cut(p, *cuts):
    """ndcg of the first k documents, by their levels."""
    plain = F.greatest(F.coalesce("rel", F.lit(0)), F.lit(0)).cast("double")
    out = {}
    for k in cuts:
        top = _when(row.rank <= k, plain / F.log2(row.rank + 1.0))
        best = _when(row.rank <= k, F.col("ideal") / F.log2(row.rank + 1.0))
        out[f"ndcg_cut_{k}"] = F.when(best > 0, top / best).otherwise(top)
    return out


@measure("ndcg_rel", "gained")
def _ndcg_rel(p):
    """Mean of ndcg at the positive documents; those not retrieved get the end's."""
    found = F.coalesce(F.sum(F.when(row.gain > 0, row.dcg / row.idcg)), F.lit(0.0))
    missing = F.max("n_gain") - F.count_if(row.gain > 0)
    return {"ndcg_rel": F.when(F.max("n_rel") > 0, _share(found + missing * _share(row.last_dcg, row.last_idcg), F.max("n_gain"))).otherwise(0.0)}


@measure("Rndcg", "gained")
def _rndcg(p):
    """Mean of ndcg where the ideal gain drops, and at the end of a longer ranking."""
    drop = (F.col("ideal") > 0) & (F.col("ideal") != F.col("next_ideal"))
    tail = (F.max("n") > F.max("n_gain") + 1).cast("int")
    total = F.coalesce(F.sum(F.when(drop, row.dcg / row.idcg)), F.lit(0.0)) + tail * _share(row.last_dcg, row.last_idcg)
    return {"Rndcg": F.when(F.max("n_rel") > 0, _share(total, F.count_if(drop) + tail)).otherwise(0.0)}


@measure("G", "gained")
def _g(p):
    """Gain discounted by the cost of the ideal ranking up to it beyond what was gained."""
    each = F.when(F.col("rel").isNotNull() & (row.gain != 0), row.gain / F.log2(2.0 + F.col("cost") - F.col("gain_sum")))
    return {"G": _share(F.coalesce(F.sum(each), F.lit(0.0)), F.max("ideal_sum"))}


# Measures by judgment group: a value for each group of a query, then their mean


@measure("map_avgjg", "groups")
def _map_avgjg(p):
    """Average precision, averaged over judgment groups."""
    return {"map_avgjg": _ap()}


@measure("P_avgjg", "groups", defaults=CUTS)
def _p_avgjg(p, *cuts):
    """Precision after k documents, averaged over judgment groups."""
    return {f"P_avgjg_{k}": _hits(k) / k for k in cuts}


@measure("Rprec_mult_avgjg", "groups", defaults=MULTIPLES)
def _rprec_avgjg(p, *multiples):
    """Precision after multiples of R documents, averaged over judgment groups."""
    return {f"Rprec_mult_avgjg_{x:.2f}": _multiple(x) for x in multiples}


SETS = {
    "official": "runid num_q num_ret num_rel num_rel_ret map gm_map Rprec bpref recip_rank iprec_at_recall P".split(),
    "set": "runid num_q num_ret num_rel num_rel_ret utility set_P set_relative_P set_recall set_map set_F".split(),
    "all_trec": (
        "runid num_q num_ret num_rel num_rel_ret map gm_map Rprec bpref recip_rank iprec_at_recall P relstring recall unj rbp rbp_resid infAP gm_bpref utility 11pt_avg ndcg relative_P Rprec_mult success "
        "map_cut ndcg_cut ndcg_rel Rndcg binG G set_P set_recall set_relative_P set_map set_F num_nonrel_judged_ret"
    ).split(),
    "groups": "map_avgjg P_avgjg Rprec_mult_avgjg".split(),
    "qrels_jg": "runid num_q map_avgjg P_avgjg Rprec_mult_avgjg".split(),
}
SETS["all"] = [n for n, m in REGISTRY.items() if m.kind in ("counted", "gained", "run")]

#: Measures that take gains by level as pairs ``level=gain``; rbp and rbp_resid take ``p=persistence`` too.
PAIRED = ("rbp", "rbp_resid", "ndcg", "ndcg_rel", "Rndcg", "G", "dcg", "ideal_dcg")


def _pairs(m: Measure, rest: str) -> tuple[Measure, tuple]:
    """A measure with its gains by level, and its persistence; names that are neither a level nor p mean nothing."""
    given = [x.split("=") for x in rest.split(",")]
    if any(len(x) != 2 for x in given):
        raise ValueError(f"{m.name} takes pairs name=value")
    gains = {int(k): float(v) for k, v in reversed(given) if re.fullmatch(r"[-+]?\d+", k)}  # the first of a level counts
    persistence = [float(v) for k, v in given if k == "p"]
    return replace(m, gains=tuple(sorted(gains.items())), suffix=f"_{rest}"), tuple(persistence[-1:]) if m.defaults and persistence else m.defaults


def parse(name: str) -> list[tuple[Measure, tuple]]:
    """Measures and parameters of ``name``, ``name.v1,v2``, ``name.level=gain,level=gain`` or a set's name. Cutoffs are sorted, positive and unique."""
    head, _, rest = name.partition(".")
    if head in SETS and not rest:
        return [x for n in SETS[head] for x in parse(n)]
    if head not in REGISTRY:
        raise ValueError(f"unknown measure {head!r}")
    m = REGISTRY[head]
    if not rest:
        return [(m, m.defaults)]
    if head in PAIRED and "=" in rest:
        return [_pairs(m, rest)]
    if not m.defaults:
        raise ValueError(f"{head} has no parameters")
    if all(isinstance(x, int) for x in m.defaults):
        cuts = sorted(int(re.match(r"\s*\d*", x)[0] or 0) for x in rest.split(","))
        if cuts[0] <= 0 or len(set(cuts)) < len(cuts):
            raise ValueError(f"cutoffs have to be positive and different: {name}")
        return [(m, tuple(cuts))]
    values = [float(x.rpartition("=")[2]) for x in rest.split(",")]
    if head in ("utility", "set_F", "rbp", "rbp_resid"):
        if len(values) != len(m.defaults):
            raise ValueError(f"{head} takes {len(m.defaults)} parameters")
        return [(m, tuple(values))]
    if len(set(values)) < len(values):
        raise ValueError(f"cutoffs have to be different: {name}")
    return [(m, tuple(sorted(values)))]


def columns(asked: list[tuple[Measure, tuple]], kind: str, p: EvalParams) -> dict[str, Column]:
    return {k + m.suffix: c for m, values in asked if m.kind == kind for k, c in m.columns(p, *values).items()}


def help_text(names: list[str] | None = None) -> str:
    """What each measure says of itself."""
    return "\n".join(f"{m.name:24}{m.doc}" for m in REGISTRY.values() if names is None or m.name in names)


def _filled(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Nulls replaced; the names may have dots in them."""
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit(values[c])).alias(c) if c in values else F.col(f"`{c}`") for c in df.columns])


def wide(run: DataFrame, qrels: DataFrame, names: list[str], p: EvalParams) -> DataFrame:
    """A row for each query with a run and judgments, a column for each measure.

    The judged ranking is made once; every measure is an aggregate of it, of the ranking beside the ideal one, or both.
    """
    asked = [x for n in names for x in parse(n)]
    ranked = J.judge(run, qrels, p)
    out = J.topics(run, qrels, p).where("in_run").select("qid")
    for gains in dict.fromkeys(m.gains for m, _ in asked):
        out = _with_gains(out, ranked, run, qrels, [x for x in asked if x[0].gains == gains], replace(p, gains={**p.gains, **dict(gains)}))
    return out


def _with_gains(out: DataFrame, ranked: DataFrame, run: DataFrame, qrels: DataFrame, asked: list[tuple[Measure, tuple]], p: EvalParams) -> DataFrame:
    """Adds the measures that share one table of gains."""
    facts = J.topics(run, qrels, p)
    here = facts.where("in_run")
    if by := columns(asked, "counted", p):
        own = J.counted(ranked, here.drop("in_run"), p).groupBy("qid").agg(*[c.alias(k) for k, c in by.items()])
        # with judged documents only, a query may have none left
        out = out.join(own, "qid", "left")
        empty = {k: math.log(LEAST) if k in ("gm_map", "gm_bpref") else 1.0 if k == "num_q" else 0.0 for k in by if not k.startswith("relstring") and k != "num_rel"}
        out = _filled(out, empty)
        if "num_rel" in by:
            out = out.drop("num_rel").join(here.select("qid", F.col("n_rel").cast("double").alias("num_rel")), "qid")
    if by := columns(asked, "gained", p):
        own = J.gained(ranked, qrels, facts, p).groupBy("qid").agg(*[c.alias(k) for k, c in by.items()])
        out = _filled(out.join(own, "qid", "left"), dict.fromkeys(by, 0.0))
    return out


def wide_groups(run: DataFrame, qrels: DataFrame, names: list[str], p: EvalParams) -> DataFrame:
    """Like :func:`wide` for measures by judgment group; qrels has a column jg."""
    asked = [x for n in names for x in parse(n)]
    facts = J.topics(run, qrels, p, "jg").where("in_run").drop("in_run")
    by = columns(asked, "groups", p)
    each = J.counted(J.judge(run, qrels, p, "jg"), facts, p, "jg").groupBy("qid", "jg").agg(*[c.alias(k) for k, c in by.items()])
    each = _filled(facts.select("qid", "jg").join(each, ["qid", "jg"], "left"), dict.fromkeys(by, 0.0))
    return each.groupBy("qid").agg(*[F.avg(f"`{k}`").alias(k) for k in by])
