"""Queries of the evaluation measures, and their SQL: values by query are rounded to six decimals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamount.evaluation import judge as J
from seamount.evaluation import measures as M
from seamount.evaluation import preferences as P
from seamount.evaluation import summary as U
from seamount.evaluation.judge import EvalParams
from seamount.sources import files

from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; -0.0 becomes 0.0, and names have no dots in them."""
    return df.select(*[(F.round(f"`{c}`", digits) + 0.0 if kind == "double" else F.col(f"`{c}`")).alias(c.replace(".", "_")) for c, kind in df.dtypes])


def judged_sql(fixture: str = X.EVENTS, level: int = 1, depth: int | None = None, judged_only: bool = False, gains: str = "greatest(rel, 0)::DOUBLE") -> str:
    """Relations of a judged ranking: ranked, facts, c (with running counts) and g (beside the ideal ranking)."""
    return f"""
{fixture},
ordered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, docno DESC) AS r FROM run),
joined AS (SELECT o.qid, t.jg, o.docno, o.sim, CASE WHEN q.rel IS NULL THEN -1 WHEN q.rel < 0 THEN -2 ELSE q.rel END AS rel
           FROM ordered o JOIN (SELECT DISTINCT qid, jg FROM qrels) t ON o.qid = t.qid
           LEFT JOIN qrels q ON q.qid = o.qid AND q.jg = t.jg AND q.docno = o.docno WHERE {f'o.r <= {depth}' if depth else 'true'}),
ranked AS (SELECT qid, jg, docno, rel, row_number() OVER (PARTITION BY qid, jg ORDER BY sim DESC, docno DESC) AS rank FROM joined WHERE {'rel >= 0' if judged_only else 'true'}),
facts AS (SELECT qid, jg, count(*) FILTER (rel >= {level}) AS n_rel, count(*) FILTER (rel >= 0 AND rel < {level}) AS n_nonrel, count(*) FILTER ({gains} > 0 AND rel >= 0) AS n_gain,
                 greatest(max(CASE WHEN rel >= 0 THEN {gains} END), 0) AS max_gain, sum(CASE WHEN rel >= 0 THEN {gains} ELSE 0 END) AS ideal_sum FROM qrels WHERE qid IN (SELECT qid FROM run) GROUP BY qid, jg),
marked AS (SELECT *, (rel >= {level})::INT AS hit, CASE WHEN rel < 0 THEN 0 ELSE {gains} END AS gain FROM ranked),
c AS (SELECT m.*, f.* EXCLUDE (qid, jg), sum(hit) OVER w AS cr, sum((rel >= 0 AND hit = 0)::INT) OVER w - (rel >= 0 AND hit = 0)::INT AS nb, sum((rel = -2)::INT) OVER w - (rel = -2)::INT AS ub
      FROM marked m JOIN facts f ON m.qid = f.qid AND m.jg = f.jg WINDOW w AS (PARTITION BY m.qid, m.jg ORDER BY rank)),
ideal AS (SELECT qid, ideal, row_number() OVER (PARTITION BY qid ORDER BY ideal DESC) AS rank FROM (SELECT qid, {gains} AS ideal FROM qrels WHERE rel >= 0) WHERE ideal > 0),
sides AS (SELECT coalesce(m.qid, i.qid) AS qid, coalesce(m.rank, i.rank) AS rank, m.rel, coalesce(m.gain, 0) AS gain, coalesce(i.ideal, 0) AS ideal
          FROM marked m FULL JOIN ideal i ON m.qid = i.qid AND m.rank = i.rank),
g AS (SELECT s.*, f.* EXCLUDE (qid, jg), sum(gain / log2(rank + 1)) OVER w AS dcg, sum(ideal / log2(rank + 1)) OVER w AS idcg, sum(gain) OVER w AS gain_sum, sum(greatest(ideal, 1)) OVER w AS cost,
             coalesce(lead(ideal) OVER (PARTITION BY s.qid ORDER BY rank), 0) AS next_ideal, count(rel) OVER (PARTITION BY s.qid) AS n
      FROM sides s JOIN facts f ON s.qid = f.qid WINDOW w AS (PARTITION BY s.qid ORDER BY rank))"""


def per_r(total: str) -> str:
    return f"coalesce({total} / nullif(max(n_rel), 0), 0)"


AP = per_r("sum(CASE WHEN hit = 1 THEN cr::DOUBLE / rank END)")
BPREF = per_r("sum(CASE WHEN hit = 1 THEN CASE WHEN nb = 0 THEN 1 ELSE 1 - least(nb, n_rel)::DOUBLE / least(n_nonrel, n_rel) END END)")
hits_at = "coalesce(sum(CASE WHEN rank <= {k} THEN hit END), 0)"


def cuts(template: str, name: str, ks=M.CUTS) -> dict[str, str]:
    return {f"{name}_{k}": template.replace("{h}", hits_at).replace("{k}", str(k)) for k in ks}


def iprec(x: float) -> str:
    return f"coalesce(max(CASE WHEN cr >= floor({x}::DOUBLE * n_rel + 0.5::DOUBLE) THEN cr::DOUBLE / rank END), 0)"


def multiple(x: float) -> str:
    c = f"floor({x}::DOUBLE * n_rel + 0.9::DOUBLE)"
    return f"coalesce(coalesce(sum(CASE WHEN rank <= {c} THEN hit END), 0)::DOUBLE / nullif(max({c}), 0), 0)"


NDCG = "coalesce(max_by(dcg, rank) / nullif(max_by(idcg, rank), 0), 0)"
MEASURES: dict[str, tuple[str, list[str], dict[str, str]]] = {
    # query: (relation, measures, {column: SQL})
    "eval_counts": ("c", ["num_q", "num_ret", "num_rel", "num_rel_ret", "num_nonrel_judged_ret"], {"num_q": "1.0", "num_ret": "count(*)", "num_rel": "max(n_rel)", "num_rel_ret": "sum(hit)", "num_nonrel_judged_ret": "count(*) FILTER (rel >= 0 AND hit = 0)"}),
    "eval_map": ("c", ["map"], {"map": AP}),
    "eval_rprec": ("c", ["Rprec"], {"Rprec": per_r("sum(CASE WHEN rank <= n_rel THEN hit ELSE 0 END)::DOUBLE")}),
    "eval_bpref": ("c", ["bpref"], {"bpref": BPREF}),
    "eval_recip_rank": ("c", ["recip_rank"], {"recip_rank": "coalesce(1.0::DOUBLE / min(CASE WHEN hit = 1 THEN rank END), 0)"}),
    "eval_iprec": ("c", ["iprec_at_recall"], {f"iprec_at_recall_{x:.2f}": iprec(x) for x in M.RECALLS}),
    "eval_11pt": ("c", ["11pt_avg"], {"11pt_avg": f"({' + '.join(iprec(x) for x in M.RECALLS)}) / 11"}),
    "eval_p": ("c", ["P"], cuts("{h}::DOUBLE / {k}", "P")),
    "eval_recall": ("c", ["recall"], cuts(per_r("{h}::DOUBLE"), "recall")),
    "eval_relative_p": ("c", ["relative_P"], cuts("coalesce({h}::DOUBLE / nullif(least(max(n_rel), {k}), 0), 0)", "relative_P")),
    "eval_success": ("c", ["success"], cuts("({h} > 0)::INT", "success", (1, 5, 10))),
    "eval_rprec_mult": ("c", ["Rprec_mult"], {f"Rprec_mult_{x:.2f}": multiple(x) for x in M.MULTIPLES}),
    "eval_map_cut": ("c", ["map_cut"], cuts(per_r("sum(CASE WHEN hit = 1 AND rank <= {k} THEN cr::DOUBLE / rank END)"), "map_cut")),
    "eval_infap": ("c", ["infAP"], {"infAP": per_r("sum(CASE WHEN hit = 1 THEN CASE WHEN rank = 1 THEN 1 ELSE 1.0::DOUBLE / rank + ((rank - 1)::DOUBLE / rank) * ((cr - 1 + nb + ub)::DOUBLE / (rank - 1)) * ((cr - 1 + 1e-5) / (cr - 1 + nb + 2e-5)) END END)")}),
    "eval_bing": ("c", ["binG"], {"binG": per_r("sum(CASE WHEN hit = 1 THEN 1 / log2(2 + rank - cr) END)")}),
    "eval_rbp": ("c", ["rbp"], {"rbp": "0.1::DOUBLE * sum(CASE WHEN max_gain > 1 THEN gain / max_gain ELSE gain END * pow(0.9::DOUBLE, rank - 1))"}),
    "eval_rbp_resid": ("c", ["rbp_resid"], {"rbp_resid": "CASE WHEN count(*) FILTER (rel < 0) = 0 THEN 0 ELSE pow(0.9::DOUBLE, count(*)) + 0.1::DOUBLE * sum(CASE WHEN rel < 0 THEN pow(0.9::DOUBLE, rank - 1) ELSE 0 END) END"}),
    "eval_unj": ("c", ["unj"], cuts("(count(*) FILTER (rel < 0 AND rank <= {k}))::DOUBLE / {k}", "unj", (5, 10, 20))),
    "eval_set": ("c", ["set_P", "set_relative_P", "set_recall", "set_map", "set_F"], {
        "set_P": "sum(hit)::DOUBLE / count(*)", "set_relative_P": "coalesce(sum(hit)::DOUBLE / nullif(least(count(*), max(n_rel)), 0), 0)", "set_recall": per_r("sum(hit)::DOUBLE"),
        "set_map": "coalesce(sum(hit)::DOUBLE * sum(hit) / nullif(count(*) * max(n_rel), 0), 0)", "set_F": "CASE WHEN sum(hit) = 0 THEN 0 ELSE 2.0::DOUBLE * sum(hit) / (count(*) + max(n_rel)) END"}),
    "eval_utility": ("c", ["utility.2,-1,-0.5,0.1"], {"utility": "2.0::DOUBLE * sum(hit) - (count(*) - sum(hit)) - 0.5::DOUBLE * (max(n_rel) - sum(hit)) + 0.1::DOUBLE * (sum(hit) - count(*) - max(n_rel))"}),
    "eval_yaap": ("c", ["yaap"], {"yaap": "CASE WHEN max(n_rel) > 0 THEN ln((1 + coalesce(sum(CASE WHEN hit = 1 THEN cr::DOUBLE / rank END), 0)) / (1 + max(n_rel) - coalesce(sum(CASE WHEN hit = 1 THEN cr::DOUBLE / rank END), 0))) ELSE 0 END"}),
    "eval_relstring": ("c", ["relstring"], {"relstring_10": "'''' || string_agg(CASE rel WHEN -1 THEN '-' WHEN -2 THEN '.' ELSE rel::VARCHAR END, '' ORDER BY rank) FILTER (rank <= 10) || ''''"}),
    "eval_dcg_ndcg": ("g", ["dcg", "ideal_dcg", "ndcg"], {"dcg": "max_by(dcg, rank)", "ideal_dcg": "max_by(idcg, rank)", "ndcg": NDCG}),
    "eval_ndcg_cut": ("g", ["ndcg_cut"], cuts("coalesce(sum(CASE WHEN rank <= {k} THEN gain / log2(rank + 1) END), 0) / coalesce(nullif(sum(CASE WHEN rank <= {k} THEN ideal / log2(rank + 1) END), 0), 1)", "ndcg_cut")),
    "eval_ndcg_rel": ("g", ["ndcg_rel"], {"ndcg_rel": f"coalesce((coalesce(sum(CASE WHEN gain > 0 THEN dcg / idcg END), 0) + (max(n_gain) - count(*) FILTER (gain > 0)) * {NDCG}) / nullif(max(n_gain), 0), 0)"}),
    "eval_rndcg": ("g", ["Rndcg"], {"Rndcg": f"CASE WHEN max(n_rel) = 0 THEN 0 ELSE (coalesce(sum(CASE WHEN ideal > 0 AND ideal <> next_ideal THEN dcg / idcg END), 0) + CASE WHEN max(n) > max(n_gain) + 1 THEN {NDCG} ELSE 0 END) / (count(*) FILTER (ideal > 0 AND ideal <> next_ideal) + (max(n) > max(n_gain) + 1)::INT) END"}),
    "eval_g": ("g", ["G"], {"G": "coalesce(sum(CASE WHEN rel IS NOT NULL AND gain <> 0 THEN gain / log2(2 + cost - gain_sum) END), 0) / nullif(max(ideal_sum), 0)"}),
}


def _wide(names: list[str], p: EvalParams = EvalParams()) -> Query:
    return lambda spark, sf: rounded(M.wide(X.run(spark, sf), X.judgments(spark, sf), names, p))


def _select(columns: dict[str, str], relation: str, by: str = "qid") -> str:
    return f"SELECT {by}, " + ", ".join(f"{sql} AS \"{n.replace('.', '_')}\"" if n.startswith("relstring") else f"round(({sql})::DOUBLE, 6) + 0 AS \"{n.replace('.', '_')}\"" for n, sql in columns.items()) + f" FROM {relation} GROUP BY {by}"


QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
for _name, (_relation, _asked, _columns) in MEASURES.items():
    QUERIES[_name] = _wide(_asked)
    SQL[_name] = f"WITH {judged_sql()} {_select(_columns, _relation)}"

# The same measures under other parameters
BASIC = {"map": AP, "bpref": BPREF, "P_10": hits_at.replace("{k}", "10") + "::DOUBLE / 10", "num_rel_ret": "sum(hit)"}
for _name, _p, _sql in (
    ("eval_level2", EvalParams(level=2), judged_sql(level=2)),
    ("eval_cutoff", EvalParams(depth=15), judged_sql(depth=15)),
    ("eval_judged_only", EvalParams(judged_only=True), judged_sql(judged_only=True)),
):
    QUERIES[_name] = _wide(["map", "bpref", "P.10", "num_rel_ret"], _p)
    SQL[_name] = f"WITH {_sql} {_select(BASIC, 'c')}"
QUERIES["eval_gains"] = _wide(["ndcg", "dcg"], EvalParams(gains={1: 0.5, 2: 4.0}))
SQL["eval_gains"] = f"WITH {judged_sql(gains='(CASE rel WHEN 1 THEN 0.5 WHEN 2 THEN 4.0 ELSE rel END)::DOUBLE')} {_select({'ndcg': NDCG, 'dcg': 'max_by(dcg, rank)'}, 'g')}"

# Gains that are asked for with a measure, beside the measure without them
QUERIES["eval_gain_pairs"] = _wide(["ndcg.1=3,2=9", "ndcg", "ndcg_rel.1=3,2=9"])
_NINE = judged_sql(gains="(CASE rel WHEN 1 THEN 3 WHEN 2 THEN 9 ELSE rel END)::DOUBLE")
SQL["eval_gain_pairs"] = f"""SELECT a.qid, "ndcg_1=3,2=9", ndcg, "ndcg_rel_1=3,2=9" FROM
(WITH {_NINE} {_select({'ndcg_1=3,2=9': NDCG, 'ndcg_rel_1=3,2=9': MEASURES['eval_ndcg_rel'][2]['ndcg_rel']}, 'g')}) a
JOIN (WITH {judged_sql()} {_select({'ndcg': NDCG}, 'g')}) b ON a.qid = b.qid"""


def _summary(names: list[str], p: EvalParams = EvalParams()) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        run = X.run(spark, sf)
        if p.complete:  # users with few events are missing from the run
            n = run.groupBy("qid").agg(F.count("*").alias("n")).where("n >= 50")
            run = run.join(n.select("qid"), "qid", "left_semi")
        return rounded(U.evaluate(run, X.judgments(spark, sf), names, p)[1])

    return query


_PER = f"WITH {judged_sql()}, t AS (SELECT qid, {AP} AS ap, {BPREF} AS bpref, count(*) AS num_ret, sum(hit) AS num_rel_ret, max(n_rel) AS num_rel FROM c GROUP BY qid)"
_LONG = " UNION ALL ".join(f"SELECT '{n}' AS measure, 'all' AS qid, round(({e})::DOUBLE, 6) + 0 AS value FROM t" for n, e in (("num_q", "count(*)"), ("num_ret", "sum(num_ret)"), ("num_rel", "sum(num_rel)"), ("num_rel_ret", "sum(num_rel_ret)"), ("map", "avg(ap)"), ("gm_map", "exp(avg(ln(greatest(ap, 1e-5))))"), ("gm_bpref", "exp(avg(ln(greatest(bpref, 1e-5))))")))
QUERIES["eval_summary"] = _summary(["num_q", "num_ret", "num_rel", "num_rel_ret", "map", "gm_map", "gm_bpref"])
SQL["eval_summary"] = f"{_PER} {_LONG}"
QUERIES["eval_complete"] = _summary(["num_q", "num_ret", "num_rel", "map", "gm_map"], EvalParams(complete=True))
_FEW = X.EVENTS.replace("run AS", "every AS") + ", run AS (SELECT * FROM every WHERE qid IN (SELECT qid FROM every GROUP BY qid HAVING count(*) >= 50))"
SQL["eval_complete"] = f"""WITH {judged_sql(_FEW)}, t AS (SELECT qid, {AP} AS ap, count(*) AS num_ret FROM c GROUP BY qid),
a AS (SELECT q.qid, t.qid IS NOT NULL AS here, coalesce(ap, 0) AS ap, coalesce(num_ret, 0) AS num_ret FROM (SELECT DISTINCT qid FROM qrels) q LEFT JOIN t ON q.qid = t.qid)
""" + " UNION ALL ".join(f"SELECT '{n}' AS measure, 'all' AS qid, round(({e})::DOUBLE, 6) + 0 AS value FROM a" for n, e in (("num_q", "count(*)"), ("num_ret", "sum(num_ret)"), ("num_rel", "max((SELECT count(*) FROM qrels WHERE rel > 0))"), ("map", "avg(ap)"), ("gm_map", "exp(avg(ln(greatest(ap, 1e-5))))")))

#: The first query by id alone.
_FIRST = X.EVENTS.replace("run AS", "every AS") + ", run AS (SELECT * FROM every WHERE qid = (SELECT min(e.qid) FROM every e WHERE e.qid IN (SELECT qid FROM qrels)))"


def eval_one_query(spark: SparkSession, sf: str) -> DataFrame:
    run, qrels = X.run(spark, sf), X.judgments(spark, sf)
    first = run.join(qrels.select("qid").distinct(), "qid", "left_semi").agg(F.min("qid")).first()[0]
    return rounded(U.evaluate(run, qrels, ["num_q", "num_ret", "map"], EvalParams(query=first))[1])


def eval_report(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a report in their order: the run's name, counts and relevant documents, by query and in all."""
    run = X.run(spark, sf).withColumn("run_id", F.lit("events"))
    lines = U.report_lines(run, X.judgments(spark, sf), ["runid", "num_q", "num_ret", "num_rel_ret", "relstring.5"], by_query=True)
    return lines.withColumn("place", F.col("place").cast("bigint")).withColumn("part", F.col("part").cast("bigint"))


def judged_rank(spark: SparkSession, sf: str) -> DataFrame:
    return J.judge(X.run(spark, sf), X.judgments(spark, sf), EvalParams()).select("qid", "docno", F.col("rank").cast("bigint").alias("rank"), F.col("rel").cast("bigint").alias("rel"))


def run_explained(spark: SparkSession, sf: str) -> DataFrame:
    rows = U.explain(X.run(spark, sf), X.judgments(spark, sf))
    return rounded(rows.withColumn("rank", F.col("rank").cast("bigint")).withColumn("rel", F.col("rel").cast("bigint")))


def score_lines(spark: SparkSession, sf: str) -> DataFrame:
    values, total = U.evaluate(X.run(spark, sf), X.judgments(spark, sf), ["num_ret", "Rprec"])
    return files.score_lines(rounded(values, 4).union(rounded(total, 4)))


def z_reference(spark: SparkSession, sf: str) -> DataFrame:
    """Means and deviations of two runs: the events by value, and by the value's opposite."""
    names, run, qrels = ["map", "P.10"], X.run(spark, sf), X.judgments(spark, sf)
    both = [U.longer(M.wide(r, qrels, names, EvalParams())) for r in (run, run.withColumn("sim", -F.col("sim")))]
    return rounded(U.z_reference(both[0].union(both[1])))


def z_scores(spark: SparkSession, sf: str) -> DataFrame:
    values = U.longer(M.wide(X.run(spark, sf), X.judgments(spark, sf), ["map", "P.10"], EvalParams()))
    return rounded(U.z_scores(values, z_reference(spark, sf)), 4)


QUERIES |= {f.__name__: f for f in (eval_one_query, eval_report, judged_rank, run_explained, score_lines, z_reference, z_scores)}
SQL["eval_one_query"] = f"""WITH {judged_sql(_FIRST)}, t AS (SELECT qid, {AP} AS ap, count(*) AS num_ret FROM c GROUP BY qid)
""" + " UNION ALL ".join(f"SELECT '{n}' AS measure, 'all' AS qid, round(({e})::DOUBLE, 6) + 0 AS value FROM t" for n, e in (("num_q", "count(*)"), ("num_ret", "sum(num_ret)"), ("map", "avg(ap)")))
SQL["eval_report"] = f"""WITH {judged_sql()}, t AS (SELECT qid, count(*) AS n, sum(hit) AS r,
  string_agg(CASE WHEN rank <= 5 THEN CASE WHEN rel = -1 THEN '-' WHEN rel = -2 THEN '.' ELSE rel::VARCHAR END END, '' ORDER BY rank) AS s FROM c GROUP BY qid),
l AS (SELECT 0 AS part, qid, 2 AS place, 'num_ret' AS m, n::VARCHAR AS v FROM t UNION ALL SELECT 0, qid, 3, 'num_rel_ret', r::BIGINT::VARCHAR FROM t UNION ALL SELECT 0, qid, 4, 'relstring_5', chr(39) || s || chr(39) FROM t
UNION ALL SELECT 1, 'all', 0, 'runid', 'events' UNION ALL SELECT 1, 'all', 1, 'num_q', count(*)::VARCHAR FROM t UNION ALL SELECT 1, 'all', 2, 'num_ret', sum(n)::BIGINT::VARCHAR FROM t UNION ALL SELECT 1, 'all', 3, 'num_rel_ret', sum(r)::BIGINT::VARCHAR FROM t)
SELECT part::BIGINT AS part, qid, place::BIGINT AS place, rpad(m, 22, ' ') || chr(9) || qid || chr(9) || v AS line FROM l"""
SQL["judged_rank"] = f"WITH {judged_sql()} SELECT qid, docno, rank, rel FROM ranked"
SQL["run_explained"] = f"WITH {judged_sql()} SELECT qid, rank, docno, rel, round(CASE WHEN hit = 1 THEN cr::DOUBLE / rank END, 6) AS precision, round(CASE WHEN hit = 1 THEN cr::DOUBLE / n_rel END, 6) AS recall FROM c"
SQL["score_lines"] = f"""WITH {judged_sql()}, t AS (SELECT qid, count(*) AS n, {MEASURES['eval_rprec'][2]['Rprec']} AS r FROM c GROUP BY qid),
l AS (SELECT 'num_ret' AS measure, qid, n::VARCHAR AS v FROM t UNION ALL SELECT 'Rprec', qid, printf('%6.4f', round(r, 4)) FROM t
      UNION ALL SELECT 'num_ret', 'all', sum(n)::BIGINT::VARCHAR FROM t UNION ALL SELECT 'Rprec', 'all', printf('%6.4f', round(avg(r), 4)) FROM t)
SELECT measure, qid, rpad(measure, 22, ' ') || chr(9) || qid || chr(9) || v AS line FROM l"""
_TWO = " UNION ALL ".join(f"SELECT qid, {n} AS n, {AP} AS map, {BASIC['P_10']} AS p FROM c{n} GROUP BY qid" for n in (1, 2))
_BOTH = f"c1 AS (WITH {judged_sql()} SELECT * FROM c), c2 AS (WITH {judged_sql(X.EVENTS.replace('floor(value)', '-floor(value)'))} SELECT * FROM c), v AS ({_TWO}), l AS (SELECT qid, n, 'map' AS measure, map AS value FROM v UNION ALL SELECT qid, n, 'P_10', p FROM v)"
SQL["z_reference"] = f"WITH {_BOTH} SELECT qid, measure, round(avg(value), 6) + 0 AS mean, round(stddev_samp(value), 6) + 0 AS stddev FROM l GROUP BY qid, measure"
SQL["z_scores"] = f"""WITH {_BOTH}, ref AS (SELECT qid, measure, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev FROM l GROUP BY qid, measure)
SELECT l.qid, l.measure, round(CASE WHEN stddev = 0 THEN CASE WHEN value = mean THEN 0 ELSE -1000000 END ELSE (value - mean) / stddev END, 4) + 0 AS value FROM l JOIN ref ON l.qid = ref.qid AND l.measure = ref.measure WHERE n = 1"""


def groups(names: list[str]) -> Query:
    return lambda spark, sf: rounded(M.wide_groups(X.run(spark, sf), X.group_judgments(spark, sf), names, EvalParams()))


for _name, _asked, _columns in (
    ("jg_map", "map_avgjg", {"map_avgjg": AP}),
    ("jg_p", "P_avgjg", cuts("{h}::DOUBLE / {k}", "P_avgjg")),
    ("jg_rprec_mult", "Rprec_mult_avgjg", {f"Rprec_mult_avgjg_{x:.2f}": multiple(x) for x in M.MULTIPLES}),
):
    QUERIES[_name] = groups([_asked])
    _inner = ", ".join(f"({sql})::DOUBLE AS \"{n}\"" for n, sql in _columns.items())
    _outer = ", ".join(f"round(avg(\"{n}\"), 6) + 0 AS \"{n.replace('.', '_')}\"" for n in _columns)
    SQL[_name] = f"WITH {judged_sql(X.EVENT_GROUPS)}, t AS (SELECT qid, jg, {_inner} FROM c GROUP BY qid, jg) SELECT qid, {_outer} FROM t GROUP BY qid"

# Preferences

PREFS = f"""
{X.TURNS},
judged AS (SELECT DISTINCT p.qid, p.docno, r.sim FROM prefs p LEFT JOIN run r ON p.qid = r.qid AND p.docno = r.docno WHERE p.qid IN (SELECT qid FROM run)),
places AS (SELECT qid, docno, row_number() OVER (PARTITION BY qid ORDER BY sim IS NULL, sim DESC, docno) - 1 AS place, sim IS NOT NULL AS ret FROM judged),
rows AS (SELECT p.*, place, ret, m.n_jsg FROM prefs p JOIN places l ON p.qid = l.qid AND p.docno = l.docno JOIN (SELECT qid, jg, count(DISTINCT jsg) AS n_jsg FROM prefs GROUP BY qid, jg) m ON p.qid = m.qid AND p.jg = m.jg),
explicit AS (SELECT x.qid, x.jg, x.n_jsg, x.place AS a, y.place AS b FROM rows x JOIN rows y ON x.qid = y.qid AND x.jg = y.jg AND x.jsg = y.jsg AND x.rel_level > y.rel_level),
closed(qid, jg, a, b) AS (SELECT qid, jg, a, b FROM explicit WHERE n_jsg > 1 UNION SELECT c.qid, c.jg, c.a, e.b FROM closed c JOIN explicit e ON c.qid = e.qid AND c.jg = e.jg AND c.b = e.a AND e.n_jsg > 1),
pairs AS (SELECT p.*, x.ret AS ar, y.ret AS br FROM (SELECT qid, jg, a, b FROM explicit WHERE n_jsg = 1 UNION ALL SELECT * FROM closed) p
          JOIN places x ON p.qid = x.qid AND p.a = x.place JOIN places y ON p.qid = y.qid AND p.b = y.place),
counts AS (SELECT g.qid, g.jg, count(*) FILTER (ar AND br AND a < b) AS fr, count(*) FILTER (ar AND br) AS pr, count(*) FILTER (ar <> br AND a < b) AS fi, count(*) FILTER (ar <> br) AS pi, count(*) FILTER (NOT ar AND NOT br) AS pn
           FROM (SELECT DISTINCT qid, jg FROM rows) g LEFT JOIN pairs p ON g.qid = p.qid AND g.jg = p.jg GROUP BY g.qid, g.jg),
met AS (SELECT qid, least(a, b) AS i, greatest(a, b) AS j, count(*) FILTER (a < b)::DOUBLE / count(*) AS ratio, bool_or(ar OR br) AS one, bool_or(ar AND br) AS two FROM pairs GROUP BY ALL)"""


def prefs(names: list[str]) -> Query:
    return lambda spark, sf: rounded(P.wide(X.turn_run(spark, sf), X.turn_preferences(spark, sf)).select("qid", *names))


def _over(ful: str, poss: str) -> str:
    return f"coalesce(sum({ful})::DOUBLE / nullif(sum({poss}), 0), 0)"


def _avg(ful: str, poss: str) -> str:
    return f"sum(coalesce(({ful})::DOUBLE / nullif({poss}, 0), 0)) / count(*)"


for _name, _relation, _columns in (
    ("prefs_counts", "counts", {"prefs_num_prefs_poss": "sum(pr + pi + pn)", "prefs_num_prefs_ful": "sum(fr + fi)", "prefs_num_prefs_ful_ret": "sum(fr)"}),
    ("prefs_simp", "counts", {"prefs_simp": _over("fr + fi", "pr + pi + pn"), "prefs_simp_ret": _over("fr", "pr"), "prefs_simp_imp": _over("fr + fi", "pr + pi")}),
    ("prefs_avgjg", "counts", {"prefs_avgjg": _avg("fr + fi", "pr + pi + pn"), "prefs_avgjg_ret": _avg("fr", "pr"), "prefs_avgjg_imp": _avg("fr + fi", "pr + pi")}),
    ("prefs_pair", "(SELECT g.qid, met.* EXCLUDE (qid) FROM (SELECT DISTINCT qid FROM rows) g LEFT JOIN met ON g.qid = met.qid)", {
        "prefs_pair": "coalesce(sum(CASE WHEN one THEN ratio ELSE 0 END) / nullif(count(i), 0), 0)", "prefs_pair_ret": "coalesce(avg(CASE WHEN two THEN ratio END), 0)", "prefs_pair_imp": "coalesce(avg(CASE WHEN one THEN ratio END), 0)"}),
):
    QUERIES[_name] = prefs(list(_columns))
    SQL[_name] = f"WITH RECURSIVE {PREFS} {_select(_columns, _relation)}"


def prefs_closure(spark: SparkSession, sf: str) -> DataFrame:
    rows = P.placed(X.turn_run(spark, sf), X.turn_preferences(spark, sf))
    return P.pairs(P.checked(rows)).select("qid", "jg", F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"))


QUERIES["prefs_closure"] = prefs_closure
SQL["prefs_closure"] = f"WITH RECURSIVE {PREFS} SELECT qid, jg, a, b FROM pairs"

#: Beyond plain SQL by its two ways of counting again; tested against a brute-force version.
QUERIES["prefs_rnonrel"] = prefs(["prefs_avgjg_Rnonrel", "prefs_avgjg_Rnonrel_ret"])
