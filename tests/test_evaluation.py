import math

import pytest

from seamount.evaluation import measures as M
from seamount.evaluation import preferences as P
from seamount.evaluation import summary as U
from seamount.evaluation.judge import EvalParams, judge

RUN = [("1", d, s, "r") for d, s in (("a", 5.0), ("b", 4.0), ("c", 4.0), ("d", 2.0), ("e", 1.0), ("f", 0.5))] + [("2", "z", 1.0, "r")]
JUDGED = [("1", "c", 1), ("1", "b", 0), ("1", "a", -1), ("1", "e", 2), ("1", "x", 1), ("3", "q", 1)]  # d and f without a judgment


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(RUN, "qid string, docno string, sim double, run_id string"), spark.createDataFrame(JUDGED, "qid string, docno string, rel bigint")


def test_ranking(data):
    got = [(r.docno, r["rank"], r.rel) for r in judge(*data, EvalParams()).orderBy("rank").collect()]
    assert got == [("a", 1, -2), ("c", 2, 1), ("b", 3, 0), ("d", 4, -1), ("e", 5, 2), ("f", 6, -1)]  # equal sims: the greater name first
    only = [r.docno for r in judge(*data, EvalParams(judged_only=True)).orderBy("rank").collect()]
    assert only == ["c", "b", "e"]


def test_by_hand(data):
    r = M.wide(*data, ["map", "P.2,5", "bpref", "recip_rank", "infAP", "ndcg", "Rprec", "relstring", "unj.5", "num_rel", "rbp"], EvalParams()).collect()
    assert len(r) == 1
    r = r[0].asDict()
    e = 1e-5
    assert r["map"] == pytest.approx((1 / 2 + 2 / 5) / 3)
    assert (r["P_2"], r["P_5"], r["recip_rank"], r["num_rel"]) == (0.5, 0.4, 0.5, 3.0)
    assert r["bpref"] == pytest.approx((1 + (1 - 1 / 1)) / 3)
    assert r["Rprec"] == pytest.approx(1 / 3)
    first = 1 / 2 + 1 / 2 * (1 / 1) * (e / (2 * e))
    second = 1 / 5 + 4 / 5 * ((1 + 1 + 1) / 4) * ((1 + e) / (2 + 2 * e))
    assert r["infAP"] == pytest.approx((first + second) / 3)
    assert r["ndcg"] == pytest.approx((1 / math.log2(3) + 2 / math.log2(6)) / (2 + 1 / math.log2(3) + 1 / 2))
    assert (r["relstring_10"], r["unj_5"]) == ("'.10-2-'", 0.4)
    assert r["rbp"] == pytest.approx(0.1 * (0.5 * 0.9 + 1 * 0.9**4))


def test_summaries(data):
    v, s = U.evaluate(*data, ["map", "gm_map", "num_q"])
    assert {r.measure: r.value for r in s.collect()}["map"] == pytest.approx(0.3)
    _, s = U.evaluate(*data, ["map", "gm_map", "num_q", "num_rel"], EvalParams(complete=True))
    got = {r.measure: r.value for r in s.collect()}
    assert got["map"] == pytest.approx(0.15) and got["num_q"] == 2 and got["num_rel"] == 4
    assert got["gm_map"] == pytest.approx(math.sqrt(0.3 * 1e-5))


def test_gain_pairs(data):
    names = ["ndcg.1=3,2=9", "ndcg", "rbp.p=0.8,2=0.5", "rbp.p=.8,5=10", "map"]
    r = M.wide(*data, names, EvalParams()).collect()[0].asDict()
    assert r["ndcg_1=3,2=9"] == pytest.approx((3 / math.log2(3) + 9 / math.log2(6)) / (9 + 3 / math.log2(3) + 3 / 2))
    assert r["ndcg"] == pytest.approx((1 / math.log2(3) + 2 / math.log2(6)) / (2 + 1 / math.log2(3) + 1 / 2))
    assert r["rbp_p=0.8,2=0.5"] == pytest.approx(0.2 * (1 * 0.8 + 0.5 * 0.8**4))
    assert r["rbp_p=.8,5=10"] == pytest.approx(0.2 * (0.1 * 0.8 + 0.2 * 0.8**4))  # scaled by a level without documents
    assert r["map"] == pytest.approx(0.3)
    with pytest.raises(ValueError):
        M.parse("ndcg.1=3,2")


def test_report(data):
    got = [x.line.split("\t") for x in U.report_lines(*data, ["runid", "num_q", "num_ret", "utility.2,-1,0,0", "relstring"], by_query=True).orderBy("part", "qid", "place").collect()]
    assert [(a.strip(), b, c) for a, b, c in got] == [
        ("num_ret", "1", "6"), ("utility_2,-1,0,0", "1", "0.0000"), ("relstring", "1", "'.10-2-'"),
        ("runid", "all", "r"), ("num_q", "all", "1"), ("num_ret", "all", "6"), ("utility_2,-1,0,0", "all", "0.0000"),
    ]


def test_one_query(data):
    run = data[0].union(data[0].where("qid = '1'").selectExpr("'3'", "docno", "sim", "run_id"))
    assert {r.measure: r.value for r in U.evaluate(run, data[1], ["num_q", "map"])[1].collect()}["num_q"] == 2
    assert {r.measure: r.value for r in U.evaluate(run, data[1], ["num_q", "map"], EvalParams(query="1"))[1].collect()} == {"num_q": 1, "map": pytest.approx(0.3)}
    for function in (U.evaluate, U.evaluate_groups):
        with pytest.raises(ValueError):
            function(run, data[1].selectExpr("qid", "'0' jg", "docno", "rel"), ["map"] if function is U.evaluate else ["map_avgjg"], EvalParams(query="2"))


def test_no_common_query(spark, data):
    with pytest.raises(ValueError):
        U.require_common(U.evaluate(data[0].where("qid = '2'"), data[1], ["map"])[0])


@pytest.mark.parametrize("name", ["nothing", "P.5,5", "P.0", "map.1", "utility.1,2"])
def test_bad_names(name):
    with pytest.raises(ValueError):
        M.parse(name)


def test_names():
    assert M.parse("P.23.4,5")[0][1] == (5, 23)
    assert [m.name for m, _ in M.parse("set")][-1] == "set_F"
    assert "Precision after k" in M.help_text(["P"])
    assert len(M.REGISTRY) >= 56


def brute(run, prefs):
    """The preference measures of one query by loops over places. run: {docno: sim}; prefs: (jg, jsg, docno, level)."""
    order = [d for d, _ in sorted(run.items(), key=lambda x: (-x[1], x[0]))]
    judged = {p[2] for p in prefs}
    ret = [d for d in order if d in judged]
    place = {d: i for i, d in enumerate([*ret, *sorted(judged - set(ret))])}
    n = len(ret)
    out = []
    for jg in sorted({p[0] for p in prefs}):
        own = [p for p in prefs if p[0] == jg]
        pairs = [(place[x[2]], place[y[2]]) for x in own for y in own if x[1] == y[1] and x[3] > y[3]]
        many = len({p[1] for p in own}) > 1
        if many:
            pairs = set(pairs)
            while more := {(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs:
                pairs |= more
        level = {place[p[2]]: p[3] for p in own}
        out.append((list(pairs), level, many))
    good = lambda a, b: a < b and a < n

    def share(pairs, some):
        pairs = [x for x in pairs if some(*x)]
        return sum(good(*x) for x in pairs), len(pairs)

    def rnonrel(pairs, level, many, top):
        here = {k: v for k, v in level.items() if not top or k < n}
        rel, non = sum(v > 0 for v in here.values()), sum(v == 0 if many else v <= 0 for v in here.values())
        some = (lambda a, b: a < n and b < n) if top else (lambda a, b: True)
        if rel >= non:
            f, p = share(pairs, some)
            return (f + sum(v > 0 and k < n for k, v in level.items()) * (rel - non)), (p + sum(v > 0 for v in level.values()) * (rel - non))
        if many:
            gone = set([k for k in sorted(here) if here[k] == 0][sum(v > 0 for v in level.values()) :])
            pairs = [x for x in pairs if some(*x) and not gone & set(x)]
        else:
            low = min(level.values())
            last = [k for k in sorted(here) if here[k] == low][:rel]
            pairs = [(a, b) for a in here for b in here if here[a] > here[b] > low] + [(a, b) for a in here for b in last]
        return sum(good(*x) for x in pairs), len(pairs)

    def mean(values):
        return 0.0 if any(p == 0 for _, p in values) else sum(f / p for f, p in values) / len(values)

    return mean([rnonrel(*x, False) for x in out]), mean([rnonrel(*x, True) for x in out])


def test_preferences(spark):
    import random

    r = random.Random(3)
    runs, prefs, want = [], [], {}
    for q in range(25):
        docs = [f"d{i}" for i in range(r.randint(2, 9))]
        run = {d: float(r.randint(0, 4)) for d in docs if r.random() < 0.8} or {"d0": 1.0}
        own = []
        for jg in "ab"[: r.randint(1, 2)]:
            level = {d: float(r.choice([0, 0, 0, 1, 2])) for d in docs}
            if r.random() < 0.5:
                own += [(jg, "0", d, level[d]) for d in docs]
            else:
                own += [(jg, s, d, level[d]) for s in "uv" for d in docs if r.random() < 0.7] or [(jg, "u", "d0", 1.0)]
        runs += [(str(q), d, s) for d, s in run.items()]
        prefs += [(str(q), *p) for p in own]
        want[str(q)] = brute(run, own)
    got = P.wide(spark.createDataFrame(runs, "qid string, docno string, sim double"), spark.createDataFrame(prefs, "qid string, jg string, jsg string, docno string, rel_level double")).collect()
    assert len(got) == 25
    for row in got:
        assert (row.prefs_avgjg_Rnonrel, row.prefs_avgjg_Rnonrel_ret) == pytest.approx(want[row.qid]), row.qid


def test_contradictions(spark):
    run = spark.createDataFrame([("1", "a", 1.0)], "qid string, docno string, sim double")
    schema = "qid string, jg string, jsg string, docno string, rel_level double"
    with pytest.raises(Exception, match="contradict"):
        P.wide(run, spark.createDataFrame([("1", "j", "0", "a", 1.0), ("1", "j", "0", "a", 2.0)], schema)).collect()
    with pytest.raises(ValueError, match="circle"):
        P.wide(run, spark.createDataFrame([("1", "j", s, d, l) for s, d, l in (("0", "a", 2.0), ("0", "b", 1.0), ("1", "b", 2.0), ("1", "a", 1.0))], schema)).collect()


def test_repeated_documents(spark, data):
    for run, judged in ((data[0].union(data[0].limit(1)), data[1]), (data[0], data[1].union(data[1].limit(1)))):
        with pytest.raises(Exception, match="twice"):
            M.wide(run, judged, ["map"], EvalParams()).collect()
