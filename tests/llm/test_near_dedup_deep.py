"""Near duplicates that no pivot finds: the second round, large buckets that are divided, and recall."""

import itertools

import numpy as np
import pytest

from seamount.llm import near_dedup

SCHEMA = "doc_id bigint, text string"


def similar_pairs(seed, pairs, n=400, apart=40):
    """Texts in pairs whose sets have a similarity of a little over 0.8, all with one passage in front."""
    r = np.random.default_rng(seed)
    out = []
    for p in range(pairs):
        own = [f"p{seed}x{p}w{i}" for i in range(n)]
        other = list(own)
        at = r.choice(n // 4, apart // 4, replace=False) * 4
        for i in at:
            other[i] = f"q{seed}x{p}w{i}"
        out += [(2 * p, " ".join(own)), (2 * p + 1, " ".join(other))]
    return out


def sets(text):
    w = text.split()
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}


def test_recall_of_signatures_and_bands():
    """At similarities from 0.80 to 0.85: pairs share a band, three of them, and their signatures admit them."""
    a, b = near_dedup._universal(near_dedup.HASHES)
    r = np.random.default_rng(3)
    banded = deep = admitted = 0
    trials = 3000
    for _ in range(trials):
        size = int(r.integers(300, 700))
        s = r.uniform(0.80, 0.85)
        common = int(np.ceil(2 * size * s / (1 + s)))
        shared = r.integers(0, 1 << 63, common, np.uint64)
        m = [near_dedup.minima(np.concatenate([shared, r.integers(0, 1 << 63, size - common, np.uint64)]), a, b) for _ in range(2)]
        met = (m[0].reshape(-1, near_dedup.ROWS) == m[1].reshape(-1, near_dedup.ROWS)).all(axis=1).sum()
        banded += met >= 1
        deep += met >= near_dedup.DEPTH
        admitted += (m[0].astype(np.uint8) == m[1].astype(np.uint8)).mean() >= 0.8 - near_dedup.SLACK
    assert banded == trials and deep >= trials - 1 and admitted == trials


@pytest.mark.parametrize("block, divide", [(2, 2), (2, 512)])
def test_pairs_without_a_pivot(spark, monkeypatch, block, divide):
    """Thousands of shared words put all texts into the same buckets; only pairs of texts are linked."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "DIVIDE", divide)
    common = " ".join(f"c{i}" for i in range(300))
    rows = [(i, f"{common} {t}") for i, t in similar_pairs(5, 12, 260, 36)]
    own = [sets(t) for _, t in rows]
    links = {(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if 100 * len(own[i] & own[j]) >= 80 * len(own[i] | own[j])}
    assert links == {(2 * p, 2 * p + 1) for p in range(12)}
    assert max(len(own[0] & own[j]) / len(own[0] | own[j]) for j in range(2, len(rows))) > 0.3
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(rows))}


def test_decisions_by_shuffle_and_by_broadcast(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, 5), (2, text + " x", 6), (2, text + " x", 6), (3, "alone", 7), (4, None, 8), (4, None, 8)]
    d = spark.createDataFrame(rows, SCHEMA + ", _id int")
    for limit in (0, 100):
        assert sorted(map(str, near_dedup.one_of_each(d, limit=limit).collect())) == sorted(map(str, (d.collect()[i] for i in (0, 3, 4, 5))))
