"""Weights of rows' terms from statistics of the whole vocabulary, in Arrow batches.

A row holds all its words, so its frequencies and its length are made where it is read; only terms' statistics are shuffled.
Terms go by their hashes, sorted, if no two of the vocabulary have the same and there are ``scored.VOCABULARY`` at most;
otherwise :func:`term_table` is None, and the callers join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamount.sources.shared import keep

from . import index as I
from . import scored as S


def hashed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))


def _sorted(table: DataFrame, *columns: str) -> list:
    found = table.select("h", *columns).toArrow()
    h = found["h"].to_numpy()
    order = np.argsort(h)
    return [h[order], *(found[c].to_numpy()[order] for c in columns)]


def row_weights(batch, h, idf):
    """row, place of the term, w of the distinct terms of a batch of hashed rows: (1 + ln tf) idf, rows scaled to length 1."""
    words, lengths = S._lists(batch.column("h"))
    some, at = np.unique(words.to_numpy(), return_inverse=True)
    row, place, tf = S.counted(np.repeat(np.arange(batch.num_rows), lengths), np.searchsorted(h, some)[at], len(h))
    w = (1 + np.log(tf)) * idf[place]
    return row, place, w / np.sqrt(np.bincount(row, w * w, batch.num_rows))[row]


def term_table(rows: DataFrame) -> tuple[DataFrame, int] | None:
    """Of written rows (doc_id, words): (term, h, df, s, q), written, with the sums of weights and of their squares, and the number of rows."""
    found = rows.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    found = keep(found.select("term", F.xxhash64("term").alias("h"), "df"), "vocabulary")
    if found.count() > S.VOCABULARY:
        return None
    h, df = _sorted(found, "df")
    if (h[1:] == h[:-1]).any():
        return None
    n = rows.count()
    sent = rows.sparkSession.sparkContext.broadcast((h, np.log((1 + n) / (1 + df)) + 1))

    def run(batches):
        h, idf = sent.value
        s, q = np.zeros(len(h)), np.zeros(len(h))
        for batch in batches:
            _, place, w = row_weights(batch, h, idf)
            np.add.at(s, place, w)
            np.add.at(q, place, w * w)
        at = np.flatnonzero(q)
        for i in range(0, len(at), 1 << 16):
            a = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(h[a]), pa.array(s[a]), pa.array(q[a])], ["h", "s", "q"])

    sums = hashed(rows).select("h").mapInArrow(run, "h bigint, s double, q double").groupBy("h").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    return keep(found.join(sums, "h").select("term", "h", "df", "s", "q"), "terms"), n


def evsm_best(rows: DataFrame, terms: DataFrame, k: int) -> DataFrame | None:
    """qid, doc_id, score > 0, rounded: of each task's rows the k best documents of each query; None if it takes joins."""
    rows = keep(rows.select("doc_id", "words"), "rows")
    asked = S.asked(terms)
    made = term_table(rows) if asked is not None else None
    if made is None:
        return None
    table, n = made
    tdw = F.sqrt(F.greatest(F.col("q") / n - F.pow(F.col("s") / n, 2), F.lit(0.0))) if n else F.lit(0.0)
    table = table.select("term", "h", "df", tdw.alias("tdw"))
    known = table.join(I.small(terms.select("term").distinct()), "term").toArrow()
    at = {t: i for i, t in enumerate(known["term"].to_pylist())}
    number = np.array([at.get(t, -1) for t in asked.terms.to_pylist()], np.int64)
    i = number[asked.t]
    used, i = i >= 0, i[i >= 0]
    if not len(i):
        return rows.sparkSession.createDataFrame([], f"qid {dict(terms.dtypes)['qid']}, doc_id {dict(rows.dtypes)['doc_id']}, score double")
    q = asked.q[used]
    w = (1 + np.log(asked.qtf[used])) * (np.log((1 + n) / (1 + known["df"].to_numpy()[i])) + 1)
    qw = w / np.sqrt(np.bincount(q, w * w, len(asked.ids)))[q] * known["tdw"].to_numpy()[i]
    qn = np.sqrt(np.bincount(q, qw * qw, len(asked.ids)))
    h, df, deviation = _sorted(table, "df", "tdw")
    places = np.searchsorted(h, known["h"].to_numpy())  # of the query terms in the vocabulary
    order = np.argsort(places)
    asked.q, asked.qtf = q, asked.qtf[used]
    asked.t, asked.terms, places = np.argsort(order)[i], known["term"].combine_chunks().take(pa.array(order)), places[order]
    sent = rows.sparkSession.sparkContext.broadcast((h, np.log((1 + n) / (1 + df)) + 1, deviation))

    def postings(batch):
        h, idf, deviation = sent.value
        row, place, w = row_weights(batch, h, idf)
        e = w * deviation[place]
        length = np.sqrt(np.bincount(row, e * e, batch.num_rows))
        t = np.minimum(np.searchsorted(places, place), len(places) - 1)
        mine = places[t] == place
        return row[mine], t[mine], e[mine], length

    def score(dots, length, block):
        by = length[:, None] * qn[block]
        return np.divide(dots, by, out=np.zeros_like(dots), where=by > 0)

    found = S.best_scores(hashed(rows), asked, qw, k, postings, score, lambda r, hits: r > 0)
    return found.groupBy("qid", "doc_id").agg(F.round(F.max("score"), 6).alias("score"))
