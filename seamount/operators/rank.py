"""Ranking: BM25 in two forms, language models with two smoothings, and vector space models.

Scores are sums over the query's terms that stand in a document; (qid, doc_id) sums are aggregated before any
sort, and the best of a query come from a window with a limit, which Spark applies before it shuffles. Scores are
rounded to six decimals before they are ranked; ties keep the order of doc_id.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamount.sources.shared import keep

from . import index as I
from . import scored as S
from . import weighted as W


def top(scores: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best documents of each query, with their rank."""
    order = Window.partitionBy("qid").orderBy(F.desc(score), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _summed(matches: DataFrame, terms: DataFrame, weight: Column, *keys: str) -> DataFrame:
    both = matches.join(I.small(terms), "term")
    return both.groupBy("qid", "doc_id", *keys).agg(F.sum(F.col("qtf") * weight).alias("score"))


def bm25(docs: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """qid, doc_id, score > 0 of tokenized documents; a term that a query repeats counts as often."""
    matches = I.matching(docs, terms)
    df = matches.groupBy("term").agg(F.count("*").alias("df"))
    stats = F.broadcast(I.collection_stats(docs))  # one row
    rated = matches.join(I.small(df), "term").crossJoin(stats)
    idf = F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return _summed(rated, terms, idf * tf).withColumn("score", F.round("score", 6)).where("score > 0")


def bm25_okapi(docs: DataFrame, terms: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """BM25 whose negative idf are replaced by a share of the vocabulary's mean idf; scores of any sign."""
    posts = docs.select(F.explode(F.array_distinct("words")).alias("term"))
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    stats = F.broadcast(I.collection_stats(docs))
    raw = F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)
    idf = df.crossJoin(stats).select("term", raw.alias("idf"))
    mean = F.broadcast(idf.agg(F.avg("idf").alias("mean")))
    known = idf.join(I.small(terms.select("term").distinct()), "term", "left_semi").crossJoin(mean)
    rated = I.matching(docs, terms).join(I.small(known.select("term", F.when(F.col("idf") < 0, epsilon * F.col("mean")).otherwise(F.col("idf")).alias("idf"))), "term").crossJoin(stats)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return _summed(rated, terms, F.col("idf") * tf).withColumn("score", F.round("score", 6))


def _document_stats(matches: DataFrame) -> tuple[int, int]:
    n, total = matches.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
    return n, total


def _rounded_top(found: DataFrame, k: int) -> DataFrame:
    return top(found.withColumn("score", F.round("score", 6)), k)


def bm25_top(docs: DataFrame, terms: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The k best of :func:`bm25`, with their rank; a task sends no more than its k best of each query."""
    queries = S.asked(terms)
    if queries is None or not len(queries.ids):
        return top(bm25(docs, terms, k1, b), k)
    matches = S.matched(docs, queries.terms)
    (n, total), (df, _) = _document_stats(matches), S.term_counts(matches, len(queries.terms))
    idf, avgdl = np.log((n - df + 0.5) / (df + 0.5) + 1), total / n if total else 1.0
    weigh = lambda tf, length, t: idf[t] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl)))
    found = S.best_scores(matches, queries, queries.qtf, k, S.document_postings(weigh), lambda s, length, q: s, lambda r, hits: r > 0)
    return _rounded_top(found, k)


def bm25_okapi_top(docs: DataFrame, terms: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """The k best of :func:`bm25_okapi`, with their rank."""
    queries = S.asked(terms)
    if queries is None or not len(queries.ids):
        return top(bm25_okapi(docs, terms, k1, b, epsilon), k)
    matches = S.matched(docs, queries.terms)
    (n, total), (df, _) = _document_stats(matches), S.term_counts(matches, len(queries.terms))
    every = docs.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    mean = every.agg(F.avg(F.ln(n - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))).first()[0] or 0.0
    idf, avgdl = np.log(n - df + 0.5) - np.log(df + 0.5), total / n if total else 1.0
    idf = np.where(idf < 0, epsilon * mean, idf)
    weigh = lambda tf, length, t: idf[t] * (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / avgdl)))
    found = S.best_scores(matches, queries, queries.qtf, k, S.document_postings(weigh), lambda s, length, q: s, lambda r, hits: hits)
    return _rounded_top(found, k)


def _collection_terms(docs: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The query terms' matches, their collection frequencies, and one row of totals with the vocabulary's size."""
    matches = I.matching(docs, terms)
    cf = matches.groupBy("term").agg(F.sum("tf").alias("cf"))
    vocabulary = docs.select(F.explode("words").alias("term")).agg(F.countDistinct("term").alias("vocab"))
    return matches, cf, I.collection_stats(docs).crossJoin(vocabulary)


def _dirichlet(docs: DataFrame, terms: DataFrame, mu: float, unknown: float) -> tuple[DataFrame, DataFrame, Callable]:
    """(qid, n, base) of the queries, (qid, doc_id, len, gain) of the documents that match, and a score of these columns."""
    matches, cf, totals = _collection_terms(docs, terms)
    known = terms.join(I.small(cf), "term", "left").crossJoin(F.broadcast(totals))
    p = F.coalesce(F.try_divide("cf", "total_terms"), F.try_divide(F.lit(unknown), F.col("vocab")))
    known = keep(known.select("qid", "term", "qtf", p.alias("p")), "known")
    base = known.groupBy("qid").agg(F.sum("qtf").alias("n"), F.sum(F.col("qtf") * F.ln(mu * F.col("p"))).alias("base"))
    gain = matches.join(I.small(known), "term").groupBy("qid", "doc_id", "len").agg(F.sum(F.col("qtf") * F.ln(1 + F.col("tf") / (mu * F.col("p")))).alias("gain"))
    return base, gain, lambda gain: F.round(F.col("base") - F.col("n") * F.ln(F.col("len") + mu) + gain, 6)


def lm_dirichlet(docs: DataFrame, terms: DataFrame, mu: float = 1000.0, unknown: float = 0.2) -> DataFrame:
    """qid, doc_id, score of every document: sum of ln((tf + mu P) / (len + mu)), P = cf / total or unknown / vocabulary.

    The part of absent terms is the same for all documents but for the length, so only matches are joined:
    sum of ln(mu P) - n ln(len + mu) + sum over matches of ln(1 + tf / (mu P)).
    """
    return _every(docs, *_dirichlet(docs, terms, mu, unknown))


def _jelinek_mercer(docs: DataFrame, terms: DataFrame, lam: float, least: float) -> tuple[DataFrame, DataFrame, Callable]:
    matches, cf, totals = _collection_terms(docs, terms)
    known = terms.join(I.small(cf), "term", "left").crossJoin(F.broadcast(totals))
    known = keep(known.select("qid", "term", "qtf", F.coalesce(F.try_divide("cf", "total_terms"), F.lit(0.0)).alias("p")), "known")
    absent = F.ln(F.greatest(lam * F.col("p"), F.lit(least)))
    base = known.groupBy("qid").agg(F.sum("qtf").alias("n"), F.sum(F.col("qtf") * absent).alias("base"))
    present = F.ln(F.greatest((1 - lam) * F.col("tf") / (F.col("len") + 1e-10) + lam * F.col("p"), F.lit(least)))
    gain = matches.join(I.small(known), "term").groupBy("qid", "doc_id", "len").agg(F.sum(F.col("qtf") * (present - absent)).alias("gain"))
    return base, gain, lambda gain: F.round(F.col("base") + gain, 6)


def lm_jelinek_mercer(docs: DataFrame, terms: DataFrame, lam: float = 0.2, least: float = 1e-10) -> DataFrame:
    """Sum of ln(max((1 - lam) tf / (len + 1e-10) + lam P, least)), P = cf / total or 0, of every document."""
    return _every(docs, *_jelinek_mercer(docs, terms, lam, least))


def _every(docs: DataFrame, base: DataFrame, gain: DataFrame, score: Callable) -> DataFrame:
    every = I.document_stats(docs).crossJoin(I.small(base))  # the queries, of a checked number
    scored = every.join(gain.drop("len"), ["qid", "doc_id"], "left")
    return scored.select("qid", "doc_id", score(F.coalesce("gain", F.lit(0.0))).alias("score"))


#: Up to this length, in words, a shorter document's rounded score for absent terms is never that of a longer one.
DISTINCT_LENGTH = 400_000


def language_model_top(docs: DataFrame, terms: DataFrame, k: int, smoothing: str = "dirichlet", head: int | None = None, mu: float = 1000.0, unknown: float = 0.2, lam: float = 0.2, least: float = 1e-10) -> DataFrame:
    """The k best of :func:`language_model`, with their rank, without a row for each query and document.

    Each task scores all its documents and sends the k best of each query. With ``head``, or more query terms than can be
    collected, they are sought among the documents that match and, for each query, the k best of the others: those come first in
    one order of all documents, the same for every query (by length and id, or by id), whose first ``head`` are tried; more if
    these don't do.
    """
    if smoothing not in ("dirichlet", "jm"):
        raise ValueError(f"unknown smoothing {smoothing!r}")
    queries = S.asked(terms) if head is None else None
    if queries is not None and len(queries.ids):
        return _language_model_scored(docs, queries, k, smoothing, mu, unknown, lam, least)
    base, gain, score = _dirichlet(docs, terms, mu, unknown) if smoothing == "dirichlet" else _jelinek_mercer(docs, terms, lam, least)
    base, gain = keep(base, "base"), keep(gain, "gain")
    order = ["len", "doc_id"] if smoothing == "dirichlet" else ["doc_id"]
    stats = I.document_stats(docs)
    total, queries = stats.count(), base.count()
    head = head or 8 * k
    while True:
        first = stats.orderBy(*order).limit(head)
        others = keep(first.crossJoin(I.small(base)).join(gain.select("qid", "doc_id"), ["qid", "doc_id"], "left_anti"), "others")
        if head >= total or others.groupBy("qid").count().where(F.col("count") >= k).count() >= queries:
            break
        head *= 8
    if smoothing == "dirichlet" and (others.agg(F.max("len")).first()[0] or 0) > DISTINCT_LENGTH:
        return top(_every(docs, base, gain, score), k)
    found = gain.join(I.small(base), "qid").select("qid", "doc_id", score(F.col("gain")).alias("score"))
    return top(found.union(others.select("qid", "doc_id", score(F.lit(0.0)).alias("score"))), k)


def _language_model_scored(docs: DataFrame, queries: S.Asked, k: int, smoothing: str, mu: float, unknown: float, lam: float, least: float) -> DataFrame:
    matches = S.matched(docs, queries.terms)
    (_, total), (_, cf) = _document_stats(matches), S.term_counts(matches, len(queries.terms))
    t, qtf = queries.t, queries.qtf
    if smoothing == "dirichlet":
        vocabulary = docs.select(F.explode("words").alias("term")).agg(F.countDistinct("term")).first()[0]
        p = np.where(cf > 0, cf / max(total, 1), unknown / max(vocabulary, 1))
        base, n = queries.by_query(qtf * np.log(mu * p[t])), queries.by_query(qtf)
        weigh = lambda tf, length, t: np.log(1 + tf / (mu * p[t]))
        score = lambda gain, length, q: base[q] - n[q] * np.log(length + mu)[:, None] + gain
    else:
        p = cf / max(total, 1)
        absent = np.log(np.maximum(lam * p, least))
        base = queries.by_query(qtf * absent[t])
        weigh = lambda tf, length, t: np.log(np.maximum((1 - lam) * tf / (length + 1e-10) + lam * p[t], least)) - absent[t]
        score = lambda gain, length, q: base[q] + gain
    found = S.best_scores(matches, queries, qtf, k, S.document_postings(weigh), score, lambda r, hits: np.True_)
    return _rounded_top(found, k)


def language_model(docs: DataFrame, terms: DataFrame, smoothing: str = "dirichlet", **parameters: float) -> DataFrame:
    if smoothing == "dirichlet":
        return lm_dirichlet(docs, terms, **parameters)
    if smoothing == "jm":
        return lm_jelinek_mercer(docs, terms, **parameters)
    raise ValueError(f"unknown smoothing {smoothing!r}")


def entropy_and_coverage(docs: DataFrame, terms: DataFrame, unknown: float = 0.2) -> DataFrame:
    """qid, entropy (bits a term under the smoothed collection model) and coverage (share of terms known)."""
    _, cf, totals = _collection_terms(docs, terms)
    known = terms.join(I.small(cf), "term", "left").crossJoin(F.broadcast(totals))
    p = unknown / F.col("vocab") + (1 - unknown) * F.coalesce(F.col("cf") / F.col("total_terms"), F.lit(0.0))
    n = F.sum("qtf")
    return known.groupBy("qid").agg((-F.sum(F.col("qtf") * F.log2(p)) / n).alias("entropy"), (F.sum(F.when(F.col("cf").isNotNull(), F.col("qtf")).otherwise(0)) / n).alias("coverage"))


def tfidf(rows: DataFrame, n_rows: DataFrame) -> DataFrame:
    """row_id, doc_id, term, w: (1 + ln tf)(ln((1 + n) / (1 + df)) + 1), rows scaled to length 1.

    rows: row_id, doc_id, words; n_rows: one row with n.
    """
    tf = rows.select("row_id", "doc_id", F.explode("words").alias("term")).groupBy("row_id", "doc_id", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = tf.join(df, "term").crossJoin(F.broadcast(n_rows))
    w = w.select("row_id", "doc_id", "term", ((1 + F.ln("tf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row_id")))
    return w.select("row_id", "doc_id", "term", (F.col("w") / norm).alias("w"))


def discrimination(weights: DataFrame, n_rows: DataFrame) -> DataFrame:
    """term, tdw: the population deviation of the term's weights over all rows, zeros included."""
    s = weights.groupBy("term").agg(F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).crossJoin(F.broadcast(n_rows))
    return s.select("term", F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))).alias("tdw"))


def query_vectors(terms: DataFrame, weights_df: DataFrame, n_rows: DataFrame) -> DataFrame:
    """qid, term, w of queries in the vocabulary of (term, df): unknown terms dropped, scaled to length 1."""
    w = terms.join(weights_df, "term").crossJoin(F.broadcast(n_rows))
    w = w.select("qid", "term", ((1 + F.ln("qtf")) * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    return w.select("qid", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("qid")))).alias("w"))


def evsm(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """qid, doc_id, score: the cosine of the query with the document's best row, all weights times their discrimination.

    The weights of all rows are written once; terms' statistics come from one aggregate of them, and lengths are summed by
    row before anything is joined with the queries.
    """
    rows = keep(rows, "rows")
    n = rows.agg(F.count("*").alias("n"))
    w = keep(tfidf(rows, n), "weights")
    stats = keep(w.groupBy("term").agg(F.count("*").alias("df"), F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).crossJoin(F.broadcast(n)), "stats")
    tdw = stats.select("term", "df", F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0))).alias("tdw"))
    q = query_vectors(terms, tdw.select("term", "df"), n).join(tdw, "term").select("qid", "term", (F.col("w") * F.col("tdw")).alias("qw"))
    q = keep(q.withColumn("qn", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("qid")))), "queries")
    e = w.join(I.small(tdw.select("term", "tdw")), "term").select("row_id", "doc_id", "term", (F.col("w") * F.col("tdw")).alias("ew"))
    length = e.groupBy("row_id").agg(F.sqrt(F.sum(F.col("ew") * F.col("ew"))).alias("en"))
    dots = e.join(I.small(q), "term").groupBy("qid", "doc_id", "row_id", "qn").agg(F.sum(F.col("qw") * F.col("ew")).alias("dot")).join(length, "row_id")
    best = dots.select("qid", "doc_id", F.try_divide("dot", F.col("en") * F.col("qn")).alias("s")).groupBy("qid", "doc_id").agg(F.max("s").alias("s"))
    return best.select("qid", "doc_id", F.round("s", 6).alias("score")).where("score > 0")


def evsm_top(rows: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """The k best of :func:`evsm`, with their rank; what is shuffled are terms' statistics and each task's best documents."""
    found = W.evsm_best(rows, terms, k)
    return top(evsm(rows, terms) if found is None else found, k)


def term_weights(rows: DataFrame) -> DataFrame:
    """term, df, s, q, n: the rows that have the term, the sums of its weights (:func:`tfidf`) and of their squares, and all rows."""
    rows = keep(rows, "rows")
    made = W.term_table(rows)
    if made:
        return made[0].select("term", "df", "s", "q", F.lit(made[1]).cast("bigint").alias("n"))
    n = rows.agg(F.count("*").alias("n"))
    w = tfidf(rows, n).groupBy("term")
    return w.agg(F.count("*").alias("df"), F.sum("w").alias("s"), F.sum(F.col("w") * F.col("w")).alias("q")).crossJoin(F.broadcast(n))


def deviation() -> Column:
    """A term's weight for discrimination, of the columns of :func:`term_weights`."""
    return F.sqrt(F.greatest(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0)))


def sentence_rows(documents: DataFrame) -> DataFrame:
    """row_id, doc_id, words: the sentences of documents, their words of two characters or more that aren't stop words."""
    from seamount.functions import text as T

    rows = documents.select("doc_id", F.posexplode(T.sentences("text")).alias("pos", "sentence"))
    words = F.filter(T.without_stop_words(T.tokens("sentence")), lambda w: F.length(w) >= 2)
    return rows.select(F.concat_ws(":", "doc_id", "pos").alias("row_id"), "doc_id", words.alias("words"))


def vector_neighbours(words: DataFrame, vocabulary: DataFrame, least: float = 0.6, k: int = 3) -> DataFrame:
    """word, synonym, cosine, rank: of each word (vec_id, v) the k others with the greatest cosine over ``least``.

    The words go to all parts of the vocabulary in blocks, and a task sends the k nearest of each. Vectors of another length
    than the first, and those with nulls or numbers that aren't finite, are compared pair by pair.
    """
    first = words.where("size(v) > 0").select(F.size("v").alias("n")).first()
    n = first.n if first else 0
    plain = F.coalesce((F.size("v") == n) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) > 1e100)), F.lit(False))
    usual, odd = (d.where(plain) for d in (words, vocabulary)), [d.where(~plain) for d in (words, vocabulary)]
    asked, among = usual
    asked = keep(asked, "vectors")
    n_words = asked.count()
    parts = [S.near_vectors(asked, among, n_words, least, k)] if n_words else []
    if not odd[0].isEmpty():
        parts.append(_vector_pairs(odd[0], vocabulary))
    if n_words and not odd[1].isEmpty():
        parts.append(_vector_pairs(asked, odd[1]))
    both = functools.reduce(DataFrame.union, parts or [_vector_pairs(asked, among)]).select("word", "synonym", (F.round("cosine", 4) + 0.0).alias("cosine"))
    order = Window.partitionBy("word").orderBy(F.desc("cosine"), "synonym")
    return both.where(F.col("cosine") > least).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _vector_pairs(words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """word, synonym, cosine of every pair of different ids."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    q = words.select(F.col("vec_id").alias("word"), F.col("v").alias("q"), norm("v").alias("qn"))
    d = vocabulary.select(F.col("vec_id").alias("synonym"), F.col("v").alias("d"), norm("v").alias("dn"))
    dot = F.aggregate(F.zip_with("q", "d", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return d.crossJoin(I.small(q)).where("word <> synonym").select("word", "synonym", F.try_divide(dot, F.col("qn") * F.col("dn")).alias("cosine"))
