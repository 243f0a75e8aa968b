"""Inverted index: postings and statistics of terms, documents and the collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamount.functions import text as T


def tokenized(documents: DataFrame, words: Column | None = None) -> DataFrame:
    """doc_id, words."""
    return documents.select("doc_id", (T.tokens("text") if words is None else words).alias("words"))


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf of tokenized documents."""
    return docs.select("doc_id", F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_stats(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size("words").cast("bigint").alias("len"))


def term_stats(posts: DataFrame) -> DataFrame:
    """term, df, cf."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def collection_stats(docs: DataFrame) -> DataFrame:
    """One row: n_docs, total_terms, avgdl."""
    n, total = F.count("*"), F.coalesce(F.sum(F.size("words").cast("bigint")), F.lit(0))
    return docs.agg(n.alias("n_docs"), total.alias("total_terms")).withColumn("avgdl", F.try_divide(F.col("total_terms").cast("double"), F.col("n_docs")))


def build(documents: DataFrame, words: Column | None = None) -> dict[str, DataFrame]:
    docs = tokenized(documents, words)
    posts = postings(docs)
    return {"postings": posts, "term_stats": term_stats(posts), "doc_stats": document_stats(docs), "corpus_stats": collection_stats(docs)}


def query_terms(queries: DataFrame, words: Column | None = None) -> DataFrame:
    """qid, term, qtf of queries (qid, text)."""
    return queries.select("qid", F.explode(T.tokens("text") if words is None else words).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


#: Query terms are broadcast up to so many rows; beyond it the documents' terms are shuffled to them.
QUERY_ROWS = 500_000


def small(df: DataFrame, limit: int = QUERY_ROWS) -> DataFrame:
    """A broadcast hint if ``df`` has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def matching(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, len, term, tf of the documents' terms that stand in a query: filtered before anything is shuffled."""
    known = small(terms.select("term").distinct())
    return docs.select("doc_id", F.size("words").cast("bigint").alias("len"), F.explode("words").alias("term")).join(known, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
