"""A corpus pipeline: quality, near duplicates, benchmark passages, mix, token ids. See ``STAGES``.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before has kept, and returns a
DataFrame; it is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamount.llm import decontaminate, line_crf, mixing
from seamount.llm.common import save, table
from seamount.llm.near_dedup import one_of_each
from seamount.llm.queries import tokenizer_path
from seamount.llm.token_huffman import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labeller doesn't reject. It learns from the labels of these documents."""
    return line_crf.keep_good(docs, line_crf.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark window."""
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix, written and read back: doc_id, start, n_tokens, ids_crc32."""
    return encode_documents(docs, tokenizer_path())


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mix", mix), ("token_ids", token_ids)]

#: Learning a classifier and token ids are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
