"""The registered queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_labeller, license_scan, line_crf, masked_lm, mixing, tiff, warc_store
from .common import table
from .near_dedup import near_duplicates
from .token_huffman import encode_documents


def tokenizer_path() -> str:
    """The place of the public byte-level BPE file on this machine; all machines of a cluster have it installed."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_huffman_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return line_crf.score(documents, line_crf.train(documents, table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (op1_huffman_token_ids, op2_benchmark_decontamination, op7_minhash_near_dedup, op8_mix_to_weights, op9_line_crf_quality)}

SQL: dict[str, str] = {"op2_benchmark_decontamination": decontaminate.SQL, "op8_mix_to_weights": mixing.SQL}


def op4_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_store.read_archive(*warc_store.write_archive(table(spark, sf_dir, "pages")))


QUERIES |= {f.__name__: f for f in (op4_license_sentences, op5_content_addressed_warc)}
SQL |= {"op4_license_sentences": license_scan.SQL, "op5_content_addressed_warc": warc_store.SQL}


def op3_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.read_texts(tiff.store_texts(table(spark, sf_dir, "documents")))


QUERIES |= {f.__name__: f for f in (op3_tiff_media,)}


def op10_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score_documents(table(spark, sf_dir, "documents"))


QUERIES |= {f.__name__: f for f in (op10_masked_likelihood,)}


def op6_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_labeller.extract(table(spark, sf_dir, "pages"))


QUERIES |= {f.__name__: f for f in (op6_block_labeller,)}
