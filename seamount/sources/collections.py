"""Collections: markup files of documents and queries, crawl records, index tables, activity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _plain(text: Column) -> Column:
    """Character references of XML decoded, trimmed."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _element(name: str, of: str = "doc") -> Column:
    """An element's text, empty for an empty element, null if it is missing."""
    found = F.regexp_extract(of, rf"(?s)<{name}\s*(?:/>|>(.*?)</{name}\s*>)", 1)
    return F.when(F.col(of).rlike(rf"<{name}\s*/?>"), _plain(found))


def parse_documents(files: DataFrame) -> DataFrame:
    """doc_id, title, author, bib, text from rows (value) of whole files: <doc> elements in a row, without a root.

    A document without one of its five elements is left out. Empty elements give empty texts.
    """
    docs = files.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<doc\s*>(.*?)</doc\s*>"), F.lit(1))).alias("doc"))
    rows = docs.select(_element("docno").alias("doc_id"), _element("title").alias("title"), _element("author").alias("author"), _element("bib").alias("bib"), _element("text").alias("text"))
    return rows.dropna()


def read_documents(spark: SparkSession, folder: str, prefix: str = "cran.all") -> DataFrame:
    """The documents of all files in a folder whose names begin with ``prefix``; ValueError if there are none."""
    out = parse_documents(spark.read.text(f"{folder}/{prefix}*", wholetext=True))
    if out.isEmpty():
        raise ValueError(f"no documents in {folder}")
    return out


def parse_queries(files: DataFrame) -> DataFrame:
    """qid, text from <top> elements; the id is the place in the file, from 1."""
    tops = files.select(F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)<top\s*>(.*?)</top\s*>"), F.lit(1))).alias("pos", "doc"))
    return tops.select((F.col("pos") + 1).cast("string").alias("qid"), _element("title").alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return parse_queries(spark.read.text(path, wholetext=True))


IMAGE = "page_url string, page_title string, categories array<string>, image_url string, alt_text string, title_text string, body_text string, surrounding_text string, caption string"


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Image records of a crawl file {"image_data": [...]}; missing texts are empty, missing categories an empty array."""
    rows = spark.read.schema(f"image_data array<struct<{IMAGE.replace(' string', ': string').replace(' array', ': array')}>>").json(path, multiLine=True)
    flat = rows.select(F.explode("image_data").alias("i")).select("i.*")
    texts = [c for c in flat.columns if c != "categories"]
    return flat.select(*[F.coalesce(c, F.lit("")).alias(c) if c in texts else F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in flat.columns])


def write_crawl(records: DataFrame, path: str) -> None:
    """Merges records into what is at ``path`` (by image_url, new ones win) and replaces it.

    Of records with the same image_url in one call the greatest stays. The merged records are written beside the old
    ones, which are only taken away once that is done.
    """
    spark = records.sparkSession
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark._jsc.hadoopConfiguration())
    merged = records.groupBy("image_url").agg(F.max(F.struct(*records.columns)).alias("r")).select("r.*")
    there = fs.exists(of(path))
    if there and fs.getFileStatus(of(path)).isFile():
        old = read_crawl(spark, path)
    elif there:
        known = spark.read.json(path).schema
        old = spark.read.schema(StructType([*records.schema, *[f for f in known if f.name not in records.columns]])).json(path)
    if there:
        kept = old.alias("o").join(merged.alias("n"), F.col("o.image_url").eqNullSafe(F.col("n.image_url")), "left_anti")
        merged = merged.unionByName(kept, allowMissingColumns=True)
    beside, before = (f"{path.rstrip('/')}.{name}-{uuid.uuid4().hex}" for name in ("new", "old"))
    merged.write.json(beside)
    if there and not fs.rename(of(path), of(before)):
        raise OSError(f"can't move {path}")
    if not fs.rename(of(beside), of(path)):
        raise OSError(f"can't move {beside} to {path}; the records of before are in {before}")
    if there:
        fs.delete(of(before), True)


def write_index(index: dict[str, DataFrame], path: str) -> None:
    for name, df in index.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("postings", "term_stats", "doc_stats", "corpus_stats")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
