"""What is done with ranked lists: fusion, pages, normalization, boosts, facets and filters of image results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZES = {"small": (0, 100), "medium": (101, 500), "large": (501, 2000)}


def fuse(vsm: DataFrame, bm25: DataFrame, lm: DataFrame) -> DataFrame:
    """qid, doc_id, vsm_score, bm25_score, lm_score, position of the union of three lists (qid, doc_id, rank, score).

    A missing score is 0. The order is that of the first list, then what only the second has, then the third.
    """
    named = [d.select("qid", "doc_id", F.col("rank").alias(f"r{i}"), F.col("score").alias(n)) for i, (d, n) in enumerate(((vsm, "vsm_score"), (bm25, "bm25_score"), (lm, "lm_score")))]
    both = named[0].join(named[1], ["qid", "doc_id"], "full").join(named[2], ["qid", "doc_id"], "full")
    first = F.when(F.col("r0").isNotNull(), F.struct(F.lit(0).alias("l"), F.col("r0").alias("r"))).when(F.col("r1").isNotNull(), F.struct(F.lit(1).alias("l"), F.col("r1").alias("r"))).otherwise(F.struct(F.lit(2).alias("l"), F.col("r2").alias("r")))
    order = Window.partitionBy("qid").orderBy(first)
    return both.select("qid", "doc_id", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in ("vsm_score", "bm25_score", "lm_score")], F.row_number().over(order).alias("position"))


def page(ranked: DataFrame, number: int, size: int = 15) -> DataFrame:
    """A page of each query's results, with whether there are pages before and after it and how many in all."""
    total = F.count("*").over(Window.partitionBy("qid"))
    rows = ranked.withColumn("total", total)
    rows = rows.where(F.col("rank").between((number - 1) * size + 1, number * size))
    return rows.select(*ranked.columns, F.lit(number > 1).alias("has_previous_page"), (F.col("total") > number * size).alias("has_next_page"), F.ceil(F.col("total") / size).alias("pages"))


def page_links(number: Column, pages: Column, around: int = 5) -> Column:
    """The page numbers that a page links to: ``around`` before and behind it, itself included, within 1..pages; none without pages."""
    first, last = F.greatest(number - around, F.lit(1)), F.least(number + around, pages)
    return F.when(first <= last, F.sequence(first.cast("int"), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def fetchable(images: DataFrame, order: str, most: int | None = 1100) -> DataFrame:
    """Of the first ``most`` images in the order of a column, those whose address can be fetched; None: of all."""
    first = images if most is None else images.orderBy(order, "image_url").limit(most)
    return first.where(F.col("image_url").startswith("http"))


def minmax(scores: DataFrame, epsilon: float = 1e-9) -> DataFrame:
    """Adds normalized = (s - min) / (max - min + epsilon) over each query."""
    low, high = (f("score").over(Window.partitionBy("qid")) for f in (F.min, F.max))
    return scores.withColumn("normalized", (F.col("score") - low) / (high - low + epsilon))


def boosted(score: Column, words: Column, objects: Column, factor: float = 3.0) -> Column:
    """The score plus ``factor`` for each query word among the detected objects."""
    return score + factor * F.size(F.filter(words, lambda w: F.array_contains(objects, w)))


def fits(size: Column, band: str | None) -> Column:
    """Whether width and height of struct<w, h> lie in a band; every size does in an unknown one."""
    if band not in SIZES:
        return F.lit(True)
    low, high = SIZES[band]
    return size["w"].between(low, high) & size["h"].between(low, high)


def near_color(colors: Column, rgb: tuple[int, int, int], within: int = 100) -> Column:
    """Whether any of the colors has every channel within a distance; null and empty have none."""
    return F.coalesce(F.exists(colors, lambda c: (F.abs(c[0] - rgb[0]) <= within) & (F.abs(c[1] - rgb[1]) <= within) & (F.abs(c[2] - rgb[2]) <= within)), F.lit(False))


def facets(results: DataFrame, column: str = "categories") -> DataFrame:
    """The distinct values of an array column of all results, with their counts."""
    return results.select(F.explode(column).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def dominant(values: DataFrame, keys: list[str], value: str, most: int = 3) -> DataFrame:
    """The most frequent values of each key: n, and their rank; ties by value."""
    n = values.groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def image_results(scored: DataFrame, metadata: DataFrame, words: list[str], band: str | None = None, rgb: tuple[int, int, int] | None = None, category: str | None = None, threshold: float = 0.25) -> DataFrame:
    """Image results in the order of serving: normalized scores over a threshold, boosted by objects, filtered.

    scored: qid, image_url, score. metadata: image_url, image_size, dominant_colors, detected_objects, categories.
    """
    rows = minmax(scored).where(F.col("normalized") >= threshold).join(metadata, "image_url", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    rows = rows.withColumn("final", boosted(F.col("normalized"), F.array(*[F.lit(w) for w in words]).cast("array<string>"), empty("detected_objects", "array<string>")))
    rows = rows.where(fits(F.col("image_size"), band))
    if rgb is not None:
        rows = rows.where(near_color(F.col("dominant_colors"), rgb))
    if category is not None:
        rows = rows.where(F.array_contains(empty("categories", "array<string>"), category))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("final"), "image_url")))


def last_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, in the order of a column: later texts replace earlier ones."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
