"""Benchmark decontamination: a prefix-filtered set join on rare shingles with exact verification of windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; null has none. A window is
``WINDOW`` consecutive words of an item; an item with fewer words, but some, is one window. A document
contains a window if its words stand in the document in a row; the words of every occurrence are hit.

A window is a set of word shingles (five words; a shorter item is one shingle) at known offsets. Containment
of the whole set means that any one of them occurs, so the prefix that has to be joined is one shingle: the
rarest in the documents. One pass over the documents finds the places of all item shingles, with the words
around each place (if the shingles are too many to broadcast, their hashes are joined alone first, and then the documents with
a hit); their counts give the order by rarity; places of rarest shingles are joined with their
windows, bounded by the length and position of the window, and compared word by word.

DataFrame functions only. The item side is broadcast only below a checked number of rows. Rows with equal ids
and texts are worked once and repeated; equal ids with different texts are different documents. Null doc_ids
are documents, null item_ids are no items. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower, bounded_broadcast, decisions, save

WINDOW = 10
SHINGLE = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(words: str, size: int) -> Column:
    """Hashes of the shingles of an array of words, by position."""
    return F.expr(f"if(size({words}) < {size}, array(), transform(sequence(0, greatest(size({words}) - {size}, 0)), i -> xxhash64(slice({words}, i + 1, {size}))))")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, words: every window of every item, once."""
    words = items.where("item_id is not null").select("item_id", words_of(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.explode(F.expr(f"sequence(1, greatest(size(w) - {window} + 1, 1))")).alias("i")
    return words.select("item_id", "w", starts).select("item_id", F.expr(f"slice(w, i, {window})").alias("words")).distinct()


def _occurrences(documents: DataFrame, items: DataFrame, window: int, shingle: int, limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows, the places of their shingles, and where windows stand in documents (doc_id, text_hash)."""
    pairs = save(windows_of(items, window), "windows")
    shapes = pairs.groupBy("words").agg(F.min(F.least(F.size("words"), F.lit(shingle))).alias("k"), F.xxhash64("words").alias("window_id"))
    # at most `shingle` sizes: those of items shorter than a shingle, and the shingle's own
    sizes = sorted({r["k"] for r in shapes.select("k").distinct().collect()} | {shingle})
    by_size = F.lit(None)
    for k in sizes:
        by_size = F.when(F.col("k") == k, _shingles("words", k)).otherwise(by_size)
    parts = save(shapes.select("words", "k", F.posexplode(by_size).alias("offset", "h")), "shingles")
    wanted = save(parts.select("k", "h").distinct(), "wanted")
    few = wanted.count() <= limit

    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    # one row for each document (k = 0) and each place of an item shingle
    marks = F.concat(F.expr("array(0L)"), *[_shingles("w", k) for k in sizes])
    k, pos, before = F.lit(0), F.lit(0), F.lit(0)
    for size in sizes:  # the n-th mark is the document's own, or a shingle of the size in whose stretch it falls
        inside = F.col("n") > before
        k, pos = F.when(inside, size).otherwise(k), F.when(inside, F.col("n") - before - 1).otherwise(pos)
        before = before + F.greatest(F.col("n_words") - size + 1, F.lit(0))
    low = F.greatest(F.col("pos") - (window - 1), F.lit(0))
    around = F.when(F.col("k") > 0, F.slice("w", low + 1, F.lit(2 * window + shingle)))
    cut = ["doc_id", "text_hash", "n_words", "k", "h", "pos", low.alias("low"), around.alias("around")]
    if few:
        spread = docs.select("doc_id", "text_hash", "w", F.size("w").alias("n_words"), F.posexplode(marks).alias("n", "h"))
        spread = spread.select("doc_id", "text_hash", "w", "n_words", k.alias("k"), pos.alias("pos"), "h")
        places = spread.join(F.broadcast(wanted.union(wanted.sparkSession.sql("select 0, 0L"))), ["k", "h"]).select(*cut)
    else:
        spread = docs.select("doc_id", "text_hash", F.size("w").alias("n_words"), F.posexplode(marks).alias("n", "h"))
        spread = spread.select("doc_id", "text_hash", "n_words", k.alias("k"), pos.alias("pos"), "h")
        own = spread.where("k = 0").withColumns({"low": F.lit(0), "around": F.lit(None).cast("array<string>")})
        met = save(spread.where("k > 0").join(wanted.hint("shuffle_hash"), ["k", "h"]).distinct(), "met")
        tag = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash"]
        hit = met.select(*tag, "n_words", "k", "h", "pos")
        back = docs.where("size(w) > 0").select("doc_id", *tag, "w").join(hit, ["no_id", "id", "text_hash"])
        places = own.select("doc_id", "text_hash", "n_words", "k", "h", "pos", "low", "around").union(back.select(*cut))
    places = save(places, "places")

    # the rarest shingle of each window, by its places in all documents; windows with an absent one can't occur
    met = places.where("k > 0")
    rarity = save(met.groupBy("k", "h").agg(F.count("*").alias("n")), "rarity")  # at most a row for each wanted shingle
    order = Window.partitionBy("words").orderBy("n", "offset")
    ranked = parts.join(F.broadcast(rarity) if few else rarity, ["k", "h"], "left").withColumn("r", F.row_number().over(order)).where("r = 1 and n > 0")
    prefix = ranked.select("words", F.size("words").alias("size"), "k", "h", "offset")
    start = F.col("pos") - F.col("offset")
    found = met.join(bounded_broadcast(save(prefix, "prefix"), limit=limit), ["k", "h"]).where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
    found = found.where(F.slice("around", start - F.col("low") + 1, F.col("size")) == F.col("words"))
    return pairs, places, save(found.select("doc_id", "text_hash", start.alias("start"), "size", "words"), "occurrences")


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, limit: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    pairs, places, found = _occurrences(documents, items, window, shingle, limit)
    key = ["doc_id", "text_hash"]
    ends = F.max(F.col("start") + F.col("size")).over(Window.partitionBy(*key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    spans = found.groupBy(*key, "start").agg(F.max("size").alias("size"))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", F.coalesce(ends, F.lit(0))))
    hits = spans.withColumn("fresh", fresh).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    which = found.select(*key, "words").distinct().join(bounded_broadcast(pairs, limit=limit), "words").groupBy(*key).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    rows = places.where("k = 0").groupBy(*key).agg(F.max("n_words").alias("n_words"), F.count("*").alias("rows"))
    tag = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash"]
    rows = rows.select(*tag, "n_words", "rows")
    both = rows.join(hits.select(*tag, "n_hit"), ["no_id", "id", "text_hash"], "left").join(which.select(*tag, "items"), ["no_id", "id", "text_hash"], "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    out = both.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items_of), ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        F.when(F.col("rows") > 1, F.sequence(F.lit(1), F.col("rows"))).otherwise(F.expr("array(1L)")).alias("each"),
    )
    return out.withColumn("each", F.explode("each")).drop("each")


def clean_rows(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The documents, with all their columns, that contain no window of any item; others with their doc_id don't matter.

    Texts are shuffled to the decisions only if more than ``limit`` documents contain one.
    """
    _, _, found = _occurrences(documents, items, window, shingle, limit)
    tag = lambda text_hash: [F.col("doc_id").isNull().alias("_no_id"), F.coalesce("doc_id", F.lit(0)).alias("_id"), text_hash.alias("_text_hash")]
    hit = save(found.select(*tag(F.col("text_hash"))).distinct(), "hit")
    rows = documents.select(F.struct(*documents.columns).alias("_row"), *tag(F.xxhash64("text")))
    return rows.join(decisions(hit, limit), ["_no_id", "_id", "_text_hash"], "left_anti").select("_row.*")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE item_id IS NOT NULL),
bi AS (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[i + 1 : i + 10], ' ') AS g, least(len(w), 10) AS n FROM bi),
sizes AS (SELECT DISTINCT n FROM win),
di AS (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n),
hit AS (SELECT di.r, di.i, di.n, win.item_id FROM (SELECT r, i, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM di) di JOIN win ON di.g = win.g AND di.n = win.n),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(cover.n_hit, 0)::BIGINT AS n_hit, coalesce(its.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(its.items, '')) AS items_sha256, coalesce(cover.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover ON d.r = cover.r LEFT JOIN its ON d.r = its.r
"""
