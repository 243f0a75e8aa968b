"""Mixing sources to target weights: weighted sampling without replacement (Efraimidis and Spirakis) in epochs.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+`` (null and empty: 0). Sources in code point
order, null last, get the weights in turn. The budget, a percentage of all sizes, is shared by weight; no
target passes ``cap`` times its source's size, and what is cut off goes to the others by weight.

A source takes whole epochs of all its documents first. What is left of its target is filled with documents in
the order of their exponential keys ``-ln(u) / quality weight``; u is a hash of the id and the text, so that
reruns agree. The last document is taken if that brings the sum nearer to the target. Repeated rows have equal
keys and are taken together. Nulls in any column are values like others. The quality weight is a column that the caller may give.

The sources may be many: they are numbered over ranges of their names, and the level of the targets is found by rounds
of one sum each; a round caps all sources whose cap is below the level. No source is sorted as a whole: keys are counted in narrow logarithmic bins, the bin in which the target falls
is found from the bins' sums, and only its rows are sorted. The result needs one cut for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, save

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
CAP = 2
SEED = "mix-1"
#: Bins for each unit of ln(key): at most 0.04 % of a source with one weight fall in one bin.
BINS = 1024

WORDS = r"[^\x20\x09-\x0D]+"
MARKS = r"[!-/:-@\[-`{-~]"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def quality_weight(text: Column) -> Column:
    """1 for a text without ASCII marks, less with more of them, 0.05 at least."""
    marks = F.regexp_count(text, F.lit(MARKS)) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), 1.0 - 4.0 * marks), F.lit(1.0))


def exponential_key(doc_id: Column, text: Column, seed: str = SEED, weight: Column | None = None) -> Column:
    """weight: the document's quality weight, over 0; :func:`quality_weight` if it isn't given."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / (quality_weight(text) if weight is None else weight)


def keyed(documents: DataFrame, weight: Column | None = None) -> DataFrame:
    """The columns of the documents as _row, and those that the plan needs: _size, _key, _source and _null (whether source is null)."""
    return documents.select(
        F.struct(*documents.columns).alias("_row"),
        size_of(F.col("text")).alias("_size"),
        exponential_key(F.col("doc_id"), F.col("text"), weight=weight).alias("_key"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.col("source").isNull().alias("_null"),
    )


def _numbered(sizes: DataFrame) -> DataFrame:
    """Adds _i, the place of each source in code point order, null last: counted over ranges, a row of the window for each range."""
    n = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = save(sizes.repartitionByRange(n, "_null", "_source").withColumn("_part", F.spark_partition_id()), "sources")
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_null", "_source"))
    return ranges.join(F.broadcast(counts), "_part").withColumn("_i", F.col("_before") + within - 1).drop("_part", "_before")  # one row a partition


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: float = SHARE_PERCENT, cap: float = CAP) -> DataFrame:
    """_null, _source, source_size -> with target. One row for each source."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_i") % len(weights) + 1).cast("int"))
    t = save(_numbered(sizes).select("_null", "_source", "source_size", w.alias("_w"), (cap * F.col("source_size").cast("double")).alias("_cap")), "weights")
    # sources whose cap is below the common level are capped; that raises the level of the others
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        below = F.lit(False) if level is None else F.col("_cap") <= level * F.col("_w")
        capped, left = t.agg(F.sum(F.when(below, F.col("_cap")).otherwise(0.0)), F.sum(F.when(below, 0.0).otherwise(F.col("_w")))).first()
        if not left:
            level = None
            break
        raised = (percent / 100 * total - capped) / left
        if level is not None and raised <= level:
            break
        level = raised
    target = F.col("_cap") if level is None else F.least(F.col("_cap"), F.lit(level) * F.col("_w"))
    return t.select("_null", "_source", "source_size", target.alias("target"))


def cuts(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: float = SHARE_PERCENT, cap: float = CAP) -> DataFrame:
    """For each source: its size and target, the whole epochs, and the greatest key that is still taken (null: none)."""
    on = ["_null", "_source"]
    binned = rows.select(*on, "_size", "_key", F.floor(F.log("_key") * BINS).alias("_bin"))
    bins = save(binned.groupBy(*on, "_bin").agg(F.sum("_size").alias("_sum"), F.max("_key").alias("_top")), "bins")
    sizes = bins.groupBy(*on).agg(F.sum("_sum").alias("source_size"))
    targets = source_targets(sizes, weights, percent, cap)
    targets = targets.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", F.col("source_size").cast("double"))), F.lit(0)))
    targets = save(targets.withColumn("_rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    run = Window.partitionBy(*on).orderBy("_bin")
    upto = bins.withColumn("_upto", F.sum("_sum").over(run)).join(targets, on)
    met = upto.where("_upto >= _rest and _rest > 0").groupBy(*on).agg(F.min("_bin").alias("_edge"))
    edge = upto.join(met, on).where("_bin = _edge").select(*on, "_edge", "_rest", (F.col("_upto") - F.col("_sum")).alias("_before"))
    below = upto.join(met, on).where("_bin < _edge").groupBy(*on).agg(F.max("_top").alias("_below"))
    inside = binned.join(bounded_broadcast(save(edge, "edge")), on).where("_bin = _edge")
    peers = inside.groupBy(*on, "_key", "_rest", "_before").agg(F.sum("_size").alias("_size"))
    before = Window.partitionBy(*on).orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    low = F.col("_before") + F.coalesce(F.sum("_size").over(before), F.lit(0))
    taken = peers.withColumn("_low", low).where(F.col("_low") + F.col("_size") / 2 <= F.col("_rest")).where("_low < _rest")
    within = taken.groupBy(*on).agg(F.max("_key").alias("_within"))
    return targets.join(below, on, "left").join(within, on, "left").select(*on, "source_size", "target", "epochs", F.greatest("_below", "_within").alias("_cut"))


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: float = SHARE_PERCENT, cap: float = CAP, measured: DataFrame | None = None) -> DataFrame:
    """Adds source_size, target, and copies (how often the mix takes the row) to :func:`keyed` rows.

    measured: the same rows' key columns from a written table, if there is one.
    """
    found = save(cuts(measured or rows, weights, percent, cap), "cuts")
    copies = F.col("epochs") + F.coalesce((F.col("_key") <= F.col("_cut")).cast("bigint"), F.lit(0))
    return rows.join(bounded_broadcast(found), ["_null", "_source"]).withColumn("copies", copies)


def mix_report(documents: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words that the mix takes of the document)."""
    rows = save(keyed(documents.select("doc_id", "source", "text")).select("_row.doc_id", "_row.source", "_size", "_key", "_source", "_null"), "sizes")
    return mix(rows).select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", (F.col("copies") * F.col("_size")).alias("taken"))


def mixed_documents(documents: DataFrame, weight: Column | None = None) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with their own columns. weight: their quality weights."""
    rows = keyed(documents, weight)
    out = mix(rows, measured=save(rows.select("_null", "_source", "_size", "_key"), "sizes"))
    return out.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
           / coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (len(regexp_extract_all(text, '[!-/:-@\[-`{-~]'))::DOUBLE / greatest(length(text), 1))), 1.0::DOUBLE) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT arg_min(level, cap / w) AS level FROM l WHERE cap / w > level),
t AS (SELECT source, source_size, CASE WHEN c.level IS NULL THEN cap ELSE least(cap, c.level * w) END AS target FROM l, c),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM t),
p AS (SELECT source, k, sum(size) AS size FROM d GROUP BY source, k),
q AS (SELECT source, k, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM p),
x AS (SELECT q.source, max(k) AS cut FROM q JOIN e ON q.source IS NOT DISTINCT FROM e.source
      WHERE low + q.size / 2.0 <= target - epochs * source_size AND low < target - epochs * source_size GROUP BY q.source)
SELECT d.doc_id, d.source, d.size, e.source_size::BIGINT AS source_size, e.target,
       ((e.epochs + CASE WHEN d.k <= x.cut THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source LEFT JOIN x ON d.source IS NOT DISTINCT FROM x.source
"""
