"""MinHash near-duplicate groups: universal hash minima, banding, verification on full sets, star components.

A document's set holds its distinct word shingles (words: ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z).
With fewer words than a shingle has, the whole sequence is the one shingle; null, empty and blank texts have
an empty set and are linked with nothing. Shingles are 64-bit hashes, sets are named by 128-bit digests.

The work is done on *classes*: documents with equal sets are one class, however many there are, so exact
copies never meet in a bucket. In each bucket a pivot (the least class) is compared with every other member:
linear work. Only buckets whose members then still lie in different components go on. Those with more than DIVIDE
members are divided by a further band each (a pair at the threshold shares 13 of 32 bands on average) and get pivots
again, up to DEPTH bands. What remains is compared member by member, in blocks of members that meet in a task. It compares signatures,
each pair only in the first buckets that it shares (by the buckets' keys), and verifies on the full
sets those pairs across components whose signatures admit the threshold, the most alike first; what the links
found so far connect is passed over. Only links leave the task, fewer than it has members. No bucket is capped
and no member is dropped.

What can be missed, of pairs at similarity 0.8: those that share no band (5e-8), in buckets of over DIVIDE
members those that share fewer than DEPTH (1e-5), and those whose signatures agree by five standard deviations too
little (3e-7; ``slack=1`` compares the sets of all pairs of a bucket).

Nulls: a null ``doc_id`` keeps its class but is no candidate for ``component_id`` (null if nothing else is
reachable). Repeated rows each give a row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ROW, bounded_broadcast, decisions, forget, lean, row_names, save, slices, texts

HASHES = 128
ROWS = 4  #: minima in a band; HASHES / ROWS bands
SHINGLE = 4
#: Ids of the documents whose sets are wanted are broadcast up to so many.
IDS = 1_000_000
#: Members of a bucket are compared in blocks of so many, or of so many bytes of sets.
BLOCK = 512
BLOCK_BYTES = 64 << 20
#: Buckets of more members are divided by further bands, up to DEPTH together. A member has a row for each of 31 bands then,
#: and size / BLOCK rows if blocks meet, so that dividing is less work only beyond some 31 blocks.
DIVIDE = 64 * BLOCK
DEPTH = 3
#: A pair goes on to verification if its signatures agree in a share that is so far below the threshold at
#: most: five standard deviations of 128 minima at a similarity of 0.8.
SLACK = 0.177

_MULT = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text."""
    words = text.lower().split()  # on bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _MULT
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _universal(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Parameters of the multiply-add-shift family, the same in every process."""
    r = np.random.default_rng(20240607)
    return r.integers(1, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, hashes, np.uint64)


def minima(items: np.ndarray, a: np.ndarray, b: np.ndarray, chunk: int = 512) -> np.ndarray:
    """The minimum of each universal hash over a set, as unsigned 32-bit integers."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(items), chunk):
        x = a[:, None] * items[None, i : i + chunk]
        x += b[:, None]
        np.minimum(low, x.view(np.uint32)[:, 1::2].min(axis=1), out=low)
    return low


def _signatures(hashes: int, rows: int, k: int, ids: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _universal(hashes)
        for whole in batches:
            for batch in slices(whole):
                keys, sizes, sigs, bands, marks = [], [], [], [], []
                for text in texts(batch):
                    s = shingle_hashes(text, k)
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    if len(s):
                        m = minima(s, a, b)
                        sigs.append(m.astype(np.uint8).tobytes())  # the low bytes: enough to compare
                        bands.append([xxhash.xxh64_intdigest(m[i : i + rows].tobytes(), i) - (1 << 63) for i in range(0, hashes, rows)])
                        marks.append(np.array(bands[-1], np.int64).tobytes())  # the bands again, as _candidates reads them
                    else:
                        sigs.append(None)
                        bands.append(None)
                        marks.append(None)
                yield pa.RecordBatch.from_arrays(
                    [*map(batch.column, ids), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                    [*ids, "key", "n_shingles", "sig", "bands", "marks"],
                )

    return lean(run)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                sets = [shingle_hashes(t, k) for t in texts(batch)]
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "items"])

    return lean(run)


def _candidates(left: list[dict], right: list[dict], same: bool, band: int, threshold: float, depth: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (left, right) and their agreement: across components, admitted, and not met in earlier buckets.

    band: the last of the ``depth`` bands that the members share; a pair that shares others before it was met there.
    """
    if not left or not right:  # no member was dealt to a block
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    ls = np.frombuffer(b"".join(x["sig"] for x in left), np.uint8).reshape(len(left), -1)
    rs = ls if same else np.frombuffer(b"".join(x["sig"] for x in right), np.uint8).reshape(len(right), -1)
    lm = np.frombuffer(b"".join(x["marks"] for x in left), np.int64).reshape(len(left), -1)
    rm = lm if same else np.frombuffer(b"".join(x["marks"] for x in right), np.int64).reshape(len(right), -1)
    names = {c: i for i, c in enumerate({x["comp"] for x in left} | {x["comp"] for x in right})}
    lc, rc = (np.array([names[x["comp"]] for x in side]) for side in (left, right))
    found = []
    for i, row in enumerate(ls):
        first = i + 1 if same else 0
        near = np.flatnonzero(rc[first:] != lc[i]) + first
        if len(near):
            alike = (rs[near] == row).mean(axis=1)
            near, alike = (x[alike >= threshold] for x in (near, alike))
            if len(near) and band:
                fresh = (rm[near, :band] == lm[i, :band]).sum(axis=1) == depth - 1  # by the keys of the buckets: equal low bytes don't make a bucket
                near, alike = near[fresh], alike[fresh]
            found.append((np.full(len(near), i), near, alike))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _sides(r: dict) -> tuple[list[dict], list[dict], bool]:
    same = r["i"] == r["j"]
    left = [x for x in r["members"] if x["block"] == r["i"]]
    return left, left if same else [x for x in r["members"] if x["block"] == r["j"]], same


CELL = "band bigint, at int, depth int, i bigint, j bigint"


def _open(threshold: float):
    """The members of each pair of blocks that stand in a candidate pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            for row in range(len(batch)):
                (r,) = batch.slice(row, 1).to_pylist()  # members are many objects: one pair of blocks at once
                left, right, same = _sides(r)
                a, b, _ = _candidates(left, right, same, r["at"], threshold, r["depth"])
                for x in [left[i] for i in set(a.tolist()) | (set(b.tolist()) if same else set())] + ([] if same else [right[i] for i in set(b.tolist())]):
                    out.append((r["band"], r["at"], r["depth"], r["i"], r["j"], x["key"], x["comp"], x["block"], x["sig"], x["marks"]))
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], k) for n, k in enumerate(kinds)], ["band", "at", "depth", "i", "j", "key", "comp", "block", "sig", "marks"])

    return lean(run)


def _links(threshold: float, percent: int):
    """Verified links between components, as many as connect what is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for row in range(len(batch)):
                (r,) = batch.slice(row, 1).to_pylist()
                left, right, same = _sides(r)
                sets = {id(x): np.frombuffer(x["items"], np.uint64) for x in r["members"]}
                parent: dict[bytes, bytes] = {}

                def root(x):
                    while parent.get(x, x) != x:
                        parent[x] = parent.get(parent[x], parent[x])
                        x = parent[x]
                    return x

                a, b, alike = _candidates(left, right, same, r["at"], threshold, r["depth"])
                for k in np.argsort(-alike, kind="stable"):
                    x, y = left[a[k]], right[b[k]]
                    p, q = root(x["comp"]), root(y["comp"])
                    if p == q:
                        continue
                    s, t = sets[id(x)], sets[id(y)]
                    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                        continue
                    at = np.searchsorted(t, s)
                    common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
                    if 100 * common >= percent * (len(s) + len(t) - common):
                        parent[p] = q
                        src.append(x["key"])
                        dst.append(y["key"])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.binary()), pa.array(dst, pa.binary())], ["src", "dst"])

    return lean(run)


def _sets_of(keys: DataFrame, documents: DataFrame, holders: DataFrame, k: int) -> DataFrame:
    """(key, items) of the wanted classes: sorted hashes as bytes, computed anew from one text of each class."""
    # up to a bound the ids go to the texts; beyond it both are shuffled
    ids = bounded_broadcast(save(holders.join(keys, "key", "left_semi").select("doc_id").distinct(), "ids"), limit=IDS)
    texts_of = documents.alias("d").join(ids.alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi").select("text")
    return texts_of.mapInArrow(_sets(k), "key binary, items binary").join(keys, "key", "left_semi").groupBy("key").agg(F.first("items").alias("items"))


@lean
def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "a", 16 << 20):
            n = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                s, t = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                n.append(int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()))
            sizes = [pc.divide(pc.binary_length(batch.column(c)), 8).cast(pa.int64()) for c in "ab"]
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst"), *sizes, pa.array(n, pa.int64())], ["src", "dst", "na", "nb", "n"])


def _verify(pairs: DataFrame, documents: DataFrame, holders: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs of classes whose full sets have 100 * intersection >= percent * union."""
    wanted = pairs.select(F.col("src").alias("key")).union(pairs.select("dst")).distinct()
    sets = save(_sets_of(wanted, documents, holders, k), "sets")
    a, b = sets.select(F.col("key").alias("src"), F.col("items").alias("a")), sets.select(F.col("key").alias("dst"), F.col("items").alias("b"))
    # by size first: sizes in a ratio below the threshold can't reach it
    sizes = sets.select("key", F.length("items").alias("n"))
    alike = pairs.join(sizes.select(F.col("key").alias("src"), F.col("n").alias("m")), "src").join(sizes.select(F.col("key").alias("dst"), "n"), "dst")
    alike = alike.where(100 * F.least("m", "n") >= percent * F.greatest("m", "n")).select("src", "dst")
    both = alike.join(a, "src").join(b, "dst").select("src", "dst", "a", "b")
    counted = both.mapInArrow(_common, "src binary, dst binary, na bigint, nb bigint, n bigint")
    return counted.where(100 * F.col("n") >= percent * (F.col("na") + F.col("nb") - F.col("n"))).select("src", "dst")


def star_components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the undirected edges (src, dst): alternating large-star and small-star until nothing changes.

    Each star needs a node's least neighbour, a partially aggregated minimum, and a join back; no
    neighbourhood is gathered. The edges of a hub are narrow rows, whose partition adaptive execution splits for the join. Self loops and repeated edges are allowed; comp is the least node reachable.
    """
    edges = save(edges.where("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct(), "edges")
    before = None
    while True:
        # large star: every greater neighbour of u moves to the least of u and its neighbours
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # small star: the lesser neighbours of u and u itself move to the least of them
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi")
        small = moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(moved.select("hi", F.col("m").alias("lo"))).where("hi <> lo").distinct()
        last, edges = edges, save(small, "edges")
        forget(last)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    # a fixed point: every node but the least of a component has one edge, to that least node
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("comp")).union(edges.select(F.col("lo"), F.col("lo"))).distinct()


def _components(documents: DataFrame, percent: int, k: int, hashes: int, rows: int, slack: float) -> tuple[DataFrame, DataFrame]:
    """(the columns but text, key, n_shingles) of each document, and (key, comp, least doc_id) of each class."""
    ids = [c for c in documents.columns if c != "text"]
    kinds = ", ".join(f"{c} {dict(documents.dtypes)[c]}" for c in ids)
    signed = save(documents.mapInArrow(_signatures(hashes, rows, k, ids), f"{kinds}, key binary, n_shingles bigint, sig binary, bands array<bigint>, marks binary"), "signatures")
    docs = signed.select(*ids, "key", "n_shingles")
    classes = save(docs.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")), "classes")
    first = (F.col("s.key") == F.col("c.key")) & F.col("s.doc_id").eqNullSafe(F.col("c.doc_id"))
    one = signed.alias("s").join(classes.alias("c"), first, "left_semi").select("key", "sig", "bands", "marks")
    members = one.select("key", F.posexplode("bands").alias("at", "band")).withColumn("depth", F.lit(1))
    links, comps, pieces = None, None, []
    for depth in range(1, DEPTH + 1):
        bucket = ["band", "at", "depth"]
        if depth == 1:
            pivots = members.groupBy(*bucket).agg(F.min("key").alias("pivot"), F.max("key").alias("most")).where("pivot <> most").select(*bucket, "pivot")
            members = save(members.join(pivots, bucket), "members")  # only buckets with two classes or more
        met = members.where("key <> pivot")
        tried = save(met.select(F.col("pivot").alias("src"), F.col("key").alias("dst")).distinct(), "pairs")
        new = save(_verify(tried, documents, classes, k, percent), "links")
        links = new if links is None else save(links.union(new).distinct(), "links")
        comps = star_components(links)
        # what goes on: buckets whose members besides the pivot, which has met them all, are in several components
        others = met.select("key", *bucket).distinct()
        at = others.join(comps, others["key"] == comps["node"], "left").select("key", *bucket, F.coalesce("comp", "key").alias("comp"))
        mixed = at.groupBy(*bucket).agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("size")).where("a <> b").select(*bucket, "size")
        rest = save(at.join(mixed, bucket), "rest")
        pieces.append(rest.where(F.col("size") <= DIVIDE) if depth < DEPTH else rest)
        large = rest.where(F.col("size") > DIVIDE)
        if depth == DEPTH or large.isEmpty():
            break
        # a large bucket's members by each later band that they have, but for the pivot
        apart = large.select("key", "band", "at", "depth").join(one.select("key", F.posexplode("bands").alias("next", "more")).dropDuplicates(["key", "next"]), "key").where("next > at")
        apart = apart.select("key", F.xxhash64("band", "more").alias("band"), F.col("next").alias("at"), (F.col("depth") + 1).alias("depth"))
        pivots = apart.groupBy(*bucket).agg(F.min("key").alias("pivot"), F.max("key").alias("most")).where("pivot <> most").select(*bucket, "pivot")
        members = save(apart.join(pivots, bucket), "members")

    rest = pieces[0]
    for more in pieces[1:]:
        rest = rest.union(more)
    # components of now: later rounds have joined some
    rest = rest.drop("comp").join(comps, rest["key"] == comps["node"], "left").select("key", "band", "at", "depth", F.coalesce("comp", "key").alias("comp"))
    more = save(_residual(save(rest, "rest"), one, documents, classes, k, percent, slack), "links")
    comps = star_components(links.union(more))

    least = classes.join(comps, classes["key"] == comps["node"], "left").select("key", F.coalesce("comp", "key").alias("comp"), "doc_id")
    return docs, least


def near_duplicates(documents: DataFrame, percent: int = 80, k: int = SHINGLE, hashes: int = HASHES, rows: int = ROWS, slack: float = SLACK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable), kept.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets. kept is true for
    the document whose id is its component's, and for documents without an id that can be given.
    """
    docs, least = _components(documents.select("doc_id", "text"), percent, k, hashes, rows, slack)
    ids = least.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    by_key = least.select("key", "comp").join(ids, "comp").select("key", "component_id")
    # documents with an empty set are no rows of one key in the join
    some = docs.where("key is not null").join(by_key, "key").select("doc_id", "n_shingles", "component_id")
    none = docs.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.union(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def one_of_each(documents: DataFrame, percent: int = 80, k: int = SHINGLE, hashes: int = HASHES, rows: int = ROWS, slack: float = SLACK, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The documents, with all their columns, but one row only of each component of near duplicates.

    Of a component, the row with the least doc_id stays (null last), then the one with the least hashes of its text
    and of all columns; of rows that are the same in all columns, one. Rows without words are linked with nothing and stay.
    Texts are shuffled to the decisions only if these are more than ``limit`` rows.
    """
    known = documents.select(F.struct(*documents.columns).alias("_row"), "doc_id", "text", *[v.alias(c) for c, v in zip(ROW, row_names(documents), strict=True)])
    docs, least = _components(known.select("doc_id", *ROW, "text"), percent, k, hashes, rows, slack)
    placed = save(docs.where("key is not null").join(least.select("key", "comp"), "key").groupBy("comp", *ROW).agg(F.count("*").alias("n")), "placed")
    stays = placed.groupBy("comp").agg(F.min(F.struct(*ROW)).alias("least"))
    marked = placed.join(stays, "comp").select(*ROW, (F.struct(*ROW) == F.col("least")).alias("stays"), "n")
    marked = save(marked.where("n > 1 or not stays"), "marked")
    single = known.join(decisions(marked.select(*ROW), limit), ROW, "left_anti").select("_row.*")
    again = known.join(decisions(marked.where("stays").select(*ROW), limit), ROW, "left_semi").dropDuplicates(ROW).select("_row.*")
    return single.union(again)


def _residual(rest: DataFrame, signed: DataFrame, documents: DataFrame, holders: DataFrame, k: int, percent: int, slack: float) -> DataFrame:
    """Links across components in the given buckets, block against block.

    A bucket's members are dealt to blocks by their key, about BLOCK of them and BLOCK_BYTES of their sets in each; pairs
    of blocks are rows of their own, so that a bucket of any size spreads over tasks. Sets go only to the pairs of
    blocks, and for the members, that have a candidate pair.
    """
    threshold = percent / 100 - slack
    bucket = ["band", "at", "depth"]
    cell = [*bucket, "i", "j"]
    rest = rest.join(holders.select("key", "n"), "key")
    needed = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES))
    sizes = rest.groupBy(*bucket).agg(needed.alias("blocks"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select(*bucket, "blocks")
    dealt = rest.drop("n").join(sizes, bucket).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    sigs = signed.join(rest.select("key").distinct(), "key", "left_semi").select("key", "sig", "marks").dropDuplicates(["key"])
    sent = dealt.join(sigs, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ends = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    cells = sent.select(*bucket, *ends, F.struct("key", "comp", "block", "sig", "marks").alias("m")).groupBy(*cell).agg(F.collect_list("m").alias("members"))
    some = F.aggregate("members", F.lit(False), lambda a, m: a | (m["comp"] != F.col("members")[0]["comp"]))
    opened = save(cells.where(some).mapInArrow(_open(threshold), f"{CELL}, key binary, comp binary, block bigint, sig binary, marks binary"), "open")
    sets = save(_sets_of(opened.select("key").distinct(), documents, holders, k), "sets")
    full = opened.join(sets, "key").select(*cell, F.struct("key", "comp", "block", "sig", "marks", "items").alias("m"))
    return full.groupBy(*cell).agg(F.collect_list("m").alias("members")).mapInArrow(_links(threshold, percent), "src binary, dst binary")
