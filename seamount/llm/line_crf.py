"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are shares of its character classes, word statistics and
how often the line stands in the document, those of its two neighbours, and whether it is the first or last.
A document's score is the length-weighted mean of its lines' forward-backward marginals for good.

Learning uses whole texts of a bounded sample of labelled documents (``TRAIN_DOCS``, those with the least hashes),
each line bearing its document's label. Scoring uses the text only. A null, empty or blank text scores 0.
Labels that disagree about a document leave it out; with labels of one kind only, or none, every other text
scores that kind (0.5 for none).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, slices, texts

TRAIN_DOCS = 2000
FOLDS = 5
THRESHOLD = 0.3
STEPS, RATE, DECAY = 120, 0.15, 1e-3

#: Features are made of so many text bytes at once: each takes some 25 bytes of work.
SLICE = 1 << 20

OWN = 17  #: features of a line by itself
SIZE = 3 * OWN + 3

# character classes
_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _PIPE, _BANG, _MARK, _HIGH, _CTRL, _CLASSES = range(11)
_CLASS = np.full(256, _MARK, np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[:32] = _CTRL
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = _STOP
_CLASS[ord("|")], _CLASS[ord("!")] = _PIPE, _BANG


def line_features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each document."""
    joined = b"\n".join(docs)
    per_doc = np.array([d.count(b"\n") + 1 for d in docs], np.int64)
    lines = joined.split(b"\n") if docs else []
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    chars = np.frombuffer(joined, np.uint8)
    of = np.repeat(np.arange(len(lines)) * _CLASSES, size + 1)[: len(chars)]
    of += _CLASS[chars]
    counts = np.bincount(of, minlength=len(lines) * _CLASSES).reshape(len(lines), _CLASSES).astype(np.float32) if len(lines) else np.zeros((0, _CLASSES), np.float32)
    if len(lines):
        ends = np.ones(len(lines), np.float32)
        ends[-1] = 0
        counts[:, _SPACE] -= ends  # the line feed
    words = np.zeros((len(lines), 4), np.float32)
    at = 0
    for n in per_doc:
        own = lines[at : at + n]
        seen = Counter(own)
        for i, line in enumerate(own, at):
            w = line.split()
            if w:
                k = len(w)
                words[i] = k, len(set(w)) / k, sum(map(eq, w, w[1:])) / k, seen[line] / n if seen[line] > 1 else 0
        at += n
    n = np.maximum(size, 1)[:, None].astype(np.float32)
    share = counts / n
    letters = np.maximum(counts[:, _UPPER] + counts[:, _LOWER] + counts[:, _HIGH], 1)
    k = np.maximum(words[:, 0], 1)
    x = np.column_stack([
        share[:, [_UPPER, _DIGIT, _SPACE, _STOP]] * 4,
        np.minimum(share[:, [_PIPE, _BANG, _MARK, _CTRL]] * 10, 2),
        share[:, _HIGH], counts[:, _UPPER] / letters,
        np.log1p(words[:, 0]) / 5, words[:, 1], words[:, 2], words[:, 3],
        np.minimum((counts[:, _UPPER] + counts[:, _LOWER] + counts[:, _HIGH]) / k / 10, 2),
        np.minimum(np.log1p(k * (1 - words[:, 1])) / 5, 2),
        (size == 0).astype(np.float32),
    ]).astype(np.float32)
    first, last = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    stops = np.cumsum(per_doc)
    first[stops - per_doc] = last[stops - 1] = True
    before, after = np.roll(x, 1, axis=0), np.roll(x, -1, axis=0)
    before[first] = 0
    after[last] = 0
    return np.column_stack([x, before, after, first, last, np.ones(len(lines))]).astype(np.float32), size, per_doc


def _batches(per_doc: np.ndarray, cells: int = 1 << 18) -> Iterator[np.ndarray]:
    """Documents in groups of about equal numbers of lines, of at most ``cells`` padded cells, or one."""
    order = np.argsort(per_doc, kind="stable")[::-1]
    i = 0
    while i < len(order):
        n = max(1, cells // int(per_doc[order[i]]))
        yield order[i : i + n]
        i += n


def forward_backward(scores: np.ndarray, mask: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Marginals for good, (docs, lines), and expected transition counts, (2, 2), if the documents are weighted.

    scores: (docs, lines), the log-odds of good by the line's features; the mask holds for a prefix of lines.
    """
    docs, n = scores.shape
    e = np.zeros((docs, n, 2))
    e[:, :, 1] = scores
    alpha, beta = np.zeros((docs, n, 2)), np.zeros((docs, n, 2))
    alpha[:, 0] = e[:, 0]

    def lse(x):  # over axis 1 of (docs, 2, 2)
        return np.logaddexp(x[:, 0], x[:, 1])

    for i in range(1, n):
        step = e[:, i] + lse(alpha[:, i - 1, :, None] + trans)
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    for i in range(n - 2, -1, -1):
        step = lse((e[:, i + 1] + beta[:, i + 1])[:, :, None] + trans.T)
        beta[:, i] = np.where(mask[:, i + 1, None], step, 0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    good = np.exp(np.minimum(alpha[:, :, 1] + beta[:, :, 1] - total[:, None], 0)) * mask
    pairs = np.zeros((2, 2))
    if n > 1 and weight is not None:
        both = alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pairs = np.einsum("dnab,dn->ab", np.exp(np.minimum(both, 0)), mask[:, 1:] * weight[:, None])
    return good, pairs


def _padded(x: np.ndarray, starts: np.ndarray, counts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line numbers (docs, lines), clipped, and the mask."""
    n = counts[docs]
    at = np.arange(n.max())[None, :]
    mask = at < n[:, None]
    return np.where(mask, starts[docs][:, None] + at, 0), mask


def fit(features: list[np.ndarray], labels: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions, by Adam on the whole sample's conditional log-likelihood."""
    w, trans = np.zeros(SIZE), np.zeros((2, 2))
    if len(set(labels)) < 2:
        w[-1] = 20.0 * (2 * labels[0] - 1) if labels else 0.0
        return w, trans
    x = np.concatenate(features).astype(np.float64)
    counts = np.array([len(f) for f in features])
    starts = np.cumsum(counts) - counts
    y = np.repeat(labels, counts).astype(np.float64)
    # each document counts alike, however many lines it has
    weight = np.repeat(1 / counts, counts)
    steps = np.zeros((2, 2))
    for label, n in zip(labels, counts, strict=True):
        steps[label, label] += (n - 1) / n
    groups = [(docs, *_padded(x, starts, counts, docs)) for docs in _batches(counts)]
    m = v = np.zeros(SIZE + 4)
    for t in range(1, STEPS + 1):
        s = x @ w
        p, pairs = np.zeros(len(x)), np.zeros((2, 2))
        for docs, at, mask in groups:
            good, some = forward_backward(s[at], mask, trans, 1 / counts[docs])
            p[at[mask]] = good[mask]
            pairs += some
        g = np.concatenate([x.T @ (weight * (y - p)), (steps - pairs).ravel()]) / len(counts) - DECAY * np.concatenate([w, trans.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, trans = w + d[:SIZE], trans + d[SIZE:].reshape(2, 2)
    return w, trans


def score_texts(docs: list[bytes], w: np.ndarray, trans: np.ndarray) -> np.ndarray:
    x, size, counts = line_features(docs)
    starts = np.cumsum(counts) - counts
    s = x.astype(np.float64) @ w
    out = np.zeros(len(docs))
    for group in _batches(counts):
        at, mask = _padded(x, starts, counts, group)
        good, _ = forward_backward(s[at], mask, trans)
        weight = size[at] * mask
        out[group] = (good * weight).sum(axis=1) / np.maximum(weight.sum(axis=1), 1)
    return np.clip(np.where([bool(d.strip()) for d in docs], out, 0.0), 0, 1)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text is divisible by FOLDS; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, limit=SLICE):
            x, _, counts = line_features(texts(batch))
            stops = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array([x[b - n : b].tobytes() for n, b in zip(counts, stops, strict=True)], pa.binary())], ["quality", "x"])


def train(documents: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Fits on the documents with a label that aren't held out, at most ``limit``: those with the least hashes of id."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    chosen = known.where(~held_out(F.col("doc_id"))).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("length(trim(text)) > 0").select("quality", "text")
    found = rows.mapInArrow(lean(_features), "quality int, x binary").toPandas().sort_values(["quality", "x"], ignore_index=True)
    return fit([np.frombuffer(b, np.float32).reshape(-1, SIZE) for b in found["x"]], [int(q) for q in found["quality"]])


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, held_out, score and predicted for each document."""
    w, trans = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score_texts(texts(batch), w, trans))], ["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(lean(run), "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """The documents, with all their columns, whose score reaches the threshold."""
    w, trans = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                yield batch.filter(pa.array(score_texts(texts(batch), w, trans) >= THRESHOLD))

    return documents.mapInArrow(lean(run), documents.schema)
