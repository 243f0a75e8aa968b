"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, by their CRC-32. All words of all
documents are counted. The most frequent ones, as many as the square root of the number of tokens, are the network's
vocabulary, which so grows with the corpus; other words share RARE classes, and inside a class a word has its smoothed
share of the counts in hashed buckets, whose number grows alike: that is the back-off.

The network reads the words at REACH places on either side of a token, never the token itself, and predicts the word:
a hidden layer over the sum of the neighbours' vectors, and a softmax over the whole vocabulary by a Huffman tree, so
that a word's probability is a product of its branches' and all of them sum to 1. A document's score is the sum of
ln p(word | both sides) over all its tokens.

Training goes over all documents in ROUNDS rounds. A document belongs to a round and a shard by a hash of its id and
text; a shard is worked in the order of these hashes, from the weights of the round before, and sends its weights.
Their mean, row by row and weighted by how often the shard has used the row, is taken in the order of the shards. So
neither files nor partitions matter to the result. What is gathered (counts, buckets, weights) grows with the input; the driver and each
task hold numbers of rows that grow with its square root.

Null, empty and blank texts have no tokens, a sum of 0 and no mean. With no tokens at all the first weights stand.
Repeated rows each give a row and count each; null ids and extra columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, save, slices, texts

#: Vocabulary for each square root of a token, buckets for each word of it, and the classes of other words.
VOCABULARY, BUCKETS, RARE = 1.0, 16, 32
REACH, HIDDEN = 2, 12
TOP = 64  #: inner nodes that most paths go through: worked as a matrix, the others one by one
BATCH, RATE = 8192, 0.15
ROUNDS = 2
#: Tokens in a shard: at least so many, and so many for each word of the vocabulary.
SHARD, SHARD_WORDS = 4_000_000, 400
CHUNK = 512  #: rows of weights that are averaged together
SHIFTS = [i for i in range(2 * REACH + 1) if i != REACH]


def hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(crc32, words), np.uint32, len(words))


@dataclass
class Words:
    """The vocabulary: sorted hashes of its words, each word's leaf, and the shares of rare words' buckets in their class."""

    known: np.ndarray
    leaf: np.ndarray
    share: np.ndarray  #: ln p(bucket | its class)
    starts: np.ndarray  #: where a leaf's path begins in nodes and signs
    sizes: np.ndarray
    nodes: np.ndarray
    signs: np.ndarray

    @property
    def size(self) -> int:
        return len(self.known)

    @property
    def pad(self) -> int:
        return self.size + RARE

    def ids(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each word, and ln p(word | leaf): 0 for words of the vocabulary."""
        bucket = hashed & np.uint32(len(self.share) - 1)
        out = self.size + (bucket % RARE).astype(np.int64)
        within = self.share[bucket]
        if self.size:
            at = np.minimum(np.searchsorted(self.known, hashed), self.size - 1)
            hit = self.known[at] == hashed
            out[hit] = self.leaf[at[hit]]
            within[hit] = 0
        return out, within


def huffman_paths(counts: np.ndarray) -> list[list[tuple[int, int]]]:
    """For each leaf the inner nodes from the root, with the side that is taken (1 or -1)."""
    n = len(counts)
    heap = [(float(c), i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    for node in range(n, 2 * n - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        up[i], up[j] = (node, 1), (node, -1)
        heapq.heappush(heap, (a + b, node))
    below: dict[int, list[tuple[int, int]]] = {2 * n - 2: []}
    for node in range(2 * n - 3, -1, -1):
        parent, side = up[node]
        below[node] = [*below[parent], (parent - n, side)]
    return [below[i] for i in range(n)]


def words_of(top: list[tuple[int, int]], buckets: np.ndarray) -> Words:
    """top: (hash, count) of the vocabulary; buckets: the counts of all other words by bucket."""
    known = np.array([h for h, _ in top], np.uint32)
    order = np.argsort(known)
    of = np.arange(len(buckets)) % RARE
    mass = np.bincount(of, buckets + 1.0, RARE)
    leaves = np.concatenate([[c for _, c in top], np.bincount(of, buckets, RARE) + 1.0])
    paths = huffman_paths(leaves)
    sizes = np.array([len(p) for p in paths])
    flat = np.array([x for p in paths for x in p], np.int64)
    # inner nodes by how many tokens pass them
    passed = np.bincount(flat[:, 0], np.repeat(leaves, sizes))
    flat[:, 0] = np.argsort(np.lexsort((np.arange(len(passed)), -passed)))[flat[:, 0]]
    return Words(known[order], order, np.log((buckets + 1.0) / mass[of]).astype(np.float32), np.cumsum(sizes) - sizes, sizes, flat[:, 0], flat[:, 1].astype(np.float32))


def vocabulary(documents: DataFrame, scale: float = VOCABULARY) -> tuple[Words, int]:
    """The words of all documents, and how many tokens there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, limit=16 << 20):
                own = [hashes(t) for t in texts(batch)]
                word, n = np.unique(np.concatenate(own), return_counts=True) if own else (np.empty(0, np.uint32), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    counts = save(documents.select("text").mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    size = int(np.ceil(scale * np.sqrt(total)))
    top = counts.orderBy(F.desc("n"), "word").limit(size)
    top = top.toArrow()
    chosen = list(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True))
    cells = 1 << int(np.ceil(np.log2(BUCKETS * max(size, 16))))
    frame = documents.sparkSession.createDataFrame([(h,) for h, _ in chosen], "word bigint")
    rest = counts.join(F.broadcast(frame), "word", "left_anti")  # as many rows as the square root of the tokens
    found = rest.groupBy(F.pmod("word", F.lit(cells)).cast("int").alias("cell")).agg(F.sum("n").alias("n")).toArrow()
    buckets = np.zeros(cells)
    buckets[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    forget(counts)
    return words_of(chosen, buckets), total


@dataclass
class Paths:
    """Paths from the root to the leaves of tokens, one after the other, by branch; u and of only for those outside TOP."""

    nodes: np.ndarray
    signs: np.ndarray
    begin: np.ndarray  #: where a token's path begins
    token: np.ndarray
    top: np.ndarray  #: places of branches at nodes below TOP
    low: np.ndarray  #: and of all others
    u: np.ndarray
    of: np.ndarray  #: hidden values
    odds: np.ndarray  #: of the side that is taken


class Network:
    """Rows of HIDDEN weights: a vector for each leaf and the padding, one for each inner node, the places' scales, and the bias."""

    def __init__(self, words: Words, rows: np.ndarray | None = None):
        self.words = words
        self.leaves, self.inner = words.pad + 1, words.pad - 1
        n = self.leaves + self.inner
        if rows is None:
            r = np.random.default_rng(7)
            rows = np.concatenate([r.normal(0, 0.3, (self.leaves, HIDDEN)), np.zeros((self.inner, HIDDEN)), r.normal(1, 0.3, (len(SHIFTS), HIDDEN)), np.zeros((1, HIDDEN))]).astype(np.float32)
        self.rows = rows
        self.e, self.u, self.s, self.b = rows[: self.leaves], rows[self.leaves : n], rows[n:-1], rows[-1]

    def predict(self, c: np.ndarray, n: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The neighbours' vectors, and hidden values, for places REACH .. REACH + n of a stream."""
        near = [self.e[c[i : i + n]] for i in SHIFTS]
        h = near[0] * self.s[0]
        for x, s in zip(near[1:], self.s[1:], strict=True):
            h += x * s
        h += self.b
        return near, np.tanh(h, out=h)

    def branches(self, h: np.ndarray, leaf: np.ndarray) -> Paths:
        """The paths to the leaves of tokens with the hidden values h."""
        w = self.words
        sizes = w.sizes[leaf]
        begin = np.cumsum(sizes) - sizes
        at = np.repeat(w.starts[leaf] - begin, sizes) + np.arange(sizes.sum())
        nodes, signs, token = w.nodes[at], w.signs[at], np.repeat(np.arange(len(leaf)), sizes)
        top = nodes < TOP
        low = np.flatnonzero(~top)
        top = np.flatnonzero(top)
        odds = np.empty(len(nodes), np.float32)
        odds[top] = (h @ self.u[:TOP].T)[token[top], nodes[top]]
        u, of = self.u[nodes[low]], h[token[low]]
        odds[low] = np.einsum("ij,ij->i", of, u)
        return Paths(nodes, signs, begin, token, top, low, u, of, odds * signs)

    def scores(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """ln p(leaf | both sides) of the tokens at places ``at`` of a stream."""
        out = np.empty(len(at))
        for i in range(0, len(at), BATCH):
            own = at[i : i + BATCH]
            first, last = own[0], own[-1] + 1
            _, h = self.predict(c[first - REACH : last + REACH], last - first)
            paths = self.branches(h[own - first], c[own])
            out[i : i + BATCH] = -np.add.reduceat(np.log(1 + np.exp(np.minimum(-paths.odds, 80))), paths.begin)
        return out


def _sums(keys: np.ndarray, values: np.ndarray, ordered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys, the sums of their values, and how many each has."""
    if not ordered:
        order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")  # 16 bits at a time are sorted by counting
        if len(keys) and keys.max() >> 16:
            order = order[np.argsort((keys[order] >> 16).astype(np.uint16 if keys.max() >> 32 == 0 else np.int64), kind="stable")]
        keys, values = keys[order], values[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(values, first, axis=0), np.diff(np.append(first, len(keys)))


class Trainer:
    """Steps of ascent on the log-likelihood; each row of weights has a rate of its own, by the squares of its steps."""

    def __init__(self, words: Words, rows: np.ndarray):
        self.net = Network(words, rows.copy())
        self.squares = np.full(len(rows), 1e-6, np.float32)
        self.used = np.zeros(len(rows), np.int64)

    def _move(self, rows: np.ndarray, g: np.ndarray, n: np.ndarray) -> None:
        self.squares[rows] += (g * g).mean(axis=1)
        self.net.rows[rows] += RATE * g / np.sqrt(self.squares[rows])[:, None]
        self.used[rows] += n

    def learn(self, c: np.ndarray, at: np.ndarray) -> None:
        net = self.net
        for i in range(0, len(at), BATCH):
            own = at[i : i + BATCH]
            first, last = own[0], own[-1] + 1
            part = c[first - REACH : last + REACH]
            near, h = net.predict(part, last - first)
            here = own - first
            h = h[here]
            x = net.branches(h, c[own])
            g = x.signs / (1 + np.exp(np.minimum(x.odds, 30)))
            dense = np.zeros((len(own), TOP), np.float32)
            dense[x.token[x.top], x.nodes[x.top]] = g[x.top]
            common = net.u[:TOP]
            d = dense[:, : len(common)] @ common
            moves = [(np.arange(len(common)), dense[:, : len(common)].T @ h, np.bincount(x.nodes[x.top], minlength=len(common)))]
            if len(x.low):
                weight = g[x.low][:, None]
                own_of, sums, _ = _sums(x.token[x.low], x.u * weight, True)
                d[own_of] += sums
                moves.append(_sums(x.nodes[x.low], x.of * weight))
            d *= 1 - h * h
            seen = np.concatenate([part[here + s] for s in SHIFTS])
            into = _sums(seen, np.concatenate([d * s for s in net.s]))
            scale = np.stack([(d * v[here]).sum(axis=0) for v in near])
            top = len(net.rows) - len(SHIFTS) - 1
            for nodes, step, n in moves:
                used = n > 0
                self._move(nodes[used] + net.leaves, step[used], n[used])
            self._move(*into)
            self._move(np.arange(top, len(net.rows)), np.concatenate([scale, d.sum(axis=0)[None]]), np.full(len(SHIFTS) + 1, len(own)))


def stream(docs: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The leaves of all documents in a row with REACH places of padding around each, and where tokens are."""
    size = np.array([len(d) for d in docs], np.int64)
    starts = np.cumsum(size + REACH) - size  # REACH places before each document, REACH after the last
    out = np.full(int((size + REACH).sum()) + REACH, pad, np.int64)
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    out[at] = np.concatenate(docs) if docs else []
    return out, at


def _mean(pdf: pd.DataFrame) -> pd.DataFrame:
    """The mean of a chunk of rows over the shards, in their order, by how often they used each row."""
    total = seen = 0
    for w, n in zip(*(pdf.sort_values("shard")[x] for x in ("w", "n")), strict=True):
        n = np.frombuffer(n, np.int64)[:, None]
        total = total + np.frombuffer(w, np.float32).reshape(len(n), HIDDEN) * n.astype(np.float64)
        seen = seen + n
    return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "w": [(total / np.maximum(seen, 1)).astype(np.float32).tobytes()], "n": [seen.tobytes()]})


def train(documents: DataFrame, words: Words, tokens: int, rounds: int = ROUNDS, shard: int | None = None) -> Network:
    """The network after all documents, each in one of the rounds. shard: how many tokens a shard has, about."""
    spark = documents.sparkSession
    shards = max(1, round(tokens / (shard or max(SHARD, SHARD_WORDS * words.size)) / rounds))
    mark = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    dealt = documents.select("text", mark.alias("mark")).where("length(text) > 0").withColumn("shard", F.pmod("mark", F.lit(rounds * shards)).cast("int"))
    net = Network(words)
    sent = spark.sparkContext.broadcast(words)
    for turn in range(rounds):
        own = dealt.where((F.col("shard") >= turn * shards) & (F.col("shard") < (turn + 1) * shards)).repartitionById(shards, F.col("shard") - turn * shards).sortWithinPartitions("shard", "mark", "text")
        start = spark.sparkContext.broadcast(net.rows)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            words, trainer, now = sent.value, None, None

            def give():
                rows, used = trainer.net.rows, trainer.used
                cuts = range(0, len(rows), CHUNK)
                kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                columns = [[now] * len(cuts), list(range(len(cuts))), [rows[i : i + CHUNK].tobytes() for i in cuts], [used[i : i + CHUNK].tobytes() for i in cuts]]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["shard", "chunk", "w", "n"])

            for whole in batches:
                shard_of = whole.column("shard").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(shard_of)) + 1).tolist(), len(shard_of)]
                for i, j in zip(edges, edges[1:]):
                    if i == j:
                        continue
                    if shard_of[i] != now:
                        if trainer:
                            yield give()
                        trainer, now = Trainer(words, start.value), int(shard_of[i])
                    for batch in slices(whole.slice(i, j - i)):
                        trainer.learn(*stream([words.ids(hashes(t))[0] for t in texts(batch)], words.pad))
            if trainer:
                yield give()

        means = own.select("text", "shard").mapInArrow(run, "shard int, chunk int, w binary, n binary").groupBy("chunk").applyInPandas(_mean, "chunk int, w binary, n binary")
        rows = net.rows.copy()
        found = means.toArrow()
        for chunk, w, n in zip(*(found.column(x).to_pylist() for x in ("chunk", "w", "n")), strict=True):
            to = rows[chunk * CHUNK : (chunk + 1) * CHUNK]
            used = np.frombuffer(n, np.int64) > 0  # rows that no shard has used stay as they are
            to[used] = np.frombuffer(w, np.float32).reshape(-1, HIDDEN)[used]
        net = Network(words, rows)
    return net


def score_texts(net: Network, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The number of tokens of each text, and the sum of their ln p(word | both sides)."""
    found = [net.words.ids(hashes(t)) for t in docs]
    size = np.array([len(x) for x, _ in found], np.int64)
    c, at = stream([x for x, _ in found], net.words.pad)
    each = net.scores(c, at) + np.concatenate([x for _, x in found]) if len(at) else np.empty(0)
    upto = np.concatenate([[0.0], np.cumsum(each)])
    stops = np.cumsum(size)
    return size, upto[stops] - upto[stops - size]


def score(documents: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (summed) and mean_log_likelihood of each document."""
    sent = documents.sparkSession.sparkContext.broadcast((net.words, net.rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(*sent.value)
        for whole in batches:
            for batch in slices(whole):
                size, total = score_texts(own, texts(batch))
                mean = pa.array(total / np.maximum(size, 1), mask=size == 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(total), mean], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, log_likelihood double, mean_log_likelihood double")


def score_documents(documents: DataFrame) -> DataFrame:
    words, tokens = vocabulary(documents)
    return score(documents, train(documents, words, tokens))
