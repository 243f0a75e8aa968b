"""Token ids in canonical length-limited Huffman code: encode from global counts, decode by table from checkpoints.

File format: a folder with two Parquet tables, so that any store Spark reads will do. ``code`` is all that decoding
needs to know: a row for each id in use (version, vocabulary, step: the same in all rows; id; length: of its code in
bits). ``blocks`` has a row for each block:

===========  =============================================================================================
part, block  order of the blocks: partitions are ranges of doc_id, blocks are numbered within one
at           ids in the partition before this block
doc_no       number within the partition of the block's first document
doc_ids      ids of the documents that the block holds, in ascending order
counts       how many token ids each of them has in this block
piece        a document of over BLOCK ids is alone in blocks of BLOCK ids each: the number of this one
pieces       and how many there are; 0 and 1 for blocks of whole documents
bits         the codes, most significant bit first
checkpoints  little-endian u32: the bit offset of every STEP-th id, so that decoding starts at any of them
===========  =============================================================================================

Codes are canonical: they follow from their lengths. Blocks decode independently of each other; within a block all checkpoints decode at once. Texts are encoded once,
into blocks of plain ids; the ids are counted from those, and each block is then rewritten in the code.

A null text is empty and has the end id only. Null doc_ids come first. Repeated doc_ids stand in the order of
their texts. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, forget, lean, new_path, save, slices, write

END = 0
BLOCK = 1 << 16
STEP = 128
VERSION = 1
#: Texts are encoded in slices of about so many bytes: longer ones hold fewer different pieces for their size.
SLICE = 8 << 20
LIMIT = 20  #: longest code in bits; more only if the ids don't fit

PLAIN = "part int, block bigint, at bigint, doc_no bigint, doc_ids array<bigint>, counts array<bigint>, piece int, pieces int, ids binary"
BLOCKS = PLAIN.replace("ids binary", "bits binary, checkpoints binary")
CODE = "version int, vocabulary int, step int, id int, length int"
PIECES = "part int, doc_no bigint, piece int, pieces int, doc_id bigint, rel bigint, n_tokens bigint, ids_crc32 bigint"


class Encoder:
    """Texts to the ids of a tokenizers file, of two or four bytes an id.

    Byte-level BPE splits a text into words first. A single space between two characters that aren't white
    space always begins a word, and a single line feed between two such characters always is one. So the pieces
    between such places are encoded apart from each other, each with the space or line feed before it, and
    remembered. Letters never join with marks behind them either, so a word with marks is put together from both.
    Arrow cuts a slice of texts into pieces and numbers them; Python sees each different piece of a slice once.

    Texts with any other white space next to these places, and texts with a special token of the file, are encoded
    as a whole; so are all texts if the file isn't plain byte-level BPE, for which alone the above holds. Pieces are
    remembered in two generations of KEEP pieces: what the last KEEP new pieces didn't need is forgotten.
    """

    KEEP = 300_000
    MARKS = ".,#%*&$!|;:?)"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.apart = self._plain_bpe(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # ids that begin with a space, or with a line feed
        self.opens = {c: np.zeros(self.size, bool) for c in " \n"}
        for t, i in self.tokenizer.get_vocab().items():
            for c, sign in ((" ", "\u0120"), ("\n", "\u010a")):
                self.opens[c][i] = t.startswith(sign)
        self.known: dict[str, bytes | None] = {}  # a piece stands for itself with a space before it unless it begins with a line feed
        self.older: dict[str, bytes | None] = {}
        self.tails: dict[str, bytes] = {}

    @staticmethod
    def _plain_bpe(path: str) -> bool:
        """Whether the file is byte-level BPE, words split by its usual rule, with nothing before or after that changes ids."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        words, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        level = words.get("type") == "ByteLevel" and not words.get("add_prefix_space", True) and words.get("use_regex", True)
        bare = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        return level and model.get("type", "BPE") == "BPE" and bare and not spec.get("normalizer") and not spec.get("truncation") and not spec.get("padding")

    def _ids(self, strings: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _pieces(self, pieces: list[str], before: str, together: int = 100) -> Iterator[bytes]:
        """The ids of pieces with a space or line feed before each; many are encoded as one text and parted there."""
        groups = [pieces[i : i + together] for i in range(0, len(pieces), together)]
        for group, ids in zip(groups, self._ids([before + before.join(g) for g in groups]), strict=True):
            starts = np.flatnonzero(self.opens[before][ids])
            if len(starts) == len(group):
                raw, width = ids.tobytes(), ids.itemsize
                cuts = [*(starts * width).tolist(), len(raw)]
                yield from (raw[i:j] for i, j in zip(cuts, cuts[1:]))
            else:
                yield from (x.tobytes() for x in self._ids([before + p for p in group]))

    def _learn(self, pieces: list[str]) -> None:
        """Remembers pieces; None for those that are empty or, but for a line feed before them, have white space at an end."""
        known, joined, plain, lines = self.known, [], {}, {}
        for p in pieces:
            if p.isalpha():
                plain[p] = None
                continue
            own = p[1:] if p[:1] == "\n" else p
            if not own or own != own.strip():
                known[p] = None
                continue
            word = p.rstrip(self.MARKS)
            if word != p and word[len(p) - len(own) :].isalpha():
                joined.append((p, word, p[len(word) :]))
                if word in known:
                    continue
                p = word
            if own is p or p[0] != "\n":
                plain[p] = None
            else:
                lines[p[1:]] = p
        known.update(zip(plain, self._pieces(list(plain), " "), strict=True))
        known.update(zip(lines.values(), self._pieces(list(lines), "\n"), strict=True))
        for p, word, marks in joined:
            tail = self.tails.get(marks)
            if tail is None:
                if len(self.tails) > self.KEEP:
                    self.tails.clear()
                tail = self.tails[marks] = self._ids([marks])[0].tobytes()
            known[p] = known[word] + tail

    def _values(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of pieces, remembered or learned."""
        if len(self.known) > self.KEEP:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for p in pieces:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append(p)
        self._learn(new)
        return [known[p] for p in pieces]

    def encode_array(self, strings: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (null: none), each text's followed by ``end``, and how many each text has."""
        n, width = len(strings), np.dtype(self.kind).itemsize
        strings = pc.fill_null(strings.cast(pa.large_string()), "")
        whole = np.zeros(n, bool) if self.apart else np.ones(n, bool)
        for token in self.special:
            whole |= pc.match_substring(strings, token).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(strings, "\n", " \n") if self.apart else strings.filter(pa.array(~whole)), " ")
        if not self.apart:  # each text is one piece
            cut = pa.array([[""]] * n, pa.list_(pa.large_string()))
        bounds = cut.offsets.to_numpy().astype(np.int64)
        bounds, words = bounds - bounds[0], cut.flatten()
        heads = bounds[:-1]
        first = words.take(pa.array(heads))
        numbered = words.dictionary_encode()
        values = self._values(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
        codes = numbered.indices.to_numpy().astype(np.int64)
        # white space follows a text's first piece: it may not be empty or end with such
        begun = first.dictionary_encode()
        begins = begun.dictionary.to_pylist()
        kept = np.array([bool(h) and h == h.rstrip() for h in begins], bool)[begun.indices.to_numpy()] if n else np.zeros(0, bool)
        several = np.diff(bounds) > 1
        unknown = np.array([v is None for v in values], bool)[codes]
        unknown[heads] = False
        whole |= several & ~kept
        whole |= np.add.reduceat(unknown, heads) > 0 if n else False
        # the dictionary goes on with first pieces, texts that are encoded as a whole, and the end
        codes[heads] = len(values) + begun.indices.to_numpy()
        at = np.flatnonzero(whole)
        codes[heads[at]] = len(values) + len(begins) + np.arange(len(at))
        stays = np.repeat(~whole, np.diff(bounds))
        stays[heads] = True
        upto = np.concatenate([[0], np.cumsum(stays)])[bounds]
        codes = np.insert(codes[stays], upto[1:], len(values) + len(begins) + len(at))
        upto += np.arange(n + 1)
        texts = strings.take(pa.array(at)).to_pylist()
        rest = [x.tobytes() for x in self._ids(begins + texts)]
        ids = pa.array([*values, *rest, end], pa.large_binary()).take(pa.array(codes))
        _, places, data = ids.buffers()
        places = np.frombuffer(places, np.int64)[ids.offset : ids.offset + len(ids) + 1]
        flat = np.frombuffer(data, self.kind, (places[-1] - places[0]) // width, places[0]) if len(codes) and data else np.empty(0, self.kind)
        return flat, np.diff((places[upto] - places[0]) // width) if n else np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        flat, sizes = self.encode_array(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(flat, np.cumsum(sizes)[:-1])]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 where the count is 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    limit = max(limit, int(np.ceil(np.log2(n))))
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    levels, row = [], leaves
    for _ in range(limit - 1):
        packages = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        order = np.argsort(np.concatenate([leaves, packages]), kind="stable")
        row = np.concatenate([leaves, packages])[order]
        levels.append(order < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(levels):
        a = int(leaf[:take].sum())
        lengths[:a] += 1
        take = 2 * (take - a)
    lengths[:take] += 1
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id): only the lengths need to be stored."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for i in order:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each string of ``width`` bits: the id that it begins with, and that id's length."""
    width = int(lengths.max(initial=1))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (width - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.int64)
    ids[: spans.sum()] = np.repeat(order, spans)
    sizes[: spans.sum()] = np.repeat(lengths[order], spans)
    return ids, sizes, width


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Bits and checkpoints of a block."""
    if not len(ids):
        return b"", b""
    code, size = codes[ids], lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    word = starts >> 6
    shift = 64 - (starts & 63) - size
    over = shift < 0
    here = np.where(over, code >> np.where(over, -shift, 0).astype(np.uint64), code << np.where(over, 0, shift).astype(np.uint64))
    words = np.zeros(int(ends[-1] + 63 >> 6) + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(here, first)
    words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: int(ends[-1] + 7 >> 3)], starts[::STEP].astype("<u4").tobytes()


def unpack(blocks: list[tuple[bytes, bytes, int]], table: tuple[np.ndarray, np.ndarray, int], step: int = STEP) -> list[np.ndarray]:
    """The ids of blocks (bits, checkpoints, how many ids), all checkpoints of all blocks side by side."""
    ids, sizes, width = table
    pad = b"\0" * (step * width // 8 + 8)
    data = np.frombuffer(b"".join(x for bits, _, _ in blocks for x in (bits, pad)), np.uint8).astype(np.uint32)
    window = data[:-3] << np.uint32(24) | data[1:-2] << np.uint32(16) | data[2:-1] << np.uint32(8) | data[3:]
    at, begins = 0, []
    for bits, marks, _ in blocks:
        begins.append(np.frombuffer(marks, "<u4").astype(np.int64) + 8 * at)
        at += len(bits) + len(pad)
    p = np.concatenate(begins) if begins else np.empty(0, np.int64)
    out = np.empty((step, len(p)), np.uint32)
    drop = np.uint32(32 - width)
    for i in range(step):
        key = window[p >> 3] << (p & 7).astype(np.uint32) >> drop
        out[i] = ids[key]
        p += sizes[key]
    flat, lane, found = out.T, 0, []
    for (_, _, n), begin in zip(blocks, begins, strict=True):
        found.append(flat[lane : lane + len(begin)].reshape(-1)[:n])
        lane += len(begin)
    return found


def crc32_combine(a: int, b: int, size: int) -> int:
    """The CRC-32 of two joined strings from theirs and the second's length."""

    def times(m: list[int], v: int) -> int:
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v >>= 1
            i += 1
        return out

    m = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        m = [times(m, x) for x in m]  # squared: one zero byte
    while size:
        if size & 1:
            a = times(m, a)
        m = [times(m, x) for x in m]
        size >>= 1
    return a ^ b


def _plain(path: str):
    """Blocks of plain ids from texts in ascending order of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        end = np.array([END], e.kind).tobytes()
        part, block, at, doc_no = TaskContext.get().partitionId(), 0, 0, 0
        docs: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []  # runs of ids, of the documents in docs
        total = 0

        def row(doc_ids, counts, ids, piece=0, pieces=1):
            nonlocal block, at
            out = [part, block, at, doc_no, doc_ids, counts, piece, pieces, ids.tobytes()]
            block, at = block + 1, at + len(ids)
            return out

        def close():
            nonlocal docs, sizes, held, total, doc_no
            out = [row(docs, sizes, np.concatenate(held))] if docs else []
            doc_no += len(docs)
            docs, sizes, held, total = [], [], [], 0
            return out

        def batch_of(rows):
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in PLAIN.split(", ")])

        for whole in batches:
            for batch in slices(whole, limit=SLICE):
                rows = []
                flat, counts = e.encode_array(batch.column("text"), end)
                begin = place = 0  # ids of the slice from begin to place belong to docs and aren't in held yet
                for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    if total + n > BLOCK:
                        held.append(flat[begin:place])
                        rows += close()
                        begin = place
                    if n > BLOCK:
                        parts = -(-n // BLOCK)
                        for i in range(parts):
                            ids = flat[place + i * BLOCK : min(place + n, place + (i + 1) * BLOCK)]
                            rows.append(row([doc_id], [len(ids)], ids, i, parts))
                        doc_no += 1
                        begin = place + n
                    else:
                        docs.append(doc_id)
                        sizes.append(n)
                        total += n
                    place += n
                held.append(flat[begin:place].copy())  # the slice's buffers may go
                if rows:
                    yield batch_of(rows)
        if docs:
            yield batch_of(close())

    return lean(run, None)


def _count(size: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column("ids"):
                total += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["id", "n"])

    return run


def _code(lengths: np.ndarray, kind: str):
    """Plain blocks in the code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical_codes(lengths)
        for whole in batches:
            for batch in slices(whole, "ids"):
                packed = [pack(np.frombuffer(raw.as_buffer(), kind), codes, lengths) for raw in batch.column("ids")]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array([p[i] for p in packed], pa.binary()) for i in (0, 1))], [*batch.schema.names[:-1], "bits", "checkpoints"])

    return run


def _read(lengths: np.ndarray, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for whole in batches:
            for batch in slices(whole, "bits", 2 << 20):
                rows, out = batch.to_pylist(), []
                for r, ids in zip(rows, unpack([(r["bits"], r["checkpoints"], sum(r["counts"])) for r in rows], table, step), strict=True):
                    raw, done = ids.astype("<u4").tobytes(), 0
                    for i, (doc_id, n) in enumerate(zip(r["doc_ids"], r["counts"], strict=True)):
                        out.append((r["part"], r["doc_no"] + i, r["piece"], r["pieces"], doc_id, r["at"] + done, n, zlib.crc32(raw[4 * done : 4 * (done + n)])))
                        done += n
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in PIECES.split(", ")])

    return lean(run, None)


def _join_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("piece")
    crc = 0
    for n, c in zip(pdf["n_tokens"], pdf["ids_crc32"], strict=True):
        crc = crc32_combine(crc, int(c), 4 * int(n))
    return pdf.head(1).assign(n_tokens=pdf["n_tokens"].sum(), ids_crc32=crc)


def plain_blocks(documents: DataFrame, path: str) -> DataFrame:
    """Writes the plain ids of all documents in blocks, in ascending doc_id order; returns the table."""
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return save(rows.mapInArrow(_plain(path), PLAIN), "token-ids")


def id_lengths(plain: DataFrame, path: str, limit: int = LIMIT) -> np.ndarray:
    """Code lengths by id, from the counts in all documents; the driver gets one row for each id in use."""
    e = encoder(path)
    found = plain.select("ids").mapInArrow(_count(e.size, e.kind), "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(e.size, np.int64)
    total[found["id"].to_numpy()] = found["n"].to_numpy()
    return code_lengths(total, limit)


def write_ids(documents: DataFrame, path: str, limit: int = LIMIT) -> str:
    """Writes the coded ids of all documents; returns the folder."""
    spark = documents.sparkSession
    folder = new_path(spark, "token-file")
    plain = plain_blocks(documents, path)
    lengths = id_lengths(plain, path, limit)
    used = np.flatnonzero(lengths)
    rows = [(VERSION, len(lengths), STEP, int(i), int(lengths[i])) for i in used]
    spark.createDataFrame(rows, CODE).coalesce(1).write.parquet(f"{folder}/code")
    write(plain.mapInArrow(_code(lengths, encoder(path).kind), BLOCKS), f"{folder}/blocks", "uncompressed")
    forget(plain)
    return folder


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    code = spark.read.schema(CODE).parquet(f"{folder}/code").toPandas()  # at most a row for each id of the vocabulary
    if set(code["version"]) - {VERSION}:
        raise ValueError(f"versions {sorted(set(code['version']))} of the file format, {VERSION} is read")
    lengths = np.zeros(code["vocabulary"].max() if len(code) else 1, np.uint8)
    lengths[code["id"].to_numpy(np.int64)] = code["length"].to_numpy()
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    pieces = save(blocks.mapInArrow(_read(lengths, int(code["step"].max()) if len(code) else STEP), PIECES), "pieces")
    whole = pieces.where("pieces = 1")
    # a document of several blocks has few pieces, one for each BLOCK ids
    parts = pieces.where("pieces > 1").groupBy("part", "doc_no").applyInPandas(_join_pieces, PIECES)
    totals = pieces.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row a partition
    out = whole.union(parts).join(bounded_broadcast(offsets), "part")
    return out.select("doc_id", (F.col("before") + F.col("rel")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(documents: DataFrame, path: str) -> DataFrame:
    """Encodes, writes, reads and decodes all documents; one row per document."""
    return read_ids(documents.sparkSession, write_ids(documents, path))
