"""TIFF as a media column: writing, and reading by walking image file directories, one row per page.

The reader takes both byte orders, strips and tiles, chunky and planar samples of 8 bits, the compressions none (1),
LZW (5), deflate (8, 32946) and PackBits (32773), and undoes the horizontal predictor (2). The writer makes the
same. A file that can't be read gives one row with ``error`` set and no pixels; a null or empty file gives none.

``store_texts`` is the lossless store that the query uses: a text's UTF-8 bytes (null: none), padded with
spaces to a positive multiple of 192, are the 8-bit samples of an RGB image of 64 x n pixels, on pages of at most
``PAGE_ROWS`` rows. The payload decides the form, so that equal texts have equal files: its CRC-32 chooses strips or (from TILE
rows on) tiles, the predictor, and, up to SHORT bytes, LZW, PackBits, deflate or none; longer ones are deflated, as the
other codecs run in Python. ``read_texts`` walks the stored files again, page by page. A payload whose file would pass 4 GB, the
format's limit, raises.

Repeated rows each give a row; null ids and extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import save, slices, texts

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
WIDTH, SAMPLES = 64, 3
PAGE_ROWS = 16384
STRIP_ROWS = 512
TILE, TILE_ROWS = 64, 192  #: tiles for images of so many rows or more
SHORT = 768  #: bytes of a payload that any codec may store

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I"}


class TiffError(ValueError):
    pass


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, codes grow one entry early, 256 clears and 257 ends."""
    out, acc, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {bytes((i,)): i for i in range(256)}
    size = 258

    def put(code):
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    put(256)
    w = b""
    for b in data:
        c = w + bytes((b,))
        if c in table:
            w = c
            continue
        put(table[w])
        table[c] = size
        size += 1
        if size == 4095:
            put(256)
            table, size, width = {bytes((i,)): i for i in range(256)}, 258, 9
        elif size + 1 > 1 << width:
            width += 1
        w = bytes((b,))
    if w:
        put(table[w])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(acc << 8 - bits & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, acc, bits, width, at = bytearray(), 0, 0, 9, 0
    start = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, last = list(start), b""
    while len(out) < size:
        while bits < width and at < len(data):
            acc, bits, at = acc << 8 | data[at], bits + 8, at + 1
        if bits < width:
            break
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, last, width = list(start), b"", 9
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last:
            entry = last + last[:1]
        else:
            raise TiffError("an LZW code that isn't in the table")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out[:size])


def _inflate(data: bytes, size: int) -> bytes:
    return zlib.decompressobj().decompress(data, size) if size else b""


_DECODE = {NONE: lambda d, n: d[:n], LZW: lzw_decode, DEFLATE: _inflate, 32946: _inflate, PACKBITS: packbits_decode}
_ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6)}


def _packed_rows(block: np.ndarray, compression: int) -> bytes:
    raw = np.ascontiguousarray(block)
    if compression == PACKBITS:  # rows are packed on their own
        return b"".join(packbits_encode(r.tobytes()) for r in raw.reshape(raw.shape[0], -1))
    return _ENCODE[compression](raw.tobytes())


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: int = 0, planar: int = 1, order: str = "<", strip_rows: int = STRIP_ROWS) -> bytes:
    """A TIFF file of pages (rows, columns, samples) of bytes. tile: the edge of square tiles, a multiple of 16; 0: strips."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        h, w, samples = page.shape
        blocks, (bh, bw) = [], (tile, tile) if tile else (min(strip_rows, h), w)
        for plane in [page] if planar == 1 else [page[:, :, s : s + 1] for s in range(samples)]:
            for y in range(0, h, bh):
                for x in range(0, w, bw):
                    b = plane[y : y + bh, x : x + bw]
                    if tile:
                        b = np.pad(b, ((0, bh - b.shape[0]), (0, bw - b.shape[1]), (0, 0)), mode="edge")
                    if predictor == 2:
                        b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
                    blocks.append(_packed_rows(b, compression))
        at = []
        for b in blocks:
            out += b"\0" * (len(out) % 2)
            at.append(len(out))
            out += b
        tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8] * samples), (259, 3, [compression]), (262, 3, [2 if samples >= 3 else 1]), (277, 3, [samples]), (284, 3, [planar]), (317, 3, [predictor])]
        tags += [(322, 4, [bw]), (323, 4, [bh]), (324, 4, at), (325, 4, [len(b) for b in blocks])] if tile else [(273, 4, at), (278, 4, [bh]), (279, 4, [len(b) for b in blocks])]
        entries = b""
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{_CODES[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                place, raw = len(out), raw
                out += raw
                raw = struct.pack(order + "I", place)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


@dataclass
class Page:
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    pixels: np.ndarray  #: (rows, columns, samples)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _CODES:
            continue  # texts, rationals and floats say nothing about the samples
        place = at + 10 + 12 * i
        if _SIZES[kind] * count > 4:
            (place,) = struct.unpack_from(order + "I", data, place)
        if place + _SIZES[kind] * count > len(data):
            raise TiffError("values beyond the file's end")
        tags[tag] = list(struct.unpack_from(f"{order}{count}{_CODES[kind]}", data, place))
    (following,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
    return tags, following


def decode(data: bytes) -> Iterator[Page]:
    """The pages of a file, one after the other. TiffError if it can't be read."""
    try:
        order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
        magic, at = struct.unpack_from(order + "HI", data, 2)
    except (KeyError, struct.error):
        raise TiffError("not a TIFF file") from None
    if magic != 42:
        raise TiffError("not a TIFF file")
    seen = set()
    while at:
        if at in seen:
            raise TiffError("the directories run in a circle")
        seen.add(at)
        try:
            tags, at = _directory(data, at, order)
            yield _page(data, tags)
        except (struct.error, zlib.error, KeyError, IndexError, ValueError, OverflowError, MemoryError) as e:
            if isinstance(e, TiffError):
                raise
            raise TiffError(f"{type(e).__name__}: {e}") from None


def _page(data: bytes, tags: dict[int, list[int]]) -> Page:
    one = lambda tag, default: tags.get(tag, [default])[0]
    w, h, samples, planar = tags[256][0], tags[257][0], one(277, 1), one(284, 1)
    compression, predictor = one(259, NONE), one(317, 1)
    if set(tags.get(258, [1])) != {8}:
        raise TiffError("only samples of 8 bits are read")
    if compression not in _DECODE or predictor not in (1, 2):
        raise TiffError(f"compression {compression}, predictor {predictor}")
    tiled = 324 in tags
    bw, bh = (tags[322][0], tags[323][0]) if tiled else (w, min(one(278, h), h))
    offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
    if min(w, h, samples, bw, bh) < 1:
        raise TiffError("a size of nothing")
    across, down = -(-w // bw), -(-h // bh)
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    if w * h * samples > 1 << 32 or len(offsets) < planes * across * down:
        raise TiffError("the size isn't that of the data")
    pixels = np.empty((h, w, samples), np.uint8)
    for k in range(planes * across * down):
        plane, y, x = k // (across * down), k % (across * down) // across * bh, k % across * bw
        rows = bh if tiled else min(bh, h - y)
        raw = _DECODE[compression](data[offsets[k] : offsets[k] + sizes[k]], rows * bw * deep)
        if len(raw) < rows * bw * deep:
            raise TiffError("a strip or tile is cut short")
        block = np.frombuffer(raw, np.uint8).reshape(rows, bw, deep)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        to = pixels[y : y + rows, x : x + bw, plane : plane + 1] if planar == 2 else pixels[y : y + rows, x : x + bw]
        to[:] = block[: to.shape[0], : to.shape[1]]
    return Page(w, h, samples, compression, predictor, pixels)


PAGES = "id bigint, page int, width int, height int, samples int, compression int, predictor int, mean double, pixels_sha256 string, pixels binary, error string"


def page_rows(data: bytes) -> Iterator[tuple[int, Page | None, str | None]]:
    """Number, page and error of each page of a file, one after the other; what can't be read ends with a row of its own."""
    n = 0
    try:
        for n, page in enumerate(decode(data) if data else (), 1):
            yield n - 1, page, None
    except TiffError as e:
        yield n, None, str(e)


def pages_of(media: DataFrame, column: str = "media", key: str = "id", pixels: bool = True) -> DataFrame:
    """A row for each page of each file; pixels: whether the decoded samples are carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PAGES.split(", ")]
        kinds = [pa.int64(), *[pa.int32()] * 6, pa.float64(), pa.string(), pa.binary(), pa.string()]
        for whole in batches:
            for batch in slices(whole, "media", 1 << 20):
                for name, data in zip(batch.column("id").to_pylist(), texts(batch, "media"), strict=True):
                    rows = []
                    for n, p, error in page_rows(data):
                        if p is None:
                            rows.append((name, n, *[None] * 8, error))
                        else:
                            raw = p.pixels.tobytes()
                            rows.append((name, n, p.width, p.height, p.samples, p.compression, p.predictor, float(p.pixels.mean()), hashlib.sha256(raw).hexdigest(), raw if pixels else None, None))
                    if rows:  # a batch for each file: its pages only
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.selectExpr(f"{key} AS id", f"{column} AS media").mapInArrow(run, PAGES)


def image_of(payload: bytes) -> bytes:
    """The TIFF file of a payload whose length is a multiple of WIDTH * SAMPLES."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, SAMPLES)
    form = zlib.crc32(payload)
    codec = (DEFLATE, LZW, PACKBITS, NONE)[form & 3] if len(payload) <= SHORT else DEFLATE
    tile = TILE if len(rows) >= TILE_ROWS and form & 4 else 0
    return encode([rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)], codec, 2 if form & 8 else 1, tile)


def store_texts(documents: DataFrame) -> DataFrame:
    """Writes doc_id, n_bytes and media (the TIFF file) of each text, and returns the table as read back."""
    line = WIDTH * SAMPLES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                own = texts(batch)
                media = [image_of(t.ljust(max(1, -(-len(t) // line)) * line)) for t in own]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in own], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return save(documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary"), "media", "uncompressed")


FACTS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def read_texts(stored: DataFrame) -> DataFrame:
    """Facts of the decoded payload and of the file. feature: pages, rows, mean and deviation of the samples, entropy in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FACTS.split(", ")]
        for whole in batches:
            for batch in slices(whole, "media", 1 << 20):
                facts = []
                for data in texts(batch, "media"):
                    sha, size, tail, pages, counts = hashlib.sha256(), 0, b"", 0, np.zeros(256, np.int64)
                    for _, p, error in page_rows(data):
                        if p is None:
                            raise TiffError(error)
                        raw = p.pixels.tobytes()
                        sha.update(raw)
                        counts += np.bincount(p.pixels.reshape(-1), minlength=256)
                        size, tail, pages = size + len(raw), raw[-16:], pages + 1
                    share = counts / size
                    values = np.arange(256)
                    mean = float(share @ values)
                    deviation = float(np.sqrt(share @ (values - mean) ** 2))
                    entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
                    feature = f"pages={pages};rows={size // (WIDTH * SAMPLES)};mean={mean:.4f};sd={deviation:.4f};bits={entropy:.4f}"
                    facts.append((size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array([f[i] for f in facts], k) for i, k in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], names)

    return stored.mapInArrow(run, FACTS)
