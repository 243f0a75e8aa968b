import hashlib
import itertools
import zlib

import numpy as np
import pytest

from seamount.llm import tiff


@pytest.mark.parametrize("compression,predictor,tile,planar,order", [x for x in itertools.product((tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS), (1, 2), (0, 16), (1, 2), "<>")])
def test_round_trip(compression, predictor, tile, planar, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 6, (37, 50, 3), dtype=np.uint8), np.zeros((70, 33, 3), np.uint8), rng.integers(0, 256, (100, 90, 1), dtype=np.uint8)]
    data = tiff.encode(pages, compression, predictor, tile, planar, order, strip_rows=11)
    got = list(tiff.decode(data))
    assert len(got) == len(pages)
    for p, q in zip(pages, got, strict=True):
        assert (p == q.pixels).all() and (q.compression, q.predictor) == (compression, predictor)


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000, 70000])
def test_codecs(n):
    for data in (bytes(n), np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes(), (b"abcab" * n)[:n]):
        assert tiff.lzw_decode(tiff.lzw_encode(data), n) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data), n) == data


@pytest.mark.parametrize("data", [b"", b"II", b"GIF89a....", b"II*\0\xff\xff\0\0", tiff.encode([np.zeros((4, 4, 3), np.uint8)])[:-30]])
def test_what_cannot_be_read(data):
    with pytest.raises(tiff.TiffError):
        list(tiff.decode(data))


def test_broken_files_end_with_an_error():
    """Every byte of a file set to 0 and to 255, and the file cut anywhere: pages or an error, nothing else."""
    for data in (tiff.encode([np.zeros((20, 20, 3), np.uint8)] * 2, tiff.LZW, 2, 16, 2), tiff.encode([np.zeros((9, 9, 1), np.uint8)], tiff.PACKBITS)):
        for i in range(len(data)):
            for broken in (data[:i] + b"\0" + data[i + 1 :], data[:i] + b"\xff" + data[i + 1 :], data[:i]):
                rows = list(tiff.page_rows(broken))
                assert all((page is None) == (error is not None) for _, page, error in rows) and all(page for _, page, _ in rows[:-1])


def test_all_forms_are_stored():
    r = np.random.default_rng(6)
    seen = set()
    for n in [1] * 60 + [200] * 60:
        payload = r.integers(97, 123, 192 * n, dtype=np.uint8).tobytes()
        data = tiff.image_of(payload)
        (page,) = tiff.decode(data)
        assert page.pixels.tobytes() == payload and data == tiff.image_of(payload)
        seen.add((page.compression, page.predictor))
    assert len(seen) == 8


def test_texts(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 500_000), (5, "abc"), (None, "x" * 192)]
    named = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id bigint, text string, n_bytes int, media string")
    got = {r.doc_id: r for r in tiff.read_texts(tiff.store_texts(named)).collect()}
    for doc_id, text in rows:
        raw = (text or "").encode()
        padded = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64
    assert got[1].media_sha256 == got[5].media_sha256 and got[1].feature == got[5].feature
    stored = tiff.store_texts(spark.createDataFrame([(4, "é" * 500_000 * 4)], "doc_id bigint, text string"))
    assert sorted(r.page for r in tiff.pages_of(stored, key="doc_id").collect()) == [0, 1]
    bad = spark.createDataFrame([(1, b"junk"), (2, None)], "id bigint, media binary")
    assert [(r.id, r.error is not None) for r in tiff.pages_of(bad).collect()] == [(1, True)]
    assert tiff.read_texts(tiff.store_texts(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0
