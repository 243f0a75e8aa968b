"""Pairs of the second round are met in the bucket that they really share first."""

import numpy as np

from seamount.llm import near_dedup


def member(comp, sig, marks):
    return {"comp": comp, "sig": sig.astype(np.uint8).tobytes(), "marks": marks.astype(np.int64).tobytes()}


def test_equal_low_bytes_of_an_earlier_band_hide_no_pair():
    sig, bands = np.arange(128), np.arange(32)
    other = bands + 100
    other[5] = bands[5]  # only the sixth bucket is shared, though all low bytes agree
    pair = [member(b"a", sig, bands), member(b"b", sig, other)]
    assert [len(near_dedup._candidates(pair, pair, True, band, 0.6)[0]) for band in (5, 6)] == [1, 0]


def test_marks_are_the_keys_of_the_buckets():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b c d e", None]})
    (out,) = near_dedup._signatures(128, 4, 4, ["doc_id"])(iter([batch]))
    rows = out.to_pylist()
    assert np.frombuffer(rows[0]["marks"], np.int64).tolist() == rows[0]["bands"] and rows[1]["marks"] is None
