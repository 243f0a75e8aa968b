"""An executor's memory holds its JVM and its Python workers: these need little at once, and give back what they have freed."""

import os
import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from seamount.llm import line_crf, near_dedup

AT_REST = """
import gc, random, sys
import pyarrow as pa
from seamount.llm import near_dedup

random.seed(1)
words = ["".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9))) for _ in range(20_000)]
pool = [" ".join(random.choices(words, k=6000)) for _ in range(30)]
def anon():
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) / 1024
def stream(rows):  # texts of 40 to 36,000 bytes, whose sets are held in pieces of many sizes
    for _ in range(3):
        yield pa.RecordBatch.from_pydict({"text": [f"{i} " + " ".join(random.choices(pool, k=1))[: random.randint(1, 60) ** 2 * 10] for i in range(rows)]})
run = near_dedup._sets(4)
held = [len(x) for x in run(stream(9))]  # what is loaded once
gc.collect()
before = anon()
held = [len(x) for x in run(stream(3000))]
print(anon() - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_worker_at_rest_holds_little():
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", AT_REST], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, check=True, timeout=300)
    assert float(out.stdout) < 25


def peak(run, batches):
    """MB of Python and numpy at once."""
    tracemalloc.start()
    try:
        n = sum(len(b) for b in run(iter(batches)))
        return n, tracemalloc.get_traced_memory()[1] / (1 << 20)
    finally:
        tracemalloc.stop()


def test_line_features_of_a_large_batch():
    text = "\n".join(" ".join(f"word{i * j % 97}" for i in range(12)) for j in range(40))
    batch = pa.RecordBatch.from_pydict({"quality": [1] * 2000, "text": [text] * 2000})
    assert batch.nbytes > 6 << 20
    n, mb = peak(line_crf._features, [batch])
    assert n == 2000 and mb < 70


def test_blocks_are_opened_one_pair_at_a_time():
    rng = np.random.default_rng(1)

    def member(i, block):
        sig = rng.integers(0, 256, 128, np.uint8)
        return {"key": bytes([i % 256, i // 256]), "comp": bytes([i % 256, i // 256]), "block": block, "sig": sig.tobytes(), "marks": rng.integers(0, 1 << 60, 32).astype(np.int64).tobytes()}

    members = [[member(i, i % 2) for i in range(400)] for _ in range(40)]
    kinds = pa.list_(pa.struct({"key": pa.binary(), "comp": pa.binary(), "block": pa.int64(), "sig": pa.binary(), "marks": pa.binary()}))
    n = len(members)
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array([0] * n, pa.int32()), pa.array([1] * n, pa.int32()), pa.array([0] * n), pa.array([1] * n), pa.array(members, kinds)], ["band", "at", "depth", "i", "j", "members"])
    _, all_mb = peak(lambda b: (x for x in [next(b).to_pylist()]), [batch])
    found, mb = peak(near_dedup._open(0.6), [batch])
    assert found == 0 and mb < all_mb / 4
