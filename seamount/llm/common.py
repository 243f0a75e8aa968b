"""Helpers shared by the training-data operators: shared-folder tables and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import functools
import shutil
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most so many rows (of fixed, small width) may be broadcast; beyond it a shuffle join runs.
BROADCAST_ROWS = 200_000
#: Python works on slices of an Arrow batch of about so many text bytes, whatever the batch holds.
SLICE_BYTES = 4 << 20
#: Workers give freed memory back after so many bytes of results.
GIVE_BACK = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a new folder of this machine serves a local session; on a cluster, whose executors
    wouldn't see that folder, a ValueError is raised. The session's settings stay as they are.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="seamount-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


_local: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as Parquet and reads it back with its schema."""
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts lineage: :func:`write` to a new path of the shared folder."""
    path = new_path(df.sparkSession, name)
    out = write(df, path, codec)
    out._saved_at = path  # for forget
    return out


def forget(*saved: DataFrame) -> None:
    """Removes tables of :func:`save` that nothing reads any more."""
    for df in saved:
        remove(df.sparkSession, df._saved_at)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_broadcast(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only where ``df`` (its row count, if known, is ``rows``) is within ``limit``."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= limit else df


def decisions(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Narrow rows that decide about documents: broadcast within ``limit``, otherwise hashed where texts are shuffled to them."""
    return F.broadcast(df) if df.count() <= limit else df.hint("shuffle_hash")


#: The columns of :func:`row_names`.
ROW = ["_no_id", "_id", "_text_hash", "_row_hash"]


def row_names(documents: DataFrame) -> list[Column]:
    """What tells rows apart that may share a doc_id: whether it is null, the id, a hash of the text, a hash of all columns."""
    every = [x for c in documents.columns for x in (F.col(c), F.col(c).isNull())]  # a hash passes over nulls
    return [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast("bigint")), F.xxhash64("text", F.col("text").isNull()), F.xxhash64(*every)]


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes in ``column`` each, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < len(sizes):
        yield batch.slice(at)


def give_back() -> None:
    """Returns what Python and Arrow have freed to the system; both keep it otherwise, for as long as a worker is reused."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):  # glibc
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: int | None = GIVE_BACK) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, which gives back its memory whenever ``every`` bytes have gone out (None: not before the end), and at the end.

    An executor's memory holds its JVM and all its workers, those at rest too.
    """

    @functools.wraps(run)
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = 0
        try:
            for batch in run(batches):
                sent += batch.nbytes
                yield batch
                if every is not None and sent >= every:
                    del batch
                    give_back()
                    sent = 0
        finally:
            give_back()

    return each


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return pc.fill_null(batch.column(column).cast(pa.large_binary()), b"").to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
