"""Shared plumbing: table access, the cluster's shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Largest side, in bytes, that is ever sent whole to every executor.
BROADCAST_LIMIT = 64 << 20

#: Steps of a plan that keep the rows of each partition and their order.
_STABLE = {"FileScan", "BatchScan", "Filter", "Project", "ColumnarToRow", "WholeStageCodegen", "InputAdapter", "AdaptiveSparkPlan", "Batched"}

_local_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is this one machine (tests)
    is a temporary folder made; a cluster without the setting is an error.
    """
    global _local_dir
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "local") or "local"
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="vellumine-")
        atexit.register(shutil.rmtree, _local_dir, True)
    return f"file://{_local_dir}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which ends its lineage; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    spark._jvm.System.gc()  # Spark removes the shuffle files of a plan when the driver has collected it
    return out


def release(*tables: DataFrame) -> None:
    """Remove what ``cut`` wrote, once nothing reads it any more; other tables are left alone."""
    for df in tables:
        if path := getattr(df, "cut_path", None):
            place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def pinned(df: DataFrame, label: str) -> DataFrame:
    """``df`` itself if it is a scan of files with filters and projections that always give the same, else its written copy.

    Kernels that number rows by (partition, position) need every retry of a task
    to see the same rows in the same order; rows behind a shuffle give no such
    promise, files do.
    """
    found = df._jdf.queryExecution()
    names = {m[1] for line in found.executedPlan().toString().splitlines() if (m := re.match(r"[\s:+*()\d-]*([A-Za-z]+)", line))}
    return df if names <= _STABLE and found.analyzed().deterministic() else cut(df, label)


def partitions(spark: SparkSession, df: DataFrame | None = None, size: int = 0) -> int:
    """Partitions of a shuffle: what the session sets, or more where ``df`` has more than that many times ``size`` bytes by the plan's estimate."""
    least = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if df is None:
        return least
    found = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-found // size)) if found < 1 << 60 else least  # a plan that can't tell says the largest number


def text_bytes(col: pa.Array | pa.ChunkedArray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if lower:
        col = pc.utf8_lower(col)
    _, offs, data = col.buffers()
    if not len(col):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def doc_chunks(data: np.ndarray, offs: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``size`` bytes each."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def int_column(batch: pa.RecordBatch | pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values with 0 for null, null mask) of an integer column."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.int64())
    return pc.fill_null(col, 0).to_numpy(zero_copy_only=False), pc.is_null(col).to_numpy(zero_copy_only=False)


def binary_views(col: pa.Array) -> list[memoryview]:
    """The values of a binary column without copying them."""
    return [memoryview(x.as_buffer()) if x.is_valid else memoryview(b"") for x in col]


def batches_by_key(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys as one table each; rows come sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(c[lo] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def row_slices(batches: Iterator[pa.RecordBatch], name: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of the text column ``name``."""
    for batch in batches:
        col = batch.column(name).cast(pa.large_string())
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        for lo, hi in doc_chunks(offs, offs, size):
            yield batch.slice(lo, hi - lo)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that gives memory back when a task ends.

    A worker process lives on between tasks; what the C library keeps of large
    arrays that were freed would count against the executor all the while.
    """

    def lean_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # arrays of a megabyte or more get pages of their own
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return lean_run
