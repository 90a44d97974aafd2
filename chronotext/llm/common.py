"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import math
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back (cuts the lineage)."""
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="chronotext-"), "chronotext_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


_HELD: list = [None, None]  # the key and value of the one model that this worker holds


def worker_model(key, load: Callable):
    """The model named ``key``, kept for the worker's next tasks in place of any other one."""
    if _HELD[0] != key:
        _HELD[:] = None, None
        tidy()
        _HELD[:] = key, load()
    return _HELD[1]


def tidy() -> None:
    """Give memory that is free back to the system, so that a reused worker doesn't keep its largest task's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


@contextmanager
def tidied() -> Iterator[None]:
    """Around a task's work: what it held is given back at its end."""
    try:
        yield
    finally:
        tidy()


def bounded_sample(df: DataFrame, draw: Column, most: int, ties: str) -> DataFrame:
    """At most ``most`` rows, those of the least ``draw`` (a hash), for models that are fitted on a sample.

    Rows that can't be among them are left out by the known number of rows
    first, so that what reaches the driver doesn't grow with the partitions.
    """
    n, steps = df.count(), 1 << 20
    part = F.pmod(draw, F.lit(steps))
    return df.where(part < math.ceil(steps * min(1.0, (1.2 * most + 200) / max(n, 1)))).orderBy(part, draw, ties).limit(most)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_ids() -> Iterator[int]:
    """Numbers that no other task of the same stage gives out."""
    n = TaskContext.get().partitionId() << 33
    while True:
        yield n
        n += 1


def to_batches(rows: Iterable[tuple], schema: pa.Schema, max_rows: int = 4096,
               max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches bounded by rows and by bytes of text."""
    buf, size = [], 0

    def flush():
        cols = list(zip(*buf, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for row in rows:
        buf.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(buf) >= max_rows or size >= max_bytes:
            yield flush()
            buf, size = [], 0
    if buf:
        yield flush()


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges of items whose sizes add up to about ``most`` (whole items)."""
    lo, size, n = 0, 0, 0
    for n, own in enumerate(sizes, 1):
        size += own
        if size >= most:
            yield lo, n
            lo, size = n, 0
    if lo < n:
        yield lo, n


def text_slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2_000_000) -> Iterator[tuple[int, int, list]]:
    """``(lo, hi, texts)`` of a batch, about ``max_bytes`` of text at a time: no more of it is held as Python strings."""
    col = batch.column(column)
    for lo, hi in slices(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).tolist(), max_bytes):
        yield lo, hi, col.slice(lo, hi - lo).to_pylist()
