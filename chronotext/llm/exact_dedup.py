"""Exact deduplication by Grace hashing.

Each task puts its records into an open-addressing table that compares complete
contents. Records that the table has no room for go to spill files by the next
hash digit, and every file is worked off the same way, with one more digit,
until its contents fit. A first pass over the input's own partitions leaves one
record per distinct content and task, so that only those are shuffled, however
large a group of copies is; a second pass over the shuffled records ends it.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import free_name, row_ids, ship_package, stored, to_batches

BUDGET = 32 << 20
FAN_OUT = 16


def normalise(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null counts as empty."""
    return (text or "").encode("utf-8").lower()


class Group:
    """Records of one content: their number, the one that stays, and whatever the caller keeps."""

    __slots__ = ("content", "count", "best", "payload", "members", "number")

    def __init__(self, content: bytes, number: int):
        self.content, self.number = content, number
        self.count, self.best, self.payload, self.members = 0, None, None, array("q")


class ContentTable:
    """Open addressing with linear probing; equal means equal in the complete content."""

    def __init__(self):
        self.slots, self.hashes, self.groups = [-1] * 1024, [], []
        self.bytes = 0

    def find(self, h: int, content: bytes) -> tuple[int, Group | None]:
        mask = len(self.slots) - 1
        at = h & mask
        while (k := self.slots[at]) >= 0:
            if self.hashes[k] == h and self.groups[k].content == content:
                return at, self.groups[k]
            at = (at + 1) & mask
        return at, None

    def add(self, at: int, h: int, group: Group) -> None:
        self.slots[at] = len(self.groups)
        self.hashes.append(h)
        self.groups.append(group)
        if 3 * len(self.groups) > 2 * len(self.slots):
            mask = 2 * len(self.slots) - 1
            self.slots = [-1] * (mask + 1)
            for k, h2 in enumerate(self.hashes):
                at = h2 & mask
                while self.slots[at] >= 0:
                    at = (at + 1) & mask
                self.slots[at] = k


def grace(records: Iterable[tuple[bytes, tuple]], merge: Callable[[Group, tuple], int], numbers: Iterator[int],
          budget: int = BUDGET, depth: int = 0) -> Iterator[tuple[Group, tuple | None]]:
    """Yield ``(group, record)`` for each record and ``(group, None)`` for each finished group.

    ``merge`` adds a record to its group and returns by how many bytes the group grew.
    """
    table, spills = ContentTable(), None
    for content, record in records:
        h = xxhash.xxh3_64_intdigest(content)
        at, group = table.find(h, content)
        if group is None:
            if table.groups and table.bytes + len(content) > budget:
                if spills is None:
                    spills = [tempfile.TemporaryFile() for _ in range(FAN_OUT)]
                digit = xxhash.xxh3_64_intdigest(content, seed=depth + 1) % FAN_OUT
                pickle.dump((content, record), spills[digit], protocol=5)
                continue
            group = Group(content, next(numbers))
            table.add(at, h, group)
            table.bytes += len(content) + 200
        table.bytes += merge(group, record)
        yield group, record
    for group in table.groups:
        yield group, None
    del table
    for f in spills or ():
        with f:
            f.seek(0)
            yield from grace(_reread(f), merge, numbers, budget, depth + 1)


def _reread(f) -> Iterator[tuple[bytes, tuple]]:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _order(doc_id: int | None, row: int) -> tuple:
    """Larger for the row that stays: the largest id, nulls last, then the earlier row."""
    return doc_id is not None, doc_id or 0, -row


def duplicate_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``df``.

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Exactly one row of a group is kept: that of the largest id (null is
    smallest, and of rows with the same id the first read). Other columns are
    not read; an empty table gives an empty table.
    """
    spark = df.sparkSession
    ship_package(spark)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("grp", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()),
                        ("h", pa.int64()), ("content", pa.binary())])

    def local(batches):
        rows, groups = row_ids(), row_ids()

        def records():
            for b in batches:
                for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    yield normalise(text), (key, next(rows))

        def merge(group, record):
            group.count += 1
            if group.best is None or _order(*record) > _order(*group.best):
                group.best = record
            return 0

        def out():
            for group, record in grace(records(), merge, groups, budget):
                if record is not None:
                    yield group.number, record[1], record[0], None, None, None
                else:
                    yield (group.number, group.best[1], group.best[0], group.count,
                           xxhash.xxh3_64_intdigest(group.content) - (1 << 63), group.content)
        yield from to_batches(out(), schema)

    first = stored(spark, src.mapInArrow(local, "grp long, row long, doc_id long, size long, h long, content binary"),
                   "copies")
    found = pa.schema([("grp", pa.int64()), ("keep_row", pa.int64()), ("keep_id", pa.int64()),
                       ("group_size", pa.int64()), ("text_sha256", pa.string())])

    def merged(batches):
        def records():
            for b in batches:
                cols = [b.column(c).to_pylist() for c in ("content", "grp", "row", "doc_id", "size")]
                for content, *rest in zip(*cols, strict=True):
                    yield content, tuple(rest)

        def merge(group, record):
            grp, row, doc_id, size = record
            group.count += size
            group.members.append(grp)
            if group.best is None or _order(doc_id, row) > _order(*group.best):
                group.best = (doc_id, row)
            return 8

        def out():
            for group, record in grace(records(), merge, row_ids(), budget):
                if record is None:
                    sha = hashlib.sha256(group.content).hexdigest()
                    for grp in group.members:
                        yield grp, group.best[1], group.best[0], group.count, sha
        yield from to_batches(out(), found)

    groups = (first.where(F.col("content").isNotNull()).select("content", "grp", "row", "doc_id", "size", "h")
              .repartition("h").drop("h")
              .mapInArrow(merged, "grp long, keep_row long, keep_id long, group_size long, text_sha256 string"))
    members = first.where(F.col("content").isNull()).select("grp", "row", "doc_id")
    return members.join(groups, "grp").select("doc_id", "keep_id", "group_size",
                                              (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns as they were.

    The same groups and the same choice as ``duplicate_report``; only one full
    row per distinct text and task is shuffled.
    """
    spark = df.sparkSession
    ship_package(spark)
    row_col = free_name(df, "row_no")
    hash_col = free_name(df.withColumn(row_col, F.lit(0)), "text_hash")
    wide = df.withColumn(row_col, F.lit(None).cast("long")).withColumn(hash_col, F.lit(None).cast("long"))
    schema = to_arrow_schema(wide.schema)
    id_at, text_at = df.columns.index(id_col), df.columns.index(text_col)

    def survivors(batches, numbered: bool):
        rows = row_ids()

        def records():
            for b in batches:
                for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if not numbered:
                        values = (*values[:-2], next(rows), None)
                    yield normalise(values[text_at]), values

        def merge(group, record):
            group.count += 1
            order = _order(record[id_at], record[-2])
            if group.best is None or order > group.best:
                group.best, group.payload = order, record
            return len(group.content) if group.count == 1 else 0

        def out():
            for group, record in grace(records(), merge, row_ids(), budget):
                if record is None:
                    yield (*group.payload[:-1], xxhash.xxh3_64_intdigest(group.content) - (1 << 63))
        yield from to_batches(out(), schema)

    local = wide.mapInArrow(lambda batches: survivors(batches, False), wide.schema)
    return (local.repartition(hash_col).mapInArrow(lambda batches: survivors(batches, True), wide.schema)
            .drop(row_col, hash_col))
