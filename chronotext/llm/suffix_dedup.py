"""Removal of long byte strings that occur more than once, by a hash-compared suffix sort.

A string of ``LENGTH`` bytes holds an anchor: the leftmost of its least hashed
``GRAM``-byte pieces. Equal strings have equal anchors at equal places, so the
corpus is dealt out by anchor, and what is dealt are stretches of neighbouring
strings with the same anchor, as numbers. Stretches that are equal throughout,
by a cryptographic digest, are settled by counting; those that share an anchor and differ are fetched and
their suffixes sorted by mergesort, two suffixes being compared by binary
search for their common extension over prefix polynomial hashes. Neighbours in
that order that agree in ``LENGTH`` bytes are verified byte by byte.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, stored, tidied, to_batches

LENGTH = 200
GRAM = 32
GROUP = 512  # different stretches of one anchor that are sorted together; more are divided first
BATCH_BYTES = 1 << 20
STRETCH_BYTES = 1 << 26  # longer texts are dealt in overlapping parts of so many bytes; positions in a batch have 28 bits
CELLS = (16, 1)  # strings of a stretch that stay together in the first and the second division

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POSITION_BITS = np.uint64(28)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept between calls."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, 1 << 16), base)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class PrefixHashes:
    """Polynomial hash of any piece of a buffer: ``sum(byte[i + t] * inverse**t)`` modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.up, down = _power_tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * down[:len(data)], out=self.sums[1:])

    def piece(self, start, length):
        return (self.sums[start + length] - self.sums[start]) * self.up[start]


def stretches(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``(text number, start, strings, lead, anchor hash)`` of all stretches of a batch.

    ``strings`` strings begin at start, start + 1, ...; the anchor lies ``lead`` bytes after start.
    """
    lens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum(lens)
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none
    hashes = PrefixHashes(data)
    grams = len(data) - gram + 1
    h = _mix((hashes.sums[gram:] - hashes.sums[:grams]) * hashes.up[:grams])
    low = np.uint64((1 << int(_POSITION_BITS)) - 1)
    least = (h & ~low) | np.arange(grams, dtype=np.uint64)
    reach, span = length - gram + 1, 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[:len(least) - (reach - span)], least[reach - span:])
    counts = np.maximum(lens - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(ends - lens, counts)
    anchor = (least[start] & low).astype(np.int64)
    if not len(start):
        return none, none, none, none, none
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
    strings = np.diff(np.append(first, len(start)))
    begin, lead = start[first], anchor[first] - start[first]
    return owner[first], begin - (ends - lens)[owner[first]], strings, lead, h[anchor[first]].view(np.int64)


def dealt_stretches(body: bytes, length: int = LENGTH, most: int | None = None):
    """Stretches of one text of any length, part by part; parts overlap so that each string is in one."""
    most = most or STRETCH_BYTES
    for lo in range(0, max(1, len(body) - length + 1), most):
        _, start, strings, lead, anchor = stretches([body[lo:lo + most + length - 1]], length)
        yield start + lo, strings, lead, anchor


def digest(body: bytes, start: int, strings: int, lead: int, length: int = LENGTH) -> bytes:
    """Names a stretch by its bytes and its anchor's place; cryptographic, so that equal names are equal stretches."""
    return hashlib.blake2b(body[start:start + strings - 1 + length], digest_size=16, salt=struct.pack("<QQ", strings, lead)).digest()


def repeated_strings(parts: list[bytes], strings: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which strings occur again in their group, for the ``strings[k]`` strings of each part, one after another."""
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    at = np.cumsum([0, *map(len, parts)])[:-1]
    pos = np.repeat(at, strings) + np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
    owner = np.repeat(group, strings)
    hashes = PrefixHashes(data)
    order = _suffix_sort(data, hashes, pos, owner, length)
    p, own = pos[order], owner[order]
    near = np.flatnonzero((own[1:] == own[:-1]) & (hashes.piece(p[1:], length) == hashes.piece(p[:-1], length)))
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    for lo in range(0, len(near), 20_000):
        k = near[lo:lo + 20_000]
        if (windows[p[k]] != windows[p[k + 1]]).any():  # a hash collision: order the bytes themselves
            order = np.array(sorted(range(len(pos)), key=lambda i: (owner[i], windows[pos[i]].tobytes())))
            p, own = pos[order], owner[order]
            near = np.array([i for i in range(len(p) - 1) if own[i] == own[i + 1]
                             and (windows[p[i]] == windows[p[i + 1]]).all()], dtype=np.int64)
            break
    out = np.zeros(len(pos), dtype=bool)
    out[order[near]] = out[order[near + 1]] = True
    return out


def _suffix_sort(data, hashes, pos, group, length) -> np.ndarray:
    """Order of suffixes by their first ``length`` bytes within each group (groups are contiguous).

    In a merge only the left run is searched for its places; the right run
    takes the places that are left. The first eight bytes, or equal hashes of
    all ``length`` bytes, settle most comparisons.
    """
    n = len(pos)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes = np.diff(np.append(first, n))
    base, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
    local = np.arange(n) - base
    head = np.zeros(n, dtype=np.uint64)
    for k in range(min(8, length)):
        head = (head << np.uint64(8)) | data[pos + k]
    whole = hashes.piece(pos, length)
    order = np.arange(n)
    run = 1
    while run < sizes.max():
        right = (local // run | 1) * run  # where the right run of each block begins
        left = np.flatnonzero((local < right) & (right < size))
        begin = (base + right)[left]
        lo, hi = begin.copy(), (base + np.minimum(right + run, size))[left]
        heads = head[order]
        live = np.arange(len(left))
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            mine = left[live]
            less = heads[mid] < heads[mine]
            close = np.flatnonzero(heads[mid] == heads[mine])
            p, q = order[mid[close]], order[mine[close]]
            differ = whole[p] != whole[q]
            close, p, q = close[differ], p[differ], q[differ]
            less[close] = _compare(data, hashes, pos[p], pos[q], length) < 0
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        place = left + (lo - begin)
        after = np.empty_like(order)
        after[place] = order[left]
        free, rest = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        free[place] = rest[left] = False
        after[free] = order[rest]
        order = after
        run *= 2
    return order


def _compare(data, hashes, p, q, length) -> np.ndarray:
    """Sign of suffix p against suffix q: the common extension by binary search, then the next byte."""
    common = np.zeros(len(p), dtype=np.int64)
    step = 1 << (length.bit_length() - 1)
    sums, up = hashes.sums, hashes.up
    at_p, at_q, up_p, up_q = sums[p], sums[q], up[p], up[q]
    while step:
        longer = common + step
        inside = np.minimum(longer, length)
        same = ((sums[p + inside] - at_p) * up_p == (sums[q + inside] - at_q) * up_q) & (longer <= length)
        common = np.where(same, longer, common)
        step >>= 1
    k = np.minimum(common, length - 1)
    return np.where(common == length, 0, data[p + k].astype(np.int16) - data[q + k])


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   group: int = GROUP) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` for every row of ``df``.

    A byte goes if it is covered by a string of ``length`` bytes that starts
    anywhere else in the column too, the same text and overlaps included, all
    judged on the input. Null counts as empty; texts shorter than ``length``
    stay whole; repeated rows are occurrences like any other; null ids keep
    their rows; other columns are not read; an empty table gives an empty table.
    """
    ship_package(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("text_hash"),
                    F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    spans = repeated_spans(src, length, group).withColumnRenamed("doc_id", "k").withColumnRenamed("text_hash", "h")

    def cut(batches):
        def rows():
            for b in batches:
                for key, body, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "body", "spans")), strict=True):
                    gone, kept, at, runs, end = 0, hashlib.sha256(), 0, 0, -1
                    for s in sorted((x["start"], x["stop"]) for x in found or ()):
                        if s[0] > end:
                            kept.update(body[at:s[0]])
                            runs += 1
                            gone += s[1] - s[0]
                        elif s[1] > end:
                            gone += s[1] - end
                        end = max(end, s[1])
                        at = end
                    kept.update(body[at:])
                    yield key, len(body), gone, runs, kept.hexdigest()
        yield from to_batches(rows(), schema)

    joined = src.join(spans, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left")
    return (joined.select("doc_id", "body", "spans")
            .mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def repeated_spans(src: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``(doc_id, text_hash, spans)``: array of ``(start, stop)`` byte ranges that occur more than once."""
    spark = src.sparkSession
    fields = [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("strings", pa.int16()),
              ("lead", pa.int16()), ("anchor", pa.int64()), ("whole", pa.binary())]

    def deal(named: bool):
        """All stretches, ``named`` by digest or with their anchors alone."""
        schema = pa.schema(fields if named else [("anchor", pa.int64())])

        def batch(b, texts, own, start, strings, lead, anchor):
            if not named:
                return pa.RecordBatch.from_arrays([pa.array(anchor)], schema=schema)
            who = pa.array(own)
            whole = [digest(texts[t], s, n, k, length) for t, s, n, k in zip(own.tolist(), start.tolist(), strings.tolist(), lead.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(who), b.column("text_hash").take(who), pa.array(start, pa.int32()), pa.array(strings, pa.int16()),
                 pa.array(lead, pa.int16()), pa.array(anchor), pa.array(whole, pa.binary())], schema=schema)

        def run(batches):
            with tidied():
                for b in batches:
                    texts = b.column("body").to_pylist()
                    at, size = 0, 0
                    for k, t in enumerate(texts):
                        if len(t) >= STRETCH_BYTES:
                            for start, strings, lead, anchor in dealt_stretches(t, length):
                                yield batch(b, texts, np.full(len(start), k), start, strings, lead, anchor)
                            texts[k] = b""
                        size += len(texts[k])
                        if size >= BATCH_BYTES or k == len(texts) - 1:
                            own, *rest = stretches(texts[at:k + 1], length)
                            yield batch(b, texts, own + at, *rest)
                            at, size = k + 1, 0

        return src.mapInArrow(run, "doc_id long, text_hash long, start int, strings short, lead short, anchor long, whole binary" if named else "anchor long")

    # stored, as are the ranges below: a join of two plain shuffles is one whose hot keys Spark can split
    repeated = stored(spark, deal(False).groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    hits = stored(spark, deal(True).join(repeated, "anchor"), "stretches")
    kinds = hits.groupBy("anchor", "whole").agg(F.count("*").alias("n"), F.min(F.struct(
        "doc_id", "text_hash", "start", "strings", "lead")).alias("one"))
    kinds = stored(spark, kinds, "kinds")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = (kinds.join(several, "anchor")
              .select(F.col("one.doc_id").alias("k"), F.col("one.text_hash").alias("h"),
                      F.struct("anchor", "whole", "one.start", "one.strings", "one.lead").alias("want"))
              .groupBy("k", "h").agg(F.collect_list("want").alias("wants")))
    piece = pa.schema([("cell", pa.int64()), ("anchor", pa.int64()), ("whole", pa.binary()), ("first", pa.int32()),
                       ("strings", pa.int32()), ("lead", pa.int32()), ("part", pa.binary())])
    ddl = "cell long, anchor long, whole binary, first int, strings int, lead int, part binary"

    def fetch(batches):
        def rows():
            for b in batches:
                for body, wants in zip(b.column("body").to_pylist(), b.column("wants").to_pylist(), strict=True):
                    for w in wants:
                        yield (w["anchor"], w["anchor"], w["whole"], 0, w["strings"], w["lead"],
                               body[w["start"]:w["start"] + w["strings"] - 1 + length])
        yield from to_batches(rows(), piece)

    texts = src.join(wanted, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")))
    parts = stored(spark, texts.select("body", "wants").mapInArrow(fetch, ddl), "parts")  # rows of repeated documents repeat
    settled = [kinds.where("n > 1").select("anchor", "whole", F.lit(0).alias("lo"), F.col("one.strings").cast("int").alias("hi"))]
    for width in (*CELLS, None):
        sizes = parts.groupBy("cell").agg(F.count("*").alias("size"))
        if width is None:
            settled.append(_sorted_cells(parts, length))
            break
        crowded = stored(spark, sizes.where(F.col("size") > group).select("cell"), "crowded")
        settled.append(_sorted_cells(parts.join(crowded, "cell", "left_anti"), length))
        if crowded.isEmpty():
            break
        cells = stored(spark, parts.join(crowded, "cell", "left_semi")
                       .mapInArrow(_divider(width, length, piece), ddl), "cells")
        content = ("cell", "strings", "lead", "part")  # the bytes themselves
        same = cells.groupBy(*content).agg(F.count("*").alias("n"), F.min(F.struct("anchor", "whole", "first")).alias("one"))
        same = stored(spark, same, "equal_cells")
        settled.append(cells.join(same.where("n > 1").select(*content), list(content))
                       .select("anchor", "whole", F.col("first").alias("lo"), (F.col("first") + F.col("strings")).alias("hi")))
        mixed = same.groupBy("cell").agg(F.count("*").alias("kinds")).where("kinds > 1").select("cell")
        parts = stored(spark, same.join(mixed, "cell").select("cell", "one.anchor", "one.whole", "one.first", "strings", "lead", "part"), "parts")
    found = settled[0]
    for more in settled[1:]:
        found = found.unionByName(more)
    ranges = stored(spark, found.distinct().groupBy("anchor", "whole")
                    .agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")), "ranges")
    return (hits.join(ranges, ["anchor", "whole"])
            .select("doc_id", "text_hash", F.transform("ranges", lambda r: F.struct(
                (F.col("start") + r["lo"]).alias("start"), (F.col("start") + r["hi"] - 1 + F.lit(length)).alias("stop"))).alias("spans"))
            .groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans")))


def _divider(width: int, length: int, piece: pa.Schema):
    """Cut stretches into cells of strings whose anchor lies equally far in, counted in steps of ``width``.

    All strings of a cell share its core, whose hash is the cell's new name.
    """
    def divide(batches):
        def rows():
            for b in batches:
                for cell, anchor, whole, first, strings, lead, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    lo = 0
                    while lo < strings:
                        step = (lead - lo) // width
                        hi = min(strings, lead - step * width + 1)
                        core = part[lead - step * width:lead - step * width - width + 1 + length]
                        name = xxhash.xxh3_64_intdigest(core, seed=(step * 256 + width)) ^ (anchor & (2 ** 64 - 1))
                        yield (name - (1 << 63), anchor, whole, first + lo, hi - lo, lead - lo, part[lo:hi - 1 + length])
                        lo = hi
        yield from to_batches(rows(), piece)

    return divide


def _sorted_cells(parts: DataFrame, length: int) -> DataFrame:
    """``(anchor, whole, lo, hi)``: ranges of repeated strings, by one suffix sort over many cells at a time."""
    schema = pa.schema([("anchor", pa.int64()), ("whole", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32())])

    def sort(batches):
        def rows():
            held, total = [], 0
            last = None
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in ("cell", "anchor", "whole", "first", "strings", "part")), strict=True):
                    if row[0] != last and total > 60_000:
                        yield from settle(held)
                        held, total = [], 0
                    if row[0] != last:
                        seen: set = set()
                        last = row[0]
                    if row[1:4] not in seen:
                        seen.add(row[1:4])
                        held.append(row)
                        total += row[4]
            if held:
                yield from settle(held)

        def settle(held):
            strings = np.array([r[4] for r in held], dtype=np.int64)
            cells = np.array([r[0] for r in held], dtype=np.int64)
            group = np.cumsum(np.append(False, cells[1:] != cells[:-1]))
            flags = repeated_strings([r[5] for r in held], strings, group, length)
            for r, mine in zip(held, np.split(flags, np.cumsum(strings)[:-1]), strict=True):
                for lo, hi in _intervals(mine):
                    yield r[1], r[2], r[3] + lo, r[3] + hi
        yield from to_batches(rows(), schema)

    return (parts.select("cell", "anchor", "whole", "first", "strings", "part").repartition("cell")
            .sortWithinPartitions("cell").mapInArrow(sort, "anchor long, whole binary, lo int, hi int"))
