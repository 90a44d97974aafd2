"""Near copies among embeddings by iterative quantisation and multi-index Hamming tables.

Rotations learned on a bounded sample turn vectors into balanced binary codes;
disjoint substrings of the codes are the keys of as many hash tables; vectors
of one label that meet in a table are compared by their original components.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bucket_join import components, distinct_nodes, links
from .common import bounded_sample, row_ids, ship_package, stored, tidied, to_batches

MIN_COSINE = 0.93
SAMPLE_ROWS = 20_000  # vectors that the rotations are fitted on
SAMPLE_BYTES = 64 << 20  # and at most so many bytes of them
WHOLE = 512  # vectors of a label and length that are compared without codes
RECALL = 0.98  # measured for sampled pairs right at the least cosine; closer pairs are found more surely
BUCKET = 32  # vectors of a label that a bucket should hold


def learn_rotation(x: np.ndarray, rng: np.random.Generator, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Mean and rotation whose signs are close to the rotated vectors (iterative quantisation)."""
    mean = x.mean(axis=0)
    v = x - mean
    _, axes = np.linalg.eigh(v.T @ v)
    v = v @ axes
    r = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    return mean, axes @ r


def table_plan(largest: int, min_cosine: float, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a table's key, so that buckets stay small, and the fewest tables, for vectors around zero."""
    bits = max(6, math.ceil(math.log2(max(largest, 1) / bucket + 1)))
    meet = (1 - math.acos(min_cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def limit_pairs(x: np.ndarray, min_cosine: float, rng: np.random.Generator, n: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Sampled vectors, and for each a unit vector right at the least cosine: half in any direction, half towards other vectors."""
    a = x[rng.integers(0, len(x), n)]
    u = rng.standard_normal(a.shape)
    u[n // 2:] = x[rng.integers(0, len(x), n - n // 2)]
    u -= (u * a).sum(axis=1, keepdims=True) * a
    alone = np.linalg.norm(u, axis=1) < 1e-6  # no other vector in that direction
    u[alone] = rng.standard_normal((int(alone.sum()), x.shape[1]))
    u[alone] -= (u[alone] * a[alone]).sum(axis=1, keepdims=True) * a[alone]
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return a, min_cosine * a + math.sqrt(max(0.0, 1 - min_cosine ** 2)) * u


def fit_tables(x: np.ndarray, bits: int, least: int, min_cosine: float, recall: float, rng: np.random.Generator,
               most: int = 16) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Rotations, and so many tables that pairs at the limit meet as often as ``recall`` asks, as measured.

    Vectors minus their mean are at wider angles the more of a common direction they share, those near the mean
    most of all. Where ``most`` times the ``least`` tables don't do, random rotations about zero take their
    place, whose angles are those of the cosine.
    """
    dim = x.shape[1]
    if dim == 1:  # vectors of one component are equal or opposite
        return [learn_rotation(x, rng) for _ in range(bits * least)], least
    a, b = limit_pairs(x, min_cosine, np.random.default_rng(1))
    near = np.argsort(np.linalg.norm(a - x.mean(axis=0), axis=1))[:len(a) // 10]
    half = len(a) // 2
    for centred in (True, False):
        spaces, tables, met = [], 0, np.zeros(len(a), dtype=bool)
        same = np.zeros((len(a), 0), dtype=bool)
        while not centred or tables < most * least:
            mean, r = learn_rotation(x, rng) if centred else (np.zeros(dim), np.linalg.qr(rng.standard_normal((dim, dim)))[0])
            spaces.append((mean, r))
            same = np.concatenate([same, ((a - mean) @ r >= 0) == ((b - mean) @ r >= 0)], axis=1)
            while same.shape[1] >= bits:
                met |= same[:, :bits].all(axis=1)
                same, tables = same[:, bits:], tables + 1
                if tables >= least and min(met[:half].mean(), met[half:].mean()) >= recall and met[near].mean() >= min(recall, 0.9):
                    return spaces, tables
    raise AssertionError("unreachable")


def _unit(values: list | None) -> np.ndarray | None:
    """Unit vector in double precision; None where it can't be compared."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    v = np.array(values, dtype=np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top  # neither overflow nor underflow in the norm
    return v / math.sqrt(float(v @ v))


def _similar(min_cosine: float):
    def similar(left, right):
        a, b = (np.frombuffer(b"".join(x), dtype="<f8").reshape(len(x), -1) for x in (left, right))
        return a @ b.T >= min_cosine
    return similar


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 min_cosine: float = MIN_COSINE, sample_rows: int = SAMPLE_ROWS, recall: float = RECALL,
                 seed: int = 11) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row.

    Vectors link within one label at ``min_cosine`` or more. Null labels, null
    or empty vectors, zero vectors and vectors with null or non-finite
    components link with nothing, nor do vectors of different lengths. Equal
    vectors of a label are compared as one and counted by their number; rows
    with the same id count as different vectors. Null ids have no component.
    There are as many tables as pairs at ``min_cosine`` made from the sample
    need for ``recall``, also where vectors share a common direction; lengths
    that no label has more than ``WHOLE`` vectors of need none, as these are all
    compared.
    Other columns are not read; an empty table gives an empty table.
    """
    spark = df.sparkSession
    ship_package(spark)
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                    F.col(vector_col).alias("embedding"))
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("payload", pa.binary()), ("uid", pa.int64())])

    def prepare(batches):
        ids = row_ids()

        def rows():
            for b in batches:
                for key, label, values in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True):
                    unit = None if label is None else _unit(values)
                    yield key, label, None if unit is None else unit.astype("<f8").tobytes(), next(ids)
        yield from to_batches(rows(), schema)

    rows = stored(spark, src.mapInArrow(prepare, "vec_id long, label long, payload binary, uid long"), "vectors")
    usable = rows.where(F.col("payload").isNotNull()).withColumn("dim", F.length("payload") / 8)
    distinct = stored(spark, usable.groupBy("label", "dim", "payload").agg(
        F.count("*").alias("n"), F.min("uid").alias("item"), F.min("vec_id").alias("low_id")), "distinct_vectors")
    groups = stored(spark, distinct.groupBy("label", "dim").agg(F.count("*").alias("size")), "label_sizes")
    large = stored(spark, groups.groupBy("dim").agg(F.max("size").alias("largest")).where(F.col("largest") > WHOLE), "coded_lengths")
    # vectors of lengths that no label has many of meet all others of their label and length
    members = (distinct.join(large.select("dim"), "dim", "left_anti")
               .select("item", F.xxhash64("label", "dim").alias("node")))
    for dim, largest in large.orderBy("dim").toLocalIterator():  # lengths that more than WHOLE vectors of a label have
        own = distinct.where(F.col("dim") == dim).select("item", "label", "payload")
        members = members.unionByName(stored(spark, _coded(own, int(dim), largest, min_cosine, sample_rows, recall, seed), "codes"))
    members = stored(spark, distinct_nodes(members), "buckets")
    counts, edges = links(members, distinct.select("item", "n", "payload"), _similar(min_cosine))
    labels = (distinct.join(counts, "item", "left").join(components(edges), "item", "left")
              .withColumn("component", F.coalesce("component", "item")))
    low = labels.groupBy("component").agg(F.min("low_id").alias("component_id"))
    labels = stored(spark, labels.join(low, "component").select(
        "label", "payload", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "vector_labels")
    linked = rows.join(labels, ["label", "payload"], "left")
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         F.coalesce("component_id", "vec_id").alias("component_id"),
                         F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"))


def _coded(vectors: DataFrame, dim: int, largest: int, min_cosine: float, sample_rows: int, recall: float, seed: int) -> DataFrame:
    """``(item, node)`` of vectors of one length in the hash tables fitted on a sample of them."""
    bits, tables = table_plan(largest, min_cosine, recall)
    sample = bounded_sample(vectors, F.xxhash64("item", F.lit(seed)), max(1, min(sample_rows, SAMPLE_BYTES // (8 * dim))), "item")
    x = np.frombuffer(b"".join(bytes(r[0]) for r in sample.select("payload").collect()), dtype="<f8").reshape(-1, dim)
    held = vectors.sparkSession.sparkContext.broadcast(fit_tables(x, bits, tables, min_cosine, recall, np.random.default_rng(seed)))  # dim x dim numbers a rotation
    keys = pa.schema([("item", pa.int64()), ("node", pa.int64())])

    def hash_tables(batches):
        def out():
            powers = 1 << np.arange(bits, dtype=np.int64)
            rotations, n = held.value
            for b in batches:
                items, labels, payloads = (b.column(c).to_pylist() for c in ("item", "label", "payload"))
                x = np.frombuffer(b"".join(payloads), dtype="<f8").reshape(-1, dim)
                code = np.concatenate([(x - mean) @ r >= 0 for mean, r in rotations], axis=1)
                for t in range(n):
                    part = code[:, t * bits:(t + 1) * bits] @ powers
                    for item, label, v in zip(items, labels, part.tolist(), strict=True):
                        yield item, _node(label, dim, t, v)
        with tidied():
            yield from to_batches(out(), keys, max_rows=65536)

    return vectors.mapInArrow(hash_tables, "item long, node long")


def _node(label: int, dim: int, t: int, value: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{label},{dim},{t},{value}".encode()) - (1 << 63)
