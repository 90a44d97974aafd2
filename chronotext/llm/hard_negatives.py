"""Hard negatives of embeddings by inner products, with coordinate pruning in length buckets.

Rows are sorted by length and cut into buckets of similar length. A bucket is
held with its coordinates as sorted lists of unit-vector components. For an
anchor and the least inner product that still counts, the cosine needed in a
bucket bounds every component of a candidate; the ranges for the anchor's
largest components (its focus) are looked up in the sorted lists, their
candidate sets intersected, and what is left is verified by exact integer
products. Buckets and blocks of anchors meet as pairs of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import row_ids, ship_package, stored, to_batches

SCALE = 256
BUCKET_ROWS = 4096
BUCKET_BYTES = 2 << 20
ANCHOR_ROWS = 1024
ANCHOR_BYTES = 512 << 10
FOCUS = 5  # components of an anchor whose ranges are intersected
PAIRS_A_TASK = 8
LOWEST, HIGHEST = 1 - (1 << 63), (1 << 63) - 1

_ROW = "uid long, vec_id long, label long, dim int, squared long, payload binary"


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``(uid, vec_id, label, dim, squared, payload)``: the integers floor(scale * x) of every vector that takes part, stored."""
    ship_package(df.sparkSession)
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                    F.col(vector_col).cast("array<double>").alias("vector")).where("vec_id is not null and label is not null and vector is not null")
    schema = pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()),
                        ("squared", pa.int64()), ("payload", pa.binary())])

    def prepare(batches):
        ids = row_ids()

        def rows():
            for b in batches:
                for key, label, values in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "vector")), strict=True):
                    with np.errstate(over="ignore", invalid="ignore"):
                        x = np.array([math.nan if v is None else v for v in values], dtype=np.float64) * scale
                        if not float(x @ x) < 2.0 ** 62:
                            continue
                    whole = np.floor(x).astype("<i8")
                    yield next(ids), key, label, len(whole), sum(v * v for v in whole.tolist()), whole.tobytes()
        yield from to_batches(rows(), schema)

    return stored(df.sparkSession, src.mapInArrow(prepare, _ROW), "whole_vectors")


def length_buckets(rows: DataFrame, most_rows: int, most_bytes: int, name: str) -> DataFrame:
    """Stored rows ``(block, dim, longest, n, vectors)``, each a run of rows of similar length, the longest ones first.

    ``vectors`` is an array of the rows' structs. A block ends with its
    dimension, at ``most_rows`` or at ``most_bytes``.
    """
    held = [c for c in rows.columns if c not in ("dim", "squared")]
    kind = "array<struct<{}>>".format(",".join(f"{f.name}:{f.dataType.simpleString()}" for f in rows.select(*held).schema))
    out_type = f"block long, dim int, longest long, n int, vectors {kind}"
    schema = _arrow_schema(rows.sparkSession, out_type)
    ordered = rows.repartitionByRange("dim", F.desc("squared"), "uid").sortWithinPartitions("dim", F.desc("squared"), "uid")

    def cut(batches):
        numbers = row_ids()

        def flush(dim, longest, got):
            return pa.RecordBatch.from_pylist([{"block": next(numbers), "dim": dim, "longest": longest, "n": len(got), "vectors": got}], schema=schema)

        got, dim, longest, size = [], None, 0, 0
        for b in batches:
            for r in b.to_pylist():
                own = sum(len(v) if isinstance(v, bytes) else 8 * (len(v) if isinstance(v, list) else 1) for v in r.values())
                if got and (r["dim"] != dim or len(got) >= most_rows or size + own > most_bytes):
                    yield flush(dim, longest, got)
                    got, size = [], 0
                if not got:
                    dim, longest = r["dim"], r["squared"]
                got.append({c: r[c] for c in held})
                size += own
        if got:
            yield flush(dim, longest, got)

    return stored(rows.sparkSession, ordered.mapInArrow(cut, out_type), name)


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


class Bucket:
    """Vectors of similar length with sorted lists of their unit components."""

    def __init__(self, ints: np.ndarray, labels: np.ndarray):
        self.ints, self.labels = ints, labels
        self.lengths = np.sqrt((ints.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(self.lengths.max())
        self.unit = ints / np.where(self.lengths > 0, self.lengths, 1.0)[:, None]
        self.order = np.argsort(self.unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)
        # sums of products stay below the square of the longest length
        self.peak = int(np.abs(ints).max()) if ints.size else 0
        self.doubles = ints.astype(np.float64)

    def candidates(self, anchor: np.ndarray, least: int, focus: int = FOCUS) -> np.ndarray:
        """Positions of all vectors whose inner product with ``anchor`` may reach ``least`` (an integer)."""
        length = math.sqrt(float((anchor.astype(np.float64) ** 2).sum()))
        if least <= 0 or not length or not self.longest:
            return np.arange(len(self.ints)) if least <= 0 else np.zeros(0, dtype=np.int64)
        cosine = least / (length * self.longest) * (1 - 1e-12)
        if cosine > 1:
            return np.zeros(0, dtype=np.int64)
        q = anchor / length
        ranges = []
        for f in np.argsort(-np.abs(q), kind="stable")[:focus].tolist():
            # the angle to axis f may differ from the anchor's by as much as the cosine allows
            spread = math.sqrt(max(0.0, (1 - cosine * cosine) * (1 - q[f] * q[f])))
            low = -1.0 if q[f] < -cosine else q[f] * cosine - spread
            high = 1.0 if q[f] > cosine else q[f] * cosine + spread
            low, high = low - 1e-9, high + 1e-9
            first, end = np.searchsorted(self.sorted[:, f], [low, high])
            ranges.append((int(end - first), f, int(first), int(end), low, high))
        ranges.sort()
        _, f, first, end, _, _ = ranges[0]
        found = self.order[first:end, f]
        for _, f, _, _, low, high in ranges[1:]:
            x = self.unit[found, f]
            found = found[(x >= low) & (x < high)]
        return found

    def products(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact integer inner products."""
        if self.peak * int(np.abs(anchor).max(initial=0)) * max(1, len(anchor)) < 1 << 53:
            return (self.doubles[at] @ anchor.astype(np.float64)).astype(np.int64)
        return np.array([sum(x * y for x, y in zip(row, anchor.tolist(), strict=True)) for row in self.ints[at].tolist()], dtype=np.int64)


def best(queries: DataFrame, buckets: DataFrame, same_label: bool, most: int, focus: int = FOCUS) -> DataFrame:
    """``(anchor_uid, high, uid, vec_id, score)``: what can be among the ``most`` best of each anchor's windows.

    ``queries`` are rows of ``_ROW`` with ``windows``, an array of ``(high,
    low)``: scores between, the higher first, ties by the smaller ``vec_id``.
    With ``same_label`` rows of the anchor's label count, but for the anchor;
    else those of other labels. Each pair of blocks gives its own best; their
    best are to be taken after.
    """
    spark = buckets.sparkSession
    blocks = length_buckets(queries, ANCHOR_ROWS, ANCHOR_BYTES, "anchor_blocks")
    left = blocks.select(F.col("block").alias("anchors"), "dim")
    pairs = stored(spark, left.join(buckets.select("block", "dim"), "dim").select("anchors", "block"), "block_pairs")
    tasks = max(1, -(-pairs.count() // PAIRS_A_TASK))
    met = (pairs.join(blocks.select(F.col("block").alias("anchors"), F.col("vectors").alias("asked")), "anchors")
           .join(buckets.select("block", "vectors"), "block"))
    met = met.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "anchors", "block")
    schema = pa.schema([("anchor_uid", pa.int64()), ("high", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        def rows():
            for b in batches:
                for k in range(b.num_rows):
                    yield from _search(b.column("asked")[k].as_py(), b.column("vectors")[k].as_py(), same_label, most, focus)
        yield from to_batches(rows(), schema, max_rows=65536)

    return met.select("asked", "vectors").mapInArrow(search, "anchor_uid long, high long, uid long, vec_id long, score long")


def _search(asked: list[dict], vectors: list[dict], same_label: bool, most: int, focus: int):
    dim = len(vectors[0]["payload"]) // 8
    ints = np.frombuffer(b"".join(v["payload"] for v in vectors), dtype="<i8").reshape(len(vectors), dim)
    labels, ids, uids = (np.array([v[c] for v in vectors], dtype=np.int64) for c in ("label", "vec_id", "uid"))
    bucket = Bucket(ints, labels)
    for q in asked:
        windows = [(w["high"], w["low"]) for w in q["windows"] if w["low"] <= w["high"]]
        if not windows:
            continue
        anchor = np.frombuffer(q["payload"], dtype="<i8")
        at = bucket.candidates(anchor, min(w[1] for w in windows), focus)
        at = at[(labels[at] == q["label"]) & (uids[at] != q["uid"])] if same_label else at[labels[at] != q["label"]]
        scores = bucket.products(anchor, at)
        order = np.lexsort((ids[at], -scores))
        at, scores = at[order], scores[order]
        for high, low in windows:
            lo, hi = np.searchsorted(-scores, -high, side="left"), np.searchsorted(-scores, -low, side="right")
            for j in range(lo, min(hi, lo + most)):
                yield q["uid"], high, int(uids[at[j]]), int(ids[at[j]]), int(scores[j])


def _top(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` best of each window, with ``place`` from 1."""
    order = Window.partitionBy("anchor_uid", "high").orderBy(F.desc("score"), "vec_id", "uid")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def _two_waves(queries: DataFrame, buckets: DataFrame, same_label: bool, most: int, name: str) -> DataFrame:
    """Best of all buckets: the bucket of the longest vectors first, whose ``most``-th score then bounds the others'."""
    spark = buckets.sparkSession
    first = stored(spark, buckets.groupBy("dim").agg(F.max_by("block", F.struct("longest", "block")).alias("block")).select("block"), "longest")
    early = stored(spark, _top(best(queries, buckets.join(first, "block", "left_semi"), same_label, most), most), name)
    reached = early.where(F.col("place") == most).select(F.col("anchor_uid").alias("uid"), "high", F.col("score").alias("reached"))
    raised = (queries.select("uid", F.inline("windows")).join(reached, ["uid", "high"], "left")
              .groupBy("uid").agg(F.collect_list(F.struct("high", F.greatest("low", F.coalesce("reached", "low")).alias("low"))).alias("windows")))
    later = best(queries.drop("windows").join(raised, "uid"), buckets.join(first, "block", "left_anti"), same_label, most)
    return stored(spark, _top(early.drop("place").unionByName(later), most), name)


def mine(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         every: int = 100, positives: int = 5, negatives: int = 5, least_percent: int = 80,
         label: str | None = None) -> DataFrame:
    """Hard negatives of the anchors, the rows whose id is divisible by ``every``.

    ``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score``: the ``positives`` best other rows of the anchor's label,
    and for each the ``negatives`` best rows of other labels that score between
    ``least_percent`` per cent of the positive and the positive. Scores are
    inner products of floor(256 * x); ties go to the smaller id. ``label`` may
    give the label as an SQL expression over ``vec_id`` and ``label``.

    Null ids, labels and vectors, and vectors with null or non-finite
    components, take no part, nor do vectors whose scaled length is 2^31 or
    more, as scores would leave 64 bits. Vectors of different lengths have no
    score with each other. Rows that repeat an id are rows of their own, also
    as anchors. Other columns aren't read; an empty table gives an empty table.
    """
    spark = df.sparkSession
    rows = whole_vectors(df, id_col, vector_col, label_col)
    if label:
        rows = rows.withColumn("label", F.expr(label).cast("long"))
    buckets = length_buckets(rows, BUCKET_ROWS, BUCKET_BYTES, "length_buckets")
    anchors = rows.where(F.col("vec_id") % every == 0)
    window = lambda high, low: F.struct(high.alias("high"), low.alias("low"))
    near = _two_waves(anchors.withColumn("windows", F.array(window(F.lit(HIGHEST), F.lit(LOWEST)))), buckets, True, positives, "positives")
    # least integer not below least_percent per cent of the score, without leaving 64 bits
    score = F.col("score").cast("decimal(20,0)")
    low = F.ceil(score * least_percent / 100).cast("long")
    windows = near.select(F.col("anchor_uid").alias("uid"), window(F.col("score"), low).alias("w")).groupBy("uid").agg(F.collect_set("w").alias("windows"))
    far = _two_waves(anchors.join(windows, "uid"), buckets, False, negatives, "negatives")
    pairs = near.select("anchor_uid", F.col("uid").alias("positive_uid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("high"))
    return (pairs.join(far.select("anchor_uid", "high", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"),
                                  F.col("score").alias("negative_score")), ["anchor_uid", "high"])
            .join(anchors.select(F.col("uid").alias("anchor_uid"), F.col("vec_id").alias("anchor_id")), "anchor_uid")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    F.col("high").alias("positive_score"), "negative_score"))


SQL = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score
          FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, positive_id,
           (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    QUALIFY rank <= 5"""
