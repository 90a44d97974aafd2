"""Similarity links inside buckets, and their connected components.

A candidate search of any kind ends in memberships ``(node, item)``; two items
are compared when they share a node. Large nodes are cut into blocks and
compared block against block, so no task holds more than two blocks, and
nothing but counts of links and a spanning forest of each comparison leaves it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, stored, tidied, to_batches

BLOCK = 512  # items of a node that stay together in a comparison
BLOCK_BYTES = 4 << 20  # and about so many bytes of payloads
SLICE = 256  # rows that are taken out of a batch at a time


def node_sizes(members: DataFrame) -> DataFrame:
    """``(node, size, who)``: number of items and an order-free hash of them."""
    h = F.xxhash64("item")
    return members.groupBy("node").agg(F.count("*").alias("size"), F.bit_xor(h).alias("x"),
                                       F.sum(F.shiftright(h, 20)).alias("s"))


def distinct_nodes(members: DataFrame) -> DataFrame:
    """Memberships in nodes of two items or more; of nodes with the same items one is left."""
    sizes = node_sizes(members).where("size > 1")
    one = sizes.groupBy("size", "x", "s").agg(F.min("node").alias("node")).select("node", "size")
    return members.join(one, "node").select("node", "item", "size")


def links(members: DataFrame, items: DataFrame, similar: Callable[[list, list], np.ndarray],
          block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Verified links of ``items (item, n, payload)`` that share a node of ``members (node, item, size)``.

    ``similar`` takes two lists of payloads and returns a Boolean matrix.
    Returns ``(item, links)``, the sum of ``n`` over the linked items, and
    ``edges (a, b)`` that span what is linked. A pair that shares several nodes
    is counted in the smallest of them.
    """
    spark = members.sparkSession
    ship_package(spark)
    nodes = members.groupBy("item").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    rows = _comparisons(members, items.join(nodes, "item"), block)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def compare(batches):
        def rows_out():
            for node, group in _groups(batches):
                yield from _compare(node, group, similar)
        with tidied():
            yield from to_batches(rows_out(), schema)

    found = stored(spark, rows.mapInArrow(compare, "a long, b long, links long"), "links")
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("item")).agg(F.sum("links").alias("links"))
    return counts, found.where(F.col("b").isNotNull()).select("a", "b").distinct()


def prune(members: DataFrame, items: DataFrame, similar: Callable[[list, list], np.ndarray],
          block: int = BLOCK) -> DataFrame:
    """The memberships ``(node, item)`` of items that are ``similar`` to another item of their node."""
    ship_package(members.sparkSession)
    rows = _comparisons(members, items.withColumn("n", F.lit(1)).withColumn("nodes", F.array().cast("array<long>")), block)
    schema = pa.schema([("node", pa.int64()), ("item", pa.int64())])

    def compare(batches):
        def rows_out():
            for node, group in _groups(batches):
                sides = _sides(group)
                if len(sides) == 2:
                    linked = similar([r[4] for r in sides[0]], [r[4] for r in sides[1]])
                    if group[0][-1]:
                        np.fill_diagonal(linked, False)
                    for side, axis in zip(sides, (1, 0), strict=True):
                        for k in np.flatnonzero(linked.any(axis=axis)).tolist():
                            yield node, side[k][0]
        with tidied():
            yield from to_batches(rows_out(), schema)

    return rows.mapInArrow(compare, "node long, item long").distinct()


def _comparisons(members: DataFrame, items: DataFrame, block: int) -> DataFrame:
    """Rows sorted by comparison ``(node, i, j)`` of the blocks i and j of a node.

    A node has as many blocks as its items and the bytes of their payloads need.
    """
    weighed = members.join(items.select("item", F.length("payload").alias("bytes")), "item")
    weight = weighed.groupBy("node").agg(F.sum("bytes").alias("bytes"))
    # stored, so that the join below is of two plain shuffles and Spark can split a large node
    weight = stored(members.sparkSession, weight.where(F.col("bytes") > BLOCK_BYTES), "heavy_nodes")
    blocks = F.greatest(F.ceil(F.col("size") / F.lit(block)), F.ceil(F.coalesce("bytes", F.lit(0)) / F.lit(BLOCK_BYTES))).cast("int")
    placed = (members.join(weight, "node", "left").withColumn("blocks", blocks)
              .withColumn("mine", F.pmod(F.xxhash64("item", "node"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("node", "item", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine"))
    return placed.join(items, "item").repartition("node", "i", "j").sortWithinPartitions("node", "i", "j")


def _sides(group) -> list[list]:
    """The two sides of a comparison; a block against itself is both."""
    if group[0][-1]:
        return [group, group]
    return [[r for r in group if r[1] == m] for m in sorted({r[1] for r in group})]


def _groups(batches):
    """Runs of equal (node, i, j) of sorted batches, as lists of rows."""
    key, group = None, []
    for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
        cols = [b.column(c).to_pylist() for c in ("node", "i", "j", "item", "mine", "n", "nodes", "payload")]
        for node, i, j, *rest in zip(*cols, strict=True):
            if (node, i, j) != key:
                if len(group) > 1:
                    yield key[0], group
                key, group = (node, i, j), []
            group.append((*rest, i == j))
    if len(group) > 1:
        yield key[0], group


def _compare(node, group, similar):
    """Rows ``(item, None, links)`` and ``(a, b, None)`` of one comparison."""
    inner = group[0][-1]
    sides = _sides(group)
    if len(sides) < 2:
        return
    left, right = sides
    linked = similar([r[4] for r in left], [r[4] for r in right])
    if inner:
        np.fill_diagonal(linked, False)
    linked &= ~_met_before(node, [r[3] for r in left], [r[3] for r in right])
    ids = [np.array([r[0] for r in s]) for s in (left, right)]
    weight = [np.array([r[2] for r in s]) for s in (left, right)]
    for item, n in zip(ids[0].tolist(), (linked @ weight[1]).tolist(), strict=True):
        if n:
            yield item, None, n
    if not inner:
        for item, n in zip(ids[1].tolist(), (linked.T @ weight[0]).tolist(), strict=True):
            if n:
                yield item, None, n
    yield from _forest(ids, linked)


def _met_before(node, left, right) -> np.ndarray:
    """Pairs that share a node smaller than this one."""
    before = {v: k for k, v in enumerate(sorted({v for ns in left for v in ns if v < node}
                                                & {v for ns in right for v in ns if v < node}))}
    if not before:
        return np.zeros((len(left), len(right)), dtype=bool)
    held = []
    for side in (left, right):
        m = np.zeros((len(side), len(before)), dtype=np.float32)
        for k, ns in enumerate(side):
            m[k, [before[v] for v in ns if v in before]] = 1
        held.append(m)
    return held[0] @ held[1].T > 0


def _forest(ids, linked):
    """Edges of a spanning forest of a Boolean matrix."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(p, p)
            x = p
        return x

    a, b = ids[0].tolist(), ids[1].tolist()
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        u, v = root(a[i]), root(b[j])
        if u != v:
            parent[max(u, v)] = min(u, v)
    for x in list(parent):
        r = root(x)
        if r != x:
            yield r, x, None


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(item, component)``: the smallest item reachable, for every item with an edge.

    Large-star and small-star steps in turn: each joins every item's larger
    (then smaller) neighbours to its smallest one, until all edges form stars.
    Each step is written to the shared folder.
    """
    spark = edges.sparkSession
    now = stored(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .where("a <> b").distinct(), name)
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # stored, so that the join below is of two plain shuffles and Spark can split a hub's edges
        least = stored(spark, both.groupBy("a").agg(F.min("b").alias("b"))
                       .select("a", F.least("a", "b").alias("m")), name)
        large = (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        now = stored(spark, large, name)
        least = now.groupBy("a").agg(F.min("b").alias("m"))
        small = now.join(least, "a")
        small = (small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        now = stored(spark, small, name)
        h = F.xxhash64("a", "b")
        seen = now.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    stars = now.select(F.col("a").alias("item"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("item"), F.col("b").alias("component")).distinct())
