"""Similarity join of documents on the Jaccard similarity of their word 5-grams, by chosen paths.

A set is embedded as the values of its MinHash functions. In each run every set
follows its own sampled values into nodes, so that sets meet where they share a
sampled value. Nodes that are still large are split again in the same way;
small ones, and those whose sets are alike throughout, are compared set by set.
The runs are repeated often enough for the target recall.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bucket_join import components, distinct_nodes, links, node_sizes, prune
from .common import free_name, row_ids, ship_package, stored, text_slices, tidied, to_batches

WORDS = 5
MIN_JACCARD = 0.8
VALUES = 64  # MinHash values of a set
RECALL = 0.999
LARGE = 512  # a node of more sets is split
ALIKE = 0.5  # unless their mean similarity is this high
DEPTH = 10  # then its blocks are compared, however large it is
SIGNS = 32  # random signs that the mean similarity of a large node is estimated with
SLACK = 0.25  # a sketch may be that far below the limit before the sets are compared themselves

_GOLDEN = 0x9E3779B97F4A7C15


def runs_needed(recall: float = RECALL) -> int:
    """Runs so that a pair at the limit, split twice, is missed with probability 1 - recall.

    A run shares a sampled value with probability 1 - 1/e at least, and a
    second split keeps the pair together as often.
    """
    return math.ceil(math.log(1 / (1 - recall)) / (1 - math.exp(-1)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of the word n-grams of a text; word hashes are kept between texts."""

    def __init__(self, words: int = WORDS, cache_words: int = 100_000):
        self.words, self.cache_words, self.known = words, cache_words, {}
        self.factors = [np.uint64(pow(_GOLDEN, 2 * k + 1, 1 << 64)) for k in range(words)]

    def sets(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """One array a text; None for a text without words. A shorter text is one n-gram of all its words."""
        if len(self.known) > self.cache_words:
            self.known = {}
        per_text = [(t or "").lower().split() for t in texts]
        flat = [w for ws in per_text for w in ws]
        for w in set(flat) - self.known.keys():
            self.known[w] = xxhash.xxh3_64_intdigest(w.encode())
        ids = np.fromiter(map(self.known.__getitem__, flat), dtype=np.uint64, count=len(flat))
        out, at = [], 0
        for ws in per_text:
            h = ids[at:at + len(ws)]
            at += len(ws)
            n = min(self.words, len(h))
            if not n:
                out.append(None)
                continue
            total = np.zeros(len(h) - n + 1, dtype=np.uint64)
            for k in range(n):
                total += h[k:len(h) - n + 1 + k] * self.factors[k]
            out.append(np.unique(_mix(total + np.uint64(n))))
        return out


def _functions(values: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, values, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, values, dtype=np.uint64)


def min_hashes(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each function, marked with the function's number."""
    a, b = functions
    least = np.full(len(a), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(shingles), 1024):
        part = shingles[lo:lo + 1024]
        np.minimum(least, ((part[:, None] ^ b) * a).min(axis=0), out=least)
    return _mix(least + np.arange(len(a), dtype=np.uint64))


def _alike(limit: float):
    """Sketches that agree in ``limit`` of their values."""
    def similar(left, right):
        a, b = (np.frombuffer(b"".join(x), dtype="<u8").reshape(len(x), -1) for x in (left, right))
        same = np.zeros((len(a), len(b)), dtype=np.int32)
        for k in range(a.shape[1]):
            same += a[:, k][:, None] == b[:, k]
        return same >= limit * a.shape[1]
    return similar


def _jaccard(limit: float):
    """Sets whose exact Jaccard similarity reaches ``limit``."""
    def similar(left, right):
        sets = [np.frombuffer(x, dtype="<u8") for x in left]
        sizes = [np.array([len(s) for s in sets])]
        if right is not left:
            other = [np.frombuffer(x, dtype="<u8") for x in right]
            sizes.append(np.array([len(s) for s in other]))
            sets = sets + other
        lens = np.array([len(s) for s in sets])
        _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        number = np.cumsum(held > 1) - 1  # n-grams of one set alone are in no intersection
        owner = np.repeat(np.arange(len(sets)), lens)
        shared = held[column] > 1
        owner, column = owner[shared], number[column[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        n, m = sizes[0], sizes[-1]
        both = np.zeros((len(n), len(m)))
        for lo in range(0, int(number[-1]) + 1, 8192):
            a, b = np.searchsorted(column, [lo, lo + 8192])
            held_by = np.zeros((len(sets), 8192), dtype=np.float32)
            held_by[owner[a:b], column[a:b] - lo] = 1
            both += held_by[:len(n)] @ held_by[-len(m):].T
        return both >= limit * (n[:, None] + m - both) - 1e-9
    return similar


def _chosen(sig: np.ndarray, path: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of the values that each row's path samples; 1 / ``least`` values a row on average."""
    mixed = _mix(sig ^ path[:, None])
    rows, at = np.nonzero(mixed < np.uint64(int(2 ** 64 / (least * sig.shape[1]))))
    return rows, _mix(mixed[rows, at] + np.uint64(1))


def paths(sketches: DataFrame, runs: int, least: float) -> DataFrame:
    """``(node, item)`` after the first split of every run."""
    schema = pa.schema([("node", pa.int64()), ("item", pa.int64())])

    def follow(batches):
        for b in batches:
            if b.num_rows:
                items = b.column("item").to_numpy()
                sig = np.frombuffer(b"".join(b.column("payload").to_pylist()), dtype="<u8").reshape(len(items), -1)
                for run in range(runs):
                    start = _mix(np.array([run + 1], dtype=np.uint64))
                    rows, nodes = _chosen(sig, np.repeat(start, len(items)), least)
                    yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(items[rows])], schema=schema)

    return sketches.mapInArrow(follow, "node long, item long")


def split_large(members: DataFrame, sketches: DataFrame, least: float, large: int = LARGE, alike: float = ALIKE,
                depth: int = DEPTH) -> DataFrame:
    """Memberships ``(node, item, size)`` with large nodes split until they are small or alike throughout."""
    spark = members.sparkSession
    members = stored(spark, distinct_nodes(members), "nodes")
    done = members.where(F.col("size") <= large)
    schema = pa.schema([("node", pa.int64()), ("item", pa.int64())])

    def follow(batches):
        for b in batches:
            if b.num_rows:
                nodes, items = b.column("node").to_numpy(), b.column("item").to_numpy()
                sig = np.frombuffer(b"".join(b.column("payload").to_pylist()), dtype="<u8").reshape(len(items), -1)
                rows, found = _chosen(sig, _mix(nodes.view(np.uint64)), least)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(items[rows])], schema=schema)

    for _ in range(depth):
        big = members.where(F.col("size") > large).join(sketches, "item").select("node", "item", "size", "payload")
        counted = big.groupBy("node").agg(*_sign_sums()).select("node", _peers().alias("peers"))
        sizes = members.where(F.col("size") > large).select("node", "size").distinct()
        mixed = stored(spark, counted.join(sizes, "node").where(F.col("peers") < alike * F.col("size")).select("node"), "mixed")
        if mixed.isEmpty():
            break
        children = (big.join(mixed, "node", "left_semi").select("node", "item", "payload")
                    .mapInArrow(follow, "node long, item long"))
        # small nodes are never split: only large ones are told apart
        done = done.unionByName(members.where(F.col("size") > large).join(mixed, "node", "left_anti"))
        members = stored(spark, distinct_nodes(children), "nodes")
        done = done.unionByName(members.where(F.col("size") <= large))
    return done.unionByName(members.where(F.col("size") > large))


def _sign_sums() -> list:
    """For each random sign, how often it is positive for the members' values (every eighth of their MinHash values)."""
    drawn = [F.xxhash64(F.substring("payload", 64 * k + 1, 8)) for k in range(VALUES // 8)]
    return [F.count("*").alias("members"), *(F.sum(sum((F.shiftright(h, r).bitwiseAND(F.lit(1)) for h in drawn), F.lit(0))).alias(f"s{r}")
                                             for r in range(SIGNS))]


def _peers():
    """About how many members of a node share a value: the second moment of its values over their number.

    The square of a sum of random signs, one for each value, has that moment as its mean.
    """
    held = F.col("members") * F.lit(VALUES // 8)
    return sum(((2 * F.col(f"s{r}") - held).cast("double") * (2 * F.col(f"s{r}") - held) for r in range(SIGNS)), F.lit(0.0)) / (SIGNS * held)


def near_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
               min_jaccard: float = MIN_JACCARD, recall: float = RECALL) -> DataFrame:
    """``(doc_id, class_id, n_links, kept)`` for every row of ``df``.

    Texts link when the sets of their lower-cased, space-separated word n-grams
    have a Jaccard similarity of ``min_jaccard`` or more; a class is what links
    connect, named by its smallest id, and the row of that id is kept (of
    repeated ids the first read; null ids come last). Texts with the same set
    are joined as one and counted by their number. A text of fewer words is one
    n-gram of them all; null texts and texts without words link with nothing.
    Other columns are not read; an empty table gives an empty table.
    """
    return _labelled(df, id_col, text_col, words, min_jaccard, recall).select("doc_id", "class_id", "n_links", "kept")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                     min_jaccard: float = MIN_JACCARD, recall: float = RECALL) -> DataFrame:
    """The rows of ``df`` that ``near_texts`` keeps, with all their columns.

    Of rows that share id and text one stays, whichever Spark reads first. Null
    texts and texts without words all stay but for such repeats; an empty table
    gives an empty table; other columns, whatever their names, stay as they are.
    """
    gone = stored(df.sparkSession, _labelled(df, id_col, text_col, words, min_jaccard, recall)
                  .groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "judged")
    key, hash_col = free_name(df, "lost_id"), free_name(df, "lost_hash")
    lost = gone.where(~F.col("kept")).select(F.col("doc_id").alias(key), F.col("text_hash").alias(hash_col))
    left = df.join(lost, df[id_col].cast("long").eqNullSafe(F.col(key)) & (F.xxhash64(df[text_col]) == F.col(hash_col)), "left_anti")
    if gone.where("kept and n > 1").isEmpty():
        return left
    return left.dropDuplicates([id_col, text_col])


def _labelled(df, id_col, text_col, words, min_jaccard, recall):
    spark = df.sparkSession
    ship_package(spark)
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                    F.col(text_col).alias("text"))
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("set_hash", pa.binary()),
                        ("payload", pa.binary())])

    def sketch(batches):
        shingler, functions, ids = Shingler(words), _functions(VALUES), row_ids()

        def rows():
            for b in batches:
                keys, hashes = (b.column(c).to_pylist() for c in ("doc_id", "text_hash"))
                for lo, _, texts in text_slices(b, "text"):
                    for k, s in enumerate(shingler.sets(texts), lo):
                        yield (next(ids), keys[k], hashes[k], None if s is None else xxhash.xxh3_128_digest(s.tobytes()),
                               None if s is None else min_hashes(s, functions).astype("<u8").tobytes())
        with tidied():
            yield from to_batches(rows(), schema)

    rows = stored(spark, src.mapInArrow(sketch, "uid long, doc_id long, text_hash long, set_hash binary, payload binary"),
                  "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid", "text_hash"))
    classes = stored(spark, rows.where(F.col("set_hash").isNotNull()).groupBy("set_hash")
                     .agg(F.count("*").alias("n"), first.alias("first"), F.min("payload").alias("payload"))
                     .select("set_hash", "n", "first", F.col("first.uid").alias("item"), "payload"), "classes")
    sketches = classes.select("item", "payload")
    nodes = split_large(paths(sketches, runs_needed(recall), min_jaccard), sketches, min_jaccard)
    mixed, alike = nodes.where(F.col("size") <= LARGE), nodes.where(F.col("size") > LARGE).select("node", "item")
    close = stored(spark, prune(mixed, sketches, _alike(min_jaccard - SLACK)).unionByName(alike), "close")
    members = stored(spark, distinct_nodes(close), "compared")
    wanted = (classes.join(members.select("item").distinct(), "item")
              .select("item", "n", F.col("first.doc_id").alias("k"), F.col("first.text_hash").alias("h")))

    found = pa.schema([("item", pa.int64()), ("n", pa.int64()), ("payload", pa.binary())])

    def shingle(batches):
        shingler = Shingler(words)

        def out():
            for b in batches:
                items, counts = (b.column(c).to_pylist() for c in ("item", "n"))
                for lo, _, texts in text_slices(b, "text"):
                    for k, s in enumerate(shingler.sets(texts), lo):
                        if s is not None:
                            yield items[k], counts[k], s.astype("<u8").tobytes()
        with tidied():
            yield from to_batches(out(), found)

    texts = src.join(wanted, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")))
    sets = stored(spark, texts.select("item", "n", "text").mapInArrow(shingle, "item long, n long, payload binary")
                  .dropDuplicates(["item"]), "sets")
    counts, edges = links(members, sets, _jaccard(min_jaccard))
    labels = (classes.drop("payload").join(counts, "item", "left").join(components(edges), "item", "left")
              .withColumn("component", F.coalesce("component", "item")))
    low = labels.groupBy("component").agg(F.min("first").alias("low"))
    labels = stored(spark, labels.join(low, "component").select(
        "set_hash", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "low"), "labels")
    return (rows.drop("payload").join(labels, "set_hash", "left")
            .select("doc_id", "text_hash", F.when(F.col("low").isNull(), F.col("doc_id")).otherwise(F.col("low.doc_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce(F.col("low.uid") == F.col("uid"), F.lit(True)).alias("kept")))
