"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target fixes how often its documents are taken: a whole number of
times each, and once more with an inclusion probability. The cube method's
flight moves the probabilities of three documents at a time along the null
space of the constraints (number of documents, number of words) until one of
them is 0 or 1. Random groups of documents fly by themselves; what each leaves
open, two documents at most, is dealt into new groups, until one group a
source is left. Of its last two documents one is landed whole, and of the
other as many words are taken as its probability leaves.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import running_index
from .common import free_name, ship_package, stored, to_batches

WORD = r"[^\x20\x09-\x0D]+"
WORD_GAPS = r"[\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_TIMES = 2
GROUP = 4096
_COPIES_AT_ONCE = 1 << 16
_ZERO = 1e-9


def flight(units: Iterator[tuple], rng: random.Random) -> Iterator[tuple]:
    """Fast flight phase over ``(key, size, p)``; yields ``(key, size, p)`` with p 0 or 1, and two open ones at most in the end.

    Sums of p and of p * size are kept; three units are held at a time.
    """
    held: list[list] = []
    for unit in units:
        held.append(list(unit))
        while True:
            for u in [u for u in held if not _ZERO < u[2] < 1 - _ZERO]:
                held.remove(u)
                yield u[0], u[1], float(round(u[2]))
            if len(held) == 2 and held[0][1] == held[1][1]:
                step = [1.0, -1.0]
            elif len(held) == 3:
                a, b, c = (u[1] for u in held)
                step = [1.0, -1.0, 0.0] if a == b else [float(c - b), float(a - c), float(b - a)]
            else:
                break
            _move(held, step, rng)
    yield from (tuple(u) for u in held)


def landing(units: list[tuple], rng: random.Random) -> Iterator[tuple]:
    """Settles all but one of the last open units: the number of documents is given up, the number of words kept."""
    held = [list(u) for u in units]
    if len(held) == 2:
        a, b = held[0][1], held[1][1]
        _move(held, [1.0, 0.0] if a == 0 else [0.0, 1.0] if b == 0 else [float(b), float(-a)], rng)
    for key, size, p in held:
        yield key, size, 0.0 if p < _ZERO or not size else 1.0 if p > 1 - _ZERO else p


def _move(held: list[list], step: list[float], rng: random.Random) -> None:
    """Go along ``step`` or against it until a probability is 0 or 1, keeping all expectations."""
    def reach(sign: int) -> float:
        return min((1 - u[2]) / (sign * s) if sign * s > 0 else u[2] / -(sign * s) for u, s in zip(held, step, strict=True) if s)

    ahead, back = reach(1), reach(-1)
    way = ahead if rng.random() * (ahead + back) < back else -back
    for u, s in zip(held, step, strict=True):
        p = u[2] + way * s
        u[2] = 0.0 if p < _ZERO else 1.0 if p > 1 - _ZERO else p


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most_times: float = MOST_TIMES) -> DataFrame:
    """``sizes (source, source_size, ...)`` with ``place`` (0-based) and ``target``: shares by weight, none above ``most_times`` its source's size.

    Sources in code-point order, null last, have the weights in turn. The excess of capped
    sources is shared anew among the others by weight until none is above.
    """
    spark = sizes.sparkSession
    ranked = running_index(sizes.withColumn("no_source", F.col("source").isNull()), [], ["no_source", "source"], "place")
    ranked = stored(spark, ranked.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)),
                                                                    F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1)), "source_sizes")
    most = F.col("source_size") * F.lit(float(most_times))
    total = float(ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, capped = 0.0, -1
    while True:
        # words a unit of weight gets, once the sources above their limit at the last level have that limit
        above = F.col("weight") * F.lit(level) > most
        got = ranked.agg(F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
                         F.coalesce(F.sum(above.cast("long")), F.lit(0))).first()
        if got[2] == capped or not got[1]:
            break
        capped, level = got[2], max(0.0, (total - got[0]) / got[1])
    return ranked.withColumn("target", F.least(F.col("weight") * F.lit(level), most)).drop("no_source", "weight")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def plan_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_times: float = MOST_TIMES,
             group: int = GROUP, seed: int = 17) -> DataFrame:
    """How often the mix takes each document: ``(doc_id, source, text_hash, size, source_size, target, copies, part)``.

    ``copies`` times whole, and once more ``part`` words of it; only one
    document a source has a part, the one whose probability is open in the end.

    Sizes are numbers of words (null and empty texts: 0, taken like others of
    their source but without words). A source without words has the target 0.
    Null sources are one source, the last. Rows alike in id, source and text
    are dealt one by one, as are null ids. The draw hangs on ids, texts and the
    seed alone, so reruns agree however the table is laid out. A text is
    counted whole; other columns aren't read; an empty table gives an empty
    table. Only numbers and hashes are shuffled, in groups of about ``group``.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                     F.xxhash64(F.col(text_col)).alias("text_hash"), word_count(F.col(text_col)).alias("size"))
    rows = stored(spark, rows.groupBy("doc_id", "source", "text_hash", "size").agg(F.count("*").alias("same")), "sizes")
    sizes = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("same")).cast("long").alias("source_size"),
                                       F.sum("same").alias("documents"))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = source_targets(sizes, weights, share, most_times).withColumn("times", times)
    targets = stored(spark, targets.withColumn("whole", F.floor("times")).withColumn("p", F.col("times") - F.floor("times"))
                     .withColumnRenamed("place", "source_no"), "targets")
    # a number for each of equal rows, in two steps, so that no long array is made
    at_once = F.lit(_COPIES_AT_ONCE)
    each = (rows.withColumn("far", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("same") - 1) / at_once))))
            .withColumn("near", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("same") - F.col("far") * at_once, at_once) - 1)))
            .select("doc_id", "source", "text_hash", "size", (F.col("far") * at_once + F.col("near")).alias("copy")))
    each = each.withColumn("key", F.xxhash64("doc_id", "source", "text_hash", "copy"))
    t = targets.withColumnRenamed("source", "of_source")
    dealt = stored(spark, each.join(t, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source"), "dealt")
    schema = pa.schema([("source_no", pa.int64()), ("key", pa.int64()), ("size", pa.int64()), ("p", pa.float64()), ("again", pa.bool_())])

    def fly(batches):
        def units():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("source_no", "grp", "groups", "key", "size", "p", "round")), strict=True)

        def settled():
            for (source, grp, groups, turn), own in _runs(units()):
                rng = random.Random(f"{seed},{turn},{source},{grp}")
                left = []
                for key, size, p in flight(own, rng):
                    if p in (0.0, 1.0):
                        yield source, key, size, p, False
                    else:
                        left.append((key, size, p))
                if groups == 1:
                    yield from ((source, key, size, p, False) for key, size, p in landing(left, rng))
                else:
                    yield from ((source, key, size, p, True) for key, size, p in left)
        yield from to_batches(settled(), schema)

    now, taken, turn = dealt.where("p > 0").select("source_no", "key", "size", "p"), [], 0
    while True:
        # groups of about the same size, as many as the source's open documents need
        open_now = now.groupBy("source_no").agg(F.ceil(F.count("*") / F.lit(group)).alias("groups"))
        ready = (now.join(stored(spark, open_now, "open"), "source_no").withColumn("round", F.lit(turn))
                 .withColumn("grp", F.pmod(F.xxhash64("key", F.lit(seed + turn)), F.col("groups")))
                 .repartition("source_no", "grp").sortWithinPartitions("source_no", "grp", F.desc("size"), "key"))
        done = stored(spark, ready.mapInArrow(fly, "source_no long, key long, size long, p double, again boolean"), "flown")
        taken.append(done.where("not again and p > 0").select("source_no", "key", (F.col("p") == 1).cast("long").alias("more"),
                                                              F.when(F.col("p") < 1, F.round(F.col("p") * F.col("size"))).otherwise(0).cast("long").alias("words")))
        now = done.where("again").select("source_no", "key", "size", "p")
        turn += 1
        if now.isEmpty():
            break
    more = taken[0]
    for x in taken[1:]:
        more = more.unionByName(x)
    more = more.groupBy("source_no", "key").agg(F.max("more").alias("more"), F.max("words").alias("words"))
    return dealt.join(more, ["source_no", "key"], "left").select(
        "doc_id", "source", "text_hash", "size", "source_size", "target",
        (F.col("whole") + F.coalesce("more", F.lit(0))).cast("long").alias("copies"), F.coalesce("words", F.lit(0)).cast("long").alias("part"))


def _runs(units):
    """Sorted units as ``((source, grp, groups, round), iterator of (key, size, p))``; an iterator is read before the next run."""
    held = next(units, None)

    while held is not None:
        name = (held[0], held[1], held[2], held[6])

        def own(name=name):
            nonlocal held
            while held is not None and (held[0], held[1]) == name[:2]:
                yield held[3:6]
                held = next(units, None)
        yield name, own()


def mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with all their columns.

    A part is the first words of its text, with single spaces between. Of rows
    alike in id, source and text any may be those that are taken once more.
    """
    plan = plan_mix(df, id_col, text_col, source_col, **options)
    key_id, key_source, key_hash, copies, same, part, at = (free_name(df, n) for n in ("mix_id", "mix_source", "mix_hash", "mix_copies", "mix_same", "mix_part", "mix_at"))
    times = stored(df.sparkSession, plan.groupBy(F.col("doc_id").alias(key_id), F.col("source").alias(key_source), F.col("text_hash").alias(key_hash))
                   .agg(F.sum("copies").alias(copies), F.count("*").alias(same), F.max("part").alias(part)), "mix_times")
    met = df.join(times, df[id_col].cast("long").eqNullSafe(F.col(key_id)) & df[source_col].cast("string").eqNullSafe(F.col(key_source))
                  & F.xxhash64(df[text_col]).eqNullSafe(F.col(key_hash)))
    single = met.where(F.col(same) == 1).withColumn(at, F.lit(0).cast("long"))
    # numbered by a hash of their place, so that many equal rows spread over tasks
    alike = stored(df.sparkSession, met.where(F.col(same) > 1).withColumn(at, F.monotonically_increasing_id()), "mix_alike")
    number = running_index(alike.select(key_id, key_source, key_hash, F.col(at).alias(at + "_row")), [key_hash], [key_id, key_source, at + "_row"], at + "_no")
    first = number.groupBy(key_id, key_source, key_hash).agg(F.min(at + "_no").alias(at + "_first"))
    number = (number.withColumnsRenamed({c: c + "_n" for c in (key_id, key_source, key_hash)})
              .join(first, F.col(key_id + "_n").eqNullSafe(F.col(key_id)) & F.col(key_source + "_n").eqNullSafe(F.col(key_source))
                    & F.col(key_hash + "_n").eqNullSafe(F.col(key_hash)))
              .select(F.col(at + "_row").alias(at), (F.col(at + "_no") - F.col(at + "_first")).alias(at + "_k")))
    alike = alike.join(number, at).drop(at).withColumnRenamed(at + "_k", at)
    rows = single.unionByName(alike)
    spare = F.col(copies) % F.col(same)
    cut = F.when((F.col(part) > 0) & (F.col(at) == spare), F.array(F.col(part))).otherwise(F.array())
    whole = F.array_repeat(F.lit(-1).cast("long"), (F.floor(F.col(copies) / F.col(same)) + (F.col(at) < spare).cast("long")).cast("int"))
    first_words = F.array_join(F.slice(F.array_remove(F.split(F.col(text_col), WORD_GAPS), ""), 1, F.greatest(F.col(part), F.lit(0)).cast("int")), " ")
    rows = rows.withColumn(part, F.explode(F.concat(whole, cut)))
    return rows.withColumn(text_col, F.when(F.col(part) < 0, F.col(text_col)).otherwise(first_words)).select(*df.columns)
