"""Interaction of five document filters, for every order in which they can be applied.

A document fails a filter by its own text (A to D) or because a smaller id has
the same text (E). E is found by an existential self-join; the failures of a
document are united into one combination of bits, and only the counts of
combinations are carried through the orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
WORD_GAPS = r"[\x20\x09-\x0D]+"
SIGNS = r"[#$%&*|]"

_COPY = 1 << FILTERS.index("E")


def text_failures(text: Column) -> Column:
    """The bits of A to D (1, 2, 4, 8) that a text that isn't null fails."""
    words = F.array_remove(F.split(text, WORD_GAPS), "")
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    fails = (n < MIN_WORDS, distinct * 100 < n * MIN_DISTINCT_PERCENT,
             capitals * 100 > F.length(text).cast("long") * MAX_CAPITAL_PERCENT, text.rlike(SIGNS))
    return sum((f.cast("int") * F.lit(1 << k) for k, f in enumerate(fails)), F.lit(0))


def later_copies(rows: DataFrame) -> DataFrame:
    """The rows of ``rows (doc_id, hash, text, ...)`` whose text a smaller ``doc_id`` has.

    A left-semi join on hash and exact text. Its other side has one row for
    each text whose hash repeats: if any id of that text is smaller, then the
    smallest one is.
    """
    again = stored(rows.sparkSession, rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeated_hashes")
    # stored, so that the join below is of two plain shuffles and Spark can split a text with many copies
    first = stored(rows.sparkSession, rows.join(again, "hash", "left_semi").groupBy("hash", "text").agg(F.min("doc_id").alias("least")),
                   "first_copies")
    left, right = rows.alias("l"), first.alias("r")
    return left.join(right, (F.col("l.hash") == F.col("r.hash")) & (F.col("l.text") == F.col("r.text"))
                     & (F.col("r.least") < F.col("l.doc_id")), "left_semi")


def failure_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   part_col: str = "source") -> DataFrame:
    """``(part, bits, good, toxic, n)``: documents of a part that fail just the filters in ``bits``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    # a row is known by its id and its text, as a digest
    key = (F.col("doc_id"), F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), F.col("part"))
    own = rows.select(*key, text_failures(F.col("text")).alias("bits"), F.lit(1).alias("n"))
    copies = later_copies(rows).select(*key, F.lit(_COPY).alias("bits"), F.lit(0).alias("n"))
    failed = own.unionByName(copies).groupBy("doc_id", "digest", "part").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    known = failed.join(marks, "doc_id", "left")
    return known.groupBy("part", "bits", F.coalesce("good", F.lit(False)).alias("good"),
                         F.coalesce("toxic", F.lit(False)).alias("toxic")).agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step, with what the step keeps and removes.

    ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``. Null texts are empty texts (they fail A
    only, and E as copies of each other), null parts the empty part. A row
    without an id is no copy of a smaller one and has no labels; rows that
    repeat an id and text count one by one and don't make each other fail E;
    a label that any row of an id gives counts. Long texts are read whole;
    other columns aren't read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    counts = failure_counts(docs, labels, id_col, text_col, part_col)
    full = (1 << len(FILTERS)) - 1
    # each filter after each set of earlier ones: 80 cases whatever the data
    cases = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(1 << f).alias("bit"), F.lit(before).alias("before"),
                               F.lit(factorial(before.bit_count()) * factorial(len(FILTERS) - 1 - before.bit_count())).alias("orders"))
                      for f in range(len(FILTERS)) for before in range(full + 1) if not before >> f & 1))
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    met = F.col("bits").bitwiseAND(F.col("before")) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    steps = counts.select("*", F.inline(cases)).groupBy("part", "f", "before", "orders").agg(
        total(~fails & ~met).alias("kept"), total(fails & ~met).alias("removed"), total(fails & met).alias("redundant"),
        total(fails & ~met & F.col("good")).alias("good_lost"), total(fails & ~met & F.col("toxic")).alias("toxic_lost"),
        total(F.col("bits") == F.col("bit")).alias("unique_fails"))
    steps = stored(spark, steps, "filter_steps")
    shapley = steps.groupBy("part", "f").agg(F.sum(F.col("removed") * F.col("orders")).cast("long").alias("shapley"))
    orders = spark.createDataFrame([("".join(o), k + 1, FILTERS.index(c), sum(1 << FILTERS.index(x) for x in o[:k]))
                                    for o in permutations(FILTERS) for k, c in enumerate(o)],
                                   "filter_order string, step int, f int, before int")
    return (steps.join(shapley, ["part", "f"]).join(F.broadcast(orders), ["f", "before"])
            .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost",
                    "toxic_lost", "shapley"))


SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
    first_ids AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    fails AS (
        SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
               len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
               100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text) AS c,
               regexp_matches(w.text, '[#$%&*|]') AS d, coalesce(first_ids.least < w.doc_id, false) AS e
        FROM w JOIN first_ids ON w.text = first_ids.text LEFT JOIN l ON w.doc_id = l.doc_id),
    counted AS (SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS bits, count(*) AS n
                FROM fails GROUP BY ALL),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
    orders AS (
        SELECT p.letter || q.letter || r.letter || s.letter || t.letter AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits
        FROM f p, f q, f r, f s, f t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31
          AND len(list_distinct([p.bit, q.bit, r.bit, s.bit, t.bit])) = 5),
    steps AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
              FROM orders, range(1, 6) AS g(step)),
    rows AS (
        SELECT part, filter_order, step, bit,
               sum(CASE WHEN counted.bits & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
               sum(CASE WHEN counted.bits & bit <> 0 AND counted.bits & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
               sum(CASE WHEN counted.bits & bit <> 0 AND counted.bits & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
               sum(CASE WHEN counted.bits = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
               sum(CASE WHEN good AND counted.bits & bit <> 0 AND counted.bits & before = 0 THEN n ELSE 0 END)::BIGINT AS good_lost,
               sum(CASE WHEN toxic AND counted.bits & bit <> 0 AND counted.bits & before = 0 THEN n ELSE 0 END)::BIGINT AS toxic_lost
        FROM counted, steps GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
    FROM rows"""
