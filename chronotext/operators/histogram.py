"""Cumulative length distribution (histogram kernel).

Bins have edges 1..upto-1, so there are ``upto-2`` bins; the last bin also
holds length ``upto-1``; longer values leave the denominator.  The value of
bin ``b`` is the share of in-range values <= b (an ECDF).

Counting is an ``explode`` + ``groupBy(doc_id, bin)`` with partial
aggregation; the per-document sparse counts (at most ``upto-2`` entries),
summed up in bin order by a window over the document, are turned into the dense cumulative vector inside the row by range
expansion, O(bins) per document, with no join against a bin grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ecdf(values: DataFrame, doc_ids: DataFrame, upto: int, prefix: str,
         mode: str = "intended", fset: str | None = None) -> DataFrame:
    """``values(doc_id, v)`` -> ``(doc_id, fset, term, bin, value)``.

    Documents without an in-range value get NaN (``reference``) or 0.0
    (``intended``) in every bin."""
    nb = upto - 2
    counts = (values.where((F.col("v") >= 1) & (F.col("v") <= upto - 1))
              .groupBy("doc_id", F.least(F.col("v"), F.lit(nb)).alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    so_far = F.sum("n").over(Window.partitionBy("doc_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    per_doc = counts.withColumn("cum", so_far).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("bin", "cum"))).alias("h"),
        F.max("cum").alias("total"))
    docs = doc_ids.select("doc_id").join(per_doc, "doc_id", "left")

    h = F.col("h")
    size = F.size(h)

    def run(e, i):  # entry i covers bins [bin_i, bin_{i+1} - 1]; share through entry i
        nxt = F.when(i + 1 < size, F.element_at(h, i + 2)["bin"]).otherwise(F.lit(nb + 1))
        return F.struct(e["bin"].alias("lo"), (nxt - 1).alias("hi"),
                        (e["cum"].cast("double") / F.col("total").cast("double")).alias("share"))

    # materialise the runs first: a lambda re-evaluates what it refers to
    docs = docs.select("doc_id", "total", F.when(F.col("total") > 0, F.transform(h, run)).alias("runs"))
    runs = F.col("runs")
    head = F.when(F.element_at(runs, 1)["lo"] > 1,
                  F.transform(F.sequence(F.lit(1), F.element_at(runs, 1)["lo"] - 1),
                              lambda b: F.struct(b.alias("bin"), F.lit(0.0).alias("value"))))
    head = F.coalesce(head, F.array().cast("array<struct<bin:int,value:double>>"))
    body = F.flatten(F.transform(runs, lambda r: F.transform(
        F.sequence(r["lo"], r["hi"]), lambda b: F.struct(b.alias("bin"), r["share"].alias("value")))))
    empty_value = F.lit(float("nan")) if mode == "reference" else F.lit(0.0)
    empty = F.transform(F.sequence(F.lit(1), F.lit(nb)),
                        lambda b: F.struct(b.alias("bin"), empty_value.alias("value")))
    dense = F.when(F.coalesce(F.col("total"), F.lit(0)) > 0, F.concat(head, body)).otherwise(empty)
    out = docs.select("doc_id", F.explode(dense).alias("e"))
    return out.select("doc_id", F.lit(fset or prefix).alias("fset"),
                      F.concat(F.lit(prefix + "_"), F.col("e.bin").cast("string")).alias("term"),
                      F.col("e.bin").cast("int").alias("bin"), F.col("e.value").alias("value"))


def steps(values: DataFrame, upto: int) -> DataFrame:
    """``values(doc_id, v)`` -> ``(doc_id, bin, step)``: by how much the cumulative curve rises at each bin.

    A curve is the running sum of its steps over bins 1..upto-2, so a document
    has as many rows as it has different lengths.  Documents without an
    in-range value have none (a curve of zeros)."""
    nb = upto - 2
    counts = (values.where((F.col("v") >= 1) & (F.col("v") <= upto - 1))
              .groupBy("doc_id", F.least(F.col("v"), F.lit(nb)).cast("int").alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    total = F.sum("n").over(Window.partitionBy("doc_id"))
    return counts.select("doc_id", "bin", (F.col("n") / total).alias("step"))


def normalize_steps(curves: DataFrame, upto: int, step: str = "step") -> DataFrame:
    """Steps divided by the L2 norm of their document's curve over all its bins."""
    w = Window.partitionBy("doc_id").orderBy("bin")
    height = F.sum(step).over(w.rowsBetween(Window.unboundedPreceding, 0))
    width = F.coalesce(F.lead("bin").over(w), F.lit(upto - 1)) - F.col("bin")
    squared = curves.withColumn("_part", height * height * width)
    norm = F.sqrt(F.sum("_part").over(Window.partitionBy("doc_id")))
    return squared.withColumn(step, F.when(norm > 0, F.col(step) / norm).otherwise(F.lit(0.0))).drop("_part")
