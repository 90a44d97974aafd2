"""Long-form term kernel shared by every bag-of-terms feature family.

``counts(doc_id, [carry...], term, c)`` -> ``vocab(term, df)`` ->
``weights(doc_id, term, c, value)`` -> row normalisation.

Counting groups by ``(doc_id, term)``; on a doc-partitioned input the
aggregation and the per-document normalisation window need no shuffle.
The vocabulary is a ``groupBy(term)`` with map-side partial counts, so a hot
term (space, 'e') is pre-aggregated before the shuffle.  The vocabulary join
is left to AQE: it is broadcast when its measured size is under the
broadcast threshold, and a shuffled join (with skew splitting) otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_terms(df: DataFrame, terms: Column, carry: list[str] | tuple = ()) -> DataFrame:
    """Explode an ``array<string>`` of terms per document and count them."""
    carry = [c for c in carry if c in df.columns and c != "doc_id"]
    exploded = df.select("doc_id", *carry, F.explode(terms).alias("term"))
    return exploded.groupBy("doc_id", *carry, "term").agg(F.count(F.lit(1)).alias("c"))


def fit_vocabulary(counts: DataFrame, min_df: int = 1, weight_col: str | None = None) -> DataFrame:
    """``vocab(term, df)``: document frequency, terms with df >= min_df.

    With ``weight_col`` every document counts ``w`` times (row multiplicity
    kept as a weight instead of duplicated rows)."""
    one = F.col(weight_col) if weight_col else F.lit(1)
    vocab = counts.groupBy("term").agg(F.sum(one).cast("long").alias("df"))
    return vocab.where(F.col("df") >= min_df) if min_df > 1 else vocab


def apply_vocabulary(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Frozen-vocabulary transform: keep only fitted terms (inner join)."""
    return counts.join(vocab, "term", "inner")


def tf_idf(counts_in_vocab: DataFrame, n_docs, use_idf: bool = True,
           sublinear_tf: bool = False, smooth_idf: bool = True) -> DataFrame:
    """tf = 1 + ln(c) if sublinear else c; idf = ln((1+N)/(1+df)) + 1."""
    c = F.col("c").cast("double")
    tf = (F.lit(1.0) + F.log(c)) if sublinear_tf else c
    if use_idf:
        n = F.lit(n_docs) if not isinstance(n_docs, Column) else n_docs
        extra = 1.0 if smooth_idf else 0.0
        idf = F.log((n.cast("double") + extra) / (F.col("df").cast("double") + extra)) + F.lit(1.0)
        tf = tf * idf
    return counts_in_vocab.withColumn("value", tf)


def normalize_rows(weights: DataFrame, norm: str | None = "l2", value: str = "value",
                   by: tuple = ("doc_id",)) -> DataFrame:
    """Row L1 / L2 normalisation; an all-zero row stays zero."""
    if not norm:
        return weights
    w = Window.partitionBy(*by)
    v = F.col(value)
    if norm == "l1":
        total = F.sum(F.abs(v)).over(w)
    elif norm == "l2":
        total = F.sqrt(F.sum(v * v).over(w))
    else:
        raise ValueError("norm must be 'l1', 'l2' or None")
    return weights.withColumn(value, F.when(total > 0, v / total).otherwise(F.lit(0.0)))


def term_totals(counts_in_vocab: DataFrame) -> DataFrame:
    """Number of fitted-vocabulary terms per document."""
    return counts_in_vocab.groupBy("doc_id").agg(F.sum("c").cast("long").alias("n_terms"))
