"""Labels, class balance, epoch filters and non-empty checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.functions.text import strip_space


def label_encode(docs: DataFrame, mapping: Mapping[str, int], col: str = "epoch",
                 out: str = "label", on_unknown: str = "error") -> DataFrame:
    """Map a (trimmed) class name to an integer through a literal map.

    ``on_unknown``: ``error`` fails the job on an unmapped name (``raise_error``),
    ``drop`` removes the row, ``null`` keeps it with a null label."""
    lookup = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(int(v)))])
    key = strip_space(col)
    value = lookup[key]
    if on_unknown == "error":
        value = F.when(value.isNull(), F.raise_error(F.concat(F.lit("unknown label: "), key))).otherwise(value)
    out_df = docs.withColumn(out, value.cast("int"))
    if on_unknown == "drop":
        out_df = out_df.where(F.col(out).isNotNull())
    return out_df


def skip_labels(docs: DataFrame, names: Iterable[str], col: str = "epoch") -> DataFrame:
    names = sorted({n.strip().lower() for n in names})
    return docs.where(~F.lower(strip_space(col)).isin(names)) if names else docs


def class_balance(docs: DataFrame, label: str = "label") -> DataFrame:
    return docs.groupBy(label).agg(F.count(F.lit(1)).cast("long").alias("n"))


def drop_null_segments(segments: DataFrame, col: str = "text", what: str = "segments") -> DataFrame:
    """Drop segments without annotation; fail the job if none is left."""
    kept = segments.where(F.col(col).isNotNull())
    if kept.limit(1).count() == 0:
        raise ValueError(f"all {what} are empty")
    return kept
