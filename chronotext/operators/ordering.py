"""Exact running index within groups without a single-task window.

``row_number() OVER (PARTITION BY g ORDER BY o)`` puts a whole group into
one task; a group may hold a large share of all rows.  Here the rows are
globally sorted by ``(g, o)`` (range partitioning splits a hot group over
many tasks), every row gets its position inside its sorted partition, and a
small table of per-(partition, group) counts turns that position into the
exact index within the group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.session import ensure_checkpoint_dir, stored

_MASK = (1 << 33) - 1


def running_index(df: DataFrame, group_cols: list[str], order_cols: list,
                  name: str = "idx") -> DataFrame:
    """Add ``name`` = 0-based rank of each row inside its group.

    ``order_cols`` together with ``group_cols`` must order rows totally
    (ties would make the index depend on the physical layout).
    """
    sort_cols = [F.col(c) for c in group_cols] + [
        F.col(c) if isinstance(c, str) else c for c in order_cols]
    mid = "_ri_mid"
    # The numbered rows are read twice (counts, join back).  They are fixed
    # by a reliable checkpoint in the shared checkpoint folder: two reads of
    # the sort could otherwise be coalesced differently by AQE and disagree
    # on partition numbers and positions.
    ensure_checkpoint_dir(df.sparkSession)
    s = df.orderBy(*sort_cols).withColumn(mid, F.monotonically_increasing_id()).checkpoint(eager=True)
    s = (s.withColumn("_ri_part", F.shiftright(F.col(mid), 33))
          .withColumn("_ri_pos", F.col(mid).bitwiseAND(F.lit(_MASK)))
          .drop(mid))
    keys = ["_ri_part"] + list(group_cols)
    firsts = s.groupBy(*keys).agg(F.min("_ri_pos").alias("_ri_p0"),
                                  F.count(F.lit(1)).alias("_ri_n"))
    w = Window.partitionBy(*group_cols).orderBy("_ri_part").rowsBetween(
        Window.unboundedPreceding, -1)
    offs = firsts.withColumn("_ri_off", F.coalesce(F.sum("_ri_n").over(w), F.lit(0)))
    out = s.join(offs.drop("_ri_n"), on=keys, how="inner")
    out = out.withColumn(name, (F.col("_ri_off") + F.col("_ri_pos") - F.col("_ri_p0")).cast("long"))
    return out.drop("_ri_part", "_ri_pos", "_ri_p0", "_ri_off")


def exact_median(df: DataFrame, group_cols: list[str], value_col: str,
                 name: str = "median", bins: int = 1024) -> DataFrame:
    """Exact median per group (mean of the two middle values for even n).

    Counted, not sorted: each round counts the values of every group in
    ``bins`` parts of the range that holds its middle, and narrows it to one of
    them, until that range is one value.  Null, NaN and infinite values don't
    count; a group without values has none."""
    values = stored(df.select(*group_cols, F.col(value_col).cast("double").alias("_v")).where(F.abs("_v") < float("inf")), "median-values")
    state = values.groupBy(*group_cols).agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    # _rank: place of the lower middle value among those from _lo on
    state = stored(state.withColumn("_rank", F.floor((F.col("_n") - 1) / 2)), "median-ranges")
    found = state.where("_lo = _hi")
    state = state.where("_lo < _hi")
    while not state.isEmpty():
        r = state.withColumnsRenamed({c: "g_" + c for c in group_cols})
        on = F.lit(True)
        for c in group_cols:
            on = on & values[c].eqNullSafe(r["g_" + c])
        near = values.join(r, on & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop(*("g_" + c for c in group_cols))
        # the least and the greatest value are never in one part, so every round narrows the range
        wide = F.col("_hi") / 2 - F.col("_lo") / 2
        share = F.when(wide < 1e307, (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise((F.col("_v") / 2 - F.col("_lo") / 2) / wide)
        part = F.least(F.floor(share * bins), F.lit(bins - 1))
        counts = near.groupBy(*group_cols, "_n", "_rank", part.alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_c").over(Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))  # bins rows
        counts = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
        state = stored(counts.select(*group_cols, "_n", "_lo", "_hi", (F.col("_rank") - (F.col("_upto") - F.col("_c"))).alias("_rank")), "median-ranges")
        found = found.unionByName(state.where("_lo = _hi"))
        state = state.where("_lo < _hi")
    found = stored(found.select(*group_cols, "_n", F.col("_lo").alias("_m")), "median-lower")
    # the upper middle value: the same one if enough values are no greater, else the next
    r = found.withColumnsRenamed({c: "g_" + c for c in group_cols})
    on = F.lit(True)
    for c in group_cols:
        on = on & values[c].eqNullSafe(r["g_" + c])
    both = (values.join(r, on).groupBy(*group_cols, "_n", "_m")
            .agg(F.sum((F.col("_v") <= F.col("_m")).cast("long")).alias("_c"), F.min(F.when(F.col("_v") > F.col("_m"), F.col("_v"))).alias("_next")))
    upper = F.when(F.col("_c") > F.floor(F.col("_n") / 2), F.col("_m")).otherwise(F.col("_next"))
    return both.select(*group_cols, ((F.col("_m") + upper) / 2).alias(name))
