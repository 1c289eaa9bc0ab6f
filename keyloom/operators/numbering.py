"""Numbers in an order over many rows, without one task that sees them all.

Keys are dealt to ranges of the order and sorted within each; how many rows of a group a range has is a short table, whose running
sums say where each range begins. Only the keys are moved; texts join by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

#: Bits of monotonically_increasing_id that count within a partition.
_WITHIN = 33


def numbered(rows: DataFrame, order: list[Column | str], group: str | None = None, name: str = "nth") -> DataFrame:
    """The rows with their number (long, from 0) in the order, within each group if one is named.

    The order should tell all rows apart, or equal ones get numbers in any order. Rows are written once, so pass keys and no
    texts. Null groups are a group; an empty table gives no rows.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    by = [F.lit(0) if group is None else F.col(group), *order]
    by = by[1:] if group is None else by
    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = cut(dealt).withColumn("_range", F.shiftright("_at", _WITHIN))
    own = F.lit(0).alias("_group") if group is None else F.col(group).alias("_group")
    counts = dealt.groupBy("_range", own).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # a row for each range and group in it: a group of many rows has many ranges, and a range of many groups is one task's rows
    before = F.sum("_n").over(Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("_range").alias("_r"), F.col("_group").alias("_g"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start"))
    same = F.col("_range") == F.col("_r")
    if group is not None:
        same &= F.col(group).eqNullSafe(F.col("_g"))
    return dealt.join(starts, same).select(*rows.columns, (F.col("_at") + F.col("_start")).alias(name))
