"""Ordering a whole table without one task that sees all of it.

Rows are dealt by ranges of the order columns; the range a row is in is stored with
it, so every later step sees the same ranges. Totals per range are few rows, and
running values are windows inside a range plus what earlier ranges hand on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import ref, value_counts
from tablewright.session import stored

ROWS_IN_RANGE = 1_000_000


def ranged(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """``df`` with the number of its range in ``name``; ranges ascend with ``order_by``.

    The number of ranges follows the number of rows. ``order_by`` should identify a row:
    equal rows are in one range.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(least, df.count() // ROWS_IN_RANGE + 1)
    dealt = df.repartitionByRange(parts, *[ref(o) for o in order_by])
    return stored(dealt.withColumn(name, F.spark_partition_id()), "ranges")


def cumulative_counts(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value, n, before, total) per distinct value of each column.

    ``before`` counts the column's smaller values. Values are doubles; null and NaN are
    left out. Counting first makes a hot value one row, so ranges are even.
    """
    counts = value_counts(df, columns, "double", keep).where(~F.isnan("value"))
    placed = ranged(counts, [*keep, "column", "value"], "_range")
    groups = [*keep, "column"]
    totals = placed.groupBy(*groups, "_range").agg(F.sum("n").alias("_n"))
    # one row per range and group
    by_group = Window.partitionBy(*groups)
    starts = totals.select(
        *[ref(g).alias(f"_{g}") for g in groups],
        F.col("_range").alias("_r"),
        F.coalesce(
            F.sum("_n").over(by_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
        F.sum("_n").over(by_group).alias("total"),
    )
    match = F.col("_range") == F.col("_r")
    for g in groups:
        match = match & ref(g).eqNullSafe(ref(f"_{g}"))
    inside = Window.partitionBy("_range", *groups).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return counted.join(starts, match).select(
        *groups, "value", "n", (F.col("_start") + F.col("_inside")).alias("before"), "total"
    )


def average_ranks(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., column, value, n, rank, total): the mean rank of each distinct value, from 1."""
    return cumulative_counts(df, columns, keep).select(
        *keep, "column", "value", "n", (F.col("before") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"), "total"
    )


def carry(
    df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = (), backward: bool = False
) -> DataFrame:
    """Fill nulls of ``column`` from the previous (or next) non-null row in order.

    With ``partition_by`` values are not carried from one key to another; a key of any
    size is spread over ranges like the table itself.
    """
    at = "_range"
    while at in df.columns:
        at = "_" + at
    placed = ranged(df, [*partition_by, *order_by], at)
    keys = [ref(k) for k in partition_by]
    position = F.struct(*[ref(o) for o in order_by])
    known = F.when(ref(column).isNotNull(), position)
    pick = F.min_by if backward else F.max_by
    ends = placed.groupBy(*[k.alias(f"{at}k{i}") for i, k in enumerate(keys)], ref(at).alias(f"{at}r")).agg(
        pick(ref(column), known).alias(f"{at}end"), F.count(F.lit(1)).alias(f"{at}n")
    )
    # one row per key and range; only keys that go over a range border have several
    names = [f"{at}k{i}" for i in range(len(keys))]
    across = Window.partitionBy(*names) if names else Window.partitionBy(F.lit(0))
    turn = ref(f"{at}r").desc() if backward else ref(f"{at}r").asc()
    handed = ends.withColumn(
        f"{at}handed",
        F.last(f"{at}end", ignorenulls=True).over(across.orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)),
    ).where(ref(f"{at}handed").isNotNull())
    match = ref(at) == ref(f"{at}r")
    for k, n in zip(keys, names, strict=True):
        match = match & k.eqNullSafe(ref(n))
    order = [(ref(o).desc_nulls_last() if backward else ref(o).asc_nulls_first()) for o in order_by]
    inside = Window.partitionBy(ref(at), *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(ref(column), ignorenulls=True).over(inside), ref(f"{at}handed"))
    own = [ref(c) if c != column else filled.alias(column) for c in df.columns]
    return placed.join(handed, match, "left").select(*own)
