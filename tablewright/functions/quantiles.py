"""Exact quantiles, linearly interpolated, of columns of any size.

Distinct values are counted, ordered by ranges with running counts, and the one or two
values at a wanted rank are picked from them. No task holds a column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.ordered import cumulative_counts


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keep: Sequence[str] = ()
) -> DataFrame:
    """(keep..., column, q array<double>) with one entry of ``q`` per probability.

    A column without values has no row.
    """
    runs = cumulative_counts(df, list(dict.fromkeys(columns)), keep)
    parts = []
    for p in probs:
        rank = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(rank), F.ceil(rank)
        upto = F.col("before") + F.col("n")
        at_low = F.max(F.when((F.col("before") <= low) & (low < upto), F.col("value")))
        at_high = F.max(F.when((F.col("before") <= high) & (high < upto), F.col("value")))
        share = F.max(rank - low)
        parts.append(at_low + (at_high - at_low) * share)
    return runs.groupBy(*keep, "column").agg(F.array(*parts).alias("q"))


def quantile_row(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row with a map column -> quantiles; use with ``scalar()`` or ``with_scalar``."""
    return exact_quantiles(df, columns, probs).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "q"))).alias("q")
    )
