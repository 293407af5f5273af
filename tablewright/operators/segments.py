"""Segments, their share in a measure, and tests between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import ref, share, with_scalar
from tablewright.functions.ordered import average_ranks
from tablewright.operators.profile import number


def _groups(df: DataFrame, dimensions: Sequence[str], measure: str) -> DataFrame:
    """(dimension, value, n, total, mean): all dimensions in one pass."""
    long = df.select(number(measure).alias("_x"), *[ref(d).cast("string").alias(d) for d in dimensions]).unpivot(
        ["_x"], [ref(d) for d in dimensions], "dimension", "value"
    )
    fit = long.where("_x IS NOT NULL AND value IS NOT NULL")
    return fit.groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("total"), F.avg("_x").alias("mean"))


def _overall(df: DataFrame, measure: str) -> DataFrame:
    x = number(measure)
    return df.agg(F.avg(x).alias("mean"), F.sum(x).alias("total"), F.count(x).alias("n"))


def segment_vs_mean(df: DataFrame, dimensions: Sequence[str], measure: str, least: float = 0.15) -> DataFrame:
    """Segments of three rows or more whose mean is off the overall one by over ``least``; under 10 rows sparse."""
    known = with_scalar(_groups(df, dimensions, measure).where("n >= 3"), _overall(df, measure), "_o")
    off = F.try_divide(F.col("mean") - F.col("_o.mean"), F.abs("_o.mean"))
    return known.select("dimension", "value", "n", "mean", off.alias("deviation"), (F.col("n") < 10).alias("sparse")).where(
        F.abs("deviation") > least
    )


def segment_contribution(df: DataFrame, dimensions: Sequence[str], measure: str, k: int = 10) -> DataFrame:
    """The ``k`` segments with the largest absolute share of the total."""
    known = with_scalar(_groups(df, dimensions, measure), _overall(df, measure), "_o")
    return (
        known.select(
            "dimension",
            "value",
            "n",
            "total",
            "mean",
            share(F.col("total"), F.col("_o.total")).alias("share"),
            (F.try_divide(F.col("mean") - F.col("_o.mean"), F.abs("_o.mean")) * 100).alias("deviation_pct"),
        )
        .orderBy(F.abs("share").desc(), "dimension", "value")
        .limit(k)
    )


def segment_breakdown(df: DataFrame, dimensions: Sequence[str], measure: str, baseline: float | None = None) -> DataFrame:
    """Each segment's pull on the mean: |mean - baseline| times its share of rows, in per cent, ranked."""
    known = with_scalar(_groups(df, dimensions, measure), _overall(df, measure), "_o")
    base = F.lit(float(baseline)) if baseline is not None else F.col("_o.mean")
    pull = F.abs(F.try_divide((F.col("mean") - base) * share(F.col("n"), F.col("_o.n")) * 100, base))
    # values of a dimension, already grouped
    order = Window.partitionBy("dimension").orderBy(F.desc("contribution"), "value")
    ranked = known.select("dimension", "value", "n", "mean", pull.alias("contribution"))
    return ranked.withColumn("rank", F.row_number().over(order)).withColumn("top", F.col("rank") <= 3)


def group_moments(df: DataFrame, group: str, measure: str) -> DataFrame:
    """(group, n, mean, variance) of groups with three values or more."""
    x = number(measure)
    return (
        df.where(ref(group).isNotNull())
        .groupBy(ref(group).cast("string").alias("group"))
        .agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("variance"))
        .where("n >= 3")
    )


def welch_t(df: DataFrame, group: str, a: str, b: str, measure: str) -> DataFrame:
    """(t, df, effect) of two groups with unequal variances."""
    groups = group_moments(df, group, measure)
    row = groups.agg(
        *[
            F.max(F.when(F.col("group") == F.lit(g), F.struct("n", "mean", "variance"))).alias(name)
            for name, g in (("a", a), ("b", b))
        ]
    ).where("a IS NOT NULL AND b IS NOT NULL")
    va, vb = F.col("a.variance") / F.col("a.n"), F.col("b.variance") / F.col("b.n")
    t = (F.col("a.mean") - F.col("b.mean")) / F.sqrt(va + vb)
    freedom = (va + vb) ** 2 / (va**2 / (F.col("a.n") - 1) + vb**2 / (F.col("b.n") - 1))
    spread = F.sqrt((F.col("a.variance") + F.col("b.variance")) / 2)
    return row.select(t.alias("t"), freedom.alias("df"), (F.abs(F.col("a.mean") - F.col("b.mean")) / spread).alias("effect"))


def anova_f(df: DataFrame, group: str, measure: str) -> DataFrame:
    """(f, df_between, df_within) of all groups."""
    groups = group_moments(df, group, measure)
    whole = groups.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean"))
    off = with_scalar(groups, whole, "_o").withColumn("off", F.col("mean") - F.col("_o.mean"))
    sums = off.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("off") ** 2).alias("between"),
        F.sum((F.col("n") - 1) * F.col("variance")).alias("within"),
    )
    low, high = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.try_divide(F.try_divide(F.col("between"), low), F.try_divide(F.col("within"), high))
    return sums.select(f.alias("f"), low.alias("df_between"), high.alias("df_within"))


def kruskal_h(df: DataFrame, group: str, measure: str) -> DataFrame:
    """(h, df): the rank statistic of all groups, corrected for ties.

    Ranks belong to distinct values, so groups and values are counted and no row is ranked.
    """
    ranks = average_ranks(df.where(ref(group).isNotNull()), [measure])
    counts = (
        df.where(ref(group).isNotNull() & number(measure).isNotNull())
        .groupBy(ref(group).cast("string").alias("g"), number(measure).alias("v"))
        .agg(F.count(F.lit(1)).alias("m"))
    )
    met = counts.join(ranks, F.col("v") == F.col("value"))
    groups = met.groupBy("g").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("rank")).alias("r"))
    ties = ranks.agg(F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"), F.max("total").cast("double").alias("total"))
    sums = with_scalar(groups.agg(F.sum(F.col("r") ** 2 / F.col("n")).alias("s"), F.count(F.lit(1)).alias("k")), ties, "t")
    n = F.col("t.total")
    h = 12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)
    return sums.select((h / (1 - F.col("t.ties") / (n**3 - n))).alias("h"), (F.col("k") - 1).alias("df"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """(chi2, df, n) of two categorical columns, with Yates' correction for two by two levels.

    Empty cells count through the sum over seen ones: their expected counts are what is
    left of n.
    """
    cells = df.where(ref(a).isNotNull() & ref(b).isNotNull()).groupBy(ref(a).alias("a"), ref(b).alias("b")).agg(F.count(F.lit(1)).alias("o"))
    wa, wb = Window.partitionBy("a"), Window.partitionBy("b")
    known = cells.select("a", "b", "o", F.sum("o").over(wa).alias("ra"), F.sum("o").over(wb).alias("rb"))
    total = cells.agg(F.sum("o")).scalar().cast("double")
    met = known.withColumn("e", F.col("ra") * F.col("rb") / total)
    levels = cells.agg(F.count_distinct("a").alias("x"), F.count_distinct("b").alias("y"))
    sums = met.agg(
        F.sum((F.col("o") - F.col("e")) ** 2 / F.col("e")).alias("plain"),
        F.sum((F.abs(F.col("o") - F.col("e")) - F.least(F.lit(0.5), F.abs(F.col("o") - F.col("e")))) ** 2 / F.col("e")).alias("yates"),
        F.sum("o").alias("n"),
        F.sum("e").alias("seen"),
    )
    known = with_scalar(sums, levels, "l")
    empty = F.col("n") - F.col("seen")
    two = (F.col("l.x") == 2) & (F.col("l.y") == 2)
    return known.select(
        F.when(two, F.col("yates")).otherwise(F.col("plain") + empty).alias("chi2"),
        ((F.col("l.x") - 1) * (F.col("l.y") - 1)).alias("df"),
        "n",
    )
