"""What a table's columns hold: one row per column, from one aggregate where values allow it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    count_if,
    number,
    numeric_columns,
    per_column,
    ref,
    share,
    string_columns,
    temporal_columns,
    value_counts,
)
from tablewright.functions.quantiles import exact_quantiles
from tablewright.functions.text import as_boolean, as_email, as_timestamp, guarded_double, tidy_spaces
from tablewright.operators.validate import digest
from tablewright.session import stored

# Limits that decide roles and labels.
FEW_SHARE, FEW_VALUES = 0.05, 15
EXTENDED_PROBS = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
Z_LIMIT = 2.5
URL = r"^https?://\S+$"


def _numbers(df: DataFrame, columns: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    names = list(columns or numeric_columns(df))
    return df.select(*[number(c).alias(c) for c in names]), names


def numeric_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n, min, max, mean, median, variance, std, skewness, kurtosis) of numeric columns.

    Variance is the sample's; skewness and excess kurtosis are corrected for bias.
    """
    rows, names = _numbers(df, columns)
    stats = per_column(
        rows,
        names,
        {
            "n": lambda c: F.count(c),
            "min": lambda c: F.min(c),
            "max": lambda c: F.max(c),
            "mean": lambda c: F.avg(c),
            "variance": lambda c: F.var_samp(c),
            "std": lambda c: F.stddev_samp(c),
            "g1": lambda c: F.skewness(c),
            "g2": lambda c: F.kurtosis(c),
        },
    )
    n = F.col("n").cast("double")
    skew = F.when(F.col("n") > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(F.col("n") > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    middle = exact_quantiles(rows, names, [0.5]).select("column", F.col("q")[0].alias("median"))
    return stats.join(middle, "column", "left").select(
        "column", "n", "min", "max", "mean", "median", "variance", "std", skew.alias("skewness"), kurt.alias("kurtosis")
    )


def extended_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Percentiles, spread, a 95 % interval of the mean, far values and the shape of numeric columns.

    Spread is the population's. ``far`` counts absolute z over 2.5, ``outliers`` values
    beyond 1.5 IQR of the quartiles.
    """
    rows, names = _numbers(df, columns)
    quantiles = exact_quantiles(rows, names, EXTENDED_PROBS)
    moments = per_column(
        rows,
        names,
        {
            "n": lambda c: F.count(c),
            "mean": lambda c: F.avg(c),
            "std": lambda c: F.stddev_pop(c),
            "skewness": lambda c: F.skewness(c),
            "kurtosis": lambda c: F.kurtosis(c),
        },
    )
    known = moments.join(quantiles, "column", "left")
    n = F.col("n")
    z = F.when(n >= 30, 1.96).when(n >= 20, 2.09).when(n >= 15, 2.13).when(n >= 10, 2.23).otherwise(2.57)
    q = F.col("q")
    shaped = known.select(
        "column",
        "n",
        "mean",
        "std",
        "skewness",
        "kurtosis",
        *[q[i].alias(f"p{int(p * 100)}") for i, p in enumerate(EXTENDED_PROBS)],
        F.when(F.col("mean") != 0, F.col("std") / F.abs("mean")).alias("cv"),
        (F.col("mean") - z * F.col("std") / F.sqrt("n")).alias("ci_low"),
        (F.col("mean") + z * F.col("std") / F.sqrt("n")).alias("ci_high"),
    ).withColumn("shape", distribution_shape())
    # a row per column, written so that the second pass, which counts values beyond its limits, does not compute it anew
    shaped = stored(shaped, "shapes")
    limits = shaped.agg(
        F.map_from_entries(F.collect_list(F.struct("column", F.struct("mean", "std", "p25", "p75")))).alias("m")
    ).scalar()
    marked = rows.withColumn("_m", limits)

    def at(c: str, name: str) -> Column:
        return F.col("_m")[c][name]

    counts = marked.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    count_if(F.abs(ref(c) - at(c, "mean")) > Z_LIMIT * at(c, "std")).alias("far"),
                    count_if(
                        (ref(c) < at(c, "p25") - 1.5 * (at(c, "p75") - at(c, "p25")))
                        | (ref(c) > at(c, "p75") + 1.5 * (at(c, "p75") - at(c, "p25")))
                    ).alias("outliers"),
                )
                for c in names
            ]
        ).alias("rows")
    ).select(F.inline("rows"))
    return shaped.join(counts, "column")


def distribution_shape() -> Column:
    """normal, right_skewed, left_skewed, bimodal, uniform or unknown, from an extended_stats row."""
    skew, kurt = F.col("skewness"), F.col("kurtosis")
    return (
        F.when((F.abs(skew) < 0.5) & (F.abs(kurt) < 1), "normal")
        .when(skew > 1, "right_skewed")
        .when(skew < -1, "left_skewed")
        .when((F.col("n") > 20) & ((F.col("p75") - F.col("p25")) / F.col("std") < 0.5), "bimodal")
        .when(kurt < -1, "uniform")
        .otherwise("unknown")
    )


def _keyed(df: DataFrame) -> DataFrame:
    """Texts as digests, so that counting distinct values does not shuffle them."""
    texts = set(string_columns(df))
    return df.select(*[(digest(ref(c)) if c in texts else ref(c).cast("string")).alias(c) for c in df.columns])


def entropy(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, entropy): -sum of p log2(p) over the shares of the non-null values."""
    names = list(columns or df.columns)
    counts = value_counts(_keyed(df.select(*[ref(c) for c in names])), names)
    p = F.col("n") / F.sum("n").over(Window.partitionBy("column"))
    return counts.withColumn("p", p).groupBy("column").agg((-F.sum(F.col("p") * F.log2(F.col("p") + 1e-12))).alias("entropy"))


def profile_columns(df: DataFrame) -> DataFrame:
    """(column, kind, rows, nulls, null_share, distinct, distinct_share, role).

    Roles: datetime by type; key when every row has its own value (text or whole
    number); measure for other numbers with many values; dimension otherwise.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    numbers, dates = set(numeric_columns(df)), set(temporal_columns(df))
    stats = per_column(
        df, df.columns, {"rows": lambda c: F.count(F.lit(1)), "nulls": lambda c: count_if(c.isNull())}
    )
    distinct = value_counts(_keyed(df), df.columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    facts = F.create_map(
        *[
            x
            for c in df.columns
            for x in (
                F.lit(c),
                F.struct(
                    F.lit(kinds[c]).alias("kind"),
                    F.lit(c in numbers).alias("number"),
                    F.lit(c in dates).alias("date"),
                    F.lit(kinds[c] in ("double", "float")).alias("fraction"),
                ),
            )
        ]
    )
    known = (
        stats.join(distinct, "column", "left")
        .withColumn("distinct", F.coalesce("distinct", F.lit(0)))
        .withColumn("fact", facts[F.col("column")])
        .withColumn("distinct_share", share(F.col("distinct"), F.col("rows")))
    )
    few = (F.col("distinct_share") < FEW_SHARE) & (F.col("distinct") < FEW_VALUES)
    role = (
        F.when(F.col("fact.date"), "datetime")
        .when((F.col("distinct") == F.col("rows")) & (F.col("rows") > 0) & ~F.col("fact.fraction"), "key")
        .when(F.col("fact.number") & ~few, "measure")
        .otherwise("dimension")
    )
    return known.select(
        "column", "fact.kind", "rows", "nulls", share(F.col("nulls"), F.col("rows")).alias("null_share"),
        "distinct", "distinct_share", role.alias("role"),
    )


def infer_technical_type(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, type): email, url, boolean, date, number, id or categorical, by shares of all values."""
    names = list(columns or string_columns(df))
    filled = df.select(*[F.when(tidy_spaces(ref(c)) != "", ref(c)).alias(c) for c in names])
    stats = per_column(
        filled,
        names,
        {
            "present": lambda c: F.count(c),
            "email": lambda c: F.count(as_email(c)),
            "url": lambda c: count_if(tidy_spaces(c).rlike(URL)),
            "boolean": lambda c: F.count(as_boolean(c)),
            "date": lambda c: F.count(as_timestamp(c)),
            "number": lambda c: F.count(guarded_double(c)),
        },
    )
    counts = value_counts(_keyed(filled), names).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))
    known = stats.join(counts, "column", "left")

    def over(name: str, limit: float) -> Column:
        return share(F.col(name), F.col("present")) > limit

    kind = (
        F.when(over("email", 0.7), "email")
        .when(over("url", 0.7), "url")
        .when(over("boolean", 0.7), "boolean")
        .when(over("date", 0.7), "date")
        .when(over("number", 0.85), "number")
        .when((F.col("present") > 1) & (F.col("distinct") == F.col("present")), "id")
        .otherwise("categorical")
    )
    return known.select("column", kind.alias("type"))


def column_quality(profile: DataFrame, outliers: DataFrame, violations: DataFrame) -> DataFrame:
    """Completeness, uniqueness and a score per column.

    ``profile``: of profile_columns; ``outliers``: column, affected; ``violations``: column, n.
    score = 100 - 40 null share - 30 outlier share - 10 violations, within 0 and 100.
    """
    known = (
        profile.join(outliers.select("column", F.col("affected").alias("far")), "column", "left")
        .join(violations.groupBy("column").agg(F.sum("n").alias("broken")), "column", "left")
        .fillna(0, ["far", "broken"])
    )
    present = F.col("rows") - F.col("nulls")
    far_share = share(F.col("far"), present)
    score = 100 - 40 * F.col("null_share") - 30 * far_share - 10 * F.col("broken")
    return known.select(
        "column",
        (1 - F.col("null_share")).alias("completeness"),
        share(F.col("distinct"), present).alias("uniqueness"),
        far_share.alias("outlier_share"),
        F.col("broken").alias("violations"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"),
    )


def time_profile(df: DataFrame, column: str) -> DataFrame:
    """(first, last, span_days, periods, gap_days, granularity, seasonal) of a date column.

    The gap is the median distance of successive distinct dates.
    """
    days = df.select(ref(column).cast("date").alias("day")).where("day IS NOT NULL").distinct()
    # distinct dates only: their number is bounded by the calendar
    gaps = days.select("day", F.datediff("day", F.lag("day").over(Window.orderBy("day"))).alias("gap"))
    span = F.datediff(F.max("day"), F.min("day"))
    found = gaps.agg(
        F.min("day").alias("first"),
        F.max("day").alias("last"),
        span.alias("span_days"),
        F.count(F.lit(1)).alias("periods"),
        F.median("gap").alias("gap_days"),
    )
    gap = F.col("gap_days")
    kind = F.when(gap < 2, "day").when(gap < 9, "week").when(gap < 35, "month").when(gap < 100, "quarter").otherwise("year")
    return found.select("*", kind.alias("granularity"), (F.col("span_days") > 365).alias("seasonal"))
