"""Exploration tables: frequencies, missing values, correlations, groups, periods, KPIs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import (
    count_if,
    distinct_counts,
    long_values,
    number,
    numeric_columns,
    per_column,
    ref,
    share,
    string_columns,
    value_counts,
)
from tablewright.functions.gram import correlation, covariance, gram
from tablewright.functions.text import blank_to_null, guarded_double
from tablewright.operators.validate import digest
from tablewright.session import stored

DOMINANT_SHARE = 0.40
STRONG, MODERATE = 0.7, 0.4


def frequency_table(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent values per column with their share of all rows.

    Texts are counted by digest; only those that can be shown are looked up.
    """
    texts = [c for c in columns if c in set(string_columns(df))]
    keyed = df.select(*[(digest(ref(c)) if c in texts else ref(c).cast("string")).alias(c) for c in columns])
    counts = value_counts(keyed, columns)
    # values as frequent as the k-th one are still among them
    frequent = counts.withColumn("place", F.rank().over(Window.partitionBy("column").orderBy(F.col("n").desc())))
    lead = stored(frequent.where(F.col("place") <= k).drop("place"), "frequent-values")
    if texts:
        spelled = long_values(df, texts).select(F.col("column").alias("c"), digest(F.col("value")).alias("d"), F.col("value").alias("text"))
        shown = lead.select("column", "value").join(spelled, (F.col("column") == F.col("c")) & (F.col("value") == F.col("d")))
        words = shown.groupBy("c", "d").agg(F.min("text").alias("text"))
        lead = lead.join(words, (F.col("column") == F.col("c")) & (F.col("value") == F.col("d")), "left").select(
            "column", F.coalesce("text", "value").alias("value"), "n"
        )
    best = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc())
    rows = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    top = lead.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    shares = top.withColumn("share", share(F.col("n"), rows))
    return shares.withColumn("dominant", (F.col("rank") == 1) & (F.col("share") > DOMINANT_SHARE))


def missingness_table(df: DataFrame) -> DataFrame:
    stats = per_column(
        df, df.columns, {"nulls": lambda c: count_if(c.isNull()), "rows": lambda c: F.count(F.lit(1))}
    )
    return stats.select("column", "nulls", share(F.col("nulls"), F.col("rows")).alias("null_share"))


def strength(r: Column) -> Column:
    return (
        F.when(F.abs(r) > STRONG, "strong").when(F.abs(r) > MODERATE, "moderate").otherwise("weak")
    )


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, min_rows: int = 5
) -> DataFrame:
    """(a, b, n, r, strength) over the rows where both are known, in one pass."""
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        empty = "a string, b string, n long, r double, strength string"
        return df.sparkSession.createDataFrame([], empty)
    pairs = gram(df, columns).where("a <> b").select("a", "b", "n", correlation().alias("r"))
    known = pairs.where((F.col("n") >= min_rows) & F.col("r").isNotNull() & ~F.isnan("r"))
    return known.withColumn("strength", strength(F.col("r")))


def covariance_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Sample covariances over the rows where every column is known."""
    columns = list(columns or numeric_columns(df))
    if not columns:
        return df.sparkSession.createDataFrame([], "a string, b string, covariance double")
    pairs = gram(df, columns, whole=True)
    return pairs.select("a", "b", F.try_divide(covariance(), F.col("n") - 1).alias("covariance"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of value pairs in long form; pivot ``b`` for a wide table."""
    known = df.where(ref(a).isNotNull() & ref(b).isNotNull())
    return known.groupBy(ref(a).alias(a), ref(b).alias(b)).agg(F.count(F.lit(1)).alias("n"))


def top_bottom_groups(df: DataFrame, dimension: str, measure: str, k: int = 3) -> DataFrame:
    """The ``k`` highest and ``k`` lowest group means."""
    means = (
        df.where(ref(dimension).isNotNull())
        .groupBy(ref(dimension).cast("string").alias("value"))
        .agg(F.avg(ref(measure)).alias("mean"))
        .where(F.col("mean").isNotNull())
    )
    # both ends from one grouping: each group is sent to either side, and each side keeps k
    sides = means.select(
        "value", "mean", F.inline(F.array(
            F.struct(F.lit("top").alias("side"), (-F.col("mean")).alias("_by")),
            F.struct(F.lit("bottom").alias("side"), F.col("mean").alias("_by")),
        ))
    )
    best = Window.partitionBy("side").orderBy("_by", "value")
    return sides.withColumn("_at", F.row_number().over(best)).where(F.col("_at") <= k).select("value", "mean", "side")


def distribution_observations(summary: DataFrame) -> DataFrame:
    """Remarks on rows of ``numeric_summary``: skewed, or more spread than mean."""
    skewed = summary.where(F.abs("skewness") > 1).select(
        "column",
        F.when(F.col("skewness") > 0, "right_skewed").otherwise("left_skewed").alias("observation"),
        F.col("skewness").alias("value"),
    )
    spread = summary.where((F.col("std") > F.col("mean")) & (F.col("mean") > 0)).select(
        "column", F.lit("high_volatility").alias("observation"), F.col("std").alias("value")
    )
    return skewed.unionByName(spread)


PERIOD_LABELS = {
    "year": lambda d: F.date_format(d, "yyyy"),
    "quarter": lambda d: F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")),
    "month": lambda d: F.date_format(d, "yyyy-MM"),
    "week": lambda d: F.concat(
        F.extract(F.lit("YEAROFWEEK"), d).cast("string"),
        F.lit("-W"),
        F.lpad(F.weekofyear(d).cast("string"), 2, "0"),
    ),
    "day": lambda d: F.date_format(d, "yyyy-MM-dd"),
}


def period_start(date: Column, unit: str) -> Column:
    return F.trunc(date, unit) if unit != "day" else date.cast("date")


def period_mean_trend(df: DataFrame, date: str, measure: str, unit: str = "month") -> DataFrame:
    """Mean per period, and the change from the first to the last in per cent."""
    means = (
        df.where(ref(date).isNotNull())
        .groupBy(period_start(ref(date), unit).alias("period"))
        .agg(F.avg(ref(measure)).alias("mean"))
    )
    ends = means.agg(
        F.min_by("mean", "period").alias("first"), F.max_by("mean", "period").alias("last")
    ).select(F.try_divide((F.col("last") - F.col("first")) * 100, F.col("first")).alias("change"))
    return means.withColumn("change_pct", ends.scalar())


def measure_over_time(df: DataFrame, date: str, measure: str, unit: str = "month") -> DataFrame:
    """Sum per calendar bucket; the label is for display, order by ``period``."""
    return (
        df.where(ref(date).isNotNull())
        .groupBy(period_start(ref(date), unit).alias("period"))
        .agg(F.sum(ref(measure)).alias("total"))
        .withColumn("label", PERIOD_LABELS[unit](F.col("period")))
    )


def measure_by_dimension(df: DataFrame, dimension: str, measure: str | None, k: int = 10) -> DataFrame:
    """Top ``k`` values by sum (or by rows without a measure) and their share of the top."""
    amount = F.count(F.lit(1)).cast("double") if measure is None else F.sum(ref(measure))
    groups = df.groupBy(F.coalesce(ref(dimension).cast("string"), F.lit("Unknown")).alias("value"))
    top = groups.agg(amount.alias("total")).orderBy(F.desc("total"), F.asc("value")).limit(k)
    # at most k rows
    whole = F.sum("total").over(Window.partitionBy(F.lit(1)))
    return top.withColumn("share_of_shown", share(F.col("total"), whole))


def _number(df: DataFrame, column: str) -> Column:
    """The column as double; texts lose currency signs, commas and per cent signs."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        value = guarded_double(F.regexp_replace(ref(column), "[$£€¥₹%,]", ""))
    else:
        value = ref(column).cast("double")
    return F.when(~F.isnan(value), value)


def kpi_aggregate(df: DataFrame, catalog: Sequence[dict]) -> DataFrame:
    """KPIs of a catalog whose entries have name, column, aggregation and unit.

    Aggregations: sum, avg, count (filled values), distinct, and rate (share of ones in
    per cent, or the mean). Entries name their column; those the table lacks are left out.
    """
    rows, ids = [F.struct(
        F.lit("Total Records").alias("kpi"),
        F.lit(None).cast("string").alias("column"),
        F.lit("count").alias("aggregation"),
        F.count(F.lit(1)).cast("double").alias("value"),
        F.lit(None).cast("string").alias("unit"),
    )], []
    for entry in catalog:
        column, how = entry["column"], entry["aggregation"]
        if column not in df.columns:
            continue
        if how == "distinct":
            ids.append(entry)
            continue
        x = _number(df, column)
        if how == "count":
            value = F.count(_filled(df, column)).cast("double")
        elif how == "rate":
            flags = F.bool_and(x.isin(0.0, 1.0))
            mean = F.avg(x)
            value = F.when(flags, mean * 100).when(mean.between(0, 1), mean * 100).otherwise(mean)
        else:
            value = {"sum": F.sum(x), "avg": F.avg(x)}[how]
        rows.append(
            F.struct(
                F.lit(entry["name"]).alias("kpi"),
                F.lit(column).alias("column"),
                F.lit(how).alias("aggregation"),
                F.coalesce(value, F.lit(0.0)).alias("value"),
                F.lit(entry.get("unit")).cast("string").alias("unit"),
            )
        )
    out = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    if ids:
        columns = sorted({e["column"] for e in ids})
        # digests stand for texts where only their number counts
        texts = set(string_columns(df))
        filled = df.select(*[(digest(_filled(df, c)) if c in texts else _filled(df, c)).alias(c) for c in columns])
        counts = {
            e["name"]: distinct_counts(filled, [e["column"]]).agg(F.coalesce(F.max("distinct"), F.lit(0)).cast("double")).scalar()
            for e in ids
        }
        extra = [
            F.struct(
                F.lit(e["name"]).alias("kpi"),
                F.lit(e["column"]).alias("column"),
                F.lit("distinct").alias("aggregation"),
                counts[e["name"]].alias("value"),
                F.lit(e.get("unit")).cast("string").alias("unit"),
            )
            for e in ids
        ]
        one = df.sparkSession.range(1)
        out = out.unionByName(one.select(F.array(*extra).alias("rows")).select(F.inline("rows")))
    return out


def _filled(df: DataFrame, column: str) -> Column:
    """The column with blank texts as null."""
    return blank_to_null(ref(column)) if isinstance(df.schema[column].dataType, T.StringType) else ref(column)


# The KPIs of each domain as (label, aggregation); a null is zero in a rate.
DOMAIN_KPIS = {
    "Retail": [("Total Revenue", "sum"), ("Total Orders", "rows")],
    "HR": [("Average Salary", "avg"), ("Total Headcount", "rows")],
    "Healthcare": [("Average Length of Stay", "avg"), ("Patient Volume", "rows")],
    "Manufacturing": [("Defect Rate", "avg_zero")],
}


def domain_kpis(df: DataFrame, domain: str, column: str | None = None) -> DataFrame:
    """(kpi, column, value) of a domain, over the measure the caller names.

    Without a column, or with one the table lacks, only the row counts are given.
    """
    known = column is not None and column in df.columns
    x = ref(column).cast("double") if known else F.lit(None).cast("double")
    rows = []
    for label, how in DOMAIN_KPIS[domain]:
        if how != "rows" and not known:
            continue
        value = {
            "rows": F.count(F.lit(1)).cast("double"),
            "sum": F.sum(x),
            "avg": F.avg(x),
            "avg_zero": F.avg(F.coalesce(x, F.lit(0.0))),
        }[how]
        rows.append(
            F.struct(
                F.lit(label).alias("kpi"),
                F.lit(column if how != "rows" else None).cast("string").alias("column"),
                value.alias("value"),
            )
        )
    if not rows:
        return df.sparkSession.createDataFrame([], "kpi string, column string, value double")
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def basic_kpis(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Records, attributes, completeness, and sum and mean of every measure."""
    cells = F.count(F.lit(1)) * len(df.columns)
    filled = reduce(lambda a, b: a + b, [F.count(ref(c)) for c in df.columns])
    entries = [
        ("records", F.count(F.lit(1)).cast("double")),
        ("attributes", F.lit(float(len(df.columns)))),
        ("completeness_pct", F.coalesce(F.try_divide(filled, cells) * 100, F.lit(100.0))),
    ]
    for m in measures:
        entries += [(f"sum_{m}", F.sum(ref(m)).cast("double")), (f"avg_{m}", F.avg(ref(m)))]
    rows = [F.struct(F.lit(k).alias("kpi"), v.alias("value")) for k, v in entries]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
