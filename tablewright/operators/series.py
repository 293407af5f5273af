"""Time series by period, any number of them: keyed, one row per key and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import ref
from tablewright.operators.explore import period_start

GAP_DAYS = {"day": 1, "week": 7, "month": 30, "quarter": 90, "year": 365}


def period_buckets(df: DataFrame, date: str, measure: str, unit: str = "month", keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., period, total, mean, n): undated rows and rows without a number are left out."""
    x = ref(measure).cast("double")
    fit = df.where(ref(date).isNotNull() & x.isNotNull() & ~F.isnan(x))
    return fit.groupBy(*[ref(k) for k in keys], period_start(ref(date), unit).alias("period")).agg(
        F.sum(x).alias("total"), F.avg(x).alias("mean"), F.count(F.lit(1)).alias("n")
    )


def _by(keys: Sequence[str]):
    # the periods of one series are bounded by the calendar
    return Window.partitionBy(*[ref(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))


def period_growth(buckets: DataFrame, keys: Sequence[str] = (), value: str = "total") -> DataFrame:
    """``growth_pct`` on the period before; null for the first and after a zero."""
    before = F.lag(value).over(_by(keys).orderBy("period"))
    return buckets.withColumn("growth_pct", F.when(before != 0, (F.col(value) - before) / F.abs(before) * 100))


def moving_average_centered(buckets: DataFrame, keys: Sequence[str] = (), value: str = "total") -> DataFrame:
    """``moving_average`` of three periods, two at the ends; null for a series of one."""
    near = _by(keys).orderBy("period").rowsBetween(-1, 1)
    return buckets.withColumn("moving_average", F.when(F.count(value).over(near) >= 2, F.avg(value).over(near)))


def period_anomalies(buckets: DataFrame, keys: Sequence[str] = (), value: str = "total", limit: float = 2.0) -> DataFrame:
    """Periods whose population z exceeds the limit: kind spike or drop, HIGH beyond 3."""
    all_ = _by(keys)
    z = (F.col(value) - F.avg(value).over(all_)) / F.nullif(F.stddev_pop(value).over(all_), F.lit(0.0))
    far = buckets.withColumn("z", z).where(F.abs("z") > limit)
    return far.withColumn("kind", F.when(F.col("z") > 0, "spike").otherwise("drop")).withColumn(
        "severity", F.when(F.abs("z") > 3, "HIGH").otherwise("MEDIUM")
    )


def numbered(buckets: DataFrame, keys: Sequence[str], name: str = "at") -> DataFrame:
    return buckets.withColumn(name, F.row_number().over(_by(keys).orderBy("period")).cast("double"))


def trend_class(buckets: DataFrame, keys: Sequence[str] = (), value: str = "total") -> DataFrame:
    """(keys..., periods, slope, growth_pct, peak, trough, trend) per series.

    volatile over a variation of 0.5; growing or declining when the slope exceeds 2 % of
    the mean; else flat.
    """
    found = numbered(buckets, keys).groupBy(*[ref(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("periods"),
        F.regr_slope(F.col(value), F.col("at")).alias("slope"),
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.min_by(value, "period").alias("first"),
        F.max_by(value, "period").alias("last"),
        F.max_by("period", F.struct(F.col(value), -F.col("at"))).alias("peak"),
        F.min_by("period", F.struct(F.col(value), F.col("at"))).alias("trough"),
    )
    scale = F.abs("mean")
    trend = (
        F.when(F.col("std") / F.nullif(scale, F.lit(0.0)) > 0.5, "volatile")
        .when(F.col("slope") > 0.02 * scale, "growing")
        .when(F.col("slope") < -0.02 * scale, "declining")
        .otherwise("flat")
    )
    growth = F.when(F.col("first") != 0, (F.col("last") - F.col("first")) / F.abs("first") * 100)
    return found.select(*[ref(k) for k in keys], "periods", "slope", growth.alias("growth_pct"), "peak", "trough", trend.alias("trend"))


def change_point(buckets: DataFrame, keys: Sequence[str] = (), value: str = "mean") -> DataFrame:
    """(keys..., period, before, after): the middle, if the halves' means differ by over half a deviation."""
    count = F.count(F.lit(1)).over(_by(keys))
    halves = numbered(buckets, keys).withColumn("half", F.floor(count / 2))
    found = halves.groupBy(*[ref(k) for k in keys]).agg(
        F.avg(F.when(F.col("at") <= F.col("half"), F.col(value))).alias("before"),
        F.avg(F.when(F.col("at") > F.col("half"), F.col(value))).alias("after"),
        F.stddev_pop(value).alias("std"),
        F.min(F.when(F.col("at") > F.col("half"), F.col("period"))).alias("period"),
    )
    return found.where(F.abs(F.col("after") - F.col("before")) > 0.5 * F.col("std")).select(
        *[ref(k) for k in keys], "period", "before", "after"
    )


def seasonality_acf(
    buckets: DataFrame, keys: Sequence[str] = (), value: str = "mean", lags: Sequence[int] = (7, 12, 30), least: int = 14
) -> DataFrame:
    """(keys..., lag, acf): the lag of the strongest autocorrelation above 0.35, per series of ``least`` periods."""
    order = _by(keys).orderBy("period")
    shifted = buckets.select("*", *[F.lag(value, k).over(order).alias(f"_lag{k}") for k in lags])
    found = shifted.groupBy(*[ref(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"), *[F.corr(F.col(value), F.col(f"_lag{k}")).alias(f"_r{k}") for k in lags]
    )
    rows = F.array(
        *[F.struct(F.lit(k).alias("lag"), F.when(F.col("n") > 2 * k, F.col(f"_r{k}")).alias("acf")) for k in lags]
    )
    long = found.where(F.col("n") >= least).select(*[ref(k) for k in keys], F.inline(rows)).where("acf > 0.35")
    best = long.groupBy(*[ref(k) for k in keys]).agg(F.max_by(F.struct("lag", "acf"), F.struct("acf", -F.col("lag"))).alias("b"))
    return best.select(*[ref(k) for k in keys], "b.lag", "b.acf")


def seasonality_index(buckets: DataFrame, part: Column, keys: Sequence[str] = (), value: str = "total") -> DataFrame:
    """(keys..., part, index, peak): mean by calendar part over the mean of all; peak above 1.3."""
    groups = [ref(k) for k in keys]
    parts = buckets.groupBy(*groups, part.alias("part")).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    all_ = _by(keys)
    mean = F.sum("s").over(all_) / F.sum("n").over(all_)
    index = F.col("m") / F.nullif(mean, F.lit(0.0))
    return parts.select(*groups, "part", index.alias("index")).withColumn("peak", F.col("index") > 1.3)


def time_gaps(buckets: DataFrame, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., after, before, days): successive periods further apart than 1.5 units."""
    order = _by(keys).orderBy("period")
    steps = buckets.select(*[ref(k) for k in keys], F.lag("period").over(order).alias("after"), F.col("period").alias("before"))
    days = F.datediff("before", "after")
    return steps.withColumn("days", days).where(F.col("days") > 1.5 * GAP_DAYS[unit])


def future_periods(buckets: DataFrame, unit: str, steps: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., step, period): the periods that follow the last one."""
    last = buckets.groupBy(*[ref(k) for k in keys]).agg(F.max("period").alias("last"))
    ahead = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    months = {"month": 1, "quarter": 3, "year": 12}
    if unit in months:
        period = F.add_months("last", F.col("step") * months[unit])
    else:
        period = F.date_add("last", (F.col("step") * GAP_DAYS[unit]).cast("int"))
    return ahead.select(*[ref(k) for k in keys], "step", period.alias("period"))


def linear_forecast(buckets: DataFrame, steps: int, keys: Sequence[str] = (), value: str = "total") -> DataFrame:
    """(keys..., step, linear, moving, weighted): the fitted line, the mean of the last three and 0.5/0.3/0.2 of them.

    Values below zero are zero; a series needs four periods.
    """
    groups = [ref(k) for k in keys]
    back = Window.partitionBy(*groups).orderBy(F.col("period").desc()) if keys else Window.partitionBy(F.lit(0)).orderBy(F.col("period").desc())
    placed = numbered(buckets, keys).withColumn("back", F.row_number().over(back))
    weights = F.when(F.col("back") == 1, 0.5).when(F.col("back") == 2, 0.3).when(F.col("back") == 3, 0.2)
    fitted = placed.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(F.col(value), F.col("at")).alias("slope"),
        F.regr_intercept(F.col(value), F.col("at")).alias("start"),
        F.avg(F.when(F.col("back") <= 3, F.col(value))).alias("moving"),
        F.sum(weights * F.col(value)).alias("weighted"),
    )
    ahead = fitted.where("n >= 4").withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    line = F.col("start") + F.col("slope") * (F.col("n") + F.col("step"))
    return ahead.select(*groups, "step", *[F.greatest(F.lit(0.0), x).alias(n) for x, n in ((line, "linear"), (F.col("moving"), "moving"), (F.col("weighted"), "weighted"))])
