"""Forecasts of any number of series, by recursions over each key's ordered values.

A series is one row with an array of its values; its length is bounded by the calendar.
The recursions are folds of that array inside Spark's expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import ref
from tablewright.operators.series import future_periods

# Weights of the last three periods, smoothing of level and trend, limits.
WEIGHTS = (0.5, 0.3, 0.2)
ALPHA, HOLT_ALPHA, HOLT_BETA = 0.3, 0.4, 0.2
HELD_SHARE, HELD_MOST, LEAST_PERIODS = 0.3, 3, 4
BAND = 1.96
METHODS = ("moving_average", "weighted_moving_average", "exponential_smoothing", "linear_regression")


def _series(buckets: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., v, n): the values of each key in the order of their periods."""
    pairs = F.array_sort(F.collect_list(F.struct(ref("period").alias("p"), ref(value).cast("double").alias("x"))))
    rows = buckets.where(ref(value).isNotNull() & ref("period").isNotNull()).groupBy(*[ref(k) for k in keys])
    return rows.agg(F.transform(pairs, lambda s: s["x"]).alias("v")).where("size(v) > 0").withColumn("n", F.size("v"))


def _levels(alpha: float) -> str:
    """The smoothed level after each value."""
    step = f"(levels, x) -> concat(levels, array({alpha}D * x + {1 - alpha}D * element_at(levels, -1)))"
    return f"aggregate(slice(v, 2, n), cast(array(v[0]) as array<double>), {step})"


def _running(values: str) -> str:
    """Sums up to each place of an array."""
    step = "(sums, x) -> concat(sums, array(element_at(sums, -1) + x))"
    return f"aggregate(slice({values}, 2, n), cast(array({values}[0]) as array<double>), {step})"


def _line(count: str, at: str) -> str:
    """Least squares over the first ``count`` values, at place ``at``; flat with one value."""
    sx, sxx = f"({count} * ({count} - 1D) / 2)", f"({count} * ({count} - 1D) * (2 * {count} - 1) / 6)"
    s, p = f"sums[{count} - 1]", f"products[{count} - 1]"
    slope = f"if({count} < 2, 0D, ({count} * {p} - {sx} * {s}) / ({count} * {sxx} - {sx} * {sx}))"
    return f"({s} - {slope} * {sx}) / {count} + {slope} * {at}"


def _deviation(values: str) -> str:
    """Population standard deviation of an array."""
    mean = f"(aggregate({values}, 0D, (a, x) -> a + x) / size({values}))"
    return f"sqrt(aggregate({values}, 0D, (a, x) -> a + (x - {mean}) * (x - {mean})) / size({values}))"


_A, _B, _C = (f"{w}D" for w in WEIGHTS)
# the value after the first i ones, by each method
NEXT = {
    "moving_average": "aggregate(slice(v, greatest(1, i - 2), least(3, i)), 0D, (a, x) -> a + x) / least(3, i)",
    "weighted_moving_average": "CASE WHEN i = 1 THEN v[0]"
    f" WHEN i = 2 THEN {_A} * v[1] + {_B} * v[0] + {_C} * (v[0] + v[1]) / 2"
    f" ELSE {_A} * v[i - 1] + {_B} * v[i - 2] + {_C} * v[i - 3] END",
    "exponential_smoothing": "levels[i - 1]",
    "linear_regression": _line("i", "i"),
}


def _ahead(steps: int) -> dict[str, str]:
    """The next values, by each method; the averages take in their own forecasts."""
    last = "slice(v, n - 2, 3)"
    turn = f"sequence(1, {steps})"
    mean = "(element_at(acc, -1) + element_at(acc, -2) + element_at(acc, -3)) / 3"
    weighted = f"{_A} * element_at(acc, -1) + {_B} * element_at(acc, -2) + {_C} * element_at(acc, -3)"
    fold = f"slice(aggregate({turn}, {last}, (acc, i) -> concat(acc, array(%s))), 4, {steps})"
    return {
        "moving_average": fold % mean,
        "weighted_moving_average": fold % weighted,
        "exponential_smoothing": f"array_repeat(levels[n - 1], {steps})",
        "linear_regression": f"transform({turn}, i -> {_line('n', '(n + i - 1)')})",
    }


def forecast_best_of_four(
    buckets: DataFrame, steps: int = 4, unit: str = "month", keys: Sequence[str] = (), value: str = "total"
) -> DataFrame:
    """(keys..., step, period, method, mape, confidence, predicted, lower, upper).

    The last periods, three at most, are each forecast from those before them; the method
    with the smallest mean error in proportion wins, the first of METHODS among equals.
    The band is 1.96 deviations of its one-step errors, wider with the root of the step.
    Forecasts are not below zero. A series of fewer than four periods has its mean, 30 %
    up and down.
    """
    groups = [ref(k) for k in keys]
    all_ = _series(buckets, keys, value)
    fit = all_.where(F.col("n") >= LEAST_PERIODS).selectExpr("*", f"{_levels(ALPHA)} AS levels", f"{_running('v')} AS sums")
    fit = fit.selectExpr("*", "transform(v, (x, i) -> x * i) AS placed").selectExpr("*", f"{_running('placed')} AS products")
    fit = fit.withColumn("held", F.expr(f"greatest(1, least({HELD_MOST}, cast(floor(n * {HELD_SHARE}D) as int)))"))
    tried = fit.selectExpr("*", *[f"transform(sequence(1, n - 1), i -> {e}) AS past{k}" for k, e in enumerate(NEXT.values())])
    error = "aggregate(sequence(n - held, n - 1), 0D, (a, i) -> a + abs((v[i] - past{0}[i - 1]) / if(v[i] = 0, 1D, v[i]))) / held"
    ahead = _ahead(steps)
    choices = [
        f"named_struct('mape', {error.format(k)}, 'turn', {k}, 'method', '{m}',"
        f" 'rest', transform(past{k}, (x, i) -> v[i + 1] - x), 'ahead', {ahead[m]})"
        for k, m in enumerate(METHODS)
    ]
    chosen = tried.withColumn("best", F.expr(f"array_min(array({', '.join(choices)}))"))
    chosen = chosen.withColumn("spread", F.expr(_deviation("best.rest")))
    margin = F.lit(BAND) * F.col("spread") * F.sqrt("step")
    good = chosen.select(*groups, "best", "spread", F.posexplode("best.ahead").alias("i", "x")).withColumn("step", F.col("i") + 1)
    good = good.select(
        *groups,
        "step",
        F.col("best.method").alias("method"),
        F.col("best.mape").alias("mape"),
        F.greatest(F.lit(0.4), F.least(F.lit(0.95), 1 - F.col("best.mape"))).alias("confidence"),
        F.greatest(F.lit(0.0), F.col("x")).alias("predicted"),
        F.greatest(F.lit(0.0), F.col("x") - margin).alias("lower"),
        (F.col("x") + margin).alias("upper"),
    )
    mean = F.expr("aggregate(v, 0D, (a, x) -> a + x) / n")
    short = all_.where(F.col("n") < LEAST_PERIODS).withColumn("x", mean).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    short = short.select(
        *groups, "step", F.lit(METHODS[0]).alias("method"), F.lit(0.3).alias("mape"), F.lit(0.5).alias("confidence"),
        F.col("x").alias("predicted"), (F.col("x") * 0.7).alias("lower"), (F.col("x") * 1.3).alias("upper"),
    )
    return _dated(good.unionByName(short), buckets, unit, steps, keys)


def _dated(rows: DataFrame, buckets: DataFrame, unit: str, steps: int, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the period of each step; there are ``steps`` rows per key."""
    dates = future_periods(buckets.where(ref("period").isNotNull()), unit, steps, keys)
    dates = dates.select(*[ref(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("step").alias("_step"), "period")
    match = F.col("step") == F.col("_step")
    for i, k in enumerate(keys):
        match = match & ref(k).eqNullSafe(ref(f"_k{i}"))
    own = [ref(c) for c in rows.columns if c not in (*keys, "step")]
    return rows.join(dates, match).select(*[ref(k) for k in keys], "step", "period", *own)


def forecast_holt(
    buckets: DataFrame, steps: int = 3, unit: str = "month", keys: Sequence[str] = (), value: str = "total"
) -> DataFrame:
    """(keys..., step, period, method, predicted, lower, upper) by holt, moving_average and smoothing.

    Holt's line has a level (0.4) and a trend (0.2). The moving mean is of the last six
    values, half the series at most, and its band stays; the others' widen with the root of
    the step. Bands are 1.96 deviations of the values, or a tenth of a single one.
    """
    groups = [ref(k) for k in keys]
    start = "named_struct('level', v[0], 'trend', if(n > 1, v[1] - v[0], 0D))"
    level = f"({HOLT_ALPHA}D * x + {1 - HOLT_ALPHA}D * (s.level + s.trend))"
    step = f"named_struct('level', {level}, 'trend', {HOLT_BETA}D * ({level} - s.level) + {1 - HOLT_BETA}D * s.trend)"
    found = _series(buckets, keys, value).selectExpr(
        "*",
        f"aggregate(slice(v, 2, n), cast({start} as struct<level: double, trend: double>), (s, x) -> {step}) AS holt",
        f"element_at({_levels(ALPHA)}, -1) AS smooth",
        "greatest(1, least(6, n div 2)) AS width",
        f"if(n > 1, {_deviation('v')}, null) AS spread",
    )
    found = found.withColumn("mean", F.expr("aggregate(slice(v, cast(n - width + 1 as int), cast(width as int)), 0D, (a, x) -> a + x) / width"))
    rows = found.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))

    def band(method: str, at: str, base: str, widens: bool):
        return F.expr(
            f"named_struct('method', '{method}', 'predicted', {at}, 'margin',"
            f" {BAND}D * coalesce(spread, 0.1D * abs({base})) * {'sqrt(step)' if widens else '1D'})"
        )

    bands = F.array(
        band("holt", "holt.level + step * holt.trend", "holt.level", True),
        band("moving_average", "mean", "mean", False),
        band("smoothing", "smooth", "smooth", True),
    )
    long = rows.select(*groups, "step", F.inline(bands))
    out = long.select(
        *groups, "step", "method", "predicted", (F.col("predicted") - F.col("margin")).alias("lower"), (F.col("predicted") + F.col("margin")).alias("upper")
    )
    return _dated(out, buckets, unit, steps, keys)
