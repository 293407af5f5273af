"""Tests with p-values: correlation, normality, groups, trend; collinearity.

Statistics come from sums, value counts and ranks of distinct values, so no row is ranked
or sorted. p-values are functions of a handful of result rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import distributions as dist
from tablewright.functions.columns import number, ref, with_scalar
from tablewright.functions.gram import correlation, gram, inflation
from tablewright.functions.ordered import average_ranks, cumulative_counts
from tablewright.operators.explore import strength
from tablewright.operators.segments import anova_f, group_moments, kruskal_h, welch_t
from tablewright.operators.series import numbered

# Limits that decide results.
ALPHA = 0.05
LEAST_FOR_NORMALITY = 8
VIF_CAP = 999.0
SKEW_LIMIT, KURTOSIS_LIMIT = 0.5, 1.0
SLOPE_LIMIT = 0.001


def vif(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, vif): 1 / (1 - R^2) of each column on the others, over rows where all are known.

    999 at most; 1 with fewer than two columns or five complete rows. A column without
    spread has 1 and takes no part in the others' fits.
    """
    columns = list(columns)
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    if len(columns) < 2:
        return names.withColumn("vif", F.lit(1.0))
    pairs = gram(df, columns, whole=True).where("a <> b AND n >= 5")
    known = pairs.select("a", "b", correlation().alias("r")).where("r IS NOT NULL AND NOT isnan(r)")
    found = inflation(known, VIF_CAP).withColumnRenamed("column", "c")
    return names.join(F.broadcast(found), F.col("column") == F.col("c"), "left").select(
        "column", F.coalesce("vif", F.lit(1.0)).alias("vif")
    )


def k_squared(n: Column, skewness: Column, kurtosis: Column) -> Column:
    """D'Agostino's and Pearson's statistic from population skewness and excess kurtosis; n >= 8."""
    n = n.cast("double")
    y = skewness * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    z_skew = F.asinh(y / F.sqrt(2 / (w2 - 1))) / F.sqrt(0.5 * F.log(w2))
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurtosis + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(spread)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    low = 1 + x * F.sqrt(2 / (a - 4))
    z_kurtosis = (1 - 2 / (9 * a) - F.signum(low) * F.cbrt((1 - 2 / a) / F.abs(low))) / F.sqrt(2 / (9 * a))
    return z_skew * z_skew + z_kurtosis * z_kurtosis


def _judged_normal(moments: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``moments``: keep..., n, skewness, kurtosis; both are null or NaN without spread."""
    fit = (F.col("n") >= LEAST_FOR_NORMALITY) & F.col("skewness").isNotNull() & ~F.isnan("skewness")
    k2 = F.when(fit, k_squared(F.col("n"), F.col("skewness"), F.col("kurtosis")))
    near = (F.abs("skewness") < SKEW_LIMIT) & (F.abs("kurtosis") < KURTOSIS_LIMIT)
    deviation = F.sqrt(F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4)
    known = moments.withColumns({"k2": k2, "deviation": F.when(fit, deviation), "near_normal": fit & near})
    known = known.withColumn("p", F.exp(-F.col("k2") / 2))
    normal = F.coalesce(F.col("p") > ALPHA, F.lit(False))
    return known.select(*keep, "n", "skewness", "kurtosis", "k2", "p", normal.alias("normal"), "deviation", "near_normal")


def normality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, skewness, kurtosis, k2, p, normal, deviation, near_normal).

    ``normal``: p of the K-squared test is above 0.05; never below eight values or without
    spread. ``near_normal`` is the rule of thumb on skewness and excess kurtosis, and
    ``deviation`` its statistic.
    """
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(number(c)).alias("n"),
            F.skewness(number(c)).alias("skewness"),
            F.kurtosis(number(c)).alias("kurtosis"),
        )
        for c in columns
    ]
    return _judged_normal(df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")), ["column"])


def normality_ks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, d, p, normal): Kolmogorov's test of the standardised column against the normal law.

    The gap is taken below and at every distinct value. Columns need three values and a
    spread; the law of the gap is the one for many values.
    """
    rows = [
        F.struct(F.lit(c).alias("c"), F.avg(number(c)).alias("mean"), F.stddev_samp(number(c)).alias("std")) for c in columns
    ]
    stats = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).where("std > 0")
    runs = cumulative_counts(df, list(columns)).join(F.broadcast(stats), F.col("column") == F.col("c"))
    law = dist.normal_cdf((F.col("value") - F.col("mean")) / (F.col("std") + F.lit(1e-9)))
    placed = runs.withColumn("law", law)
    under = F.col("law") - F.col("before") / F.col("total")
    over = (F.col("before") + F.col("n")) / F.col("total") - F.col("law")
    gaps = placed.groupBy("column").agg(F.max("total").alias("n"), F.max(F.greatest(under, over)).alias("d")).where("n >= 3")
    found = gaps.withColumn("p", dist.kolmogorov_p("d", F.col("n").cast("double")))
    return found.withColumn("normal", F.col("p") > ALPHA)


def _pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(pair, x, y): a row per pair of columns and row where both are known."""
    rows = [F.struct(F.lit(k).alias("pair"), number(a).alias("x"), number(b).alias("y")) for k, (a, b) in enumerate(pairs)]
    return df.select(F.inline(F.array(*rows))).where("x IS NOT NULL AND y IS NOT NULL")


def coefficient(x: Column, y: Column) -> Column:
    """Pearson's coefficient of a group, null without spread; a perfect one is 1 or -1 exactly."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.abs(r) >= 1 - 1e-14, F.signum(r)).otherwise(r)


def _pearson(long: DataFrame) -> DataFrame:
    return long.groupBy("pair").agg(coefficient(F.col("x"), F.col("y")).alias("pearson"))


def _spearman(long: DataFrame) -> DataFrame:
    """(pair, spearman): ranks belong to distinct values and meet the counted value pairs."""
    ranks = average_ranks(long, ["x", "y"], keep=["pair"])
    x = ranks.where("column = 'x'").select(F.col("pair").alias("px"), F.col("value").alias("vx"), F.col("rank").alias("rx"), "total")
    y = ranks.where("column = 'y'").select(F.col("pair").alias("py"), F.col("value").alias("vy"), F.col("rank").alias("ry"))
    counts = long.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("m"))
    met = counts.join(x, (F.col("pair") == F.col("px")) & (F.col("x") == F.col("vx"))).join(
        y, (F.col("pair") == F.col("py")) & (F.col("y") == F.col("vy"))
    )
    middle = (F.col("total") + 1) / F.lit(2.0)
    off = met.select("pair", "m", (F.col("rx") - middle).alias("u"), (F.col("ry") - middle).alias("v"))
    sums = off.groupBy("pair").agg(
        *[F.sum(F.col("m") * F.col(a) * F.col(b)).alias(name) for a, b, name in (("u", "v", "uv"), ("u", "u", "uu"), ("v", "v", "vv"))]
    )
    return sums.select("pair", F.try_divide(F.col("uv"), F.sqrt(F.col("uu") * F.col("vv"))).alias("spearman"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a coefficient over n rows; a perfect one has 0."""
    perfect = F.abs(r) >= 1 - 1e-15
    t = r * F.sqrt((n - 2) / (1 - r * r))
    return F.when(perfect, F.lit(0.0)).otherwise(dist.t_p(F.when(~perfect, t), (n - 2).cast("double")))


def correlation_test(df: DataFrame, pairs: Sequence[tuple[str, str]], method: str | None = None) -> DataFrame:
    """(a, b, method, n, r, p, significant, strength) of column pairs, over rows where both are known.

    Without a ``method``, pearson where both columns are normal and spearman elsewhere. With
    fewer than three rows or no spread r is 0 and p is 1.
    """
    pairs = list(pairs)
    spark = df.sparkSession
    long = _pairs(df, pairs)
    names = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    stats = long.groupBy("pair").agg(
        F.count(F.lit(1)).alias("n"), ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("varies")
    )
    known = names.join(stats, "pair", "left")
    if method is None:
        columns = sorted({c for p in pairs for c in p})
        normal = normality(df, columns).select("column", "normal")
        for side in "ab":
            own = F.broadcast(normal.select(F.col("column").alias(f"c{side}"), F.col("normal").alias(f"normal_{side}")))
            known = known.join(own, F.col(side) == F.col(f"c{side}"))
        known = known.withColumn("method", F.when(F.col("normal_a") & F.col("normal_b"), "pearson").otherwise("spearman"))
    else:
        known = known.withColumn("method", F.lit(method))
    known = known.join(_pearson(long), "pair", "left").join(_spearman(long), "pair", "left")
    fit = F.coalesce((F.col("n") >= 3) & F.col("varies"), F.lit(False))
    r = F.when(F.col("method") == "pearson", F.col("pearson")).otherwise(F.col("spearman"))
    found = known.select("a", "b", "method", F.coalesce("n", F.lit(0)).alias("n"), F.when(fit, r).otherwise(F.lit(0.0)).alias("r"), fit.alias("fit"))
    p = F.when(F.col("fit"), correlation_p(F.when(F.col("fit"), F.col("r")), F.col("n"))).otherwise(F.lit(1.0))
    judged = found.withColumn("p", p)
    return judged.select("a", "b", "method", "n", "r", "p", (F.col("p") < ALPHA).alias("significant"), strength(F.col("r")).alias("strength"))


def mann_whitney_u(df: DataFrame, group: str, a: str, b: str, measure: str) -> DataFrame:
    """(u, z, p, n_a, n_b) of two groups, two-sided, corrected for ties and continuity; no row if one is empty.

    ``u`` belongs to ``a``. The normal law is used at every size.
    """
    own = ref(group).cast("string")
    two = df.where(own.isin(a, b) & number(measure).isNotNull()).select(own.alias("g"), number(measure).alias("v"))
    ranks = average_ranks(two, ["v"]).select(F.col("value").alias("rv"), "n", "rank", "total")
    counts = two.groupBy("v").agg(F.count_if(F.col("g") == a).alias("m"))
    met = counts.join(ranks, F.col("v") == F.col("rv"))
    sums = met.agg(
        F.sum("m").cast("double").alias("n1"),
        F.max("total").cast("double").alias("n"),
        F.sum(F.col("m") * F.col("rank")).alias("r1"),
        F.sum(F.col("n").cast("double") ** 3 - F.col("n")).alias("ties"),
    )
    n1, n = F.col("n1"), F.col("n")
    n2 = n - n1
    fit = sums.where((n1 > 0) & (n2 > 0))
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1))))
    z = F.coalesce(F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, spread), F.lit(0.0))
    found = fit.select(u.alias("u"), z.alias("z"), n1.cast("long").alias("n_a"), n2.cast("long").alias("n_b"))
    return found.select("u", "z", F.when(F.col("z") <= 0, 1.0).otherwise(dist.normal_p("z")).alias("p"), "n_a", "n_b")


def choose_group_test(df: DataFrame, group: str, measure: str) -> DataFrame:
    """(groups, normal_groups, method) over groups of three values or more.

    t_test or mann_whitney for two groups, anova or kruskal for more: the first if every
    group has eight values and passes the K-squared test. none with fewer than two groups.
    """
    x = number(measure)
    moments = (
        df.where(ref(group).isNotNull())
        .groupBy(ref(group).cast("string").alias("group"))
        .agg(F.count(x).alias("n"), F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"))
        .where("n >= 3")
    )
    counts = _judged_normal(moments, ["group"]).agg(
        F.count(F.lit(1)).alias("groups"), F.count_if(F.col("normal")).alias("normal_groups")
    )
    normal = F.col("normal_groups") == F.col("groups")
    method = (
        F.when(F.col("groups") < 2, "none")
        .when(F.col("groups") == 2, F.when(normal, "t_test").otherwise("mann_whitney"))
        .otherwise(F.when(normal, "anova").otherwise("kruskal"))
    )
    return counts.withColumn("method", method)


def compare_groups(df: DataFrame, group: str, measure: str, method: str | None = None) -> DataFrame:
    """(method, statistic, p, significant): the chosen test of all groups of three values or more.

    Of two groups the first by name is compared with the second.
    """
    spark = df.sparkSession
    method = method or choose_group_test(df, group, measure).first()["method"]
    sized = group_moments(df, group, measure).select(F.col("group").alias("_group"))
    if method == "none":
        return spark.createDataFrame([], "method string, statistic double, p double, significant boolean")
    fit = df.join(sized, ref(group).cast("string") == F.col("_group"), "left_semi")
    if method in ("t_test", "mann_whitney"):
        a, b = (r["_group"] for r in sized.orderBy("_group").limit(2).collect())
        if method == "t_test":
            found = welch_t(fit, group, a, b, measure).select(F.col("t").alias("statistic"), dist.t_p("t", "df").alias("p"))
        else:
            found = mann_whitney_u(fit, group, a, b, measure).select(F.col("u").alias("statistic"), "p")
    elif method == "anova":
        f = anova_f(fit, group, measure)
        found = f.select(F.col("f").alias("statistic"), dist.f_p("f", F.col("df_between").cast("double"), F.col("df_within").cast("double")).alias("p"))
    else:
        h = kruskal_h(fit, group, measure)
        found = h.select(F.col("h").alias("statistic"), dist.chi2_p("h", F.col("df").cast("double")).alias("p"))
    return found.select(F.lit(method).alias("method"), "statistic", "p", (F.col("p") < ALPHA).alias("significant"))


def linear_trend_test(buckets: DataFrame, keys: Sequence[str] = (), value: str = "mean", least: int = 10) -> DataFrame:
    """(keys..., n, slope, intercept, r2, p, direction) of each series against the place of its periods.

    growth, decline or plateau where the slope is significant, by its sign beyond 0.001;
    else stable. Series of fewer than ``least`` periods are stable without a slope.
    """
    groups = [ref(k) for k in keys]
    x, y = F.col("_at") - 1, F.col(value)
    placed = numbered(buckets.where(y.isNotNull()), keys, "_at")
    fits = placed.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        coefficient(x, y).alias("r"),
        (F.min(y) < F.max(y)).alias("varies"),
    )
    fit = F.col("n") >= least
    known = fits.where("n > 0").select(
        *groups, "n", *[F.when(fit, F.col(c)).alias(c) for c in ("slope", "intercept")],
        F.when(fit, F.when(F.col("varies"), F.col("r")).otherwise(0.0)).alias("r"),
    )
    judged = known.withColumn("p", correlation_p(F.col("r"), F.col("n")))
    kind = (
        F.when(~F.coalesce(F.col("p") < ALPHA, F.lit(False)), "stable")
        .when(F.col("slope") > SLOPE_LIMIT, "growth")
        .when(F.col("slope") < -SLOPE_LIMIT, "decline")
        .otherwise("plateau")
    )
    return judged.select(*groups, "n", "slope", "intercept", (F.col("r") ** 2).alias("r2"), "p", kind.alias("direction"))
