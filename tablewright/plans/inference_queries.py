"""Queries for tests with p-values, collinearity and forecasts, with their SQL.

The SQL integrates densities by Simpson's rule where a p-value is wanted.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import forecast, inference, series
from tablewright.plans.registry import Registry, derived, derived_sql, rounded, table, union_all

QUERIES = Registry()
GAPPY = derived_sql("gappy_lineitem")
MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]
STEPS = 4000


def integral(density: str, upto: str) -> str:
    """Integral from 0 to ``upto`` of a density of x; joins range(0, STEPS + 1) r(i), grouped by the row."""
    x = f"({upto}) * i / {STEPS}"
    weight = f"CASE WHEN i IN (0, {STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"sum({weight} * {density.replace('$x', x)}) * any_value({upto}) / {3 * STEPS}"


T_DENSITY = "exp(lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5 * ln(pi() * v) - (v + 1) / 2 * ln(1 + ($x) * ($x) / v))"
NORMAL_DENSITY = "exp(-($x) * ($x) / 2) / sqrt(2 * pi())"
RANGE = f"range(0, {STEPS + 1}) r(i)"

R = {(a, b): f"corr({a}, {b})" for a in MEASURES for b in MEASURES}


def vif_sql(c: str) -> str:
    a, b = (x for x in MEASURES if x != c)
    ya, yb, ab = R[c, a], R[c, b], R[a, b]
    share = f"({ya} ** 2 + {yb} ** 2 - 2 * {ya} * {yb} * {ab}) / (1 - {ab} ** 2)"
    known = " AND ".join(f"{x} IS NOT NULL" for x in MEASURES)
    return f"SELECT '{c}' AS \"column\", round(1 / (1 - {share}), 4) AS vif FROM {GAPPY} WHERE {known}"


@QUERIES.add("vif", union_all([vif_sql(c) for c in MEASURES]))
def vif(spark, folder):
    return rounded(inference.vif(derived(spark, folder, "gappy_lineitem"), MEASURES), ["vif"])


PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_discount", "l_tax")]


def spearman_sql(a: str, b: str) -> str:
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    return (
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, corr(ra, rb) AS r FROM (SELECT {rank.format(a)} AS ra, {rank.format(b)} AS rb"
        f" FROM {GAPPY} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    )


@QUERIES.add(
    "correlation_test",
    f"WITH f AS ({union_all([spearman_sql(a, b) for a, b in PAIRS])}), t AS (SELECT *, least(abs(r) * sqrt((n - 2) / (1 - r * r)), 60) AS t, (n - 2)::DOUBLE AS v FROM f),"
    f" p AS (SELECT a, b, n, r, greatest(1 - 2 * {integral(T_DENSITY, 't')}, 0) AS p FROM t, {RANGE} GROUP BY a, b, n, r, t, v)"
    " SELECT a, b, 'spearman' AS method, n, round(r, 6) AS r, abs(round(p, 6)) AS p, p < 0.05 AS significant,"
    " CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength FROM p",
)
def correlation_test(spark, folder):
    """No column is normal, so ranks are compared."""
    return rounded(inference.correlation_test(derived(spark, folder, "gappy_lineitem"), PAIRS), ["r", "p"], 6)


def moments_sql(c: str, source: str, group: str = "") -> str:
    """n, population skewness and excess kurtosis."""
    return (
        f"SELECT count(*)::DOUBLE AS n, avg(d ** 3) / avg(d ** 2) ** 1.5 AS g1, avg(d ** 4) / avg(d ** 2) ** 2 - 3 AS g2{', ' + group if group else ''}"
        f" FROM (SELECT {c} - avg({c}) OVER ({'PARTITION BY ' + group if group else ''}) AS d{', ' + group if group else ''} FROM {source} WHERE {c} IS NOT NULL)"
        f"{' GROUP BY ' + group if group else ''}"
    )


def k2_sql(moments: str, keep: str) -> str:
    """D'Agostino's and Pearson's statistic in steps."""
    return (
        f"SELECT *, exp(-k2 / 2) AS p FROM (SELECT *, (asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2))) ** 2"
        " + ((1 - 2 / (9 * a) - sign(u) * cbrt((1 - 2 / a) / abs(u))) / sqrt(2 / (9 * a))) ** 2 AS k2"
        f" FROM (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 1 + x * sqrt(2 / (a - 4)) AS u FROM"
        " (SELECT *, 6 + 8 / s * (2 / s + sqrt(1 + 4 / (s * s))) AS a FROM"
        " (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y,"
        " 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS b2,"
        " (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,"
        " 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS s"
        f" FROM ({moments})))))"
    )


BELL = "(SELECT c_acctbal, (c_custkey * 7919 % 1009 + c_custkey * 104729 % 1013 + c_custkey * 1299709 % 1019 + c_custkey * 15485863 % 1021) AS bell FROM customer)"


@QUERIES.add(
    "normality",
    union_all(
        [
            f"SELECT '{c}' AS \"column\", CAST(n AS BIGINT) AS n, round(g1, 6) AS skewness, round(g2, 6) AS kurtosis, round(k2, 4) AS k2, round(p, 6) AS p, p > 0.05 AS normal,"
            f" round(sqrt(g1 * g1 + g2 * g2 / 4), 6) AS deviation, abs(g1) < 0.5 AND abs(g2) < 1 AS near_normal FROM ({k2_sql(moments_sql(c, BELL), '')})"
            for c in ("c_acctbal", "bell")
        ]
    ),
)
def normality(spark, folder):
    """A flat column, and a sum of four that is nearly normal."""
    bell = " + ".join(f"c_custkey * {m} % {d}" for m, d in ((7919, 1009), (104729, 1013), (1299709, 1019), (15485863, 1021)))
    rows = table(spark, folder, "customer").selectExpr("c_acctbal", f"{bell} AS bell")
    found = inference.normality(rows, ["c_acctbal", "bell"])
    return rounded(found, {"skewness": 6, "kurtosis": 6, "k2": 4, "p": 6, "deviation": 6})


def ks_sql(c: str) -> str:
    cdf = f"0.5 + sign(z) * {integral(NORMAL_DENSITY, 'abs(z)')}"
    return (
        f"SELECT '{c}' AS \"column\", max(total) AS n, max(greatest(law - before / total, (before + n) / total - law)) AS d FROM (SELECT n, before, total, {cdf} AS law FROM"
        f" (SELECT ({c} - m) / (s + 1e-9) AS z, count(*) AS n, sum(count(*)) OVER (ORDER BY {c}) - count(*) AS before, sum(count(*)) OVER () AS total"
        f" FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem) GROUP BY {c}, m, s), {RANGE} GROUP BY z, n, before, total)"
    )


@QUERIES.add(
    "normality_ks",
    f"SELECT \"column\", CAST(n AS BIGINT) AS n, round(d, 6) AS d, round(2 * sum((CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * (k * (sqrt(n) * d + 1 / (6 * sqrt(n)) + (sqrt(n) * d - 1) / (4 * n))) ** 2)), 6) AS p,"
    f" false AS normal FROM ({union_all([ks_sql(c) for c in ('l_quantity', 'l_discount')])}), range(1, 60) k(k) GROUP BY ALL",
)
def normality_ks(spark, folder):
    return rounded(inference.normality_ks(table(spark, folder, "lineitem"), ["l_quantity", "l_discount"]), ["d", "p"], 6)


@QUERIES.add(
    "mann_whitney_u",
    "WITH x AS (SELECT c_mktsegment AS g, round(c_acctbal / 100) AS v FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),"
    " r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM x),"
    " s AS (SELECT count(*) FILTER (g = 'BUILDING')::DOUBLE AS a, count(*)::DOUBLE AS n, sum(rk) FILTER (g = 'BUILDING') AS ra FROM r),"
    " t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM x GROUP BY v)),"
    " u AS (SELECT ra - a * (a + 1) / 2 AS u, a, n - a AS b, n, ties FROM s, t),"
    " z AS (SELECT u, a, b, (greatest(u, a * b - u) - a * b / 2 - 0.5) / sqrt(a * b / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)"
    f" SELECT u, round(z, 6) AS z, round(least(1, 1 - 2 * {integral(NORMAL_DENSITY, 'z')}), 6) AS p, CAST(a AS BIGINT) AS n_a, CAST(b AS BIGINT) AS n_b FROM z, {RANGE} GROUP BY u, z, a, b",
)
def mann_whitney_u(spark, folder):
    rows = table(spark, folder, "customer").selectExpr("c_mktsegment", "round(c_acctbal / 100) AS balance")
    return rounded(inference.mann_whitney_u(rows, "c_mktsegment", "BUILDING", "MACHINERY", "balance"), ["z", "p"], 6)


@QUERIES.add(
    "choose_group_test",
    f"WITH k AS ({k2_sql(moments_sql('l_quantity', 'lineitem', 'l_returnflag'), '')}) SELECT count(*) AS groups, count(*) FILTER (n >= 8 AND p > 0.05) AS normal_groups,"
    " CASE WHEN count(*) < 2 THEN 'none' WHEN count(*) = 2 THEN CASE WHEN bool_and(n >= 8 AND p > 0.05) THEN 't_test' ELSE 'mann_whitney' END"
    " WHEN bool_and(n >= 8 AND p > 0.05) THEN 'anova' ELSE 'kruskal' END AS method FROM k WHERE n >= 3",
)
def choose_group_test(spark, folder):
    return inference.choose_group_test(table(spark, folder, "lineitem"), "l_returnflag", "l_quantity")


@QUERIES.add(
    "compare_groups",
    "WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rk FROM lineitem),"
    " t AS (SELECT sum(c * c * c - c) AS ties, sum(c) AS n FROM (SELECT count(*)::DOUBLE AS c FROM lineitem GROUP BY l_quantity)),"
    " s AS (SELECT sum(rs * rs / k) AS s, count(*) AS groups FROM (SELECT sum(rk) AS rs, count(*) AS k FROM r GROUP BY g)),"
    " h AS (SELECT (12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM s, t)"
    " SELECT 'kruskal' AS method, round(h, 5) AS statistic, round(exp(-h / 2), 6) AS p, exp(-h / 2) < 0.05 AS significant FROM h",
)
def compare_groups(spark, folder):
    """Three groups that are not normal; the law has two degrees of freedom."""
    found = inference.compare_groups(table(spark, folder, "lineitem"), "l_returnflag", "l_quantity")
    return rounded(found, {"statistic": 5, "p": 6})


DAILY = (
    "(SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS period, sum(value) AS total, avg(value) AS mean FROM events GROUP BY 1, 2)"
)
SHIFTED = (
    "(SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY period) - 1 AS x,"
    f" mean + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END * (row_number() OVER (PARTITION BY event_type ORDER BY period)) AS y FROM {DAILY})"
)


def daily(spark, folder):
    return series.period_buckets(table(spark, folder, "events"), "ts", "value", "day", ["event_type"])


@QUERIES.add(
    "linear_trend_test",
    f"WITH f AS (SELECT event_type, count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(x, y) AS r FROM {SHIFTED} GROUP BY 1),"
    " t AS (SELECT *, least(abs(r) * sqrt((n - 2) / (1 - r * r)), 60) AS t, (n - 2)::DOUBLE AS v FROM f),"
    f" p AS (SELECT event_type, n, slope, intercept, r, greatest(1 - 2 * {integral(T_DENSITY, 't')}, 0) AS p FROM t, {RANGE} GROUP BY event_type, n, slope, intercept, r, t, v)"
    " SELECT event_type, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r * r, 6) AS r2, abs(round(p, 6)) AS p,"
    " CASE WHEN p >= 0.05 THEN 'stable' WHEN slope > 0.001 THEN 'growth' WHEN slope < -0.001 THEN 'decline' ELSE 'plateau' END AS direction FROM p",
)
def linear_trend_test(spark, folder):
    place = F.expr("row_number() OVER (PARTITION BY event_type ORDER BY period)")
    rows = daily(spark, folder).withColumn("mean", F.col("mean") + F.when(F.col("event_type") == "click", place).otherwise(0))
    found = inference.linear_trend_test(rows, ["event_type"])
    return rounded(found, ["slope", "intercept", "r2", "p"], 6)


MONTHLY = (
    "SELECT o_orderpriority AS k, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS y,"
    " row_number() OVER (PARTITION BY o_orderpriority ORDER BY date_trunc('month', o_orderdate)) AS i FROM orders GROUP BY 1, 2, date_trunc('month', o_orderdate)"
)
SMOOTHED = (
    f"m AS ({MONTHLY}), ends AS (SELECT k, count(*) AS n, max(period) AS last FROM m GROUP BY k),"
    " es AS (SELECT k, i, y AS level FROM m WHERE i = 1 UNION ALL SELECT m.k, m.i, 0.3 * m.y + 0.7 * es.level FROM es JOIN m ON m.k = es.k AND m.i = es.i + 1)"
)
# one-step forecasts of value i + 1 from the first i ones
PAST = (
    "past AS (SELECT k, i, avg(y) OVER w3 AS ma,"
    " CASE i WHEN 1 THEN y WHEN 2 THEN 0.5 * y + 0.3 * l1 + 0.2 * (y + l1) / 2 ELSE 0.5 * y + 0.3 * l1 + 0.2 * l2 END AS wma,"
    " CASE WHEN i = 1 THEN y ELSE regr_intercept(y, i) OVER wa + regr_slope(y, i) OVER wa * (i + 1) END AS lr"
    " FROM (SELECT *, lag(y, 1) OVER w AS l1, lag(y, 2) OVER w AS l2 FROM m WINDOW w AS (PARTITION BY k ORDER BY i))"
    " WINDOW w3 AS (PARTITION BY k ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), wa AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING))"
)
BEST_SQL = f"""
WITH RECURSIVE {SMOOTHED}, {PAST},
long AS (
  SELECT p.k, p.i, 0 AS turn, 'moving_average' AS method, ma AS f FROM past p UNION ALL
  SELECT k, i, 1, 'weighted_moving_average', wma FROM past UNION ALL
  SELECT k, i, 2, 'exponential_smoothing', level FROM es UNION ALL
  SELECT k, i, 3, 'linear_regression', lr FROM past),
errors AS (
  SELECT l.k, turn, method, l.i + 1 AS i, n, m.y - f AS rest, abs((m.y - f) / CASE WHEN m.y = 0 THEN 1 ELSE m.y END) AS off
  FROM long l JOIN m ON m.k = l.k AND m.i = l.i + 1 JOIN ends e ON e.k = l.k),
scores AS (
  SELECT k, turn, method, avg(off) FILTER (i > n - greatest(1, least(3, floor(n * 0.3)))) AS mape, stddev_pop(rest) AS spread FROM errors GROUP BY k, turn, method),
best AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY mape, turn) AS r FROM scores),
tail AS (
  SELECT e.k, n, last, max(y) FILTER (i = n) AS a, max(y) FILTER (i = n - 1) AS b, max(y) FILTER (i = n - 2) AS c, regr_slope(y, i) AS slope, regr_intercept(y, i) AS start
  FROM m JOIN ends e ON e.k = m.k GROUP BY e.k, n, last),
ahead AS (
  SELECT k, 1 AS step, (a + b + c) / 3 AS ma, a AS ma1, b AS ma2, 0.5 * a + 0.3 * b + 0.2 * c AS wma, a AS w1, b AS w2 FROM tail UNION ALL
  SELECT k, step + 1, (ma + ma1 + ma2) / 3, ma, ma1, 0.5 * wma + 0.3 * w1 + 0.2 * w2, wma, w1 FROM ahead WHERE step < 4),
chosen AS (
  SELECT a.k, step, method, mape, spread, CAST(last + to_months(CAST(step AS INT)) AS DATE) AS period,
    CASE method WHEN 'moving_average' THEN ma WHEN 'weighted_moving_average' THEN wma WHEN 'exponential_smoothing' THEN (SELECT max(level) FROM es WHERE es.k = a.k AND es.i = t.n)
      ELSE start + slope * (n + step) END AS x
  FROM ahead a JOIN best b ON a.k = b.k AND r = 1 JOIN tail t ON t.k = a.k)
SELECT k AS o_orderpriority, CAST(step AS INT) AS step, period, method, round(mape, 6) AS mape, round(greatest(0.4, least(0.95, 1 - mape)), 6) AS confidence,
  round(greatest(0, x), 3) AS predicted, round(greatest(0, x - 1.96 * spread * sqrt(step)), 3) AS lower, round(x + 1.96 * spread * sqrt(step), 3) AS upper FROM chosen
"""


def monthly(spark, folder):
    return series.period_buckets(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "month", ["o_orderpriority"])


@QUERIES.add("forecast_best_of_four", BEST_SQL)
def forecast_best_of_four(spark, folder):
    found = forecast.forecast_best_of_four(monthly(spark, folder), 4, "month", ["o_orderpriority"])
    return rounded(found, {"mape": 6, "confidence": 6, "predicted": 3, "lower": 3, "upper": 3})


HOLT_SQL = f"""
WITH RECURSIVE {SMOOTHED},
holt AS (
  SELECT m.k, m.i, m.y AS level, m2.y - m.y AS trend FROM m JOIN m m2 ON m2.k = m.k AND m2.i = 2 WHERE m.i = 1 UNION ALL
  SELECT m.k, m.i, 0.4 * m.y + 0.6 * (h.level + h.trend), 0.2 * (0.4 * m.y + 0.6 * (h.level + h.trend) - h.level) + 0.8 * h.trend
  FROM holt h JOIN m ON m.k = h.k AND m.i = h.i + 1),
stats AS (SELECT e.k, n, last, stddev_pop(y) AS spread, avg(y) FILTER (i > n - least(6, n // 2)) AS mean FROM m JOIN ends e ON e.k = m.k GROUP BY e.k, n, last),
long AS (
  SELECT s.k, step, last, 'holt' AS method, level + step * trend AS x, spread * sqrt(step) AS w FROM stats s JOIN holt h ON h.k = s.k AND h.i = s.n, range(1, 4) t(step) UNION ALL
  SELECT s.k, step, last, 'moving_average', mean, spread FROM stats s, range(1, 4) t(step) UNION ALL
  SELECT s.k, step, last, 'smoothing', level, spread * sqrt(step) FROM stats s JOIN es ON es.k = s.k AND es.i = s.n, range(1, 4) t(step))
SELECT k AS o_orderpriority, CAST(step AS INT) AS step, CAST(last + to_months(CAST(step AS INT)) AS DATE) AS period, method, round(x, 3) AS predicted,
  round(x - 1.96 * w, 3) AS lower, round(x + 1.96 * w, 3) AS upper FROM long
"""


@QUERIES.add("forecast_holt", HOLT_SQL)
def forecast_holt(spark, folder):
    found = forecast.forecast_holt(monthly(spark, folder), 3, "month", ["o_orderpriority"])
    return rounded(found, ["predicted", "lower", "upper"], 3)
