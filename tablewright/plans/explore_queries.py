"""Queries for the exploration tables and KPIs, with their SQL."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import functions as F

from tablewright.operators import explore, profile
from tablewright.plans.registry import Registry, derived, derived_sql, rounded, table, union_all
from tablewright.plans.table_queries import MISSINGNESS_SQL

QUERIES = Registry()
GAPPY = derived_sql("gappy_lineitem")


@QUERIES.add(
    "frequency_table",
    "WITH c AS (" + union_all([f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY 2" for c in ("p_brand", "p_type")])
    + "), r AS (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank FROM c)"
    " SELECT \"column\", value, n, CAST(rank AS INT) AS rank, round(n / (SELECT count(*) FROM part), 6) AS share,"
    " rank = 1 AND n / (SELECT count(*) FROM part) > 0.4 AS dominant FROM r WHERE rank <= 10",
)
def frequency_table(spark, folder):
    return rounded(explore.frequency_table(table(spark, folder, "part"), ["p_brand", "p_type"]), ["share"], 6)


@QUERIES.add("missingness_table", MISSINGNESS_SQL)
def missingness_table(spark, folder):
    return rounded(explore.missingness_table(derived(spark, folder, "gappy_lineitem")), ["null_share"], 6)


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORRELATION = union_all(
    [
        f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, corr({a}, {b}) AS r FROM {GAPPY}"
        for a, b in combinations(MEASURES, 2)
    ]
)


@QUERIES.add(
    "correlation_matrix",
    "SELECT a, b, n, round(r, 6) AS r, CASE WHEN abs(r) > 0.7 THEN 'strong' WHEN abs(r) > 0.4 THEN 'moderate' ELSE 'weak' END"
    f" AS strength FROM ({CORRELATION}) WHERE n >= 5 AND r IS NOT NULL",
)
def correlation_matrix(spark, folder):
    return rounded(explore.correlation_matrix(derived(spark, folder, "gappy_lineitem"), MEASURES), ["r"], 6)


@QUERIES.add(
    "covariance_matrix",
    union_all(
        [
            f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 4) AS covariance FROM {GAPPY} WHERE "
            + " AND ".join(f"{c} IS NOT NULL" for c in MEASURES)
            for a, b in combinations_with_replacement(MEASURES, 2)
        ]
    ),
)
def covariance_matrix(spark, folder):
    return rounded(explore.covariance_matrix(derived(spark, folder, "gappy_lineitem"), MEASURES), ["covariance"])


@QUERIES.add(
    "crosstab",
    f"SELECT l_returnflag, l_linestatus, count(*) AS n FROM {GAPPY} WHERE l_returnflag IS NOT NULL GROUP BY ALL",
)
def crosstab(spark, folder):
    return explore.crosstab(derived(spark, folder, "gappy_lineitem"), "l_returnflag", "l_linestatus")


@QUERIES.add(
    "top_bottom_groups",
    "WITH m AS (SELECT CAST(l_suppkey AS VARCHAR) AS value, avg(l_quantity) AS mean FROM lineitem GROUP BY 1)"
    " (SELECT value, round(mean, 6) AS mean, 'top' AS side FROM m ORDER BY m.mean DESC, value LIMIT 3) UNION ALL"
    " (SELECT value, round(mean, 6), 'bottom' FROM m ORDER BY m.mean, value LIMIT 3)",
)
def top_bottom_groups(spark, folder):
    return rounded(explore.top_bottom_groups(table(spark, folder, "lineitem"), "l_suppkey", "l_quantity"), ["mean"], 6)


SKEWED = "(SELECT l_quantity, l_quantity * l_quantity * l_quantity * l_quantity AS fourth, 60 - l_quantity * l_quantity / 41 AS low FROM lineitem)"


@QUERIES.add(
    "distribution_observations",
    union_all(
        [
            f"SELECT '{c}' AS \"column\", CASE WHEN skewness({c}) > 0 THEN 'right_skewed' ELSE 'left_skewed' END AS observation,"
            f" round(skewness({c}), 4) AS value FROM {SKEWED} HAVING abs(skewness({c})) > 1 UNION ALL"
            f" SELECT '{c}', 'high_volatility', round(stddev_samp({c}), 4) FROM {SKEWED} HAVING stddev_samp({c}) > avg({c}) AND avg({c}) > 0"
            for c in ("l_quantity", "fourth", "low")
        ]
    ),
)
def distribution_observations(spark, folder):
    rows = table(spark, folder, "lineitem").selectExpr(
        "l_quantity", "l_quantity * l_quantity * l_quantity * l_quantity AS fourth", "60 - l_quantity * l_quantity / 41 AS low"
    )
    return rounded(explore.distribution_observations(profile.numeric_summary(rows)), ["value"])


@QUERIES.add(
    "period_mean_trend",
    "WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, avg(o_totalprice) AS mean FROM orders GROUP BY 1)"
    " SELECT period, round(mean, 4) AS mean, round((SELECT (arg_max(mean, period) - arg_min(mean, period)) * 100 / arg_min(mean, period) FROM m), 4)"
    " AS change_pct FROM m",
)
def period_mean_trend(spark, folder):
    return rounded(explore.period_mean_trend(table(spark, folder, "orders"), "o_orderdate", "o_totalprice"), ["mean", "change_pct"])


LABELS = {
    "year": "strftime(period, '%Y')",
    "quarter": "year(period) || '-Q' || quarter(period)",
    "month": "strftime(period, '%Y-%m')",
    "week": "strftime(period, '%G-W%V')",
    "day": "strftime(period, '%Y-%m-%d')",
}


@QUERIES.add(
    "measure_over_time",
    union_all(
        [
            f"SELECT '{u}' AS unit, period, round(total, 2) AS total, {label} AS label FROM (SELECT CAST(date_trunc('{u}', ts) AS DATE) AS period,"
            " sum(value) AS total FROM events GROUP BY 1)"
            for u, label in LABELS.items()
        ]
    ),
)
def measure_over_time(spark, folder):
    events = table(spark, folder, "events")
    out = None
    for unit in LABELS:
        part = explore.measure_over_time(events, "ts", "value", unit).withColumn("unit", F.lit(unit))
        out = part if out is None else out.unionByName(part)
    return rounded(out, ["total"], 2)


@QUERIES.add(
    "measure_by_dimension",
    "SELECT value, round(total, 2) AS total, round(total / sum(total) OVER (), 6) AS share_of_shown FROM (SELECT p_brand AS value,"
    " sum(p_retailprice) AS total FROM part GROUP BY 1 ORDER BY total DESC, value LIMIT 10)",
)
def measure_by_dimension(spark, folder):
    found = explore.measure_by_dimension(table(spark, folder, "part"), "p_brand", "p_retailprice")
    return rounded(found, {"total": 2, "share_of_shown": 6})


UNTIDY = derived_sql("untidy_orders")
CATALOG = [
    {"name": "Revenue", "column": "o_totalprice", "aggregation": "sum", "unit": "EUR"},
    {"name": "Average Discount", "column": "discount_text", "aggregation": "avg"},
    {"name": "Notes", "column": "note", "aggregation": "count"},
    {"name": "Customers", "column": "o_custkey", "aggregation": "distinct", "unit": "ids"},
    {"name": "Big Orders", "column": "big", "aggregation": "rate", "unit": "%"},
    {"name": "Absent", "column": "nowhere", "aggregation": "sum"},
]


@QUERIES.add(
    "kpi_aggregate",
    "SELECT kpi, \"column\", aggregation, round(value, 2) AS value, unit FROM ("
    f"SELECT 'Total Records' AS kpi, NULL AS \"column\", 'count' AS aggregation, count(*)::DOUBLE AS value, NULL AS unit FROM orders UNION ALL"
    " SELECT 'Revenue', 'o_totalprice', 'sum', sum(o_totalprice), 'EUR' FROM orders UNION ALL"
    f" SELECT 'Average Discount', 'discount_text', 'avg', avg(TRY_CAST(replace(discount_text, '%', '') AS DOUBLE)), NULL FROM {UNTIDY} UNION ALL"
    f" SELECT 'Notes', 'note', 'count', count(*) FILTER (trim(note) <> ''), NULL FROM {UNTIDY} UNION ALL"
    " SELECT 'Customers', 'o_custkey', 'distinct', count(DISTINCT o_custkey), 'ids' FROM orders UNION ALL"
    " SELECT 'Big Orders', 'big', 'rate', avg(CAST(o_totalprice > 100000 AS INT)) * 100, '%' FROM orders)",
)
def kpi_aggregate(spark, folder):
    rows = derived(spark, folder, "untidy_orders").withColumn("big", (F.col("o_totalprice") > 100_000).cast("int"))
    return rounded(explore.kpi_aggregate(rows, CATALOG), ["value"], 2)


@QUERIES.add(
    "domain_kpis",
    "SELECT 'Total Revenue' AS kpi, 'o_totalprice' AS \"column\", round(sum(o_totalprice), 2) AS value FROM orders UNION ALL"
    " SELECT 'Total Orders', NULL, count(*) FROM orders UNION ALL"
    " SELECT 'Average Salary', 'c_acctbal', round(avg(c_acctbal), 2) FROM customer UNION ALL"
    " SELECT 'Total Headcount', NULL, count(*) FROM customer UNION ALL"
    f" SELECT 'Defect Rate', 'l_tax', round(avg(coalesce(l_tax, 0)), 2) FROM {GAPPY}",
)
def domain_kpis(spark, folder):
    parts = [
        explore.domain_kpis(table(spark, folder, "orders"), "Retail", "o_totalprice"),
        explore.domain_kpis(table(spark, folder, "customer"), "HR", "c_acctbal"),
        explore.domain_kpis(derived(spark, folder, "gappy_lineitem"), "Manufacturing", "l_tax"),
    ]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["value"], 2)


@QUERIES.add(
    "basic_kpis",
    "SELECT kpi, round(value, 2) AS value FROM ("
    + union_all(
        [
            "SELECT 'records' AS kpi, count(*)::DOUBLE AS value FROM lineitem",
            "SELECT 'attributes', 11",
            "SELECT 'completeness_pct', 100 * (" + " + ".join(f"count({c})" for c in [
                "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *MEASURES, "l_returnflag", "l_linestatus", "l_shipdate"
            ]) + f") / (11 * count(*)) FROM {GAPPY}",
            *[f"SELECT 'sum_{c}', sum({c}) FROM {GAPPY} UNION ALL SELECT 'avg_{c}', avg({c}) FROM {GAPPY}" for c in [*MEASURES, "l_linenumber"]],
        ]
    )
    + ")",
)
def basic_kpis(spark, folder):
    rows = derived(spark, folder, "gappy_lineitem")
    return rounded(explore.basic_kpis(rows, [*MEASURES, "l_linenumber"]), ["value"], 2)
