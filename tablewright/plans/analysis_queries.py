"""Queries for profiles, keys, quality, series and segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions.text import FALSE_TOKENS, TRUE_TOKENS
from tablewright.operators import keys, profile, quality, segments, series, validate
from tablewright.plans.registry import Registry, derived, derived_sql, rounded, table, union_all

QUERIES = Registry()
GAPPY = derived_sql("gappy_lineitem")
MESSY = derived_sql("messy_lineitem")
UNTIDY = derived_sql("untidy_orders")
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def lineitem(spark, folder, *columns):
    df = table(spark, folder, "lineitem")
    return df.select(*columns) if columns else df


@QUERIES.add(
    "numeric_summary",
    union_all(
        [
            f"SELECT '{c}' AS \"column\", count({c}) AS n, min({c}) AS min, max({c}) AS max, round(avg({c}), 4) AS mean,"
            f" round(median({c}), 4) AS median, round(var_samp({c}), 4) AS variance, round(stddev_samp({c}), 4) AS std,"
            f" round(skewness({c}), 4) AS skewness, round(kurtosis({c}), 4) AS kurtosis FROM {GAPPY}"
            for c in ("l_quantity", "l_discount", "l_tax")
        ]
    ),
)
def numeric_summary(spark, folder):
    found = profile.numeric_summary(derived(spark, folder, "gappy_lineitem"), ["l_quantity", "l_discount", "l_tax"])
    return rounded(found, ["mean", "median", "variance", "std", "skewness", "kurtosis"])


def extended_sql(c: str, source: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", n, round(mean, 4) AS mean, round(p5, 4) AS p5, round(p50, 4) AS p50, round(p95, 4) AS p95,"
        f" round(std / abs(mean), 6) AS cv, round(mean - 1.96 * std / sqrt(n), 4) AS ci_low,"
        f" (SELECT count(*) FROM {source} WHERE abs({c} - mean) > 2.5 * std) AS far,"
        f" (SELECT count(*) FROM {source} WHERE {c} < p25 - 1.5 * (p75 - p25) OR {c} > p75 + 1.5 * (p75 - p25)) AS outliers,"
        " CASE WHEN abs(skew) < 0.5 AND abs(kurt) < 1 THEN 'normal' WHEN skew > 1 THEN 'right_skewed' WHEN skew < -1 THEN 'left_skewed'"
        " WHEN (p75 - p25) / std < 0.5 THEN 'bimodal' WHEN kurt < -1 THEN 'uniform' ELSE 'unknown' END AS shape FROM ("
        f"SELECT count({c}) AS n, avg({c}) AS mean, stddev_pop({c}) AS std, quantile_cont({c}, 0.05) AS p5, quantile_cont({c}, 0.25) AS p25,"
        f" quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.75) AS p75, quantile_cont({c}, 0.95) AS p95, skewness({c}) AS skew,"
        f" kurtosis_pop({c}) AS kurt FROM {source})"
    )


@QUERIES.add("extended_stats", union_all([extended_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_tax")]))
def extended_stats(spark, folder):
    found = profile.extended_stats(lineitem(spark, folder), ["l_quantity", "l_extendedprice", "l_tax"])
    kept = found.select("column", "n", "mean", "p5", "p50", "p95", "cv", "ci_low", "far", "outliers", "shape")
    return rounded(kept, {"mean": 4, "p5": 4, "p50": 4, "p95": 4, "cv": 6, "ci_low": 4})


@QUERIES.add(
    "distribution_shape",
    "SELECT \"column\", shape FROM ("
    + union_all([extended_sql(c, "(SELECT value, value * value * value AS cubed FROM events)") for c in ("value", "cubed")])
    + ")",
)
def distribution_shape(spark, folder):
    rows = table(spark, folder, "events").selectExpr("value", "value * value * value AS cubed")
    return profile.extended_stats(rows, ["value", "cubed"]).select("column", "shape")


@QUERIES.add(
    "entropy",
    union_all(
        [
            f"SELECT '{c}' AS \"column\", round(-sum(p * log2(p + 1e-12)), 6) AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p"
            f" FROM part GROUP BY {c})"
            for c in ("p_brand", "p_type", "p_size")
        ]
    ),
)
def entropy(spark, folder):
    return rounded(profile.entropy(table(spark, folder, "part"), ["p_brand", "p_type", "p_size"]), ["entropy"], 6)


ORDER_KINDS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


@QUERIES.add(
    "profile_columns",
    "SELECT \"column\", kind, rows, nulls, distinct_, CASE WHEN kind = 'timestamp_ntz' THEN 'datetime' WHEN distinct_ = rows AND kind <> 'double' THEN 'key'"
    " WHEN kind IN ('bigint', 'double') AND NOT (distinct_ / rows < 0.05 AND distinct_ < 15) THEN 'measure' ELSE 'dimension' END AS role FROM ("
    + union_all(
        [
            f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_ FROM orders"
            for c, k in ORDER_KINDS.items()
        ]
    )
    + ")",
)
def profile_columns(spark, folder):
    found = profile.profile_columns(table(spark, folder, "orders"))
    return found.select("column", "kind", "rows", "nulls", F.col("distinct").alias("distinct_"), "role")


def type_sql(c: str, value: str) -> str:
    dates = " OR ".join(f"try_strptime(v, '{f}') IS NOT NULL" for f in ("%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%Y-%m-%d"))
    tokens = ", ".join(f"'{t}'" for t in (*TRUE_TOKENS, *FALSE_TOKENS))
    return (
        f"SELECT '{c}' AS \"column\", CASE WHEN count(*) FILTER (regexp_matches(lower(trim(v)), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')) > 0.7 * count(*) THEN 'email'"
        " WHEN count(*) FILTER (regexp_matches(trim(v), '^https?://\\S+$')) > 0.7 * count(*) THEN 'url'"
        f" WHEN count(*) FILTER (lower(trim(v)) IN ({tokens})) > 0.7 * count(*) THEN 'boolean' WHEN count(*) FILTER ({dates}) > 0.7 * count(*) THEN 'date'"
        " WHEN count(TRY_CAST(v AS DOUBLE)) > 0.85 * count(*) THEN 'number' WHEN count(*) > 1 AND count(DISTINCT v) = count(*) THEN 'id' ELSE 'categorical' END AS type"
        f" FROM (SELECT {value} AS v FROM {UNTIDY}) WHERE trim(v) <> ''"
    )


@QUERIES.add(
    "infer_technical_type",
    union_all(
        [
            type_sql("is_active", "CASE WHEN o_orderkey % 8 = 6 THEN 'yes' ELSE is_active END"),
            type_sql("order_date", "CASE WHEN order_date = 'invalid' THEN '2024-01-05' ELSE order_date END"),
            type_sql("email", "email"),
            type_sql("o_orderstatus", "o_orderstatus"),
            type_sql("o_key", "CAST(o_orderkey AS VARCHAR)"),
        ]
    ),
)
def infer_technical_type(spark, folder):
    rows = derived(spark, folder, "untidy_orders").selectExpr(
        "CASE WHEN o_orderkey % 8 = 6 THEN 'yes' ELSE is_active END AS is_active",
        "CASE WHEN order_date = 'invalid' THEN '2024-01-05' ELSE order_date END AS order_date",
        "email", "o_orderstatus", "CAST(o_orderkey AS STRING) AS o_key",
    )
    return profile.infer_technical_type(rows)


@QUERIES.add(
    "column_quality",
    "SELECT \"column\", round(1 - gaps, 6) AS completeness, round(far / present, 6) AS outlier_share, broken AS violations,"
    " round(greatest(0, least(100, 100 - 40 * gaps - 30 * far / present - 10 * broken)), 4) AS score FROM ("
    + union_all(
        [
            f"SELECT '{c}' AS \"column\", (count(*) - count({c})) / count(*) AS gaps, count({c}) AS present,"
            f" count(*) FILTER ({c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) AS far, {broken} AS broken"
            f" FROM {GAPPY}, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM {GAPPY})"
            for c, broken in (("l_quantity", "count(*) FILTER (l_quantity > 49)"), ("l_extendedprice", "0"), ("l_tax", "0"))
        ]
    )
    + ")",
)
def column_quality(spark, folder):
    rows = derived(spark, folder, "gappy_lineitem").select("l_quantity", "l_extendedprice", "l_tax")
    broken = quality.rule_violations(rows, {"l_quantity": "l_quantity <= 49"})
    found = profile.column_quality(
        profile.profile_columns(rows),
        quality.outlier_bounds(rows, rows.columns),
        broken.select(F.col("rule").alias("column"), F.col("broken").alias("n")),
    )
    kept = found.select("column", "completeness", "outlier_share", "violations", "score")
    return rounded(kept, {"completeness": 6, "outlier_share": 6, "score": 4})


@QUERIES.add(
    "time_profile",
    "WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), g AS (SELECT day, day - lag(day) OVER (ORDER BY day) AS gap FROM d)"
    " SELECT min(day) AS first, max(day) AS last, CAST(max(day) - min(day) AS INT) AS span_days, count(*) AS periods, median(gap) AS gap_days,"
    " CASE WHEN median(gap) < 2 THEN 'day' WHEN median(gap) < 9 THEN 'week' WHEN median(gap) < 35 THEN 'month' WHEN median(gap) < 100"
    " THEN 'quarter' ELSE 'year' END AS granularity, max(day) - min(day) > 365 AS seasonal FROM g",
)
def time_profile(spark, folder):
    return profile.time_profile(table(spark, folder, "orders"), "o_orderdate")


@QUERIES.add(
    "unique_columns",
    union_all(
        [
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count({c}) AS present, count(DISTINCT {c}) AS distinct_,"
            f" count({c}) = count(DISTINCT {c}) AND count({c}) > 0 AS uniq, count(*) = count(DISTINCT {c}) AND count({c}) > 0 AS candidate_key FROM customer"
            for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
        ]
    ),
)
def unique_columns(spark, folder):
    found = keys.unique_columns(table(spark, folder, "customer"))
    return found.select("column", "rows", "present", F.col("distinct").alias("distinct_"), F.col("unique").alias("uniq"), "candidate_key")


@QUERIES.add(
    "primary_key",
    "SELECT arg_min(c, (p, spot)) AS \"column\" FROM (SELECT *, CASE WHEN c IN ('id', 'key') THEN 0 WHEN regexp_matches(c, '(_id|_key|key)$') THEN 1 ELSE 2 END AS p,"
    " CASE WHEN regexp_matches(c, '(_id|_key|key)$') THEN -i ELSE i END AS spot FROM ("
    + union_all(
        [
            f"SELECT '{c}' AS c, {i} AS i, count(*) = count(DISTINCT {c}) AND count(*) = count({c}) AND count(*) > 0 AS fits FROM orders"
            for i, c in enumerate(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"])
        ]
    )
    + ") WHERE fits) HAVING count(*) > 0",
)
def primary_key(spark, folder):
    return keys.primary_key(table(spark, folder, "orders").drop("o_totalprice"))


PAIRED = "(SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_tax, l_discount, l_shipdate) AS place, l_linestatus FROM lineitem)"


@QUERIES.add(
    "composite_keys",
    "SELECT a, b FROM ("
    + union_all(
        [
            f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, count(DISTINCT ({a}, {b})) AS d FROM {PAIRED}"
            for a, b in (
                ("l_orderkey", "l_partkey"), ("l_orderkey", "place"), ("l_orderkey", "l_linestatus"), ("l_partkey", "place"),
                ("l_partkey", "l_linestatus"), ("place", "l_linestatus"),
            )
        ]
    )
    + ") WHERE n = d",
)
def composite_keys(spark, folder):
    rows = lineitem(spark, folder).selectExpr(
        "l_orderkey", "l_partkey", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity,"
        " l_extendedprice, l_tax, l_discount, l_shipdate) AS place", "l_linestatus",
    )
    return keys.composite_keys(rows, rows.columns)


@QUERIES.add(
    "foreign_key_candidates",
    "SELECT 'o_custkey' AS \"column\", count(*) AS rows, count(*) - count(k) AS nulls, count(*) FILTER (k IS NOT NULL AND k NOT IN"
    " (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 3)) AS orphans FROM (SELECT CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)",
)
def foreign_key_candidates(spark, folder):
    child = table(spark, folder, "orders").selectExpr("CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_custkey END AS o_custkey")
    parent = table(spark, folder, "customer").where("c_custkey % 10 <> 3")
    return keys.foreign_key_candidates(child, "o_custkey", parent, "c_custkey")


GEO = "(SELECT c_custkey, c_nationkey, n_regionkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"
GEO_COLUMNS = ["c_custkey", "c_nationkey", "n_regionkey", "n_name"]
DEPENDENCIES = union_all(
    [
        f"SELECT '{a}' AS determinant, '{b}' AS dependent, (SELECT count(DISTINCT {a}) FROM {GEO}) AS da, (SELECT count(DISTINCT {b}) FROM {GEO}) AS db"
        f" WHERE NOT EXISTS (SELECT 1 FROM {GEO} GROUP BY {a} HAVING count(DISTINCT {b}) > 1)"
        for a in GEO_COLUMNS[1:]
        for b in GEO_COLUMNS
        if a != b
    ]
)


def geography(spark, folder):
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(*GEO_COLUMNS)


@QUERIES.add("functional_dependencies", f"SELECT determinant, dependent FROM ({DEPENDENCIES})")
def functional_dependencies(spark, folder):
    return keys.functional_dependencies(geography(spark, folder), GEO_COLUMNS)


@QUERIES.add("hierarchies", f"SELECT determinant AS child, dependent AS parent FROM ({DEPENDENCIES}) WHERE da > db")
def hierarchies(spark, folder):
    return keys.hierarchies(geography(spark, folder), GEO_COLUMNS)


@QUERIES.add(
    "check_primary_key",
    "SELECT CAST(sum(n) FILTER (k IS NULL) AS BIGINT) AS null_keys, CAST(sum(n - 1) FILTER (k IS NOT NULL) AS BIGINT) AS duplicate_rows FROM"
    " (SELECT k, l_linenumber, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_orderkey END AS k, l_linenumber FROM lineitem) GROUP BY ALL)",
)
def check_primary_key(spark, folder):
    rows = lineitem(spark, folder).selectExpr("CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_orderkey END AS k", "l_linenumber")
    return keys.check_primary_key(rows, ["k", "l_linenumber"])


BROKEN = "SELECT count(*) AS broken, min(d) AS example FROM (SELECT CAST({0} AS VARCHAR) AS d FROM {1} GROUP BY 1 HAVING count(DISTINCT {2}) > 1)"


@QUERIES.add("check_functional_dependency", BROKEN.format("p_brand", "part", "p_type"))
def check_functional_dependency(spark, folder):
    return keys.check_functional_dependency(table(spark, folder, "part"), "p_brand", "p_type")


@QUERIES.add("check_hierarchy", BROKEN.format("child", "(SELECT s_nationkey % 7 AS child, s_nationkey AS parent FROM supplier)", "parent"))
def check_hierarchy(spark, folder):
    rows = table(spark, folder, "supplier").selectExpr("s_nationkey % 7 AS child", "s_nationkey AS parent")
    return keys.check_hierarchy(rows, "child", "parent")


def rule_sql(name: str, condition: str, source: str) -> str:
    return f"SELECT '{name}' AS rule, count({condition}) AS checked, count(*) FILTER (NOT ({condition})) AS broken FROM {source}"


SHIPPED = "(SELECT c_acctbal, l_quantity - 10 AS net, o_orderdate, l_shipdate, l_discount, l_tax FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"
RULES = {
    "rule_non_negative": ("c_acctbal >= 0", quality.non_negative("c_acctbal")),
    "rule_positive_quantity": ("net > 0", quality.positive("net")),
    "rule_chronology": ("o_orderdate <= l_shipdate", quality.in_order("o_orderdate", "l_shipdate")),
    "rule_ratio_bound": ("l_discount <= l_tax", quality.in_order("l_discount", "l_tax")),
}


def shipped(spark, folder):
    return (
        lineitem(spark, folder)
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .withColumn("net", F.col("l_quantity") - 10)
    )


@QUERIES.add("business_rules", union_all([rule_sql(n, sql, SHIPPED) for n, (sql, _) in RULES.items()]))
def business_rules(spark, folder):
    return quality.rule_violations(shipped(spark, folder), {n: rule for n, (_, rule) in RULES.items()})


for _name, (_sql, _rule) in RULES.items():
    QUERIES.add(_name, rule_sql(_name, _sql, SHIPPED))(
        lambda spark, folder, n=_name, r=_rule: quality.rule_violations(shipped(spark, folder), {n: r})
    )


@QUERIES.add(
    "quality_score",
    "WITH f AS (SELECT (count(l_orderkey) + count(l_linenumber) + count(l_quantity) + count(l_returnflag) + count(sparse_discount) + count(currency)"
    f" + count(price) + count(part_code) + count(order_ref)) / (9 * count(*)) AS completeness, 1 - 1.0 * (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {MESSY})))"
    " / count(*) - least(0.4, 0.08 * ("
    + " + ".join(
        f"CAST(count({c}) < {1 - validate.NULL_SHARE} * count(*) AS INT)"
        for c in ("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "sparse_discount", "currency", "price", "part_code", "order_ref")
    )
    + " + CAST(count(*) FILTER (isinf(price)) > 0 AS INT))) AS integrity,"
    " greatest(0, 1 - 0.15 * ("
    + " + ".join(
        f"CAST(count(TRY_CAST({c} AS DOUBLE)) > 0 AND count(TRY_CAST({c} AS DOUBLE)) < count({c}) AS INT)"
        for c in ("l_returnflag", "currency", "part_code", "order_ref")
    )
    + f"))::DOUBLE AS schema, count(*) FILTER (l_quantity > 49) > 0 AS broken FROM {MESSY})"
    " SELECT round(completeness, 6) AS completeness, round(integrity, 6) AS integrity, round(schema, 6) AS schema,"
    " round((completeness + integrity + schema) / 3 * 100, 4) AS score,"
    " round(greatest(40, (completeness + integrity + schema) / 3 * 100 - 4.5 * CAST(broken AS INT)), 4) AS trust FROM f",
)
def quality_score(spark, folder):
    rows = derived(spark, folder, "messy_lineitem")
    broken = quality.rule_violations(rows, {"quantity": "l_quantity <= 49"})
    found = quality.quality_score(rows, validate.validate(rows), broken).drop("level")
    return rounded(found, {"completeness": 6, "integrity": 6, "schema": 6, "score": 4, "trust": 4})


def gap_sql(c: str, others: list[str]) -> str:
    rs = ", ".join(f"abs(corr(CAST({c} IS NULL AS INT), coalesce({o}, m_{o})))" for o in others if o != c)
    medians = ", ".join(f"median({o}) AS m_{o}" for o in others)
    return (
        f"SELECT '{c}' AS \"column\", (count(*) - count({c})) / count(*) AS gaps, coalesce(greatest({rs}), 0) AS strongest FROM {GAPPY},"
        f" (SELECT {medians} FROM {GAPPY})"
    )


@QUERIES.add(
    "missing_mechanism",
    "SELECT \"column\", round(gaps, 6) AS null_share, round(strongest, 4) AS strongest, CASE WHEN gaps = 0 THEN 'none' WHEN gaps > 0.5 THEN 'MNAR'"
    " WHEN strongest > 0.25 THEN 'MAR' ELSE 'MCAR' END AS mechanism FROM (" + union_all([gap_sql(c, MEASURES) for c in MEASURES]) + ")",
)
def missing_mechanism(spark, folder):
    found = quality.missing_mechanism(derived(spark, folder, "gappy_lineitem"), MEASURES)
    return rounded(found, {"null_share": 6, "strongest": 4})


def fence_sql(c: str, width: float, source: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", round(a - {width} * (b - a), 4) AS low, round(b + {width} * (b - a), 4) AS high,"
        f" (SELECT count(*) FROM {source} WHERE {c} < a - {width} * (b - a) OR {c} > b + {width} * (b - a)) AS affected, n FROM"
        f" (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b, count(*) AS n FROM {source})"
    )


@QUERIES.add("outlier_bounds", "SELECT \"column\", low, high, affected FROM (" + union_all([fence_sql(c, 1.5, "lineitem") for c in MEASURES]) + ")")
def outlier_bounds(spark, folder):
    return rounded(quality.outlier_bounds(lineitem(spark, folder), MEASURES), ["low", "high"])


CUBED = "(SELECT value, value * value * value AS cubed FROM events)"


@QUERIES.add(
    "anomaly_iqr3",
    "SELECT \"column\", low, high, affected, CASE WHEN affected > 0.01 * n THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM ("
    + union_all([fence_sql(c, 3.0, CUBED) for c in ("value", "cubed")])
    + ") WHERE affected > 0",
)
def anomaly_iqr3(spark, folder):
    rows = table(spark, folder, "events").selectExpr("value", "value * value * value AS cubed")
    return rounded(quality.anomaly_iqr3(rows, ["value", "cubed"]), ["low", "high"])


@QUERIES.add(
    "anomaly_zscore",
    "SELECT \"column\", n AS present, affected, CASE WHEN affected > 0.03 * n THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM ("
    + union_all(
        [
            f"SELECT '{c}' AS \"column\", count({c}) AS n, count(*) FILTER (abs({c} - m) > 3 * s) AS affected FROM {CUBED},"
            f" (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {CUBED})"
            for c in ("value", "cubed")
        ]
    )
    + ") WHERE affected > 0 AND n >= 10",
)
def anomaly_zscore(spark, folder):
    rows = table(spark, folder, "events").selectExpr("value", "value * value * value AS cubed")
    return quality.anomaly_zscore(rows, ["value", "cubed"])


@QUERIES.add(
    "duplicate_transactions",
    "SELECT count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS surplus, round(sum(n - 1) / (SELECT count(*) FROM orders), 6) AS share,"
    " CASE WHEN sum(n - 1) / (SELECT count(*) FROM orders) > 0.05 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM"
    " (SELECT count(*) AS n FROM orders GROUP BY o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) HAVING count(*) > 1)",
)
def duplicate_transactions(spark, folder):
    rows = table(spark, folder, "orders").withColumn("month", F.trunc("o_orderdate", "month"))
    return rounded(quality.duplicate_transactions(rows, ["o_custkey", "month"]), ["share"], 6)


@QUERIES.add(
    "negative_values",
    "SELECT 'c_acctbal' AS \"column\", count(*) FILTER (c_acctbal < 0) AS affected,"
    " CASE WHEN count(*) FILTER (c_acctbal < 0) > 0.01 * count(*) THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM customer HAVING count(*) FILTER (c_acctbal < 0) > 0",
)
def negative_values(spark, folder):
    return quality.negative_values(table(spark, folder, "customer"), ["c_acctbal", "c_custkey"])


SUMMARY = "SELECT '{0}' AS \"column\", count({0}) AS n, round(avg({0}), 4) AS mean, round(stddev_samp({0}), 4) AS std, min({0})::DOUBLE AS min, max({0})::DOUBLE AS max FROM lineitem"


@QUERIES.add("column_summaries", union_all([SUMMARY.format(c) for c in ("l_quantity", "l_linenumber")]))
def column_summaries(spark, folder):
    return rounded(quality.column_summaries(lineitem(spark, folder), ["l_quantity", "l_linenumber"]), ["mean", "std"])


@QUERIES.add(
    "detect_drift",
    union_all(
        [
            f"SELECT '{c}' AS \"column\", round(bm, 4) AS base_mean, round(m, 4) AS mean, round(greatest(5, 4 * bs / sqrt(n)), 4) AS \"limit\","
            f" n >= 10 AND abs(m - bm) > greatest(5, 4 * bs / sqrt(n)) AS drifted FROM (SELECT avg({c}) AS bm, stddev_samp({c}) AS bs FROM lineitem"
            f" WHERE l_orderkey % 2 = 0), (SELECT avg({c}) + {shift} AS m, count({c}) AS n FROM lineitem WHERE l_orderkey % 2 = 1)"
            for c, shift in (("l_quantity", 7), ("l_extendedprice", 0))
        ]
    ),
)
def detect_drift(spark, folder):
    rows = lineitem(spark, folder)
    base = quality.column_summaries(rows.where("l_orderkey % 2 = 0"), ["l_quantity", "l_extendedprice"])
    batch = rows.where("l_orderkey % 2 = 1").withColumn("l_quantity", F.col("l_quantity") + 7)
    found = quality.detect_drift(batch, base, ["l_quantity", "l_extendedprice"])
    return rounded(found, ["base_mean", "mean", "limit"])


BUCKETS = (
    "(SELECT event_type, CAST(date_trunc('{0}', ts) AS DATE) AS period, sum(value) AS total, avg(value) AS mean, count(*) AS n FROM events GROUP BY 1, 2)"
)
DAILY = BUCKETS.format("day")


def daily(spark, folder):
    return series.period_buckets(table(spark, folder, "events"), "ts", "value", "day", ["event_type"])


@QUERIES.add("period_buckets", f"SELECT event_type, period, round(total, 4) AS total, round(mean, 6) AS mean, n FROM {DAILY}")
def period_buckets(spark, folder):
    return rounded(daily(spark, folder), {"total": 4, "mean": 6})


W = "(PARTITION BY event_type ORDER BY period)"


@QUERIES.add(
    "period_growth",
    f"SELECT event_type, period, round((total - lag(total) OVER {W}) / abs(lag(total) OVER {W}) * 100, 4) AS growth_pct FROM {DAILY}",
)
def period_growth(spark, folder):
    found = series.period_growth(daily(spark, folder), ["event_type"])
    return rounded(found.select("event_type", "period", "growth_pct"), ["growth_pct"])


@QUERIES.add(
    "moving_average_centered",
    f"SELECT event_type, period, round(avg(total) OVER (PARTITION BY event_type ORDER BY period ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS moving_average FROM {DAILY}",
)
def moving_average_centered(spark, folder):
    found = series.moving_average_centered(daily(spark, folder), ["event_type"])
    return rounded(found.select("event_type", "period", "moving_average"), ["moving_average"])


@QUERIES.add(
    "period_anomalies",
    "SELECT event_type, period, round(z, 6) AS z, CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END AS kind, CASE WHEN abs(z) > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM"
    f" (SELECT event_type, period, (total - avg(total) OVER (PARTITION BY event_type)) / stddev_pop(total) OVER (PARTITION BY event_type) AS z FROM {DAILY}) WHERE abs(z) > 1.5",
)
def period_anomalies(spark, folder):
    found = series.period_anomalies(daily(spark, folder), ["event_type"], limit=1.5)
    return rounded(found.select("event_type", "period", "z", "kind", "severity"), ["z"], 6)


NUMBERED = f"(SELECT *, row_number() OVER {W} AS spot FROM {DAILY})"


@QUERIES.add(
    "trend_class",
    "SELECT event_type, count(*) AS periods, round(regr_slope(total, spot), 4) AS slope,"
    " round((arg_max(total, period) - arg_min(total, period)) / abs(arg_min(total, period)) * 100, 4) AS growth_pct,"
    " CASE WHEN stddev_pop(total) / abs(avg(total)) > 0.5 THEN 'volatile' WHEN regr_slope(total, spot) > 0.02 * abs(avg(total)) THEN 'growing'"
    f" WHEN regr_slope(total, spot) < -0.02 * abs(avg(total)) THEN 'declining' ELSE 'flat' END AS trend, arg_max(period, total) AS peak, arg_min(period, total) AS trough FROM {NUMBERED} GROUP BY 1",
)
def trend_class(spark, folder):
    return rounded(series.trend_class(daily(spark, folder), ["event_type"]), ["slope", "growth_pct"])


@QUERIES.add(
    "change_point",
    "SELECT event_type, period, round(before, 4) AS before, round(after, 4) AS after FROM (SELECT event_type, min(period) FILTER (spot > h) AS period,"
    " avg(shifted) FILTER (spot <= h) AS before, avg(shifted) FILTER (spot > h) AS after, stddev_pop(shifted) AS s FROM"
    f" (SELECT *, mean + CASE WHEN event_type = 'click' THEN spot ELSE 0 END AS shifted, count(*) OVER (PARTITION BY event_type) // 2 AS h FROM {NUMBERED}) GROUP BY 1)"
    " WHERE abs(after - before) > 0.5 * s",
)
def change_point(spark, folder):
    place = F.expr("row_number() OVER (PARTITION BY event_type ORDER BY period)")
    rows = daily(spark, folder).withColumn("mean", F.col("mean") + F.when(F.col("event_type") == "click", place).otherwise(0))
    return rounded(series.change_point(rows, ["event_type"]), ["before", "after"])


WAVE = f"(SELECT event_type, period, spot, mean + 50 * sin(2 * pi() * spot / 7) AS v FROM {NUMBERED})"


@QUERIES.add(
    "seasonality_acf",
    "WITH s AS (SELECT event_type, v, " + ", ".join(f"lag(v, {k}) OVER {W} AS l{k}" for k in (7, 12)) + f" FROM {WAVE}), r AS ("
    + union_all([f"SELECT event_type, {k} AS lag, corr(v, l{k}) AS acf, count(*) AS n FROM s GROUP BY 1" for k in (7, 12)])
    + ") SELECT event_type, arg_max(lag, acf) AS lag, round(max(acf), 6) AS acf FROM r WHERE acf > 0.35 AND n >= 14 AND n > 2 * lag GROUP BY 1",
)
def seasonality_acf(spark, folder):
    place = F.expr("row_number() OVER (PARTITION BY event_type ORDER BY period)")
    rows = daily(spark, folder).withColumn("v", F.col("mean") + 50 * F.sin(2 * F.pi() * place / 7))
    return rounded(series.seasonality_acf(rows, ["event_type"], "v", (7, 12)), ["acf"], 6)


MONTHLY = "(SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, sum(o_totalprice) AS total FROM orders GROUP BY 1)"


def monthly(spark, folder):
    return series.period_buckets(table(spark, folder, "orders"), "o_orderdate", "o_totalprice", "month")


@QUERIES.add(
    "seasonality_index",
    f"SELECT CAST(month(period) AS INT) AS part, round(avg(total) / (SELECT avg(total) FROM {MONTHLY}), 6) AS index, avg(total) / (SELECT avg(total) FROM {MONTHLY}) > 1.3 AS peak FROM {MONTHLY} GROUP BY 1",
)
def seasonality_index(spark, folder):
    return rounded(series.seasonality_index(monthly(spark, folder), F.month("period")), ["index"], 6)


@QUERIES.add(
    "time_gaps",
    "SELECT * FROM (SELECT lag(period) OVER (ORDER BY period) AS after, period AS before, CAST(period - lag(period) OVER (ORDER BY period) AS INT) AS days FROM"
    " (SELECT DISTINCT CAST(o_orderdate AS DATE) AS period FROM orders WHERE dayofyear(o_orderdate) % 10 < 7)) WHERE days > 1.5",
)
def time_gaps(spark, folder):
    rows = table(spark, folder, "orders").where("dayofyear(o_orderdate) % 10 < 7")
    return series.time_gaps(series.period_buckets(rows, "o_orderdate", "o_totalprice", "day"), "day")


@QUERIES.add(
    "future_periods",
    f"SELECT CAST(s AS INT) AS step, CAST((SELECT max(period) FROM {MONTHLY}) + to_months(CAST(s AS INT)) AS DATE) AS period FROM range(1, 4) t(s)",
)
def future_periods(spark, folder):
    return series.future_periods(monthly(spark, folder), "month", 3)


@QUERIES.add(
    "linear_forecast",
    "SELECT event_type, CAST(s AS INT) AS step, round(greatest(0, a + b * (n + s)), 4) AS linear, round(m, 4) AS moving, round(w, 4) AS weighted FROM ("
    "SELECT event_type, count(*) AS n, regr_slope(total, spot) AS b, regr_intercept(total, spot) AS a, avg(total) FILTER (back <= 3) AS m,"
    " sum(total * CASE back WHEN 1 THEN 0.5 WHEN 2 THEN 0.3 WHEN 3 THEN 0.2 END) AS w FROM"
    f" (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY period DESC) AS back FROM {NUMBERED}) GROUP BY 1), range(1, 4) t(s)",
)
def linear_forecast(spark, folder):
    return rounded(series.linear_forecast(daily(spark, folder), 3, ["event_type"]), ["linear", "moving", "weighted"])


SEGMENTS = "SELECT '{0}' AS dimension, CAST({0} AS VARCHAR) AS value, count(*) AS n, sum({1}) AS total, avg({1}) AS mean FROM {2} GROUP BY ALL"
PRICED = " UNION ALL ".join(SEGMENTS.format(d, "p_retailprice", "part") for d in ("p_brand", "p_type"))


@QUERIES.add(
    "segment_vs_mean",
    "SELECT dimension, value, n, round(mean, 4) AS mean, round((mean - m) / abs(m), 6) AS deviation, n < 10 AS sparse FROM"
    f" ({' UNION ALL '.join(SEGMENTS.format(d, 'o_totalprice', 'orders') for d in ('o_custkey', 'o_orderpriority'))}), (SELECT avg(o_totalprice) AS m FROM orders)"
    " WHERE n >= 3 AND abs((mean - m) / abs(m)) > 0.15",
)
def segment_vs_mean(spark, folder):
    found = segments.segment_vs_mean(table(spark, folder, "orders"), ["o_custkey", "o_orderpriority"], "o_totalprice")
    return rounded(found, {"mean": 4, "deviation": 6})


@QUERIES.add(
    "segment_contribution",
    f"SELECT dimension, value, n, round(total, 2) AS total, round(mean, 4) AS mean, round(total / t, 6) AS share, round((mean - m) / abs(m) * 100, 4) AS deviation_pct FROM ({PRICED}),"
    " (SELECT sum(p_retailprice) AS t, avg(p_retailprice) AS m FROM part) ORDER BY abs(total / t) DESC, dimension, value LIMIT 10",
)
def segment_contribution(spark, folder):
    found = segments.segment_contribution(table(spark, folder, "part"), ["p_brand", "p_type"], "p_retailprice")
    return rounded(found, {"total": 2, "mean": 4, "share": 6, "deviation_pct": 4})


@QUERIES.add(
    "segment_breakdown",
    "SELECT dimension, value, n, round(mean, 4) AS mean, round(c, 6) AS contribution, CAST(r AS INT) AS rank, r <= 3 AS top FROM (SELECT *, row_number() OVER"
    " (PARTITION BY dimension ORDER BY c DESC, value) AS r FROM (SELECT dimension, value, n, mean, abs((mean - m) * (n / k) * 100 / m) AS c FROM"
    f" ({PRICED}), (SELECT count(*) AS k, avg(p_retailprice) AS m FROM part)))",
)
def segment_breakdown(spark, folder):
    found = segments.segment_breakdown(table(spark, folder, "part"), ["p_brand", "p_type"], "p_retailprice")
    return rounded(found, {"mean": 4, "contribution": 6})


@QUERIES.add(
    "welch_t",
    "SELECT round((ma - mb) / sqrt(va / na + vb / nb), 6) AS t, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 4) AS df,"
    " round(abs(ma - mb) / sqrt((va + vb) / 2), 6) AS effect FROM (SELECT avg(l_quantity) FILTER (l_returnflag = 'A') AS ma, avg(l_quantity) FILTER (l_returnflag = 'N') AS mb,"
    " var_samp(l_quantity) FILTER (l_returnflag = 'A') AS va, var_samp(l_quantity) FILTER (l_returnflag = 'N') AS vb,"
    " count(*) FILTER (l_returnflag = 'A') AS na, count(*) FILTER (l_returnflag = 'N') AS nb FROM lineitem)",
)
def welch_t(spark, folder):
    found = segments.welch_t(lineitem(spark, folder), "l_returnflag", "A", "N", "l_quantity")
    return rounded(found, {"t": 6, "df": 4, "effect": 6})


@QUERIES.add(
    "anova_f",
    "SELECT round((sum(n * (m - g) ** 2) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) AS f, count(*) - 1 AS df_between,"
    " CAST(sum(n) - count(*) AS BIGINT) AS df_within FROM (SELECT count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v FROM lineitem GROUP BY l_returnflag),"
    " (SELECT avg(l_quantity) AS g FROM lineitem)",
)
def anova_f(spark, folder):
    return rounded(segments.anova_f(lineitem(spark, folder), "l_returnflag", "l_quantity"), ["f"], 6)


@QUERIES.add(
    "kruskal_h",
    "WITH r AS (SELECT l_returnflag AS g, l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rk FROM lineitem),"
    " t AS (SELECT sum(n * n * n - n) AS ties, sum(n) AS n FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_quantity)),"
    " s AS (SELECT sum(rs * rs / k) AS s, count(*) AS groups FROM (SELECT sum(rk) AS rs, count(*) AS k FROM r GROUP BY g))"
    " SELECT round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 5) AS h, groups - 1 AS df FROM s, t",
)
def kruskal_h(spark, folder):
    return rounded(segments.kruskal_h(lineitem(spark, folder), "l_returnflag", "l_quantity"), ["h"], 5)


@QUERIES.add(
    "chi_square",
    "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS o FROM lineitem GROUP BY ALL), ra AS (SELECT a, sum(o) AS x FROM c GROUP BY a),"
    " rb AS (SELECT b, sum(o) AS y FROM c GROUP BY b), e AS (SELECT coalesce(o, 0) AS o, x * y / (SELECT sum(o) FROM c) AS e FROM ra CROSS JOIN rb LEFT JOIN c ON c.a = ra.a AND c.b = rb.b)"
    " SELECT round(sum((o - e) ** 2 / e), 6) AS chi2, ((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM rb) - 1) AS df, CAST(sum(o) AS BIGINT) AS n FROM e",
)
def chi_square(spark, folder):
    return rounded(segments.chi_square(lineitem(spark, folder), "l_returnflag", "l_linestatus"), ["chi2"], 6)
