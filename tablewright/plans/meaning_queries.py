"""Queries for semantic types, roles, rules, scores, duplicates and drivers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import drivers, duplicates, quality, rules, semantics, series
from tablewright.plans.registry import Registry, rounded, table, union_all
from tablewright.session import new_path

QUERIES = Registry()

# columns of many kinds from every order: name -> (kind, expression both engines understand)
TYPED = {
    "o_orderkey": ("integer", "o_orderkey"),
    "o_custkey": ("integer", "o_custkey"),
    "o_totalprice": ("float", "o_totalprice"),
    "o_orderpriority": ("text", "o_orderpriority"),
    "o_orderdate": ("datetime", "o_orderdate"),
    "is_paid": ("text", "CASE WHEN o_orderkey % 3 = 0 THEN 'Yes' WHEN o_orderkey % 3 = 1 THEN ' no' ELSE NULL END"),
    "shipped_on": ("text", "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 10) END"),
    "discount_text": ("text", "CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 101 AS STRING) || '%' END"),
    "amount_text": ("text", "'$' || CAST(o_custkey AS STRING) || ' fee'"),
    "longitude": ("float", "o_orderkey % 350 - 174.75"),
    "comment": ("text", "'order ' || CAST(o_orderkey AS STRING) || ' was placed by customer ' || CAST(o_custkey AS STRING)"),
    "two": ("integer", "o_orderkey % 2"),
}
TYPED_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, (_, e) in TYPED.items()) + " FROM orders)"


def typed(spark, folder):
    exprs = [f"CAST({e} AS {'DOUBLE' if k == 'float' else 'BIGINT' if k == 'integer' else 'STRING'}) AS {c}" if k != "datetime" else f"{e} AS {c}" for c, (k, e) in TYPED.items()]
    return table(spark, folder, "orders").selectExpr(*exprs)


def quoted_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def evidence_sql(c: str, kind: str) -> str:
    s = f"CAST({c} AS VARCHAR)"
    x = {"text": f"CASE WHEN regexp_matches(trim({c}), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN TRY_CAST({c} AS DOUBLE) END", "datetime": "NULL::DOUBLE"}.get(kind, f"CAST({c} AS DOUBLE)")
    d = {"text": f"TRY_CAST({c} AS TIMESTAMP) IS NOT NULL AND regexp_matches({c}, '^\\d{{4}}-')", "datetime": "true"}.get(kind, "false")
    return (
        f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count(*)::DOUBLE AS rows, count(s)::DOUBLE AS n, count(x)::DOUBLE AS numbers, count(*) FILTER (s IS NOT NULL AND d)::DOUBLE AS dates,"
        f" count(*) FILTER (lower(trim(s)) IN ({quoted_list(semantics.TRUTH_TOKENS)}))::DOUBLE AS truths, count(*) FILTER (lower(trim(s)) IN ({quoted_list(semantics.ROLE_TOKENS)}))::DOUBLE AS flags,"
        " coalesce(avg(CASE WHEN trim(s) <> '' THEN length(trim(s)) END), 0) AS length, count(*) FILTER (regexp_matches(s, '(?i)%|percent'))::DOUBLE AS percents,"
        f" count(*) FILTER (regexp_matches(s, '{semantics.MONEY_TOKENS}'))::DOUBLE AS moneys, count(*) FILTER (x BETWEEN 0 AND 100)::DOUBLE AS hundreds, count(*) FILTER (x >= 0)::DOUBLE AS positives,"
        " count(*) FILTER (x BETWEEN -90 AND 90)::DOUBLE AS lats, count(*) FILTER (x BETWEEN -180 AND 180)::DOUBLE AS lons, count(*) FILTER (abs(x % 1) > 1e-9)::DOUBLE AS fractions,"
        " count(DISTINCT s)::DOUBLE AS distincts, count(DISTINCT x)::DOUBLE AS xs, max(x) - min(x) AS spread, quantile_cont(abs(x), 0.75) AS upper"
        f" FROM (SELECT {s} AS s, {x} AS x, {d} AS d FROM {TYPED_SQL})"
    )


EVIDENCE = "e AS (" + union_all([evidence_sql(c, k) for c, (k, _) in TYPED.items()]) + ")"
SCORES = """
shares AS (
  SELECT *, distincts / nullif(n, 0) AS u, dates / nullif(n, 0) AS dt, truths / nullif(n, 0) AS tr, numbers / nullif(n, 0) AS rate, kind IN ('text', 'datetime') AS textual,
    coalesce(1 - fractions / nullif(numbers, 0), 1) AS whole, coalesce(greatest(lats, lons) / nullif(numbers, 0), 0) AS span FROM e),
found AS (
  SELECT *, CASE WHEN rate > 0 THEN 0.5 * rate + 0.5 * hundreds / numbers ELSE percents / n END AS pc,
    CASE WHEN rate > 0 THEN 0.4 * moneys / n + 0.6 * rate * (positives / numbers) * (CASE WHEN upper > 10 THEN 1.0 WHEN upper > 1 THEN 0.4 ELSE 0.2 END) ELSE moneys / n END AS mo,
    CASE WHEN rate > 0 AND span >= 0.98 AND (spread >= 5 OR fractions / numbers >= 0.3) THEN rate * span ELSE 0 END AS geo FROM shares),
scores AS (
  SELECT "column", 0 AS turn, 'IDENTIFIER' AS type, CASE WHEN u >= 0.85 THEN 0.55 WHEN u >= 0.6 THEN 0.25 ELSE 0 END AS score FROM found UNION ALL
  SELECT "column", 1, 'CATEGORICAL', CASE WHEN textual THEN 0.1 + (1 - least(1, u * 2)) * 0.5 + least(1, greatest(0, (20 - length) / 20)) * 0.5 ELSE 0 END FROM found UNION ALL
  SELECT "column", 2, 'NUMERIC_CONTINUOUS', CASE WHEN rate >= 0.7 THEN CASE WHEN whole >= 0.85 THEN 0.15 ELSE 0.7 END ELSE 0 END FROM found UNION ALL
  SELECT "column", 3, 'NUMERIC_DISCRETE', CASE WHEN rate >= 0.7 THEN CASE WHEN whole >= 0.85 THEN 0.7 * whole ELSE 0.25 * (1 - least(1, xs / numbers * 5)) END ELSE 0 END FROM found UNION ALL
  SELECT "column", 4, 'DATETIME', 0.7 * dt FROM found UNION ALL
  SELECT "column", 5, 'GEOGRAPHIC', 0.7 * geo FROM found UNION ALL
  SELECT "column", 6, 'TEXT', CASE WHEN textual THEN least(1, length / 25) * 0.6 + least(1, u * 2) * 0.4 ELSE 0 END FROM found UNION ALL
  SELECT "column", 7, 'MONETARY', 0.6 * mo FROM found UNION ALL
  SELECT "column", 8, 'PERCENTAGE', CASE WHEN rate >= 0.7 OR pc > 0.05 THEN 0.7 * pc ELSE 0 END FROM found UNION ALL
  SELECT "column", 9, 'BOOLEAN', 0.65 * tr FROM found),
-- the types that come first from 0.7 on, in their order, then the highest score
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY
    CASE WHEN type = 'BOOLEAN' AND round(score, 9) >= 0.7 THEN 0 WHEN type = 'DATETIME' AND round(score, 9) >= 0.7 THEN 1
      WHEN type = 'GEOGRAPHIC' AND round(score, 9) >= 0.7 THEN 2 WHEN type = 'IDENTIFIER' AND round(score, 9) >= 0.7 THEN 3 ELSE 4 END, round(score, 9) DESC, turn) AS r FROM scores)
"""


@QUERIES.add(
    "classify_semantic_type",
    f"WITH {EVIDENCE}, {SCORES} SELECT \"column\", type AS semantic_type, round(greatest(0.05, least(0.99, score)), 6) AS confidence FROM ranked WHERE r = 1",
)
def classify_semantic_type(spark, folder):
    return rounded(semantics.classify_semantic_type(typed(spark, folder)), ["confidence"], 6)


HINTS = {"o_totalprice": ["currency"], "o_orderpriority": ["status"], "longitude": ["percentage", "concept"]}
ROLES = (
    "roles AS (SELECT \"column\", r.column_type, r.role, CASE WHEN \"column\" = 'longitude' THEN least(1, r.score + 0.15) ELSE r.score END AS raw, (rows - n) / rows AS nulls, distincts, rows, n,"
    " kind, numbers - positives AS negatives FROM (SELECT *, CASE WHEN kind = 'datetime' THEN {'column_type': 'temporal', 'role': 'dimension', 'score': 0.9}"
    " WHEN kind = 'integer' AND distincts = rows THEN {'column_type': 'identifier', 'role': 'key', 'score': 0.9}"
    " WHEN kind <> 'text' AND distincts <= 2 AND (rows - n) / rows < 0.2 THEN {'column_type': 'boolean', 'role': 'status', 'score': 0.8}"
    " WHEN kind <> 'text' AND distincts / rows < 0.05 AND distincts < 15 THEN {'column_type': 'categorical', 'role': 'dimension', 'score': 0.7}"
    " WHEN \"column\" = 'longitude' THEN {'column_type': 'numeric', 'role': 'percentage', 'score': 0.85}"
    " WHEN \"column\" = 'o_totalprice' THEN {'column_type': 'currency', 'role': 'measure', 'score': 0.85}"
    " WHEN kind <> 'text' THEN {'column_type': 'numeric', 'role': 'measure', 'score': 0.75}"
    " WHEN n > 0 AND flags = n THEN {'column_type': 'boolean', 'role': 'status', 'score': 0.9}"
    " WHEN n > 0 AND dates = n THEN {'column_type': 'temporal', 'role': 'dimension', 'score': 0.8}"
    " WHEN distincts = rows THEN {'column_type': 'identifier', 'role': 'key', 'score': 0.85}"
    " WHEN \"column\" = 'o_orderpriority' THEN {'column_type': 'categorical', 'role': 'status', 'score': 0.8}"
    " ELSE {'column_type': 'categorical', 'role': 'dimension', 'score': 0.6} END AS r FROM e)),"
    " scored AS (SELECT *, CAST(CASE WHEN nulls > 0.4 THEN greatest(0.2, raw - 0.2) ELSE raw END AS DOUBLE) AS score FROM roles)"
)


@QUERIES.add("column_roles", f"WITH {EVIDENCE}, {ROLES} SELECT \"column\", column_type, role, round(score, 6) AS score FROM scored")
def column_roles(spark, folder):
    return rounded(semantics.column_roles(typed(spark, folder), HINTS), ["score"], 6)


CLAIMS = [
    ("o_orderpriority", "numeric", "measure", 0.8),
    ("o_custkey", "identifier", "key", 0.9),
    ("o_orderkey", "identifier", "key", 0.9),
    ("o_totalprice", "categorical", "dimension", 0.7),
    ("longitude", "numeric", "measure", 0.75),
]
CLAIMS_SQL = "claims AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {d}::DOUBLE)" for a, b, c, d in CLAIMS) + ") t(c, column_type, role, score))"


@QUERIES.add(
    "role_contradictions",
    f"WITH {EVIDENCE}, {CLAIMS_SQL}, j AS (SELECT c.*, CASE WHEN role = 'measure' AND kind = 'text' THEN 'measure_of_texts'"
    " WHEN role = 'measure' AND c = 'longitude' AND numbers - positives > n * 0.1 THEN 'negative_amounts' WHEN role = 'key' AND distincts < rows AND n = rows THEN 'repeated_key'"
    " WHEN role = 'dimension' AND kind = 'float' AND distincts > rows * 0.9 THEN 'continuous_dimension' END AS x FROM claims c JOIN e ON e.\"column\" = c.c)"
    " SELECT c AS \"column\", CASE WHEN x IN ('measure_of_texts', 'repeated_key') THEN 'categorical' WHEN x = 'continuous_dimension' THEN 'numeric' ELSE column_type END AS column_type,"
    " CASE WHEN x IN ('measure_of_texts', 'repeated_key') THEN 'dimension' WHEN x = 'continuous_dimension' THEN 'measure' ELSE role END AS role,"
    " round(CASE WHEN x = 'measure_of_texts' THEN greatest(0.1, score - 0.5) WHEN x = 'repeated_key' THEN greatest(0.2, score - 0.4) WHEN x IS NOT NULL THEN greatest(0.3, score - 0.3) ELSE score END, 6) AS score,"
    " x AS contradiction FROM j",
)
def role_contradictions(spark, folder):
    """Claimed roles, some of them wrong."""
    claims = spark.createDataFrame(CLAIMS, "column string, column_type string, role string, score double")
    return rounded(semantics.role_contradictions(typed(spark, folder), claims, ["longitude"]), ["score"], 6)


@QUERIES.add(
    "measures_and_dimensions",
    f"WITH {EVIDENCE}, {ROLES} SELECT \"column\", CASE WHEN role IN ('measure', 'percentage') THEN 'measure' ELSE 'dimension' END AS part,"
    " CASE WHEN \"column\" = 'o_custkey' THEN 'max' WHEN role = 'percentage' THEN 'avg' WHEN role = 'measure' THEN 'sum' END AS aggregation,"
    " CASE WHEN role NOT IN ('measure', 'percentage') THEN CASE WHEN distincts <= 15 THEN 'low' WHEN distincts <= 100 THEN 'medium' ELSE 'high' END END AS cardinality FROM scored WHERE role <> 'key'",
)
def measures_and_dimensions(spark, folder):
    rows = typed(spark, folder)
    return semantics.measures_and_dimensions(rows, semantics.column_roles(rows, HINTS), {"o_custkey": "max"})


@QUERIES.add(
    "semantic_gate",
    f"WITH {EVIDENCE}, {ROLES} SELECT \"column\", round(score, 6) AS score, round(score, 6) >= 0.65 AS kept, CASE WHEN round(score, 6) < 0.65 THEN 'LOW_SEMANTIC_CONFIDENCE' END AS reason FROM scored",
)
def semantic_gate(spark, folder):
    return semantics.semantic_gate(rounded(semantics.column_roles(typed(spark, folder), HINTS), ["score"], 6))


LOOKUPS = [("c_nationkey", "n_name"), ("c_custkey", "c_name"), ("c_nationkey", "c_mktsegment"), ("c_custkey", "n_name")]
PLACED = "(SELECT c_custkey, c_name, c_nationkey, c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@QUERIES.add(
    "lookup_pairs",
    "SELECT code, label, codes, labels, codes = labels AS one_to_one FROM ("
    + union_all(
        [
            f"SELECT '{a}' AS code, '{b}' AS label, count(*) AS codes, count(DISTINCT y) AS labels, bool_and(k = 1) AS fits FROM (SELECT {a}, min({b}) AS y, count(DISTINCT {b}) AS k FROM {PLACED} GROUP BY {a})"
            for a, b in LOOKUPS
        ]
    )
    + ") WHERE fits AND labels > 1",
)
def lookup_pairs(spark, folder):
    rows = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return semantics.lookup_pairs(rows, LOOKUPS)


RULED = {
    "l_quantity_positive": "l_quantity > 0",
    "l_discount_non_negative": "l_discount >= 0",
    "l_returnflag_listed": "l_returnflag IN (SELECT DISTINCT l_returnflag FROM lineitem WHERE l_orderkey % 2 = 0)",
    "l_quantity_known": "l_quantity IS NOT NULL",
    "l_discount_known": "l_discount IS NOT NULL",
    "l_returnflag_known": "l_returnflag IS NOT NULL",
    "l_discount_before_l_quantity": "l_discount <= l_quantity",
}
LATER = (
    "(SELECT l_quantity - 5 AS l_quantity, CASE WHEN l_orderkey % 9 = 1 THEN NULL ELSE l_discount END AS l_discount,"
    " CASE WHEN l_orderkey % 11 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE l_orderkey % 2 = 1)"
)


@QUERIES.add(
    "rules_store_and_apply",
    union_all(
        [
            f"SELECT '{n}' AS rule, CAST(2 AS INT) AS version, count({a}) AS checked, count(*) FILTER (NOT ({a})) AS broken, true AS applied FROM {LATER}"
            for n, a in RULED.items()
        ]
    ),
)
def rules_store_and_apply(spark, folder):
    """Rules learned from one half of the lines, in the second version, against the other half with faults."""
    lines, store = table(spark, folder, "lineitem"), new_path(spark, "rules")
    learned = lines.where("l_orderkey % 2 = 0")
    rules.save_rules(spark, store, "lineitem", {"l_quantity_known": "l_quantity IS NOT NULL"})
    found = rules.learn_rules(learned, ["l_quantity", "l_discount", "l_returnflag"], [("l_discount", "l_quantity")])
    rules.save_rules(spark, store, "lineitem", found)
    later = lines.where("l_orderkey % 2 = 1").selectExpr(
        "l_quantity - 5 AS l_quantity",
        "CASE WHEN l_orderkey % 9 = 1 THEN NULL ELSE l_discount END AS l_discount",
        "CASE WHEN l_orderkey % 11 = 0 THEN 'X' ELSE l_returnflag END AS l_returnflag",
    )
    return rules.apply_rules(later, store, "lineitem")


HOT = "(SELECT event_id, event_type, user_id, value, value * value * value * value AS fourth, event_id * 7919 % 1000 AS volume, event_id * 104729 % 997 AS promo FROM events)"


def hot(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "event_id", "event_type", "user_id", "value", "value * value * value * value AS fourth", "event_id * 7919 % 1000 AS volume", "event_id * 104729 % 997 AS promo"
    )


def fences(c: str, width: float, source: str) -> str:
    return f"(SELECT quantile_cont({c}, 0.25) - {width} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + {width} * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM {source})"


def outlier_sql(c: str, kind: str) -> str:
    return (
        f"SELECT '{c}' AS \"column\", a AS affected, round(lo, 2) AS low, round(hi, 2) AS high, round(z, 4) AS extreme_z, {kind} FROM (SELECT lo, hi, z, busy, usual, a FROM"
        f" (SELECT lo, hi, greatest(abs(max({c}) FILTER ({c} < lo OR {c} > hi) - avg({c})), abs(min({c}) FILTER ({c} < lo OR {c} > hi) - avg({c}))) / stddev_samp({c}) AS z,"
        f" avg(volume) FILTER ({c} < lo OR {c} > hi) AS busy, avg(volume) AS usual, count(*) FILTER ({c} < lo OR {c} > hi) AS a FROM {HOT}, {fences(c, 1.5, HOT)} GROUP BY lo, hi)) WHERE a > 0"
    )


_ERROR = "CASE WHEN z > 8 THEN 'entry_error' ELSE '{0}' END AS kind, CASE WHEN z > 8 THEN 'delete_rows' ELSE 'keep' END AS action, CASE WHEN z > 8 THEN 0.85 ELSE 0.7 END::DOUBLE AS confidence"
_AMOUNT = (
    "CASE WHEN z > 8 THEN 'entry_error' WHEN busy > usual * 1.5 THEN 'promotion' ELSE 'business_event' END AS kind, CASE WHEN z > 8 THEN 'delete_rows' ELSE 'keep' END AS action,"
    " CASE WHEN z > 8 THEN 0.85 WHEN busy > usual * 1.5 THEN 0.8 ELSE 0.7 END::DOUBLE AS confidence"
)


@QUERIES.add("outlier_classify", union_all([outlier_sql("value", _ERROR.format("legitimate")), outlier_sql("fourth", _AMOUNT)]))
def outlier_classify(spark, folder):
    found = quality.outlier_classify(hot(spark, folder), ["value", "fourth"], amounts=["fourth"], quantity="volume")
    return rounded(found, {"low": 2, "high": 2, "extreme_z": 4})


SCORED = "(SELECT l_returnflag, l_linestatus, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_extendedprice * l_extendedprice AS squared, 'n/a' AS weight FROM lineitem)"


@QUERIES.add(
    "quality_score_weighted",
    "WITH p AS (SELECT 100.0 * (count(l_returnflag) + count(l_linestatus) + count(l_linenumber) + count(l_quantity) + count(squared) + count(weight)) / (6 * count(*)) AS completeness,"
    f" 100.0 * (SELECT count(*) FROM (SELECT DISTINCT * FROM {SCORED})) / count(*) AS uniqueness,"
    f" 100 * (1 - 1.0 * ((SELECT count(*) FROM {SCORED}, {fences('l_quantity', 1.5, SCORED)} WHERE l_quantity < lo OR l_quantity > hi)"
    f" + (SELECT count(*) FROM {SCORED}, {fences('squared', 1.5, SCORED)} WHERE squared < lo OR squared > hi)) / (2 * count(*))) AS consistency,"
    f" 90.0::DOUBLE AS validity, 500.0::DOUBLE / 6 AS type_alignment FROM {SCORED})"
    " SELECT round(completeness, 4) AS completeness, round(uniqueness, 4) AS uniqueness, round(consistency, 4) AS consistency, validity, round(type_alignment, 4) AS type_alignment,"
    " CAST(round(0.25 * completeness + 0.15 * uniqueness + 0.2 * consistency + 0.2 * validity + 0.2 * type_alignment) AS BIGINT) AS score FROM p",
)
def quality_score_weighted(spark, folder):
    """One of two rules is broken, and one of three measures holds texts."""
    rows = table(spark, folder, "lineitem").selectExpr(
        "l_returnflag", "l_linestatus", "l_linenumber", "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "l_extendedprice * l_extendedprice AS squared", "'n/a' AS weight",
    )
    broken = quality.rule_violations(rows, {"few": "l_quantity <= 49", "some": "l_quantity >= 0"})
    found = quality.quality_score_weighted(rows, ["l_quantity", "squared"], broken, ["l_quantity", "squared", "weight"])
    return rounded(found, ["completeness", "uniqueness", "consistency", "type_alignment"])


NAMED = (
    "(SELECT c_nationkey, CASE WHEN c_custkey % 10 = 3 AND c_mktsegment = 'AUTOMOBILE' THEN ' AUTOMOBLE' WHEN c_custkey % 10 = 4 AND c_mktsegment = 'FURNITURE' THEN 'furnituree'"
    " ELSE c_mktsegment END AS segment FROM customer)"
)


@QUERIES.add(
    "duplicate_report",
    f"WITH t AS (SELECT * FROM {NAMED}), k AS (SELECT count(*) AS k FROM t), v AS (SELECT trim(segment) AS s, count(*) AS n FROM t GROUP BY 1),"
    " near AS (SELECT a.s, a.n, min(least(lower(a.s), lower(b.s))) AS g FROM v a JOIN v b ON a.s <> b.s AND levenshtein(lower(a.s), lower(b.s)) <= floor(0.12 * greatest(length(a.s), length(b.s)) + 1e-9) GROUP BY 1, 2)"
    " SELECT 'rows' AS kind, NULL::VARCHAR AS \"column\", count(*) AS groups, CAST(sum(n - 1) AS BIGINT) AS affected, round(sum(n - 1) / max(k), 6) AS share, 'low' AS risk FROM (SELECT count(*) AS n FROM t GROUP BY c_nationkey, segment HAVING count(*) > 1), k"
    " UNION ALL SELECT 'keys', 'c_nationkey', count(*), CAST(sum(n - 1) AS BIGINT), round(sum(n - 1) / max(k), 6), 'high' FROM (SELECT count(*) AS n FROM t GROUP BY c_nationkey HAVING count(*) > 1), k"
    " UNION ALL SELECT 'spellings', 'segment', count(DISTINCT g), CAST(sum(n) AS BIGINT), round(sum(n) / max(k), 6), 'medium' FROM near, k HAVING count(*) > 0",
)
def duplicate_report(spark, folder):
    rows = table(spark, folder, "customer").selectExpr(
        "c_nationkey",
        "CASE WHEN c_custkey % 10 = 3 AND c_mktsegment = 'AUTOMOBILE' THEN ' AUTOMOBLE' WHEN c_custkey % 10 = 4 AND c_mktsegment = 'FURNITURE' THEN 'furnituree'"
        " ELSE c_mktsegment END AS segment",
    )
    return rounded(duplicates.duplicate_report(rows, ["c_nationkey"]), ["share"], 6)


DRILL = ["l_returnflag", "l_linestatus", "l_linenumber"]


def drill_sql() -> str:
    one = [f"SELECT NULL AS u, NULL AS uv, '{d}' AS d, CAST({d} AS VARCHAR) AS v, count(*) AS n, avg(x) AS mean, max(m) AS m FROM r GROUP BY {d}" for d in DRILL]
    two = [
        f"SELECT '{d}', CAST({d} AS VARCHAR), '{c}', CAST({c} AS VARCHAR), count(*), avg(x), max(m) FROM r GROUP BY {d}, {c}" for d in DRILL for c in DRILL if c != d
    ]
    return (
        "WITH s AS (SELECT avg(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.9) AS hi FROM lineitem),"
        " r AS (SELECT *, l_extendedprice AS x FROM lineitem, s WHERE l_extendedprice >= hi),"
        f" g AS ({union_all(one + two)}),"
        " c AS (SELECT *, abs((mean - m) * n / sum(n) OVER (PARTITION BY u, uv, d) * 100 / m) AS c FROM g),"
        " k AS (SELECT *, row_number() OVER (PARTITION BY u, uv, d ORDER BY c DESC, v) AS r FROM c)"
        " SELECT CAST(CASE WHEN u IS NULL THEN 1 ELSE 2 END AS INT) AS level, d AS dimension, v AS value, u AS under, uv AS under_value, n, round(mean, 4) AS mean, round(c, 6) AS contribution,"
        " CAST(r AS INT) AS rank, r <= 3 AS top FROM k WHERE r <= 5 AND (u IS NULL OR EXISTS (SELECT 1 FROM k l WHERE l.u IS NULL AND l.r = 1 AND l.d = k.u AND l.v = k.uv AND l.n >= 5))"
    )


@QUERIES.add("root_cause_drilldown", drill_sql())
def root_cause_drilldown(spark, folder):
    found = drivers.root_cause_drilldown(table(spark, folder, "lineitem"), "l_extendedprice", DRILL, 500_000.0)
    return rounded(found, {"mean": 4, "contribution": 6})


@QUERIES.add(
    "anomaly_attribution",
    f"SELECT event_id, fourth, CASE WHEN p AND v THEN 'promo' WHEN v THEN 'business_event' WHEN f THEN 'operational' ELSE 'unknown' END AS cause,"
    " CASE WHEN p AND v THEN 'promo,volume' WHEN v THEN 'volume' WHEN f THEN 'flag' ELSE '' END AS support FROM (SELECT event_id, fourth, promo > qp AS p, volume > qv AS v, event_type = 'error' AS f"
    f" FROM {HOT}, {fences('fourth', 2.5, HOT)}, (SELECT quantile_cont(promo, 0.8) AS qp, quantile_cont(volume, 0.9) AS qv FROM {HOT}) WHERE fourth < lo OR fourth > hi)",
)
def anomaly_attribution(spark, folder):
    rows = hot(spark, folder).withColumn("flag", F.when(F.col("event_type") == "error", "Failed").otherwise("ok"))
    found = drivers.anomaly_attribution(rows, "fourth", ["promo"], ["volume"], ["flag"])
    return found.select("event_id", "fourth", "cause", F.array_join("support", ",").alias("support"))


def segment_sql(d: str) -> str:
    return (
        f"SELECT 'segment' AS kind, '{d}' AS target, max(c) FILTER (r = 1) AS value, max(c) FILTER (r = 2) AS detail FROM (SELECT c, row_number() OVER (ORDER BY c DESC, v) AS r FROM"
        f" (SELECT abs((avg(p_retailprice) - max(m)) * count(*) / max(k) * 100 / max(m)) AS c, {d} AS v FROM part, (SELECT avg(p_retailprice) AS m, count(*) AS k FROM part) GROUP BY {d}))"
    )


OBSERVED = 1500.0
EVIDENCE_ROWS = (
    f"SELECT *, CASE WHEN value > 30 AND value / nullif(detail, 0) > 2 THEN 'strong' WHEN value > 15 THEN 'moderate' WHEN value > 5 THEN 'weak' ELSE 'none' END AS strength, value > 10 AS supports FROM ({union_all([segment_sql(d) for d in ('p_brand', 'p_type')])})"
    " UNION ALL SELECT *, CASE WHEN abs(value) > 0.7 THEN 'strong' WHEN abs(value) > 0.4 THEN 'moderate' WHEN abs(value) > 0.2 THEN 'weak' ELSE 'none' END, abs(value) > 0.3 AND value > 0 FROM"
    " (SELECT 'correlation' AS kind, 'p_partkey' AS target, corr(p_retailprice, p_partkey) AS value, count(*)::DOUBLE AS detail FROM part UNION ALL"
    " SELECT 'correlation', 'p_size', corr(p_retailprice, p_size), count(*)::DOUBLE FROM part)"
    " UNION ALL SELECT *, CASE WHEN abs(value) > 3 THEN 'strong' WHEN abs(value) > 2 THEN 'moderate' WHEN abs(value) > 1 THEN 'weak' ELSE 'none' END, abs(value) > 1.5 FROM"
    f" (SELECT 'distribution' AS kind, 'p_retailprice' AS target, ({OBSERVED} - avg(p_retailprice)) / stddev_pop(p_retailprice) AS value, 100.0 * count(*) FILTER (p_retailprice <= {OBSERVED}) / count(*) AS detail FROM part)"
)


def part_evidence(spark, folder):
    return drivers.evidence_table(table(spark, folder, "part"), "p_retailprice", OBSERVED, ["p_brand", "p_type", "p_name"], ["p_partkey", "p_size"])


@QUERIES.add(
    "evidence_table",
    f"SELECT kind, target, round(value, 6) AS value, round(detail, 6) AS detail, strength, supports,"
    " CASE kind WHEN 'segment' THEN CASE strength WHEN 'strong' THEN 0.8 WHEN 'moderate' THEN 0.65 ELSE 0.4 END"
    " WHEN 'correlation' THEN CASE strength WHEN 'strong' THEN 0.85 WHEN 'moderate' THEN 0.65 ELSE 0.35 END ELSE 0.85 END::DOUBLE AS confidence"
    f" FROM ({EVIDENCE_ROWS})",
)
def evidence_table(spark, folder):
    found = part_evidence(spark, folder).where("target <> 'p_name'")
    return rounded(found, ["value", "detail"], 6)


@QUERIES.add(
    "driver_importance",
    f"WITH d AS (SELECT target, kind, least(100, CASE kind WHEN 'segment' THEN value ELSE abs(value) * 80 END) AS raw,"
    " CASE kind WHEN 'segment' THEN strength IN ('strong', 'moderate') ELSE abs(value) > 0.4 END AS significant"
    f" FROM ({EVIDENCE_ROWS}) WHERE kind = 'segment' OR kind = 'correlation' AND abs(value) >= 0.2)"
    " SELECT target AS \"column\", kind, round(raw * CASE WHEN sum(raw) OVER () > 100 THEN 100 / sum(raw) OVER () ELSE 1 END, 6) AS importance, significant FROM d",
)
def driver_importance(spark, folder):
    return rounded(drivers.driver_importance(part_evidence(spark, folder).where("target <> 'p_name'")), ["importance"], 6)


DAILY = "(SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS period, sum(value) AS total FROM events GROUP BY 1, 2)"


@QUERIES.add(
    "finding_pool",
    f"WITH d AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY period) AS i FROM {DAILY}),"
    " t AS (SELECT event_type, avg(total) AS base, max(total) AS top, arg_max(period, total) AS peak, CASE WHEN stddev_pop(total) / abs(avg(total)) > 0.5 THEN 'volatile'"
    " WHEN regr_slope(total, i) > 0.02 * abs(avg(total)) THEN 'growing' WHEN regr_slope(total, i) < -0.02 * abs(avg(total)) THEN 'declining' ELSE 'flat' END AS trend FROM d GROUP BY 1),"
    " a AS (SELECT d.event_type, min(d.period) AS period FROM d JOIN (SELECT event_type, avg(total) AS m, stddev_pop(total) AS s FROM d GROUP BY 1) z ON z.event_type = d.event_type JOIN t ON t.event_type = d.event_type"
    " WHERE abs((total - m) / s) > 1 AND d.period <> peak GROUP BY 1),"
    " f AS (SELECT event_type, 'peak' AS kind, peak AS period, top AS observed, base AS baseline, greatest(-1000, least(1000, (top - base) / abs(base) * 100)) AS dev, CASE WHEN trend <> 'flat' THEN 1.5 ELSE 1 END AS w, 15 AS least_ FROM t"
    " UNION ALL SELECT a.event_type, 'anomaly', a.period, d.total, base, (d.total - base) / abs(base) * 100, 1, 20 FROM a JOIN d ON d.event_type = a.event_type AND d.period = a.period JOIN t ON t.event_type = a.event_type)"
    " SELECT event_type, kind, period, round(observed, 4) AS observed, round(baseline, 4) AS baseline, round(dev, 4) AS deviation_pct, round(abs(dev) * w, 4) AS priority,"
    " CAST(row_number() OVER (ORDER BY abs(dev) * w DESC, kind, period, event_type) AS INT) AS rank FROM f WHERE abs(dev) >= least_ ORDER BY rank LIMIT 3",
)
def finding_pool(spark, folder):
    daily = series.period_buckets(table(spark, folder, "events"), "ts", "value", "day", ["event_type"])
    keys = ["event_type"]
    found = drivers.finding_pool(daily, series.trend_class(daily, keys), series.period_anomalies(daily, keys, limit=1.0), keys)
    return rounded(found, ["observed", "baseline", "deviation_pct", "priority"])


@QUERIES.add(
    "tail_findings",
    "SELECT * FROM ("
    + union_all(
        [
            f"SELECT '{c}' AS \"column\", round(quantile_cont({c}, 0.9), 4) AS observed, round(avg({c}), 4) AS baseline, round((quantile_cont({c}, 0.9) - avg({c})) / avg({c}) * 100, 4) AS deviation_pct FROM lineitem"
            for c in ("l_extendedprice", "l_quantity")
        ]
    )
    + ") WHERE deviation_pct >= 20",
)
def tail_findings(spark, folder):
    found = drivers.tail_findings(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity", "l_tax"])
    return rounded(found, ["observed", "baseline", "deviation_pct"])


@QUERIES.add("outlier_driver_tree")
def outlier_driver_tree(spark, folder):
    """Outliers of a fourth power against its root and two other numbers."""
    return rounded(drivers.outlier_driver_tree(hot(spark, folder), "fourth", ["value", "volume", "user_id"]), ["importance"])


@QUERIES.add("feature_importance")
def feature_importance(spark, folder):
    lines = table(spark, folder, "lineitem")
    return rounded(drivers.feature_importance(lines, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag"]), ["importance"])
