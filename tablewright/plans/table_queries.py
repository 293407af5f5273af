"""Queries for reading, writing and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import explore, validate
from tablewright.plans.registry import Registry, derived, derived_sql, rounded, table, union_all
from tablewright.session import new_path
from tablewright.sources import tables

QUERIES = Registry()

ISSUE = ["id", "column", "severity", "affected", "share", "action"]
MESSY = derived_sql("messy_lineitem")
LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def issue_rows(df):
    return rounded(df.select(*ISSUE), ["share"], 6)


@QUERIES.add(
    "read_csv",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
)
def read_csv(spark, folder):
    path = new_path(spark, "orders-csv")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    orders = table(spark, folder, "orders").select(*columns)
    orders.write.option("header", True).csv(path)
    back = tables.read_csv(spark, path)
    return back.withColumns({c: F.col(c).cast("long") for c in ("o_orderkey", "o_custkey")})


QUOTED = "o_orderpriority || ' \"' || o_orderstatus || '\", ' || o_custkey"


@QUERIES.add("read_csv_quoted", f"SELECT o_orderkey, {QUOTED} AS remark FROM orders")
def read_csv_quoted(spark, folder):
    """Quotes, commas and line breaks inside values."""
    path = new_path(spark, "orders-quoted")
    rows = table(spark, folder, "orders").selectExpr("o_orderkey", f"{QUOTED} AS remark")
    broken = rows.withColumn("remark", F.concat("remark", F.lit("\n.")))
    broken.write.option("header", True).option("escape", '"').csv(path)
    back = tables.read_csv(spark, path, multi_line=True)
    return back.select(F.col("o_orderkey").cast("long"), F.expr("substring(remark, 1, length(remark) - 2)").alias("remark"))


@QUERIES.add(
    "preview",
    "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey,"
    " coalesce(is_active, '') AS is_active, coalesce(weight_text, '') AS weight_text"
    f" FROM {derived_sql('untidy_orders')} ORDER BY CAST(o_orderkey AS BIGINT) LIMIT 5",
)
def preview(spark, folder):
    df = derived(spark, folder, "untidy_orders")
    return tables.preview(
        df.select("o_orderkey", "o_custkey", "is_active", "weight_text"), ["o_orderkey"], 5
    )


@QUERIES.add(
    "search_rows",
    "SELECT * FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring')"
    " OR contains(lower(p_type), 'ring')",
)
def search_rows(spark, folder):
    return tables.search_rows(table(spark, folder, "part"), "Ring")


@QUERIES.add(
    "finite_or_null",
    "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_linenumber IN (3, 4, 5) THEN NULL"
    " ELSE l_extendedprice END AS price FROM lineitem",
)
def finite_or_null(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.when(F.col("l_linenumber") == 3, float("nan"))
        .when(F.col("l_linenumber") == 4, float("inf"))
        .when(F.col("l_linenumber") == 5, float("-inf"))
        .otherwise(F.col("l_extendedprice"))
        .alias("price"),
    )
    return tables.finite_or_null(df)


GAPPY_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
MISSINGNESS_SQL = union_all(
    [
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS nulls,"
        f" round((count(*) - count({c})) / count(*), 6) AS null_share FROM {derived_sql('gappy_lineitem')}"
        for c in GAPPY_COLUMNS
    ]
)


@QUERIES.add("write_result_tables", MISSINGNESS_SQL)
def write_result_tables(spark, folder):
    path = new_path(spark, "results")
    found = explore.missingness_table(derived(spark, folder, "gappy_lineitem"))
    tables.write_result(found, path, "lineitem")
    back = tables.read_result(spark, path, "lineitem")
    return rounded(back.select("column", "nulls", "null_share"), ["null_share"], 6)


@QUERIES.add(
    "check_empty",
    "SELECT 'empty' AS id, CAST(NULL AS VARCHAR) AS \"column\", 'critical' AS severity,"
    " CAST(0 AS BIGINT) AS affected, 1.0::DOUBLE AS share, 'reject' AS action"
    " FROM (SELECT count(*) AS n FROM lineitem WHERE l_quantity < 0) WHERE n = 0",
)
def check_empty(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    none = lineitem.where("l_quantity < 0")
    return issue_rows(validate.check_empty(lineitem).unionByName(validate.check_empty(none)))


@QUERIES.add(
    "check_headers",
    union_all(
        [
            "SELECT 'missing_headers' AS id, 'Unnamed: 0' AS \"column\", 'medium' AS severity,"
            " CAST(1 AS BIGINT) AS affected, 'rename_headers' AS action, count(*) AS rows FROM supplier",
            "SELECT 'duplicate_headers', 'name', 'critical', 1, 'reject', count(*) FROM supplier",
            "SELECT 'invalid_names', 'balance %', 'low', 1, 'normalize_names', count(*) FROM supplier",
        ]
    ),
)
def check_headers(spark, folder):
    """The headers of a file as written: they are the first line of what Spark reads back."""
    path = new_path(spark, "supplier-csv")
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("Unnamed: 0"), F.col("s_name").alias("name"), F.col("s_nationkey").alias(" name "),
        F.col("s_acctbal").alias("balance %"),
    )
    supplier.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    found = validate.check_headers(tables.read_csv(spark, path, schema=supplier.schema), tables.header_names(spark, path))
    return found.select("id", "column", "severity", "affected", "action", "rows")


def with_copies(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    return lineitem.unionByName(lineitem.where("l_orderkey % 50 = 0"))


COPIES = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 50 = 0)"


@QUERIES.add(
    "check_duplicate_rows",
    "SELECT 'duplicate_rows' AS id, CAST(NULL AS VARCHAR) AS \"column\", 'medium' AS severity,"
    " n - d AS affected, round((n - d) / n, 6) AS share, 'deduplicate' AS action"
    f" FROM (SELECT (SELECT count(*) FROM {COPIES}) AS n,"
    f" (SELECT count(*) FROM (SELECT DISTINCT * FROM {COPIES})) AS d) WHERE n > d",
)
def check_duplicate_rows(spark, folder):
    return issue_rows(validate.check_duplicate_rows(with_copies(spark, folder)))


@QUERIES.add(
    "check_excessive_nulls",
    "SELECT 'excessive_nulls_' || c AS id, c AS \"column\", 'high' AS severity, n AS affected,"
    " round(n / total, 6) AS share, 'drop_or_impute' AS action FROM ("
    + union_all(
        [
            f"SELECT '{c}' AS c, count(*) - count({c}) AS n, count(*) AS total FROM {MESSY}"
            for c in ["l_orderkey", "l_quantity", "sparse_discount", "currency", "price", "part_code"]
        ]
    )
    + ") WHERE n / total > 0.40",
)
def check_excessive_nulls(spark, folder):
    return issue_rows(validate.check_excessive_nulls(derived(spark, folder, "messy_lineitem")))


MESSY_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "sparse_discount", "currency",
    "price", "part_code", "order_ref",
]


@QUERIES.add(
    "check_constant",
    "SELECT 'constant_' || c AS id, c AS \"column\", 'low' AS severity, n AS affected,"
    " round(n / total, 6) AS share, 'drop_column' AS action FROM ("
    + union_all(
        [
            f"SELECT '{c}' AS c, count({c}) AS n, count(*) AS total, count(DISTINCT {c}) AS d FROM {MESSY}"
            for c in MESSY_COLUMNS
        ]
    )
    + ") WHERE d = 1",
)
def check_constant(spark, folder):
    return issue_rows(validate.check_constant(derived(spark, folder, "messy_lineitem")))


@QUERIES.add(
    "check_high_cardinality",
    "SELECT 'high_cardinality_' || c AS id, c AS \"column\", 'low' AS severity, d AS affected,"
    " round(d / n, 6) AS share, 'flag_high_cardinality' AS action FROM ("
    + union_all(
        [
            f"SELECT '{c}' AS c, count({c}) AS n, count(DISTINCT {c}) AS d FROM documents"
            for c in ["text", "lang", "source"]
        ]
    )
    + ") WHERE d > 100 AND d / n > 0.5",
)
def check_high_cardinality(spark, folder):
    return issue_rows(validate.check_high_cardinality(table(spark, folder, "documents")))


@QUERIES.add(
    "check_infinite",
    "SELECT 'infinite_price' AS id, 'price' AS \"column\", 'high' AS severity,"
    " count(*) FILTER (isinf(price)) AS affected, round(count(*) FILTER (isinf(price)) / count(*), 6) AS share,"
    f" 'replace_infinite' AS action FROM {MESSY} HAVING count(*) FILTER (isinf(price)) > 0",
)
def check_infinite(spark, folder):
    return issue_rows(validate.check_infinite(derived(spark, folder, "messy_lineitem")))


@QUERIES.add(
    "check_mixed_types",
    "SELECT 'mixed_types_' || c AS id, c AS \"column\", 'medium' AS severity, n AS affected,"
    " round(n / p, 6) AS share, 'cast_types' AS action FROM ("
    + union_all(
        [
            f"SELECT '{c}' AS c, count({c}) AS p, count(TRY_CAST({c} AS DOUBLE)) AS n FROM {MESSY}"
            for c in ["l_returnflag", "currency", "part_code", "order_ref"]
        ]
    )
    + ") WHERE n > 0 AND n < p",
)
def check_mixed_types(spark, folder):
    return issue_rows(validate.check_mixed_types(derived(spark, folder, "messy_lineitem")))


REPORT_HEADER = (
    "(SELECT o_orderkey, CASE WHEN o_orderkey >= 2 THEN o_custkey END AS o_custkey,"
    " CASE WHEN o_orderkey >= 2 THEN o_orderstatus ELSE '' END AS o_orderstatus,"
    " CASE WHEN o_orderkey >= 2 THEN o_totalprice END AS o_totalprice FROM orders)"
)


@QUERIES.add(
    "check_metadata_rows",
    "SELECT 'metadata_rows' AS id, CAST(NULL AS VARCHAR) AS \"column\", 'medium' AS severity,"
    " count(*) FILTER (e > 2.4) AS affected, round(count(*) FILTER (e > 2.4) / count(*), 6) AS share,"
    " 'treat_as_metadata' AS action FROM (SELECT"
    " (CASE WHEN coalesce(trim(CAST(o_orderkey AS VARCHAR)), '') = '' THEN 1 ELSE 0 END)"
    " + (CASE WHEN coalesce(trim(CAST(o_custkey AS VARCHAR)), '') = '' THEN 1 ELSE 0 END)"
    " + (CASE WHEN coalesce(trim(o_orderstatus), '') = '' THEN 1 ELSE 0 END)"
    " + (CASE WHEN coalesce(trim(CAST(o_totalprice AS VARCHAR)), '') = '' THEN 1 ELSE 0 END) AS e"
    f" FROM {REPORT_HEADER} ORDER BY o_orderkey LIMIT 3) HAVING count(*) FILTER (e > 2.4) >= 2",
)
def check_metadata_rows(spark, folder):
    orders = table(spark, folder, "orders")
    body = F.col("o_orderkey") >= 2
    df = orders.select(
        "o_orderkey",
        F.when(body, F.col("o_custkey")).alias("o_custkey"),
        F.when(body, F.col("o_orderstatus")).otherwise("").alias("o_orderstatus"),
        F.when(body, F.col("o_totalprice")).alias("o_totalprice"),
    )
    return issue_rows(validate.check_metadata_rows(df, ["o_orderkey"]))


@QUERIES.add(
    "dataset_status",
    "SELECT CASE WHEN hard > 0 THEN 'invalid' WHEN soft > 0 THEN 'warning' ELSE 'valid' END AS status,"
    " CASE WHEN hard > 0 THEN 'critical' WHEN soft > 0 THEN 'medium' ELSE 'low' END AS severity,"
    " CAST(hard + soft + low AS BIGINT) AS issues FROM (SELECT"
    " CAST(count(*) = 0 AS INT) AS hard,"
    f" CAST((SELECT count(*) > (SELECT count(*) FROM (SELECT DISTINCT * FROM {MESSY})) FROM {MESSY}) AS INT)"
    " + CAST((count(*) - count(sparse_discount)) / count(*) > 0.4 AS INT)"
    " + CAST(count(*) FILTER (isinf(price)) > 0 AS INT)"
    " + CAST(count(TRY_CAST(part_code AS DOUBLE)) BETWEEN 1 AND count(part_code) - 1 AS INT) AS soft,"
    " CAST(count(DISTINCT currency) = 1 AS INT) + CAST(count(DISTINCT order_ref) > 100"
    " AND count(DISTINCT order_ref) / count(order_ref) > 0.5 AS INT)"
    " + CAST(count(DISTINCT part_code) > 100 AND count(DISTINCT part_code) / count(part_code) > 0.5 AS INT) AS low"
    f" FROM {MESSY})",
)
def dataset_status(spark, folder):
    return validate.dataset_status(validate.validate(derived(spark, folder, "messy_lineitem")))
