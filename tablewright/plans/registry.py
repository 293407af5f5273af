"""How a query is registered, and the derived tables the queries share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.tables import read_table


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Registry(dict):
    """name -> Query; ``add`` is used as a decorator."""

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            if name in self:
                raise ValueError(f"{name} is registered twice")
            self[name] = Query(fn, sql)
            return fn

        return wrap


# The test tables are clean, so cleaning queries derive dirt from every row by
# fixed rules. The rules are SQL text that Spark and the oracle both understand.
DERIVED: dict[str, tuple[str, list[str]]] = {
    "messy_lineitem": (
        "lineitem",
        [
            "l_orderkey",
            "l_linenumber",
            "l_quantity",
            "l_returnflag",
            "CASE WHEN (l_orderkey + l_linenumber) % 2 = 0 THEN NULL ELSE l_discount END AS sparse_discount",
            "'EUR' AS currency",
            "CASE WHEN l_orderkey % 101 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE l_extendedprice END AS price",
            "CASE WHEN l_linenumber = 1 THEN 'n/a' ELSE CAST(l_partkey AS STRING) END AS part_code",
            "'K' || CAST(l_orderkey AS STRING) AS order_ref",
        ],
    ),
    "gappy_lineitem": (
        "lineitem",
        [
            "l_orderkey",
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
            "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice",
            "CASE WHEN l_quantity > 40 THEN NULL ELSE l_discount END AS l_discount",
            "CASE WHEN l_suppkey % 5 < 3 THEN NULL ELSE l_tax END AS l_tax",
            "CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE l_returnflag END AS l_returnflag",
            "l_linestatus",
            "CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_shipdate END AS l_shipdate",
        ],
    ),
    "untidy_orders": (
        "orders",
        [
            "o_orderkey",
            "o_custkey",
            "CASE WHEN o_orderkey % 3 = 0 THEN '  ' || o_orderpriority || ' '"
            " WHEN o_orderkey % 3 = 1 THEN lower(o_orderpriority)"
            " ELSE o_orderpriority END AS priority_name",
            "CASE o_orderkey % 8 WHEN 0 THEN 'Yes' WHEN 1 THEN ' no' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'f'"
            " WHEN 4 THEN '1' WHEN 5 THEN 'Inactive' WHEN 6 THEN 'maybe' ELSE NULL END AS is_active",
            "CASE o_orderkey % 5"
            " WHEN 0 THEN substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 6, 2) || '/' ||"
            " substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 9, 2) || '/' ||"
            " substr(CAST(CAST(o_orderdate AS DATE) AS STRING), 1, 4)"
            " WHEN 1 THEN replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '/')"
            " WHEN 2 THEN 'invalid' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS order_date",
            "CASE WHEN o_orderkey % 6 = 0 THEN '-$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) || '.50'"
            " WHEN o_orderkey % 6 = 1 THEN '€' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) || ',250.75'"
            " WHEN o_orderkey % 6 = 2 THEN 'n/a'"
            " ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) END AS amount_text",
            "CASE WHEN o_orderkey % 4 = 0 THEN 'n/a' ELSE CAST(o_orderkey % 101 AS STRING) || '%' END AS discount_text",
            "CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS STRING) || ',000'"
            " WHEN o_orderkey % 4 = 1 THEN '+' || CAST(o_custkey AS STRING) || '.5'"
            " WHEN o_orderkey % 4 = 2 THEN '12 units' ELSE CAST(o_custkey AS STRING) END AS count_text",
            "CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey AS STRING) || ' g'"
            " WHEN o_orderkey % 5 = 1 THEN CAST(o_custkey AS STRING) || 'lbs'"
            " WHEN o_orderkey % 5 = 2 THEN CAST(o_custkey AS STRING) || ' kg'"
            " WHEN o_orderkey % 5 = 3 THEN 'invalid' ELSE NULL END AS weight_text",
            "CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS STRING) || ' cm'"
            " WHEN o_orderkey % 4 = 1 THEN CAST(o_custkey AS STRING) || ' inches'"
            " WHEN o_orderkey % 4 = 2 THEN CAST(o_custkey AS STRING) || 'm'"
            " ELSE CAST(o_custkey AS STRING) || ' miles' END AS length_text",
            "CASE WHEN o_orderkey % 4 = 0 THEN ' User' || CAST(o_custkey AS STRING) || '@Example.COM '"
            " WHEN o_orderkey % 4 = 1 THEN 'user' || CAST(o_custkey AS STRING) || '@nodot'"
            " WHEN o_orderkey % 4 = 2 THEN 'not an address' ELSE 'a.b@mail.example.org' END AS email",
            "CASE WHEN o_orderkey % 5 = 0 THEN '+1 (555) 010-' || CAST(1000 + o_custkey % 9000 AS STRING)"
            " WHEN o_orderkey % 5 = 1 THEN '555.010.' || CAST(1000 + o_custkey % 9000 AS STRING)"
            " WHEN o_orderkey % 5 = 2 THEN '12-34' WHEN o_orderkey % 5 = 3 THEN 'none'"
            " ELSE '+44-' || CAST(o_custkey % 100 AS STRING) END AS phone",
            "CASE WHEN o_orderkey % 3 = 0 THEN '   ' WHEN o_orderkey % 3 = 1 THEN '' ELSE o_orderstatus END AS note",
            "CASE WHEN o_orderkey % 2 = 0 THEN 'o''neil abc1def ' || lower(o_orderpriority)"
            " ELSE 'SAN josé del ' || o_orderstatus END AS contact_name",
            "o_orderstatus",
            "o_totalprice",
        ],
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    base, exprs = DERIVED[name]
    return table(spark, folder, base).selectExpr(*exprs)


def derived_sql(name: str) -> str:
    base, exprs = DERIVED[name]
    return "(SELECT " + ", ".join(exprs) + f" FROM {base})"


def rounded(df: DataFrame, columns: list[str] | dict[str, int], digits: int = 4) -> DataFrame:
    """Round doubles for comparison; sums differ in their last bits by order."""
    places = columns if isinstance(columns, dict) else {c: digits for c in columns}
    return df.withColumns({c: F.round(F.col(c), d) for c, d in places.items()})


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
