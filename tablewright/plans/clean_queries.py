"""Queries for the cleaning steps; each on derived dirt, with what DuckDB makes of the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import text
from tablewright.functions.columns import ref
from tablewright.operators import clean
from tablewright.plans.registry import Registry, derived, derived_sql, rounded, table, union_all
from tablewright.plans.table_queries import COPIES, with_copies

QUERIES = Registry()
ORDERS = derived_sql("untidy_orders")
GAPPY = derived_sql("gappy_lineitem")
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def orders(spark, folder, *columns):
    return derived(spark, folder, "untidy_orders").select("o_orderkey", *columns)


def tidy(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@QUERIES.add("drop_duplicate_rows", f"SELECT DISTINCT * FROM {COPIES}")
def drop_duplicate_rows(spark, folder):
    return clean.drop_duplicate_rows(with_copies(spark, folder))


@QUERIES.add(
    "audit_drop_duplicates",
    "SELECT 'drop_duplicates' AS action, CAST(NULL AS VARCHAR) AS \"column\","
    f" (SELECT count(*) FROM {COPIES}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {COPIES})) AS rows_affected",
)
def audit_drop_duplicates(spark, folder):
    copies = with_copies(spark, folder)
    return clean.audit_rows(copies, clean.drop_duplicate_rows(copies), "drop_duplicates")


@QUERIES.add(
    "normalize_headers",
    "SELECT p_partkey AS part_key, p_name AS name, p_brand AS name_2, p_type AS Name_3, p_size AS size FROM part",
)
def normalize_headers(spark, folder):
    part = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return clean.normalize_headers(part.toDF(" part  key!", "name", "name?", "Name", "(size)"))


@QUERIES.add(
    "infer_cast_datetime",
    "SELECT o_orderkey, d AS order_date, email, CASE WHEN d IS NULL THEN order_date END AS order_date_unparsed FROM (SELECT *,"
    " CAST(coalesce(try_strptime(order_date, '%m/%d/%Y'), try_strptime(order_date, '%d/%m/%Y'),"
    f" try_strptime(order_date, '%Y/%m/%d'), try_strptime(order_date, '%Y-%m-%d')) AS TIMESTAMP) AS d FROM {ORDERS})",
)
def infer_cast_datetime(spark, folder):
    return clean.infer_cast_datetime(orders(spark, folder, "order_date", "email"))


@QUERIES.add(
    "infer_cast_numeric",
    "SELECT o_orderkey, TRY_CAST(replace(replace(part, '$', ''), ',', '') AS DOUBLE) AS part, CASE WHEN part = 'n/a' THEN part END AS part_unparsed, code FROM (SELECT o_orderkey,"
    " CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE '$' || o_custkey || ',000' END AS part, 'K' || o_custkey AS code FROM orders)",
)
def infer_cast_numeric(spark, folder):
    rows = table(spark, folder, "orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE '$' || o_custkey || ',000' END AS part",
        "'K' || o_custkey AS code",
    )
    return clean.infer_cast_numeric(rows)


@QUERIES.add(
    "impute_median",
    f"WITH g AS (SELECT * FROM {GAPPY}), m AS (SELECT median(l_quantity) AS a, median(l_discount) AS b FROM g)"
    f" SELECT {', '.join(KEYS)}, coalesce(l_quantity, a) AS l_quantity, round(coalesce(l_discount, b), 6) AS l_discount FROM g, m",
)
def impute_median(spark, folder):
    rows = derived(spark, folder, "gappy_lineitem").select(*KEYS, "l_quantity", "l_discount")
    return rounded(clean.impute_median(rows, ["l_quantity", "l_discount"]), ["l_discount"], 6)


@QUERIES.add(
    "impute_mode",
    f"WITH g AS (SELECT * FROM {GAPPY}), m AS (SELECT l_returnflag AS v FROM g WHERE l_returnflag IS NOT NULL"
    " GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    f" SELECT {', '.join(KEYS)}, coalesce(l_returnflag, v) AS l_returnflag FROM g, m",
)
def impute_mode(spark, folder):
    rows = derived(spark, folder, "gappy_lineitem").select(*KEYS, "l_returnflag")
    return clean.impute_mode(rows, ["l_returnflag"])


FILLED = (
    "SELECT event_id, user_id, round(coalesce(last_value(v IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),"
    " first_value(v IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS v FROM"
    " (SELECT event_id, user_id, CASE WHEN event_id % 3 < 2 THEN NULL ELSE value END AS v FROM events)"
)


def gappy_events(spark, folder):
    return table(spark, folder, "events").selectExpr(
        "event_id", "user_id", "CASE WHEN event_id % 3 < 2 THEN NULL ELSE value END AS v"
    )


@QUERIES.add("impute_ffill_bfill", FILLED + " WINDOW w AS (ORDER BY event_id)")
def impute_ffill_bfill(spark, folder):
    return rounded(clean.impute_ffill_bfill(gappy_events(spark, folder), "v", ["event_id"]), ["v"], 6)


@QUERIES.add("impute_ffill_bfill_keyed", FILLED + " WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def impute_ffill_bfill_keyed(spark, folder):
    return rounded(clean.impute_ffill_bfill(gappy_events(spark, folder), "v", ["event_id"], ["user_id"]), ["v"], 6)


@QUERIES.add(
    "clip_iqr",
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders)"
    " SELECT o_orderkey, round(least(greatest(o_totalprice, a - 0.1 * (b - a)), b + 0.1 * (b - a)), 4) AS o_totalprice FROM orders, q",
)
def clip_iqr(spark, folder):
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return rounded(clean.clip_iqr(rows, ["o_totalprice"], 0.1), ["o_totalprice"])


@QUERIES.add(
    "trim_collapse_whitespace",
    f"SELECT o_orderkey, {tidy('priority_name')} AS priority_name, {tidy('note')} AS note FROM {ORDERS}",
)
def trim_collapse_whitespace(spark, folder):
    return clean.trim_collapse_whitespace(orders(spark, folder, "priority_name", "note"), ["priority_name", "note"])


@QUERIES.add("empty_to_null", f"SELECT o_orderkey, CASE WHEN {tidy('note')} <> '' THEN note END AS note FROM {ORDERS}")
def empty_to_null(spark, folder):
    return clean.empty_to_null(orders(spark, folder, "note"), ["note"])


TRUE, FALSE = (", ".join(f"'{t}'" for t in tokens) for tokens in (text.TRUE_TOKENS, text.FALSE_TOKENS))
BOOLEAN = f"CASE WHEN lower({tidy('is_active')}) IN ({TRUE}) THEN true WHEN lower({tidy('is_active')}) IN ({FALSE}) THEN false END"


@QUERIES.add(
    "normalize_boolean",
    "SELECT o_orderkey, b AS is_active, CASE WHEN b IS NULL THEN is_active END AS is_active_unparsed FROM"
    f" (SELECT o_orderkey, is_active, {BOOLEAN} AS b FROM {ORDERS})",
)
def normalize_boolean(spark, folder):
    return clean.normalize_boolean(orders(spark, folder, "is_active"), ["is_active"])


CURRENCY = "TRY_CAST(regexp_replace({0}, '[$,€£%\\s+-]', '', 'g') AS DOUBLE) * CASE WHEN contains({0}, '-') THEN -1 ELSE 1 END"
AUDITS = union_all(
    [
        "SELECT 'normalize' AS action, 'is_active' AS \"column\","
        f" CAST(count(*) FILTER ({BOOLEAN} IS NOT NULL) AS BIGINT) AS rows_affected FROM {ORDERS}",
        f"SELECT 'normalize', 'amount_text', CAST(count({CURRENCY.format('amount_text')}) AS BIGINT) FROM {ORDERS}",
        f"SELECT 'normalize', 'priority_name', CAST(count(*) FILTER (priority_name IS DISTINCT FROM {tidy('priority_name')}) AS BIGINT) FROM {ORDERS}",
    ]
)


@QUERIES.add("audit_changes", AUDITS)
def audit_changes(spark, folder):
    rows = orders(spark, folder, "is_active", "amount_text", "priority_name")
    changes = {
        "is_active": text.as_boolean(ref("is_active")),
        "amount_text": text.as_currency(ref("amount_text")),
        "priority_name": text.tidy_spaces(ref("priority_name")),
    }
    return clean.audit(rows, "normalize", changes)


DATE = (
    "coalesce(try_strptime(order_date, '%m/%d/%Y'), try_strptime(order_date, '%d/%m/%Y'),"
    " try_strptime(order_date, '%Y/%m/%d'), try_strptime(order_date, '%Y-%m-%d'))"
)


@QUERIES.add(
    "normalize_date",
    f"SELECT o_orderkey, CAST({DATE} AS TIMESTAMP) AS order_date,"
    f" CASE WHEN {DATE} IS NULL THEN order_date END AS order_date_unparsed FROM {ORDERS}",
)
def normalize_date(spark, folder):
    return clean.normalize_date(orders(spark, folder, "order_date"), ["order_date"])


@QUERIES.add(
    "standardize_case",
    "SELECT o_orderkey, list_aggregate(list_transform(regexp_extract_all(contact_name, '(\\p{L}+|\\P{L}+)'),"
    " lambda p: upper(p[1]) || lower(p[2:])), 'string_agg', '') AS contact_name,"
    f" upper(o_orderstatus) AS o_orderstatus, lower(email) AS email FROM {ORDERS}",
)
def standardize_case(spark, folder):
    rows = orders(spark, folder, "contact_name", "o_orderstatus", "email")
    styles = {"contact_name": "title", "o_orderstatus": "upper", "email": clean.case_style("email")}
    return clean.standardize_case(rows, styles)


def parsed_sql(column: str, value: str) -> str:
    return (
        f"SELECT o_orderkey, round(x, 6) AS {column}, CASE WHEN x IS NULL THEN {column} END AS {column}_unparsed"
        f" FROM (SELECT o_orderkey, {column}, {value} AS x FROM {ORDERS})"
    )


@QUERIES.add("parse_currency", parsed_sql("amount_text", CURRENCY.format("amount_text")))
def parse_currency(spark, folder):
    return rounded(clean.parse_currency(orders(spark, folder, "amount_text"), ["amount_text"]), ["amount_text"], 6)


@QUERIES.add(
    "parse_percent",
    parsed_sql("discount_text", "CASE WHEN suffix(discount_text, '%') THEN TRY_CAST(replace(discount_text, '%', '') AS DOUBLE) / 100 END"),
)
def parse_percent(spark, folder):
    return rounded(clean.parse_percent(orders(spark, folder, "discount_text"), ["discount_text"]), ["discount_text"], 6)


NUMBER = "CASE WHEN regexp_matches(replace(count_text, ',', ''), '^[+-]?\\d+(\\.\\d+)?$') THEN TRY_CAST(replace(count_text, ',', '') AS DOUBLE) END"


@QUERIES.add("parse_numeric", parsed_sql("count_text", NUMBER))
def parse_numeric(spark, folder):
    return rounded(clean.parse_numeric(orders(spark, folder, "count_text"), ["count_text"]), ["count_text"], 6)


STATUS = "CASE WHEN lower(o_orderstatus) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(o_orderstatus) IN ('false', 'f', 'no', 'n', '0') THEN false END"


@QUERIES.add(
    "convert_type",
    "SELECT o_orderkey, b AS o_orderstatus, CASE WHEN b IS NULL THEN o_orderstatus END AS o_orderstatus_unparsed,"
    " round(n, 6) AS count_text, CASE WHEN n IS NULL THEN count_text END AS count_text_unparsed, email FROM"
    f" (SELECT o_orderkey, o_orderstatus, count_text, email, {STATUS} AS b, {NUMBER} AS n FROM {ORDERS})",
)
def convert_type(spark, folder):
    rows = orders(spark, folder, "o_orderstatus", "count_text", "email")
    return rounded(clean.convert_type(rows, ["o_orderstatus", "count_text", "email"]), ["count_text"], 6)


def unit_sql(column: str, factors: str) -> str:
    number = f"TRY_CAST(regexp_extract(lower(trim({column})), '^\\s*([0-9.]+)\\s*([a-z\\s]+)\\s*$', 1) AS DOUBLE)"
    unit = f"trim(regexp_extract(lower(trim({column})), '^\\s*([0-9.]+)\\s*([a-z\\s]+)\\s*$', 2))"
    return f"{number} * CASE {unit} {factors} END"


WEIGHT = unit_sql("weight_text", "WHEN 'g' THEN 0.001 WHEN 'lbs' THEN 1 / 2.20462 WHEN 'kg' THEN 1.0")
LENGTH = unit_sql("length_text", "WHEN 'cm' THEN 0.01 WHEN 'inches' THEN 0.0254 WHEN 'm' THEN 1.0")


@QUERIES.add(
    "standardize_units",
    "SELECT o_orderkey, round(w, 6) AS weight_text, CASE WHEN w IS NULL THEN weight_text END AS weight_text_unparsed,"
    " round(l, 6) AS length_text, CASE WHEN l IS NULL THEN length_text END AS length_text_unparsed FROM"
    f" (SELECT o_orderkey, weight_text, length_text, {WEIGHT} AS w, {LENGTH} AS l FROM {ORDERS})",
)
def standardize_units(spark, folder):
    rows = clean.standardize_units(orders(spark, folder, "weight_text", "length_text"), ["weight_text", "length_text"])
    return rounded(rows, ["weight_text", "length_text"], 6)


@QUERIES.add(
    "validate_email",
    "SELECT o_orderkey, CASE WHEN regexp_matches(lower(trim(email)), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')"
    f" THEN lower(trim(email)) END AS email FROM {ORDERS}",
)
def validate_email(spark, folder):
    return clean.validate_email(orders(spark, folder, "email"), ["email"])


DIGITS = "regexp_replace(phone, '[^0-9]', '', 'g')"


@QUERIES.add(
    "normalize_phone",
    f"SELECT o_orderkey, CASE WHEN {DIGITS} = '' THEN phone WHEN prefix(regexp_replace(phone, '[^0-9+]', '', 'g'), '+')"
    f" THEN CASE WHEN length({DIGITS}) BETWEEN 7 AND 15 THEN '+' || {DIGITS} ELSE {DIGITS} END"
    f" WHEN length({DIGITS}) BETWEEN 7 AND 15 THEN {DIGITS} ELSE phone END AS phone FROM {ORDERS}",
)
def normalize_phone(spark, folder):
    return clean.normalize_phone(orders(spark, folder, "phone"), ["phone"])


@QUERIES.add(
    "missingness_indicator",
    f"SELECT {', '.join(KEYS)}, l_quantity, coalesce(l_returnflag, 'Unknown') AS l_returnflag,"
    f" l_quantity IS NULL AS l_quantity_is_missing, l_returnflag IS NULL AS l_returnflag_is_missing FROM {GAPPY}",
)
def missingness_indicator(spark, folder):
    rows = derived(spark, folder, "gappy_lineitem").select(*KEYS, "l_quantity", "l_returnflag")
    return clean.missingness_indicator(rows, ["l_quantity", "l_returnflag"])


@QUERIES.add("drop_columns", "SELECT p_partkey, p_name, p_type, p_size FROM part")
def drop_columns(spark, folder):
    return clean.drop_columns(table(spark, folder, "part"), ["p_brand", "p_retailprice"])


ISSUE_ROWS = union_all(
    [
        "SELECT 'nulls_is_active' AS id, 'is_active' AS \"column\", 'warning' AS severity, 'missingness_indicator' AS action,"
        f" count(*) - count(is_active) AS affected FROM {ORDERS}",
        f"SELECT 'nulls_note', 'note', 'warning', 'missingness_indicator', count(*) FILTER (trim(note) = '') FROM {ORDERS}",
        f"SELECT 'whitespace_note', 'note', 'info', 'strip_whitespace', count(*) FILTER (note <> trim(note)) FROM {ORDERS}",
        f"SELECT 'empty_note', 'note', 'info', 'empty_to_null', count(*) FILTER (trim(note) = '') FROM {ORDERS}",
        f"SELECT 'whitespace_is_active', 'is_active', 'info', 'strip_whitespace', count(*) FILTER (is_active <> trim(is_active)) FROM {ORDERS}",
        "SELECT 'convert_is_active', 'is_active', 'info', 'convert_type', count(*) FILTER (lower(trim(is_active)) IN"
        f" ('yes', 'no', 'true', 'f', '1')) FROM {ORDERS}",
        f"SELECT 'convert_order_date', 'order_date', 'info', 'convert_type', count(*) FILTER (order_date <> 'invalid') FROM {ORDERS}",
    ]
)


@QUERIES.add("detect_cleaning_issues", ISSUE_ROWS + "\nUNION ALL SELECT 'convert_note', 'note', 'info', 'convert_type', f FROM"
    f" (SELECT count(*) FILTER (note = 'F') AS f, count(*) FILTER (trim(note) <> '') AS n FROM {ORDERS}) WHERE f >= greatest(2, 0.3 * n)")
def detect_cleaning_issues(spark, folder):
    return clean.detect_cleaning_issues(orders(spark, folder, "is_active", "order_date", "note"))


@QUERIES.add(
    "apply_approved",
    f"SELECT o_orderkey, CASE WHEN {tidy('note')} <> '' THEN {tidy('note')} END AS note,"
    f" lower({tidy('priority_name')}) AS priority_name FROM {ORDERS}",
)
def apply_approved(spark, folder):
    steps = [("strip_whitespace", "note"), ("empty_to_null", "note"), ("standardize_case", "priority_name"), ("drop_duplicates", None)]
    decisions = {s: "agreed" for s in steps}
    return clean.apply_approved(orders(spark, folder, "note", "priority_name"), steps, decisions)
