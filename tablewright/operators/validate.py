"""Structural checks. Each returns issue rows (id, column, severity, affected,
share, description, action); a clean table returns none."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import (
    count_if,
    float_columns,
    per_column,
    ref,
    share,
    string_columns,
    value_counts,
)
from tablewright.functions.text import guarded_double, tidy_spaces

NULL_SHARE = 0.40
MANY_VALUES = 100
MANY_VALUES_SHARE = 0.5
BAD_HEADER = re.compile(r"[?!#@$%^*()]")


def _issues(
    found: DataFrame, prefix: str, severity: str, what: str, action: str, column: Column | None = None
) -> DataFrame:
    """Shape (column, affected, share) rows into issue rows."""
    name = F.col("column") if column is None else column
    label = F.lit(prefix) if column is not None else F.concat(F.lit(prefix + "_"), F.col("column"))
    return found.select(
        label.alias("id"),
        name.cast("string").alias("column"),
        F.lit(severity).alias("severity"),
        F.col("affected").cast("long").alias("affected"),
        F.col("share").cast("double").alias("share"),
        F.format_string(
            what, F.coalesce(name.cast("string"), F.lit("table")), F.col("affected"), F.col("share") * 100
        ).alias("description"),
        F.lit(action).alias("action"),
    )


def check_empty(df: DataFrame) -> DataFrame:
    rows = df.limit(1).agg(F.count(F.lit(1)).alias("affected"))
    empty = rows.where((F.col("affected") == 0) | F.lit(len(df.columns) == 0))
    return _issues(
        empty.withColumn("share", F.lit(1.0)),
        "empty",
        "critical",
        "%s has no rows or no columns (%d rows, %.0f%% missing)",
        "reject",
        F.lit(None),
    )


def check_headers(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Unnamed, repeated and unsuitable headers.

    ``names`` are the headers as written when they differ from ``df.columns``
    (a file with repeated headers is read without them first).
    """
    names = list(df.columns if names is None else names)
    stripped = [n.strip() for n in names]
    unnamed = [n for n in names if "Unnamed:" in n]
    repeated = sorted({n for n in stripped if stripped.count(n) > 1})
    odd = [n for n in names if not n.strip() or BAD_HEADER.search(n)]
    found = [
        ("missing_headers", unnamed, "medium", "rename_headers"),
        ("duplicate_headers", repeated, "critical", "reject"),
        ("invalid_names", odd, "low", "normalize_names"),
    ]
    rows = [
        F.struct(
            F.lit(kind).alias("id"),
            F.lit(cols[0]).alias("column"),
            F.lit(severity).alias("severity"),
            F.lit(len(cols)).cast("long").alias("affected"),
            F.lit(len(cols) / len(names)).alias("share"),
            F.lit(f"headers {cols} of {len(names)}").alias("description"),
            F.lit(action).alias("action"),
            F.col("rows"),
        )
        for kind, cols, severity, action in found
        if cols
    ]
    counted = df.agg(F.count(F.lit(1)).alias("rows"))
    if not rows:
        return _issues(
            counted.where(F.lit(False)).select(F.lit(0).alias("affected"), F.lit(0.0).alias("share")),
            "headers", "low", "%s %d %.0f", "none", F.lit(None),
        ).withColumn("rows", F.lit(0).cast("long"))
    return counted.select(F.inline(F.array(*rows)))


def digest(text: Column) -> Column:
    """Stands for a text as a key in a shuffle: SHA-256, null for null."""
    return F.sha2(text.cast("binary"), 256)


def _spelled(df: DataFrame, name: str) -> Column | None:
    """The column as text that differs where values differ; null for kinds that have no such text."""
    kind, c = df.schema[name].dataType, ref(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (c + F.lit(0.0).cast(kind)).cast("string")  # both zeros are equal
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    return None if isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) else c.cast("string")


def row_keys(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """Keys that are equal where rows are equal in ``columns``, nulls included: one digest of 32 bytes if it can be.

    Each value is written with its length before it, so no two rows are written alike.
    """
    names = list(df.columns if columns is None else columns)
    texts = [_spelled(df, c) for c in names]
    if any(t is None for t in texts):
        own = set(string_columns(df))
        return [(digest(ref(c)) if c in own else ref(c)).alias(f"_{i}") for i, c in enumerate(names)]
    parts = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return [F.unhex(digest(F.concat(*parts))).alias("_0")]


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, surplus): surplus is the number of exact copies beyond the first."""
    keys = row_keys(df)
    groups = df.select(*keys).groupBy(*[f"_{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus"),
    )


def check_duplicate_rows(df: DataFrame) -> DataFrame:
    found = duplicate_rows(df).select(
        F.col("surplus").alias("affected"), share(F.col("surplus"), F.col("rows")).alias("share")
    )
    return _issues(
        found.where("affected > 0"),
        "duplicate_rows",
        "medium",
        "%s holds %d exact copies of rows (%.1f%%)",
        "deduplicate",
        F.lit(None),
    )


def _counted(df: DataFrame, columns: list[str], condition) -> DataFrame:
    """(column, rows, affected, share) for one condition per column, in one pass."""
    stats = per_column(
        df,
        columns,
        {"rows": lambda c: F.count(F.lit(1)), "affected": lambda c: count_if(condition(c))},
    )
    return stats.withColumn("share", share(F.col("affected"), F.col("rows")))


def check_excessive_nulls(df: DataFrame, limit: float = NULL_SHARE) -> DataFrame:
    found = _counted(df, df.columns, lambda c: c.isNull()).where(F.col("share") > limit)
    return _issues(
        found, "excessive_nulls", "high", "%s is null in %d rows (%.1f%%)", "drop_or_impute"
    )


def check_constant(df: DataFrame) -> DataFrame:
    """One distinct non-null value: its minimum equals its maximum."""
    stats = per_column(
        df,
        df.columns,
        {
            "affected": lambda c: F.count(c),
            "rows": lambda c: F.count(F.lit(1)),
            "same": lambda c: F.min(c) == F.max(c),
        },
    ).withColumn("share", share(F.col("affected"), F.col("rows")))
    return _issues(
        stats.where("same"), "constant", "low", "%s has a single value in %d rows (%.1f%%)", "drop_column"
    )


def check_high_cardinality(df: DataFrame) -> DataFrame:
    """Text columns of mostly different values, by exact counts of all of them."""
    columns = string_columns(df)
    if not columns:
        return check_empty(df).limit(0)
    digests = df.select(*[digest(ref(c)).alias(c) for c in columns])
    counts = value_counts(digests, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("affected"), F.sum("n").alias("present")
    )
    found = counts.withColumn("share", share(F.col("affected"), F.col("present"))).where(
        (F.col("affected") > MANY_VALUES) & (F.col("share") > MANY_VALUES_SHARE)
    )
    return _issues(
        found, "high_cardinality", "low", "%s has %d distinct texts (%.1f%% of its values)", "flag_high_cardinality"
    )


def check_infinite(df: DataFrame) -> DataFrame:
    columns = float_columns(df)
    if not columns:
        return check_empty(df).limit(0)
    found = _counted(df, columns, lambda c: F.abs(c) == F.lit(float("inf"))).where("affected > 0")
    return _issues(found, "infinite", "high", "%s is infinite in %d rows (%.1f%%)", "replace_infinite")


def check_mixed_types(df: DataFrame) -> DataFrame:
    """Text columns in which some values are numbers and some are not."""
    columns = string_columns(df)
    if not columns:
        return check_empty(df).limit(0)
    stats = per_column(
        df,
        columns,
        {
            "present": lambda c: F.count(c),
            "affected": lambda c: F.count(guarded_double(c)),
        },
    ).withColumn("share", share(F.col("affected"), F.col("present")))
    found = stats.where((F.col("share") > 0) & (F.col("share") < 1))
    return _issues(found, "mixed_types", "medium", "%s holds %d numbers among texts (%.1f%%)", "cast_types")


def check_metadata_rows(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Leading rows that are mostly empty look like report headers."""
    empties = reduce(
        lambda a, b: a + b,
        [F.coalesce(tidy_spaces(ref(c).cast("string")) == "", F.lit(True)).cast("int") for c in df.columns],
    )
    first = df.orderBy(*[ref(o) for o in order_by]).limit(3)
    found = first.agg(
        F.count_if(empties > 0.6 * len(df.columns)).alias("affected"),
        F.count(F.lit(1)).alias("rows"),
    ).withColumn("share", share(F.col("affected"), F.col("rows")))
    return _issues(
        found.where("affected >= 2"),
        "metadata_rows",
        "medium",
        "%s starts with %d mostly empty rows (%.0f%% of the first three)",
        "treat_as_metadata",
        F.lit(None),
    )


def validate(df: DataFrame) -> DataFrame:
    """All data checks as one issue table.

    What a value shows by itself is counted for all columns in one aggregate; copies of
    rows and distinct texts take a pass each.
    """
    floats, texts = set(float_columns(df)), set(string_columns(df))

    def of(c: str) -> Column:
        x = ref(c)
        none = F.lit(0).cast("long")
        return F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            F.count(x).alias("present"),
            (F.min(x) == F.max(x)).alias("same"),
            (count_if(F.abs(x) == F.lit(float("inf"))) if c in floats else none).alias("infinite"),
            (F.count(guarded_double(x)) if c in texts else none).alias("numbers"),
        )

    stats = df.agg(F.array(*[of(c) for c in df.columns]).alias("s")).select(F.inline("s"))
    nulls = F.col("rows") - F.col("present")
    rules = [
        ("excessive_nulls", "high", "drop_or_impute", nulls, F.col("rows"), share(nulls, F.col("rows")) > NULL_SHARE),
        ("constant", "low", "drop_column", F.col("present"), F.col("rows"), F.col("same")),
        ("infinite", "high", "replace_infinite", F.col("infinite"), F.col("rows"), F.col("infinite") > 0),
        ("mixed_types", "medium", "cast_types", F.col("numbers"), F.col("present"),
         (F.col("numbers") > 0) & (F.col("numbers") < F.col("present"))),
    ]
    found = F.array(
        *[
            F.struct(
                F.concat(F.lit(f"{kind}_"), "column").alias("id"),
                F.col("column"),
                F.lit(severity).alias("severity"),
                part.cast("long").alias("affected"),
                share(part, whole).alias("share"),
                F.concat("column", F.lit(f": {kind}, "), part.cast("string"), F.lit(" values")).alias("description"),
                F.lit(action).alias("action"),
                F.coalesce(hit, F.lit(False)).alias("hit"),
            )
            for kind, severity, action, part, whole, hit in rules
        ]
    )
    by_column = stats.select(F.inline(found)).where("hit").drop("hit")
    checks = [check_empty(df), by_column, check_duplicate_rows(df), check_high_cardinality(df)]
    return reduce(lambda a, b: a.unionByName(b), checks)


def dataset_status(issues: DataFrame) -> DataFrame:
    """invalid with a critical issue, warning with a medium or high one, else valid."""
    count = issues.agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity").isin("medium", "high")).alias("serious"),
        F.count(F.lit(1)).alias("issues"),
    )
    return count.select(
        F.when(F.col("critical") > 0, "invalid")
        .when(F.col("serious") > 0, "warning")
        .otherwise("valid")
        .alias("status"),
        F.when(F.col("critical") > 0, "critical")
        .when(F.col("serious") > 0, "medium")
        .otherwise("low")
        .alias("severity"),
        "issues",
    )
