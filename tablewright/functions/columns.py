"""Choosing columns and turning wide aggregates into one row per column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """Reference a column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """The column as double, NaN as null."""
    x = ref(name).cast("double")
    return F.when(~F.isnan(x), x)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def integer_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def temporal_columns(df: DataFrame) -> list[str]:
    kinds = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def per_column(
    df: DataFrame,
    columns: Sequence[str],
    measures: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """One row per column, all measures taken in a single pass over ``df``.

    Every measure must have the same type for every column.
    """
    structs = [
        F.struct(F.lit(c).alias("column"), *[fn(ref(c)).alias(k) for k, fn in measures.items()])
        for c in columns
    ]
    return df.agg(F.array(*structs).alias("rows")).select(F.inline("rows"))


def long_values(
    df: DataFrame, columns: Sequence[str], kind: str = "string", keep: Sequence[str] = ()
) -> DataFrame:
    """(keep..., column, value) with null values left out."""
    cast = df.select(*[ref(k) for k in keep], *[ref(c).cast(kind).alias(c) for c in columns])
    return cast.unpivot([ref(k) for k in keep], [ref(c) for c in columns], "column", "value").where(
        F.col("value").isNotNull()
    )


def value_counts(
    df: DataFrame, columns: Sequence[str], kind: str = "string", keep: Sequence[str] = ()
) -> DataFrame:
    """(keep..., column, value, n): map-side combined, so a hot value is one row per task."""
    return (
        long_values(df, columns, kind, keep)
        .groupBy(*keep, "column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact (column, distinct) by two grouped counts, without the row copies of
    several ``count_distinct`` in one aggregate."""
    return value_counts(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("distinct"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def count_if(condition: Column) -> Column:
    return F.count_if(condition)


def with_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach the single row of ``one_row`` as a struct column.

    It is a scalar subquery: Spark runs it once, checks that it has one row and
    plugs the values in, so there is no join.
    """
    bundle = one_row.select(F.struct("*").alias(name)).scalar()
    return df.withColumn(name, bundle)
