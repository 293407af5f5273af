"""Duplicates of a table as one report, and values that are spellings of each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions.columns import ref, share, string_columns, value_counts
from tablewright.functions.components import components
from tablewright.operators.validate import row_keys
from tablewright.session import stored

# How alike spellings are, and the columns that are searched.
ALIKE = 0.88
FEWEST, MOST = 5, 200
GRAM = 2


def _folded(c: Column) -> Column:
    return F.lower(F.trim(c))


def _grams(text: Column) -> Column:
    """The text's runs of GRAM characters, ends marked, each with the number of its turn."""
    padded = F.concat(F.lit("\x02"), text, F.lit("\x03"))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(padded) - (GRAM - 1)))
    runs = F.array_sort(F.transform(starts, lambda i: F.substr(padded, i, F.lit(GRAM))))
    return F.transform(runs, lambda g, i: F.concat(g, F.lit(":"), (i - F.array_position(runs, g)).cast("string")))


def _steps(length: Column, alike: float) -> Column:
    """Edits between a text of this length and any that is alike."""
    return F.floor(length * F.lit((1 - alike) / alike) + 1e-9).cast("int")


def spelling_pairs(values: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(column, a, b, edits): values of a column whose edits are few for the longer one's length.

    ``values`` has column and value, each once, folded. Two such values share one of their
    rarest runs of two characters: k edits change at most 2k of them, so the first 2k + 1 in
    the order of rarity have one in common. Only pairs that share one are compared.
    """
    grams = values.select("column", "value", F.length("value").alias("size"), F.explode(_grams(F.col("value"))).alias("gram"))
    counts = grams.groupBy("column", "gram").agg(F.count(F.lit(1)).alias("n"))
    placed = grams.join(counts, ["column", "gram"])
    # the runs of one value
    rare = Window.partitionBy("column", "value").orderBy("n", "gram")
    kept = placed.withColumn("at", F.row_number().over(rare)).where(F.col("at") <= GRAM * _steps(F.col("size"), alike) + 1)
    kept = stored(kept.select("column", "gram", "value", "size"), "rare-runs")
    other = kept.select(F.col("column").alias("c"), F.col("gram").alias("g"), F.col("value").alias("b"), F.col("size").alias("size_b"))
    near = F.least("size", "size_b") >= F.greatest("size", "size_b") * F.lit(alike) - 1e-9
    met = kept.join(other, (F.col("column") == F.col("c")) & (F.col("gram") == F.col("g")) & (F.col("value") < F.col("b")) & near)
    pairs = met.select("column", F.col("value").alias("a"), "b").distinct()
    most = F.floor(F.greatest(F.length("a"), F.length("b")) * F.lit(1 - alike) + 1e-9)
    return pairs.withColumn("edits", F.levenshtein("a", "b")).where(F.col("edits") <= most)


def spelling_groups(df: DataFrame, columns: Sequence[str], alike: float = ALIKE) -> DataFrame:
    """(column, value, n, group): values that are alike, or joined by others that are.

    Blanks at the ends and case are not edits. ``group`` names the group by its most
    frequent value, the first by name among equals. Columns of 5 to 200 values are searched.
    """
    counts = value_counts(df.select(*[F.nullif(F.trim(ref(c).cast("string")), F.lit("")).alias(c) for c in columns]), columns)
    sizes = counts.groupBy("column").agg(F.count(F.lit(1)).alias("k")).where(F.col("k").between(FEWEST, MOST))
    counts = stored(counts.join(sizes, "column", "left_semi").withColumn("folded", _folded(F.col("value"))), "spellings")
    node = F.concat_ws("\x01", "column", "folded")
    pairs = spelling_pairs(counts.select("column", F.col("folded").alias("value")).distinct(), alike)
    edges = pairs.select(F.concat_ws("\x01", "column", "a").alias("a"), F.concat_ws("\x01", "column", "b").alias("b"))
    found = components(edges)
    placed = counts.withColumn("node", node).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # values of one group; at most 200 in a column
    group = Window.partitionBy("column", "component")
    named = placed.withColumns(
        {
            "group": F.first("value").over(group.orderBy(F.desc("n"), "value")),
            "members": F.count(F.lit(1)).over(group),
        }
    )
    return named.where("members > 1").select("column", "value", "n", "group")


def duplicate_report(df: DataFrame, keys: Sequence[str] = (), dimensions: Sequence[str] | None = None) -> DataFrame:
    """(kind, column, groups, affected, share, risk): what a table holds more than once.

    rows: equal rows, the first of each aside. keys: rows that repeat the key columns, a
    null being equal to a null. spellings: per column the groups of values that are alike,
    with all their rows. Kinds without a find have no row.
    """
    total = df.agg(F.count(F.lit(1))).scalar()

    def repeated(kind: str, columns: Sequence[str], risk: str) -> DataFrame:
        parts = row_keys(df, columns)
        same = df.select(*parts).groupBy(*[f"_{i}" for i in range(len(parts))]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        found = same.agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") - 1).alias("affected")).where("affected > 0")
        name = F.lit(columns[0] if kind == "keys" and len(columns) == 1 else None).cast("string")
        return found.select(F.lit(kind).alias("kind"), name.alias("column"), "groups", "affected", F.lit(risk).alias("risk"))

    out = repeated("rows", df.columns, "low")
    if keys:
        out = out.unionByName(repeated("keys", list(keys), "high"))
    columns = string_columns(df) if dimensions is None else list(dimensions)
    if columns:
        alike = spelling_groups(df, columns).groupBy("column").agg(
            F.count_distinct("group").alias("groups"), F.sum("n").alias("affected")
        )
        out = out.unionByName(alike.select(F.lit("spellings").alias("kind"), "column", "groups", "affected", F.lit("medium").alias("risk")))
    return out.select("kind", "column", "groups", "affected", share(F.col("affected"), total).alias("share"), "risk")

