"""Keys, dependencies and integrity, on all rows and all columns the caller names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import ref, value_counts
from tablewright.operators.profile import _keyed


def unique_columns(df: DataFrame) -> DataFrame:
    """(column, rows, present, distinct, unique, candidate_key) of every column."""
    rows = df.agg(F.count(F.lit(1))).scalar()
    counts = value_counts(_keyed(df), df.columns).groupBy("column").agg(
        F.sum("n").alias("present"), F.count(F.lit(1)).alias("distinct")
    )
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    known = names.join(counts, "column", "left").fillna(0, ["present", "distinct"])
    unique = (F.col("present") == F.col("distinct")) & (F.col("present") > 0)
    return known.select(
        "column", rows.alias("rows"), "present", "distinct", unique.alias("unique"),
        (unique & (F.col("present") == rows)).alias("candidate_key"),
    )


def primary_key(df: DataFrame) -> DataFrame:
    """The preferred candidate key: one named id or key, then the last named ..._id or ..._key, else the first."""
    order = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    name = F.lower("column")
    preference = F.when(name.isin("id", "key"), 0).when(name.rlike("(_id|_key|key)$"), 1).otherwise(2)
    at = order[F.col("column")]
    candidates = unique_columns(df).where("candidate_key").select(
        "column", preference.alias("p"), F.when(preference == 1, -at).otherwise(at).alias("at")
    )
    return candidates.agg(F.min_by("column", F.struct("p", "at")).alias("column")).where("column IS NOT NULL")


def column_facts(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, int]]:
    """column -> (distinct, present): a row per column."""
    counts = value_counts(_keyed(df.select(*[ref(c) for c in columns])), columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("present")
    )
    found = {r["column"]: (r["distinct"], r["present"]) for r in counts.collect()}
    return {c: found.get(c, (0, 0)) for c in columns}


def composite_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b): pairs of the named columns that are unique together and hold no nulls.

    A pair can only be unique if its columns have enough distinct values for all rows, and
    is if one of them is unique by itself; only the others are counted, in one pass over the
    rows, each row sending one digest per such pair.
    """
    spark = df.sparkSession
    facts, rows = column_facts(df, columns), df.count()
    whole = [c for c in columns if facts[c][1] == rows and rows]
    pairs = [(a, b) for a, b in combinations(whole, 2) if facts[a][0] * facts[b][0] >= rows]
    known = [p for p in pairs if rows in (facts[p[0]][0], facts[p[1]][0])]
    out = spark.createDataFrame(known, "a string, b string")
    open_ = [p for p in pairs if p not in set(known)]
    if not open_:
        return out

    def key(a: str, b: str) -> Column:
        return F.sha2(F.to_json(F.struct(ref(a).alias("a"), ref(b).alias("b"))).cast("binary"), 256)

    entries = F.array(*[F.struct(F.lit(i).alias("pair"), key(a, b).alias("k")) for i, (a, b) in enumerate(open_)])
    distinct = df.select(F.inline(entries)).groupBy("pair", "k").agg(F.lit(1)).groupBy("pair").agg(F.count(F.lit(1)).alias("distinct"))
    names = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in open_])
    counted = distinct.where(F.col("distinct") == rows)
    return out.unionByName(counted.select(names[F.col("pair")]["a"].alias("a"), names[F.col("pair")]["b"].alias("b")))


def foreign_key_candidates(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """(column, rows, nulls, orphans): whether every value of ``column`` is in the parent's key."""
    counts = child.groupBy(ref(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(ref(key).alias("k")).distinct().withColumn("here", F.lit(True))
    met = counts.join(known, F.col("v") == F.col("k"), "left")
    total = F.coalesce(F.sum("n"), F.lit(0))
    return met.agg(
        F.lit(column).alias("column"),
        total.alias("rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.coalesce(F.sum(F.when(F.col("v").isNotNull() & F.col("here").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
    )


def functional_dependencies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(determinant, dependent): every value of the first goes with one value of the second.

    Determinants are neither constant nor unique, dependents not constant; null
    determinants are left out and null dependents ignored. One grouping per determinant, of
    the dependents that have no more values than it; a determinant with nulls is held
    against all.
    """
    return _dependencies(df, columns, column_facts(df, columns))


def _dependencies(df: DataFrame, columns: Sequence[str], facts: dict[str, tuple[int, int]]) -> DataFrame:
    schema = "determinant string, dependent string"
    keyed, rows = _keyed(df.select(*[ref(c) for c in columns])), df.count()
    parts = []
    for a in columns:
        distinct, present = facts[a]
        others = [b for b in columns if b != a and facts[b][0] > 1 and (present < rows or facts[b][0] <= distinct)]
        if not 1 < distinct < present or not others:
            continue
        groups = keyed.where(ref(a).isNotNull()).groupBy(ref(a)).agg(
            *[(F.min(ref(b)) != F.max(ref(b))).alias(b) for b in others]
        )
        broken = groups.agg(*[F.count_if(ref(b)).alias(b) for b in others])
        parts.append(broken.unpivot([], [ref(b) for b in others], "dependent", "broken").withColumn("determinant", F.lit(a)))
    if not parts:
        return df.sparkSession.createDataFrame([], schema)
    return reduce(lambda x, y: x.unionByName(y), parts).where("broken = 0").select("determinant", "dependent")


def hierarchies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(child, parent): dependencies whose determinant has more distinct values."""
    facts = column_facts(df, columns)
    sizes = df.sparkSession.createDataFrame([(c, n) for c, (n, _) in facts.items()], "column string, n long")
    a = F.broadcast(sizes.toDF("determinant", "da"))  # a row per column
    b = F.broadcast(sizes.toDF("dependent", "db"))
    found = _dependencies(df, columns, facts).join(a, "determinant").join(b, "dependent").where("da > db")
    return found.select(F.col("determinant").alias("child"), F.col("dependent").alias("parent"))


def check_primary_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(null_keys, duplicate_rows): rows with a null in the key, and rows beyond the first of a key."""
    missing = reduce(lambda a, b: a | b, [ref(k).isNull() for k in keys])
    groups = df.groupBy(*[ref(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum(F.when(missing, F.col("_n"))), F.lit(0)).alias("null_keys"),
        F.coalesce(F.sum(F.when(~missing, F.col("_n") - 1)), F.lit(0)).alias("duplicate_rows"),
    )


def check_functional_dependency(df: DataFrame, determinant: str, dependent: str) -> DataFrame:
    """(broken, example): determinants with several dependents, and the smallest of them."""
    groups = (
        df.where(ref(determinant).isNotNull() & ref(dependent).isNotNull())
        .groupBy(ref(determinant).cast("string").alias("d"))
        .agg((F.min(ref(dependent)) != F.max(ref(dependent))).alias("several"))
    )
    return groups.where("several").agg(F.count(F.lit(1)).alias("broken"), F.min("d").alias("example"))


def check_hierarchy(df: DataFrame, child: str, parent: str) -> DataFrame:
    """(broken, example): children with more than one parent."""
    return check_functional_dependency(df, child, parent)
