"""Rules of a dataset, learned from its values, kept as a table with versions, applied to later batches.

The store is a folder of Parquet files that is only ever added to: a row is a rule of one
dataset in one version. A version is what a run learned; applying takes the newest one
unless told otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.columns import count_if, number, ref
from tablewright.operators.keys import column_facts
from tablewright.operators.quality import in_order, non_negative, positive, quoted, rule_violations

STORE = "dataset string, version int, rule string, assertion string, saved_at timestamp"


def learn_rules(df: DataFrame, columns: Sequence[str], orders: Sequence[tuple[str, str]] = ()) -> dict[str, str]:
    """name -> SQL assertion that every row of ``df`` keeps.

    Numbers that are all positive, or not negative; columns without nulls; columns of at
    most ten values; and those of the pairs of ``orders`` whose first never exceeds the second.
    """
    columns = list(columns)
    kinds = dict(df.dtypes)
    numeric = [c for c in columns if kinds[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or kinds[c].startswith("decimal")]
    low = {f"low{i}": F.min(number(c)) for i, c in enumerate(numeric)}
    gaps = {f"gaps{i}": count_if(ref(c).isNull()) for i, c in enumerate(columns)}
    swaps = {f"swap{i}": count_if(~F.expr(in_order(a, b))) for i, (a, b) in enumerate(orders)}
    facts = df.agg(F.count(F.lit(1)).alias("rows"), *[x.alias(k) for k, x in (low | gaps | swaps).items()]).first()
    if not facts["rows"]:
        return {}
    out = {}
    for i, c in enumerate(numeric):
        least = facts[f"low{i}"]
        if least is not None and least >= 0:
            out[f"{c}_{'positive' if least > 0 else 'non_negative'}"] = positive(c) if least > 0 else non_negative(c)
    for i, c in enumerate(columns):
        if not facts[f"gaps{i}"]:
            out[f"{c}_known"] = f"{quoted(c)} IS NOT NULL"
    texts = [c for c in columns if kinds[c] == "string"]
    if texts:
        few = [c for c, (n, _) in column_facts(df, texts).items() if 0 < n <= 10]
        for c in few:
            values = sorted(r[0] for r in df.select(ref(c)).where(ref(c).isNotNull()).distinct().collect())  # ten at most
            listed = ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
            out[f"{c}_listed"] = f"{quoted(c)} IN ({listed})"
    for i, (a, b) in enumerate(orders):
        if not facts[f"swap{i}"]:
            out[f"{a}_before_{b}"] = in_order(a, b)
    return out


def stored_rules(spark: SparkSession, store: str, dataset: str, version: int | None = None) -> DataFrame:
    """(rule, assertion, version) of a dataset, the newest version by default; empty if there is none."""
    try:
        rows = spark.read.schema(STORE).parquet(store)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STORE)
    own = rows.where(F.col("dataset") == dataset)
    wanted = F.lit(version) if version is not None else own.agg(F.max("version")).scalar()
    return own.where(F.col("version") == wanted).select("rule", "assertion", "version")


def save_rules(spark: SparkSession, store: str, dataset: str, rules: dict[str, str]) -> int:
    """Add the rules as the next version of the dataset; returns its number. One writer at a time per dataset."""
    last = stored_rules(spark, store, dataset).agg(F.max("version")).first()[0]
    version = (last or 0) + 1
    rows = spark.createDataFrame([(dataset, version, k, v) for k, v in rules.items()], "dataset string, version int, rule string, assertion string")
    rows.withColumn("saved_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(store)
    return version


def apply_rules(df: DataFrame, store: str, dataset: str, version: int | None = None) -> DataFrame:
    """(rule, version, checked, broken, applied): the stored rules against every row, in one pass.

    A rule about a column that the batch lacks is listed as not applied.
    """
    spark = df.sparkSession
    rules = stored_rules(spark, store, dataset, version).orderBy("rule").collect()  # as many as a run learned
    fit, unfit = {}, []
    for r in rules:
        try:
            df.where(F.expr(r["assertion"])).schema  # noqa: B018  analysed, not run
            fit[r["rule"]] = r["assertion"]
        except AnalysisException:
            unfit.append(r["rule"])
    number_ = rules[0]["version"] if rules else None
    out = spark.createDataFrame([(u, None, None) for u in unfit], "rule string, checked long, broken long").withColumn("applied", F.lit(False))
    if fit:
        out = out.unionByName(rule_violations(df, fit).withColumn("applied", F.lit(True)))
    return out.select("rule", F.lit(number_).cast("int").alias("version"), "checked", "broken", "applied")
