"""Business rules, quality scores, outliers, anomalies and drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import count_if, ref, share, string_columns, with_scalar
from tablewright.functions.gram import correlation, gram
from tablewright.functions.quantiles import quantile_row
from tablewright.functions.text import guarded_double
from tablewright.operators.clean import outside_fences
from tablewright.operators.profile import number
from tablewright.operators.validate import duplicate_rows


def rule_violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(rule, checked, broken) of SQL assertions; a row whose assertion is null is not checked. One pass."""
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.count(F.expr(f"({text})")).alias("checked"),
            count_if(~F.expr(f"({text})")).alias("broken"),
        )
        for name, text in rules.items()
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def non_negative(column: str) -> str:
    return f"{quoted(column)} >= 0"


def positive(column: str) -> str:
    return f"{quoted(column)} > 0"


def in_order(first: str, second: str) -> str:
    """Chronology, or one amount within another."""
    return f"{quoted(first)} <= {quoted(second)}"


def quality_score(df: DataFrame, issues: DataFrame, violations: DataFrame) -> DataFrame:
    """(completeness, integrity, schema, score, trust, level) of a table from its issues and broken rules."""
    filled = sum((F.count(ref(c)) for c in df.columns[1:]), F.count(ref(df.columns[0])))
    cells = F.count(F.lit(1)) * len(df.columns)
    own = df.agg(share(filled, cells).alias("completeness"))
    copies = F.coalesce(F.max(F.when(F.col("id") == "duplicate_rows", F.col("share"))), F.lit(0.0))
    severe = count_if(F.col("severity").isin("critical", "high"))
    shape = count_if(F.col("id").isin("missing_headers", "duplicate_headers", "invalid_names") | F.col("id").startswith("mixed_types"))
    found = issues.agg(
        F.greatest(F.lit(0.0), 1 - copies - F.least(F.lit(0.4), severe * 0.08)).alias("integrity"),
        F.greatest(F.lit(0.0), 1 - shape * 0.15).alias("schema"),
    )
    broken = violations.agg(count_if(F.col("broken") > 0).alias("broken"))
    known = with_scalar(with_scalar(own, found, "f"), broken, "v")
    score = (F.col("completeness") + F.col("f.integrity") + F.col("f.schema")) / 3 * 100
    trust = F.greatest(F.lit(40.0), score - 4.5 * F.col("v.broken"))
    level = F.when(trust >= 90, "excellent").when(trust >= 75, "good").when(trust >= 60, "fair").when(trust >= 40, "poor").otherwise("critical")
    return known.select("completeness", "f.integrity", "f.schema", score.alias("score"), trust.alias("trust"), level.alias("level"))


def missing_mechanism(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, null_share, strongest, mechanism): none, MNAR over half missing, MAR if the gaps go with another column, MCAR.

    ``strongest`` is the largest absolute correlation of the gap flag with another numeric
    column, whose own gaps are filled by its median. All correlations come from the sums of
    one pass over gap flags and filled columns.
    """
    columns = list(columns)
    numbers = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    marked = with_scalar(numbers, quantile_row(numbers, numbers.columns, [0.5]), "_m")
    at = range(len(columns))
    sides = marked.select(
        *[F.col(f"c{i}").isNull().cast("double").alias(f"gap{i}") for i in at],
        *[F.coalesce(F.col(f"c{i}"), F.col("_m.q")[f"c{i}"][0]).alias(f"full{i}") for i in at],
    )
    pairs = gram(sides, sides.columns).where("a LIKE 'gap%' AND b LIKE 'full%' AND substr(a, 4) <> substr(b, 5)")
    r = F.abs(correlation())
    best = pairs.groupBy(F.substr("a", F.lit(4)).cast("int").alias("i")).agg(F.max(F.when(~F.isnan(r), r)).alias("r"))
    rows = [
        F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), share(count_if(F.col(f"c{i}").isNull()), F.count(F.lit(1))).alias("null_share"))
        for i, c in enumerate(columns)
    ]
    gaps = numbers.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    found = gaps.join(F.broadcast(best), F.col("at") == F.col("i"), "left").select(
        "column", "null_share", F.coalesce("r", F.lit(0.0)).alias("strongest")
    )
    empty = F.col("null_share")
    kind = F.when(empty == 0, "none").when(empty > 0.5, "MNAR").when(F.col("strongest") > 0.25, "MAR").otherwise("MCAR")
    return found.withColumn("mechanism", kind)


def outlier_bounds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, low, high, affected) of columns with five values or more."""
    return outside_fences(df, columns).where("present >= 5").select("column", "low", "high", "affected")


def anomaly_iqr3(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, low, high, affected, severity): values beyond 3 IQR; HIGH over 1 % of rows."""
    far = outside_fences(df, columns, 3.0).where("affected > 0 AND high > low")
    severity = F.when(share(F.col("affected"), F.col("rows")) > 0.01, "HIGH").otherwise("MEDIUM")
    return far.select("column", "low", "high", "affected", severity.alias("severity"))


def anomaly_zscore(df: DataFrame, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """(column, present, affected, severity): absolute population z over the limit; HIGH over 3 % of values."""
    rows = df.select(*[number(c).alias(c) for c in columns])
    stats = rows.agg(*[F.struct(F.avg(ref(c)).alias("m"), F.stddev_pop(ref(c)).alias("s")).alias(c) for c in columns])
    marked = with_scalar(rows, stats, "_z")
    counted = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(ref(c)).alias("present"),
            count_if(F.abs(ref(c) - F.col("_z")[c]["m"]) > limit * F.col("_z")[c]["s"]).alias("affected"),
        )
        for c in columns
    ]
    found = marked.agg(F.array(*counted).alias("rows")).select(F.inline("rows")).where("present >= 10 AND affected > 0")
    return found.withColumn("severity", F.when(share(F.col("affected"), F.col("present")) > 0.03, "HIGH").otherwise("MEDIUM"))


def duplicate_transactions(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(groups, surplus, share, severity): rows that repeat a customer, date and amount."""
    known = df.dropna(subset=list(keys)).groupBy(*[ref(k) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    found = known.where("_n > 1").agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("surplus"))
    part = share(F.col("surplus"), total)
    return found.select("groups", "surplus", part.alias("share"), F.when(part > 0.05, "HIGH").otherwise("MEDIUM").alias("severity"))


def negative_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, affected, severity): CRITICAL over 1 % of rows."""
    rows = [
        F.struct(F.lit(c).alias("column"), count_if(number(c) < 0).alias("affected"), F.count(F.lit(1)).alias("rows"))
        for c in columns
    ]
    found = df.agg(F.array(*rows).alias("rows")).select(F.inline("rows")).where("affected > 0")
    severity = F.when(share(F.col("affected"), F.col("rows")) > 0.01, "CRITICAL").otherwise("HIGH")
    return found.select("column", "affected", severity.alias("severity"))


def column_summaries(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, min, max): a baseline for detect_drift."""
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(number(c)).alias("n"),
            F.avg(number(c)).alias("mean"),
            F.stddev_samp(number(c)).alias("std"),
            F.min(number(c)).alias("min"),
            F.max(number(c)).alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def detect_drift(df: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, base_mean, mean, limit, drifted): the mean moved by more than max(5, 4 base std / sqrt n), n >= 10."""
    base = baseline.select("column", F.col("mean").alias("base_mean"), F.col("std").alias("base_std"))
    known = column_summaries(df, columns).join(base, "column")
    limit = F.greatest(F.lit(5.0), 4 * F.col("base_std") / F.sqrt("n"))
    moved = (F.col("n") >= 10) & (F.abs(F.col("mean") - F.col("base_mean")) > limit)
    return known.select("column", "base_mean", "mean", limit.alias("limit"), moved.alias("drifted"))


# Weights of the weighted score, and the limits of outlier classes.
SCORE_WEIGHTS = {"completeness": 0.25, "uniqueness": 0.15, "consistency": 0.2, "validity": 0.2, "type_alignment": 0.2}
POINTS_PER_VIOLATION = 10
EXTREME_Z, BUSY_SHARE = 8.0, 1.5


def quality_score_weighted(df: DataFrame, columns: Sequence[str], violations: DataFrame, measures: Sequence[str] = ()) -> DataFrame:
    """(completeness, uniqueness, consistency, validity, type_alignment, score) in per cent.

    Filled cells; rows that are no copies; values of the numeric ``columns`` within 1.5 IQR;
    ten points off for each broken rule; columns without the ``measures`` that hold values
    but no number. The score is their weighted mean, a whole number; all 0 for an empty table.
    """
    filled = sum((F.count(ref(c)) for c in df.columns[1:]), F.count(ref(df.columns[0])))
    texts = [F.when((F.count(ref(m)) > 0) & (F.count(guarded_number(df, m)) == 0), 1).otherwise(0) for m in measures]
    own = df.agg(
        F.count(F.lit(1)).alias("rows"), filled.alias("filled"), sum(texts, F.lit(0)).alias("misfits")
    )
    outliers = outside_fences(df, columns).where("present >= 5").agg(F.coalesce(F.sum("affected"), F.lit(0)).alias("outliers")) if columns else None
    known = with_scalar(with_scalar(own, duplicate_rows(df), "d"), violations.agg(count_if(F.col("broken") > 0).alias("broken")), "v")
    known = with_scalar(known, outliers, "o") if outliers is not None else known.withColumn("o", F.struct(F.lit(0).alias("outliers")))
    rows = F.col("rows")
    parts = {
        "completeness": share(F.col("filled"), rows * len(df.columns)) * 100,
        "uniqueness": share(rows - F.col("d.surplus"), rows) * 100,
        "consistency": F.greatest(F.lit(0.0), 1 - share(F.col("o.outliers"), rows * max(1, len(columns)))) * 100,
        "validity": F.greatest(F.lit(0.0), 100.0 - F.col("v.broken") * POINTS_PER_VIOLATION),
        "type_alignment": (len(df.columns) - F.col("misfits")) * F.lit(100.0 / len(df.columns)),
    }
    found = known.select(*[F.when(rows > 0, x).otherwise(0.0).alias(k) for k, x in parts.items()])
    score = sum((F.col(k) * w for k, w in SCORE_WEIGHTS.items()), F.lit(0.0))
    return found.withColumn("score", F.round(score).cast("long"))


def guarded_number(df: DataFrame, column: str) -> Column:
    """The column as a number; a text only if it is written as one."""
    return guarded_double(ref(column)) if column in string_columns(df) else number(column)


def outlier_classify(
    df: DataFrame, columns: Sequence[str], sensors: Sequence[str] = (), amounts: Sequence[str] = (), quantity: str | None = None
) -> DataFrame:
    """(column, affected, low, high, extreme_z, kind, action, confidence) of columns with values beyond 1.5 IQR.

    A value over 8 deviations off is a sensor or an entry error, and its rows may go. In a
    column of amounts it is a promotion if the quantity of the outlying rows is more than
    1.5 times the usual one, else a business event; otherwise it is legitimate. Means of the
    quantity are taken beside the counts, in one pass.
    """
    bounds = outside_fences(df, columns).where("present >= 5 AND affected > 0")
    limits = outside_fences(df, columns).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("low", "high")))).alias("by"))
    marked = with_scalar(df, limits, "_f")
    q = number(quantity) if quantity else F.lit(None).cast("double")
    rows = []
    for c in columns:
        x, fence = number(c), F.col("_f.by")[c]
        out = (x < fence["low"]) | (x > fence["high"])
        rows.append(
            F.struct(
                F.lit(c).alias("c"),
                F.avg(x).alias("mean"),
                F.stddev_samp(x).alias("std"),
                F.max(F.when(out, x)).alias("top"),
                F.min(F.when(out, x)).alias("bottom"),
                F.avg(F.when(out, q)).alias("busy"),
                F.avg(q).alias("usual"),
            )
        )
    facts = marked.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    met = bounds.join(facts, F.col("column") == F.col("c"))
    z = F.greatest(F.abs(F.col("top") - F.col("mean")), F.abs(F.col("bottom") - F.col("mean"))) / F.nullif("std", F.lit(0.0))
    known = met.withColumn("extreme_z", F.coalesce(z, F.lit(0.0)))

    def verdict(kind: str, action: str, confidence: float) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(action).alias("action"), F.lit(confidence).alias("confidence"))

    extreme, amount = F.col("extreme_z") > EXTREME_Z, F.col("column").isin(list(amounts) or [""])
    kind = F.when(extreme & F.col("column").isin(list(sensors) or [""]), verdict("sensor_error", "delete_rows", 0.90)).when(
        extreme, verdict("entry_error", "delete_rows", 0.85)
    )
    if quantity:
        kind = kind.when(amount & (F.col("busy") > F.col("usual") * BUSY_SHARE), verdict("promotion", "keep", 0.80))
    kind = kind.when(amount, verdict("business_event", "keep", 0.70 if quantity else 0.75)).otherwise(verdict("legitimate", "keep", 0.70))
    return known.withColumn("v", kind).select("column", "affected", "low", "high", "extreme_z", "v.*")
