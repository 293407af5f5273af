"""What moves a measure: drill-down, attribution of outliers, evidence, trees, findings.

Segments and pairs of segments are grouped in one pass; what follows works on these
groups. The trees are those of Spark ML.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import number, numeric_columns, ref, share, with_scalar
from tablewright.functions.gram import correlation, gram
from tablewright.functions.quantiles import quantile_row
from tablewright.operators.keys import column_facts
from tablewright.operators.segments import segment_breakdown
from tablewright.session import stored

# Limits that decide results.
LEAST_DEVIATION = 20.0
DIMENSIONS, CHILDREN = 6, 3
DIMENSION_VALUES, CHILD_VALUES = (2, 30), (2, 20)
LEAST_IN_DRILL, SHOWN = 5, 5
OUTLIER_WIDTH, TREE_WIDTH = 2.5, 3.0
PROMO_SHARE, VOLUME_SHARE = 0.80, 0.90
FLAGS = ["true", "1", "fail", "failed", "yes"]
LEAST_IMPORTANCE, TREE_DEPTH, IMPORTANCE_DEPTH, SEED = 0.15, 3, 4, 42
LEAST_ROWS_IMPORTANCE = 15
EVIDENCE_DIMENSIONS, EVIDENCE_MEASURES = 8, 5
PEAK_LEAST, PEAK_MOST, SECOND_LEAST, TRENDING = 15.0, 1000.0, 20.0, 1.5
#: Texts with more values are told apart by a hash into so many bins.
BINS = 256


def _text(c: str) -> Column:
    return F.coalesce(ref(c).cast("string"), F.lit("Unknown"))


def _fitting(df: DataFrame, dimensions: Sequence[str], low: int, high: int) -> list[str]:
    """The dimensions whose distinct values are within the bounds, in their order."""
    facts = column_facts(df, list(dimensions))
    return [d for d in dimensions if low <= facts[d][0] <= high]


def root_cause_drilldown(df: DataFrame, measure: str, dimensions: Sequence[str], observed: float) -> DataFrame:
    """(level, dimension, value, under, under_value, n, mean, contribution, rank, top).

    An observed value that is off the mean by 20 % or more is looked for among the rows at
    or beyond the 90th percentile (below, the 10th). Level 1 splits these rows by up to six
    dimensions of 2 to 30 values; level 2 splits the leading segment of each, if it has five
    rows, by up to three others of at most 20 values. ``contribution`` is the segment's pull
    on the mean in per cent of it; five segments are shown, three are top. Both levels come
    from one grouping over values and pairs of values. No rows if the value is not far off.
    """
    schema = (
        "level int, dimension string, value string, under string, under_value string, n long, mean double,"
        " contribution double, rank int, top boolean"
    )
    wide = [d for d in dimensions if d != measure]
    counts = {c: n for c, (n, _) in column_facts(df, wide).items()} if wide else {}
    first = [d for d in wide if DIMENSION_VALUES[0] <= counts[d] <= DIMENSION_VALUES[1]][:DIMENSIONS]
    small = [d for d in wide if CHILD_VALUES[0] <= counts[d] <= CHILD_VALUES[1]]
    if not first:
        return df.sparkSession.createDataFrame([], schema)
    stats = df.agg(F.avg(number(measure)).alias("mean"), F.count(number(measure)).alias("known"))
    bounds = with_scalar(stats, quantile_row(df, [measure], [0.1, 0.9]), "q")
    rows = with_scalar(df.select(number(measure).alias("_x"), *[_text(d).alias(d) for d in wide]), bounds, "_s")
    mean, ends = F.col("_s.mean"), F.col("_s.q.q")[measure]
    off = F.try_divide((F.lit(float(observed)) - mean) * 100, F.abs(mean))
    far = (F.col("_s.known") >= 10) & (F.abs(mean) >= 1e-9) & (F.abs(off) >= LEAST_DEVIATION)
    beyond = F.when(F.lit(float(observed)) > mean, F.col("_x") >= ends[1]).otherwise(F.col("_x") <= ends[0])
    none = F.lit(None).cast("string")
    parts = [F.struct(F.lit(d).alias("dimension"), ref(d).alias("value"), none.alias("under"), none.alias("under_value")) for d in first]
    for d in first:
        for c in [x for x in small if x != d][:CHILDREN]:
            parts.append(F.struct(F.lit(c).alias("dimension"), ref(c).alias("value"), F.lit(d).alias("under"), ref(d).alias("under_value")))
    long = rows.where(far & beyond).select("_x", mean.alias("_mean"), F.inline(F.array(*parts)))
    keys = ["under", "under_value", "dimension", "value"]
    # at most 30 values, or 30 x 20 pairs of values, per pair of dimensions
    groups = stored(
        long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mean"), F.max("_mean").alias("base")), "drill-down"
    )
    whole = F.sum("n").over(Window.partitionBy("under", "under_value", "dimension"))
    pull = F.abs((F.col("mean") - F.col("base")) * share(F.col("n"), whole) * 100 / F.col("base"))
    placed = groups.withColumn("contribution", pull)
    order = Window.partitionBy("under", "under_value", "dimension").orderBy(F.desc("contribution"), "value")
    ranked = placed.withColumn("rank", F.row_number().over(order))
    lead = ranked.where("under IS NULL AND rank = 1").select(F.col("dimension").alias("d"), F.col("value").alias("v"), F.col("n").alias("rows"))
    below = ranked.join(lead, (F.col("under") == F.col("d")) & (F.col("under_value") == F.col("v")) & (F.col("rows") >= LEAST_IN_DRILL), "left_semi")
    shown = ranked.where("under IS NULL").withColumn("level", F.lit(1)).unionByName(below.withColumn("level", F.lit(2)))
    return shown.where(F.col("rank") <= SHOWN).select(
        "level", "dimension", "value", "under", "under_value", "n", "mean", "contribution", "rank", (F.col("rank") <= 3).alias("top")
    )


def anomaly_attribution(
    df: DataFrame, target: str, promotions: Sequence[str] = (), volumes: Sequence[str] = (), flags: Sequence[str] = ()
) -> DataFrame:
    """The rows of ``df`` whose target is beyond 2.5 interquartile ranges, with ``cause`` and ``support``.

    promo where a promotion column is above its 80th percentile and a volume column above
    its 90th; else business_event where a volume is; else operational where a flag says so;
    else unknown. ``support`` names the columns that were high or flagged. Needs ten values.
    """
    columns = list(dict.fromkeys([target, *promotions, *volumes]))
    limits = quantile_row(df, columns, [0.25, 0.75, PROMO_SHARE, VOLUME_SHARE])
    known = with_scalar(df, df.agg(F.count(number(target)).alias("n")), "_n")
    marked = with_scalar(known, limits, "_l")

    def at(c: str, i: int) -> Column:
        return F.col("_l.q")[c][i]

    width = at(target, 1) - at(target, 0)
    x = number(target)
    far = (x < at(target, 0) - OUTLIER_WIDTH * width) | (x > at(target, 1) + OUTLIER_WIDTH * width)

    def support(columns: Sequence[str], holds) -> Column:
        return F.array_compact(F.array(*[F.when(holds(c), F.lit(c)) for c in columns])) if columns else F.array().cast("array<string>")

    promo = support(promotions, lambda c: number(c) > at(c, 2))
    volume = support(volumes, lambda c: number(c) > at(c, 3))
    flagged = support(flags, lambda c: F.lower(ref(c).cast("string")).isin(FLAGS))
    rows = marked.where((F.col("_n.n") >= 10) & far).withColumns({"_p": promo, "_v": volume, "_f": flagged})
    has = {c: F.size(c) > 0 for c in ("_p", "_v", "_f")}
    cause = (
        F.when(has["_p"] & has["_v"], "promo").when(has["_v"], "business_event").when(has["_f"], "operational").otherwise("unknown")
    )
    evidence = F.when(has["_p"] & has["_v"], F.concat("_p", "_v")).when(has["_v"], F.col("_v")).otherwise(F.col("_f"))
    return rows.withColumns({"cause": cause, "support": evidence}).select(*[ref(c) for c in df.columns], "cause", "support")


def strength_of(value: Column, strong: float, moderate: float, weak: float) -> Column:
    return F.when(value > strong, "strong").when(value > moderate, "moderate").when(value > weak, "weak").otherwise("none")


def evidence_table(
    df: DataFrame, measure: str, observed: float, dimensions: Sequence[str], measures: Sequence[str], anomalies: DataFrame | None = None
) -> DataFrame:
    """(kind, target, value, detail, strength, supports, confidence) about an observed value.

    segment: the leading segment's pull, per dimension of 2 to 30 values; strong beyond 30
    and twice the next one. correlation: with each measure over eight rows or more.
    distribution: z of the observed value, its percentile in ``detail``. recurrence: the
    number of anomalous periods, if they are given.
    """
    base = "kind string, target string, value double, detail double, strength string, supports boolean, confidence double"
    out = df.sparkSession.createDataFrame([], base)
    fit = _fitting(df, [d for d in dimensions if d != measure], *DIMENSION_VALUES)[:EVIDENCE_DIMENSIONS] if dimensions else []
    if fit:
        ranked = segment_breakdown(df.select(number(measure).alias(measure), *[_text(d).alias(d) for d in fit]), fit, measure)
        best = ranked.where("rank <= 2").groupBy("dimension").agg(
            F.max(F.when(F.col("rank") == 1, F.col("contribution"))).alias("value"),
            F.max(F.when(F.col("rank") == 2, F.col("contribution"))).alias("next"),
        )
        ratio = F.when(F.col("next") > 0, F.col("value") / F.col("next")).otherwise(1.0)
        strong = (F.col("value") > 30) & (ratio > 2)
        weight = F.when(strong, "strong").otherwise(strength_of(F.col("value"), float("inf"), 15, 5))
        sure = F.when(weight == "strong", 0.8).when(weight == "moderate", 0.65).otherwise(0.4)
        out = out.unionByName(
            best.where("next IS NOT NULL").select(
                F.lit("segment").alias("kind"), F.col("dimension").alias("target"), "value", F.col("next").alias("detail"),
                weight.alias("strength"), (F.col("value") > 10).alias("supports"), sure.alias("confidence"),
            )
        )
    others = [m for m in measures if m != measure][:EVIDENCE_MEASURES]
    if others:
        rs = gram(df, [measure, *others]).where((F.col("a") == measure) & (F.col("b") != measure) & (F.col("n") >= 8))
        r = F.col("r")
        weight = strength_of(F.abs(r), 0.7, 0.4, 0.2)
        sure = F.when(weight == "strong", 0.85).when(weight == "moderate", 0.65).otherwise(0.35)
        out = out.unionByName(
            rs.withColumn("r", correlation()).where(r.isNotNull() & ~F.isnan(r)).select(
                F.lit("correlation").alias("kind"), F.col("b").alias("target"), r.alias("value"), F.col("n").cast("double").alias("detail"),
                weight.alias("strength"), ((F.abs(r) > 0.3) & (r > 0)).alias("supports"), sure.alias("confidence"),
            )
        )
    x = number(measure)
    shift = df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count_if(x <= F.lit(float(observed))).alias("upto")
    ).where("n >= 10")
    z = F.coalesce(F.try_divide(F.lit(float(observed)) - F.col("mean"), F.nullif(F.col("std"), F.lit(0.0))), F.lit(0.0))
    out = out.unionByName(
        shift.select(
            F.lit("distribution").alias("kind"), F.lit(measure).alias("target"), z.alias("value"), (F.col("upto") * 100 / F.col("n")).alias("detail"),
            strength_of(F.abs(z), 3, 2, 1).alias("strength"), (F.abs(z) > 1.5).alias("supports"), F.lit(0.85).alias("confidence"),
        )
    )
    if anomalies is not None:
        n = anomalies.agg(F.count(F.lit(1)).cast("double").alias("value")).where("value > 0")
        out = out.unionByName(
            n.select(
                F.lit("recurrence").alias("kind"), F.lit(measure).alias("target"), "value", F.lit(None).cast("double").alias("detail"),
                F.when(F.col("value") > 1, "moderate").otherwise("strong").alias("strength"), F.lit(True).alias("supports"), F.lit(0.7).alias("confidence"),
            )
        )
    return out


def driver_importance(evidence: DataFrame) -> DataFrame:
    """(column, kind, importance, significant) from rows of ``evidence_table``.

    A dimension has its leading segment's pull, a measure 80 times its |r| from 0.2 on; each
    at most 100, and scaled down together where they add up to more than 100. A column that
    is both counts as a dimension.
    """
    segment = F.col("kind") == "segment"
    raw = F.least(F.lit(100.0), F.when(segment, F.col("value")).otherwise(F.abs("value") * 80))
    sure = F.when(segment, F.col("strength").isin("strong", "moderate")).otherwise(F.abs("value") > 0.4)
    rows = evidence.where(segment | ((F.col("kind") == "correlation") & (F.abs("value") >= 0.2)))
    # a row per column of the table
    first = Window.partitionBy("target").orderBy(F.col("kind").desc())
    one = rows.withColumns({"raw": raw, "significant": sure, "at": F.row_number().over(first)}).where("at = 1")
    whole = F.sum("raw").over(Window.partitionBy(F.lit(0)))
    return one.select(
        F.col("target").alias("column"), "kind", (F.col("raw") * F.when(whole > 100, 100 / whole).otherwise(1.0)).alias("importance"), "significant"
    )


def finding_pool(buckets: DataFrame, trends: DataFrame, anomalies: DataFrame, keys: Sequence[str] = (), value: str = "total", k: int = 3) -> DataFrame:
    """(keys..., kind, period, observed, baseline, deviation_pct, priority, rank): the ``k`` leading findings.

    peak: the highest period against the mean period, within 1000 %, from 15 % on; it counts
    half as much again unless the trend is flat. anomaly: the first other anomalous period,
    from 20 % on. ``trends`` and ``anomalies`` are those of the series module.
    """
    groups = [ref(x) for x in keys]
    means = buckets.groupBy(*groups).agg(F.avg(value).alias("baseline")).where(F.abs("baseline") >= 1e-9)
    names = [f"_k{i}" for i in range(len(keys))]

    def by_key(rows: DataFrame, *columns: Column) -> DataFrame:
        return rows.select(*[g.alias(n) for g, n in zip(groups, names, strict=True)], *columns)

    def met(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
        match = F.lit(True)
        for g, n in zip(groups, names, strict=True):
            match = match & g.eqNullSafe(ref(n))
        if not keys:
            return with_scalar(rows, other, "_o").select("*", "_o.*").drop("_o")
        return rows.join(F.broadcast(other) if how == "broadcast" else other, match).drop(*names)

    peaks = met(means, by_key(trends, F.col("peak"), F.col("trend")))
    tops = buckets.groupBy(*groups).agg(F.max(value).alias("observed"))
    peaks = met(peaks, by_key(tops, F.col("observed")))
    off = (F.col("observed") - F.col("baseline")) / F.abs("baseline") * 100
    capped = F.greatest(F.lit(-PEAK_MOST), F.least(F.lit(PEAK_MOST), off))
    urgent = F.abs("deviation_pct") * F.when(F.col("trend") != "flat", TRENDING).otherwise(1.0)
    high = peaks.withColumn("deviation_pct", capped).where(F.abs("deviation_pct") >= PEAK_LEAST)
    high = high.select(*groups, F.lit("peak").alias("kind"), F.col("peak").alias("period"), "observed", "baseline", "deviation_pct", urgent.alias("priority"))
    others = met(met(anomalies.select(*groups, "period", ref(value).alias("observed")), by_key(means, F.col("baseline"))), by_key(trends, F.col("peak")))
    first = others.where("period <> peak").groupBy(*groups).agg(F.min_by(F.struct("period", "observed", "baseline"), "period").alias("f"))
    second = first.select(*groups, F.lit("anomaly").alias("kind"), "f.period", "f.observed", "f.baseline").withColumn("deviation_pct", off)
    second = second.where(F.abs("deviation_pct") >= SECOND_LEAST).withColumn("priority", F.abs("deviation_pct"))
    pool = high.unionByName(second).orderBy(F.desc("priority"), "kind", "period", *groups).limit(k)
    # k rows
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("priority"), "kind", "period", *groups)
    return pool.withColumn("rank", F.row_number().over(order))


def tail_findings(df: DataFrame, measures: Sequence[str]) -> DataFrame:
    """(column, observed, baseline, deviation_pct): without dates, the 90th percentile 20 % or more above a positive mean.

    Over the first two measures with ten values.
    """
    measures = list(measures)[:2]
    stats = [F.struct(F.lit(c).alias("column"), F.avg(number(c)).alias("baseline"), F.count(number(c)).alias("n")) for c in measures]
    rows = df.agg(F.array(*stats).alias("rows")).select(F.inline("rows")).where("n >= 10 AND baseline > 0")
    known = with_scalar(rows, quantile_row(df, measures, [0.9]), "_q")
    found = known.select("column", F.col("_q.q")[F.col("column")][0].alias("observed"), "baseline")
    return found.withColumn("deviation_pct", (F.col("observed") - F.col("baseline")) / F.col("baseline") * 100).where(
        F.col("deviation_pct") >= LEAST_DEVIATION
    )


def outlier_driver_tree(df: DataFrame, target: str, predictors: Sequence[str]) -> DataFrame:
    """(target, driver, importance, median_outliers, median_others, relation): what tells outliers of ``target``.

    Rows beyond 3 interquartile ranges are told from the others by a tree of depth 3 on the
    other numbers, gaps filled by their medians; the most important one is given if its
    importance exceeds 0.15. No row without outliers, with fewer than ten rows or five values.
    """
    spark = df.sparkSession
    schema = "target string, driver string, importance double, median_outliers double, median_others double, relation string"
    predictors = [p for p in predictors if p != target]
    if not predictors:
        return spark.createDataFrame([], schema)
    q = quantile_row(df, [target, *predictors], [0.25, 0.5, 0.75]).first()["q"]
    sizes = df.agg(F.count(F.lit(1)).alias("rows"), F.count(number(target)).alias("known")).first()
    if target not in q or sizes["rows"] < 10 or sizes["known"] < 5:
        return spark.createDataFrame([], schema)
    low, _, high = q[target]
    width = TREE_WIDTH * (high - low)
    x = number(target)
    label = F.coalesce((x < low - width) | (x > high + width), F.lit(False))
    used = [p for p in predictors if p in q]
    filled = [F.coalesce(number(p), F.lit(q[p][1])).alias(f"x{i}") for i, p in enumerate(used)]
    rows = stored(df.select(label.cast("double").alias("label"), *filled, *[number(p).alias(f"raw{i}") for i, p in enumerate(used)]), "tree-rows")
    if not used or rows.agg(F.max("label")).first()[0] != 1.0:
        return spark.createDataFrame([], schema)
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(len(used))], outputCol="features")
    tree = DecisionTreeClassifier(maxDepth=TREE_DEPTH, seed=SEED, featuresCol="features", labelCol="label")
    weights = Pipeline(stages=[vectors, tree]).fit(rows).stages[-1].featureImportances.toArray()
    best = int(weights.argmax())
    if weights[best] <= LEAST_IMPORTANCE:
        return spark.createDataFrame([], schema)
    name = f"raw{best}"
    sides = rows.select(F.when(F.col("label") == 1, F.col(name)).alias("inside"), F.when(F.col("label") == 0, F.col(name)).alias("outside"))
    medians = quantile_row(sides, ["inside", "outside"], [0.5]).select(F.col("q")["inside"][0].alias("a"), F.col("q")["outside"][0].alias("b"))
    relation = F.when(F.col("a") > F.col("b"), "higher").otherwise("lower")
    return medians.select(
        F.lit(target).alias("target"), F.lit(used[best]).alias("driver"), F.lit(float(weights[best])).alias("importance"),
        F.col("a").alias("median_outliers"), F.col("b").alias("median_others"), relation.alias("relation"),
    )


def feature_importance(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(feature, importance, rank) of a regression tree of depth 4 on ``target``.

    Numbers are filled by their mean. Texts are categories; those with more than BINS values
    are told apart by a hash into BINS bins. No rows with fewer than 15 known targets.
    """
    spark = df.sparkSession
    features = [f for f in features if f != target]
    rows = df.where(number(target).isNotNull())
    if not features or rows.limit(LEAST_ROWS_IMPORTANCE).count() < LEAST_ROWS_IMPORTANCE:
        return spark.createDataFrame([], "feature string, importance double, rank int")
    numeric = [f for f in features if f in set(numeric_columns(df))]
    texts = [f for f in features if f not in numeric]
    counts = {c: n for c, (n, _) in column_facts(rows, texts).items()} if texts else {}
    means = rows.agg(F.lit(0).alias("none"), *[F.avg(number(f)).alias(f) for f in numeric]).first()
    columns = [F.coalesce(number(f), F.lit(float(means[f] or 0.0))).alias(f"x{features.index(f)}") for f in numeric]
    for f in texts:
        own = F.coalesce(ref(f).cast("string"), F.lit(""))
        own = own if counts.get(f, 0) < BINS else F.pmod(F.xxhash64(own), F.lit(BINS)).cast("string")
        columns.append(own.alias(f"x{features.index(f)}"))
    table = stored(rows.select(number(target).alias("label"), *columns), "tree-rows")
    names = [f"x{i}" for i in range(len(features))]
    coded = [f"x{features.index(f)}" for f in texts]
    stages = [StringIndexer(inputCols=coded, outputCols=[f"{c}_code" for c in coded], stringOrderType="alphabetAsc")] if coded else []
    inputs = [f"{n}_code" if n in coded else n for n in names]
    tree = DecisionTreeRegressor(maxDepth=IMPORTANCE_DEPTH, maxBins=BINS, seed=SEED, featuresCol="features", labelCol="label")
    model = Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="features"), tree]).fit(table)
    weights = model.stages[-1].featureImportances.toArray()
    order = sorted(range(len(features)), key=lambda i: (-weights[i], features[i]))
    found = [(features[i], float(weights[i]), k) for k, i in enumerate(order, 1)]
    schema = T.StructType(
        [T.StructField("feature", T.StringType()), T.StructField("importance", T.DoubleType()), T.StructField("rank", T.IntegerType())]
    )
    return spark.createDataFrame(found, schema)
