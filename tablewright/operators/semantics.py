"""What columns mean: semantic types and roles from evidence in the values.

The evidence is one row per column: shares of values that read as dates, truth values or
numbers, ranges, lengths, and distinct counts over all rows. What a column's name suggests
is the caller's to say, as hints per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import count_if, ref, share, value_counts
from tablewright.functions.quantiles import exact_quantiles
from tablewright.functions.text import as_timestamp, guarded_double
from tablewright.operators.validate import digest
from tablewright.session import stored

# Tokens and patterns in values.
TRUTH_TOKENS = [
    "true", "false", "t", "f", "yes", "no", "y", "n", "1", "0",
    "pass", "fail", "approved", "rejected", "active", "inactive",
]
ROLE_TOKENS = ["yes", "no", "y", "n", "true", "false", "1", "0", "active", "inactive", "enabled", "disabled"]
PERCENT_TOKENS = "(?i)%|percent"
MONEY_TOKENS = r"(?i)\$|€|£|usd|eur|gbp|revenue|fee|amount|cost"
TYPES = [
    "IDENTIFIER", "CATEGORICAL", "NUMERIC_CONTINUOUS", "NUMERIC_DISCRETE", "DATETIME",
    "GEOGRAPHIC", "TEXT", "MONETARY", "PERCENTAGE", "BOOLEAN",
]
# What a hint from the name adds to a type's score.
HINT_WEIGHTS = {"BOOLEAN": 0.45, "DATETIME": 0.45, "GEOGRAPHIC": 0.35, "IDENTIFIER": 0.45, "PERCENTAGE": 0.55, "MONETARY": 0.35}
GATE = 0.65
LOW_VALUES, MEDIUM_VALUES = 15, 100

Hints = Mapping[str, Sequence[str]]


def _kind(df: DataFrame, c: str) -> str:
    kind = df.schema[c].dataType
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(kind, T.IntegralType):
        return "integer"
    return "float" if isinstance(kind, T.NumericType) else "text"


def _as_number(c: Column, kind: str) -> Column:
    if kind == "datetime":
        return F.lit(None).cast("double")
    x = guarded_double(F.regexp_replace(c, ",", "")) if kind == "text" else c.cast("double")
    return F.when(~F.isnan(x), x)


def column_evidence(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, kind, rows, n, distinct, ...): what the values of each column say, over all rows.

    Values are read once; their distinct counts and the upper quartile of their size follow
    from value counts.
    """
    columns = list(columns or df.columns)
    kinds = {c: _kind(df, c) for c in columns}
    # each reading of a value is a column of its own, so that no count writes it out again
    read = df.select(
        *[ref(c).cast("string").alias(f"s{i}") for i, c in enumerate(columns)],
        *[_as_number(ref(c), kinds[c]).alias(f"x{i}") for i, c in enumerate(columns)],
        *[
            (as_timestamp(ref(c)).isNotNull() if kinds[c] == "text" else F.lit(kinds[c] == "datetime")).alias(f"d{i}")
            for i, c in enumerate(columns)
        ],
    )
    rows = []
    for i, c in enumerate(columns):
        s, x, d = (F.col(f"{k}{i}") for k in "sxd")
        token = F.lower(F.trim(s))
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kinds[c]).alias("kind"),
                F.count(F.lit(1)).alias("rows"),
                F.count(s).alias("n"),
                F.count(x).alias("numbers"),
                count_if(s.isNotNull() & d).alias("dates"),
                (F.count(s) if kinds[c] == "boolean" else count_if(token.isin(TRUTH_TOKENS))).alias("truths"),
                count_if(token.isin(ROLE_TOKENS)).alias("flags"),
                F.avg(F.when(F.trim(s) != "", F.length(F.trim(s)))).alias("length"),
                count_if(s.rlike(PERCENT_TOKENS)).alias("percents"),
                count_if(s.rlike(MONEY_TOKENS)).alias("moneys"),
                count_if(x.between(0, 100)).alias("hundreds"),
                count_if(x >= 0).alias("positives"),
                count_if(x.between(-90, 90)).alias("latitudes"),
                count_if(x.between(-180, 180)).alias("longitudes"),
                count_if(F.abs(x % 1) > 1e-9).alias("fractions"),
                F.min(x).alias("low"),
                F.max(x).alias("high"),
            )
        )
    counted = read.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    names = {f"s{i}": c for i, c in enumerate(columns)} | {f"x{i}": c for i, c in enumerate(columns)}
    # digests stand for texts
    keyed = read.select(
        *[(digest(F.col(f"s{i}")) if kinds[c] == "text" else F.col(f"s{i}")).alias(f"s{i}") for i, c in enumerate(columns)],
        *[f"x{i}" for i in range(len(columns))],
    )
    values = value_counts(keyed, list(names)).groupBy("column").agg(F.count(F.lit(1)).alias("k"))
    place = F.create_map(*[F.lit(v) for k, c in names.items() for v in (k, c)])
    distinct = values.select(place[F.col("column")].alias("c"), F.col("column").startswith("s").alias("own"), "k")
    sizes = distinct.groupBy("c").agg(
        F.max(F.when(F.col("own"), F.col("k"))).alias("distinct"), F.max(F.when(~F.col("own"), F.col("k"))).alias("distinct_numbers")
    )
    sized = read.select(*[F.abs(F.col(f"x{i}")).alias(f"x{i}") for i in range(len(columns))])
    quartile = exact_quantiles(sized, sized.columns, [0.75]).select(place[F.col("column")].alias("qc"), F.col("q")[0].alias("upper"))
    out = counted.join(F.broadcast(sizes), F.col("column") == F.col("c"), "left").join(F.broadcast(quartile), F.col("column") == F.col("qc"), "left")
    return out.drop("c", "qc").withColumns({k: F.coalesce(k, F.lit(0)) for k in ("distinct", "distinct_numbers")})


def _hinted(hints: Hints | None, kind: str) -> Column:
    return F.col("column").isin([c for c, kinds in (hints or {}).items() if kind in kinds] or [""])


def classify_semantic_type(df: DataFrame, hints: Hints | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """(column, semantic_type, confidence): the type with the highest score; some come first from a limit on.

    ``hints`` are types of TYPES that a column's name suggests. A column without values is
    CATEGORICAL at 0.1.
    """
    e = column_evidence(df) if evidence is None else evidence
    n, numbers = F.col("n"), F.col("numbers")
    unique, dates, truths = share(F.col("distinct"), n), share(F.col("dates"), n), share(F.col("truths"), n)
    rate = share(numbers, n)
    length = F.coalesce("length", F.lit(0.0))
    number_like = rate > 0
    percent = F.when(number_like, 0.5 * rate + 0.5 * share(F.col("hundreds"), numbers)).otherwise(share(F.col("percents"), n))
    size = F.when(F.col("upper") > 10, 1.0).when(F.col("upper") > 1, 0.4).otherwise(0.2)
    tokens = share(F.col("moneys"), n)
    money = F.when(number_like, 0.4 * tokens + 0.6 * rate * share(F.col("positives"), numbers) * size).otherwise(tokens)
    span = F.greatest(share(F.col("latitudes"), numbers), share(F.col("longitudes"), numbers))
    spread = F.when(numbers > 1, F.col("high") - F.col("low")).otherwise(0.0)
    coordinates = number_like & (span >= 0.98) & ((spread >= 5) | (share(F.col("fractions"), numbers) >= 0.3))
    place = F.when(coordinates, rate * span).otherwise(0.0)
    whole = 1 - share(F.col("fractions"), numbers)
    repeats = 1 - F.least(F.lit(1.0), share(F.col("distinct_numbers"), numbers) * 5)
    numeric, text = rate >= 0.7, ~F.col("kind").isin("integer", "float", "boolean")
    discrete = whole >= 0.85
    zero = F.lit(0.0)

    def given(kind: str) -> Column:
        return F.when(_hinted(hints, kind), HINT_WEIGHTS[kind]).otherwise(0.0)

    scores = {
        "IDENTIFIER": given("IDENTIFIER") + F.when(unique >= 0.85, 0.55).when(unique >= 0.6, 0.25).otherwise(0.0),
        "CATEGORICAL": F.when(
            text,
            0.1
            + (1 - F.least(F.lit(1.0), unique * 2)) * 0.5
            + F.least(F.lit(1.0), F.greatest(zero, (20 - length) / 20)) * 0.5
            + F.when(_hinted(hints, "IDENTIFIER"), 0.1).otherwise(0.0),
        ).otherwise(0.0),
        "NUMERIC_CONTINUOUS": F.when(numeric, F.when(discrete, 0.15).otherwise(0.7)).otherwise(0.0),
        "NUMERIC_DISCRETE": F.when(numeric, F.when(discrete, 0.7 * whole).otherwise(0.25 * repeats)).otherwise(0.0),
        "DATETIME": given("DATETIME") + 0.7 * dates,
        "GEOGRAPHIC": given("GEOGRAPHIC") + 0.7 * place,
        "TEXT": F.when(text, F.least(F.lit(1.0), length / 25) * 0.6 + F.least(F.lit(1.0), unique * 2) * 0.4).otherwise(0.0),
        "MONETARY": given("MONETARY") + 0.6 * money,
        "PERCENTAGE": given("PERCENTAGE") + F.when(numeric | (percent > 0.05), 0.7 * percent).otherwise(0.0),
        "BOOLEAN": given("BOOLEAN") + 0.65 * truths,
    }
    # a row per column; sums of shares are rounded so that equal scores stay equal
    table = stored(e.select("column", "n", *[F.round(scores[t], 9).alias(t) for t in TYPES]), "type-scores")
    best = F.array_max(F.array(*[F.struct(F.col(t).alias("score"), F.lit(-i).alias("turn"), F.lit(t).alias("type")) for i, t in enumerate(TYPES)]))
    first = F.when(F.col("BOOLEAN") >= 0.7, "BOOLEAN").when(F.col("DATETIME") >= 0.7, "DATETIME").when(F.col("GEOGRAPHIC") >= 0.7, "GEOGRAPHIC")
    for kind in ("PERCENTAGE", "MONETARY"):
        first = first.when((F.col(kind) >= 0.6) & _hinted(hints, kind) & (F.col("NUMERIC_CONTINUOUS") < F.col(kind)), kind)
    first = first.when(F.col("IDENTIFIER") >= 0.7, "IDENTIFIER")
    chosen = table.withColumn("best", best).withColumn("semantic_type", F.coalesce(first, F.col("best.type")))
    score = F.create_map(*[x for t in TYPES for x in (F.lit(t), F.col(t))])[F.col("semantic_type")]
    known = F.col("n") > 0
    return chosen.select(
        "column",
        F.when(known, F.col("semantic_type")).otherwise("CATEGORICAL").alias("semantic_type"),
        F.when(known, F.greatest(F.lit(0.05), F.least(F.lit(0.99), score))).otherwise(0.1).alias("confidence"),
    )


def column_roles(df: DataFrame, hints: Hints | None = None, evidence: DataFrame | None = None) -> DataFrame:
    """(column, column_type, role, score) from kind, distinct values and tokens.

    Hints: percentage or currency for numbers, location, code or status for texts, concept
    for a column whose meaning the caller knows. Over 40 % nulls cost 0.2.
    """
    e = column_evidence(df) if evidence is None else evidence
    rows, n, k = F.col("rows"), F.col("n"), F.col("distinct")
    nulls = share(rows - n, rows)
    number = F.col("kind").isin("integer", "float", "boolean")
    every = n > 0

    def role(kind: str, name: str, score: float) -> Column:
        return F.struct(F.lit(kind).alias("column_type"), F.lit(name).alias("role"), F.lit(score).alias("score"))

    found = (
        F.when(F.col("kind") == "datetime", role("temporal", "dimension", 0.90))
        .when(number & (F.col("kind") == "integer") & (k == rows), role("identifier", "key", 0.90))
        .when(number & (k <= 2) & (nulls < 0.2), role("boolean", "status", 0.80))
        .when(number & (share(k, rows) < 0.05) & (k < 15), role("categorical", "dimension", 0.70))
        .when(number & _hinted(hints, "percentage"), role("numeric", "percentage", 0.85))
        .when(number & _hinted(hints, "currency"), role("currency", "measure", 0.85))
        .when(number, role("numeric", "measure", 0.75))
        .when(every & (F.col("flags") == n), role("boolean", "status", 0.90))
        .when(every & (F.col("dates") == n), role("temporal", "dimension", 0.80))
        .when(k == rows, role("identifier", "key", 0.85))
        .when(_hinted(hints, "location"), role("geolocation", "location", 0.80))
        .when(_hinted(hints, "code"), role("categorical", "code", 0.80))
        .when(_hinted(hints, "status"), role("categorical", "status", 0.80))
        .otherwise(role("categorical", "dimension", 0.60))
    )
    chosen = e.withColumn("r", found).select("column", "r.*", nulls.alias("nulls"))
    known = F.when(_hinted(hints, "concept"), F.least(F.lit(1.0), F.col("score") + 0.15)).otherwise(F.col("score"))
    score = F.when(F.col("nulls") > 0.4, F.greatest(F.lit(0.2), known - 0.2)).otherwise(known)
    return chosen.select("column", "column_type", "role", score.alias("score"))


def role_contradictions(df: DataFrame, roles: DataFrame, amounts: Sequence[str] = (), evidence: DataFrame | None = None) -> DataFrame:
    """(column, column_type, role, score, contradiction) of ``roles`` held against the values.

    A measure of texts and a key with repeated values become dimensions, a dimension of
    mostly distinct fractions becomes a measure, and a column of ``amounts`` with over 10 %
    negatives loses score. ``contradiction`` is null where the role stands.
    """
    e = column_evidence(df) if evidence is None else evidence
    facts = e.select(F.col("column").alias("c"), "kind", "rows", "n", "distinct", (F.col("numbers") - F.col("positives")).alias("negatives"))
    met = roles.join(F.broadcast(facts), F.col("column") == F.col("c"))
    measure = (F.col("role") == "measure") & F.col("column_type").isin("numeric", "currency")
    number = F.col("kind").isin("integer", "float", "boolean")
    kind = (
        F.when(measure & ~number, "measure_of_texts")
        .when(measure & F.col("column").isin(list(amounts) or [""]) & (F.col("negatives") > F.col("n") * 0.1), "negative_amounts")
        .when((F.col("role") == "key") & (F.col("distinct") < F.col("rows")) & (F.col("n") == F.col("rows")), "repeated_key")
        .when(
            (F.col("role") == "dimension") & (F.col("column_type") == "categorical") & (F.col("kind") == "float") & (F.col("distinct") > F.col("rows") * 0.9),
            "continuous_dimension",
        )
    )
    judged = met.withColumn("contradiction", kind)
    at = F.col("contradiction")
    less = F.when(at == "measure_of_texts", F.greatest(F.lit(0.1), F.col("score") - 0.5))
    less = less.when(at == "repeated_key", F.greatest(F.lit(0.2), F.col("score") - 0.4)).when(at.isNotNull(), F.greatest(F.lit(0.3), F.col("score") - 0.3))
    plain = at.isin("measure_of_texts", "repeated_key")
    return judged.select(
        "column",
        F.when(plain, "categorical").when(at == "continuous_dimension", "numeric").otherwise(F.col("column_type")).alias("column_type"),
        F.when(plain, "dimension").when(at == "continuous_dimension", "measure").otherwise(F.col("role")).alias("role"),
        F.coalesce(less, F.col("score")).alias("score"),
        "contradiction",
    )


def measures_and_dimensions(
    df: DataFrame, roles: DataFrame, aggregations: Mapping[str, str] | None = None, evidence: DataFrame | None = None
) -> DataFrame:
    """(column, part, aggregation, cardinality): sum for a measure, avg for a percentage, unless the caller says so.

    Dimensions have a cardinality: low up to 15 values, medium up to 100, else high. Keys
    are in neither part.
    """
    e = column_evidence(df) if evidence is None else evidence
    met = roles.join(F.broadcast(e.select(F.col("column").alias("c"), "distinct")), F.col("column") == F.col("c"))
    part = F.when(F.col("role").isin("measure", "percentage"), "measure").when(F.col("role") != "key", "dimension")
    own = F.lit(None).cast("string")
    for c, how in (aggregations or {}).items():
        own = F.when(F.col("column") == c, how).otherwise(own)
    usual = F.when(F.col("role") == "percentage", "avg").otherwise("sum")
    size = F.when(F.col("distinct") <= LOW_VALUES, "low").when(F.col("distinct") <= MEDIUM_VALUES, "medium").otherwise("high")
    placed = met.withColumn("part", part).where("part IS NOT NULL")
    measure = F.col("part") == "measure"
    return placed.select(
        "column", "part", F.when(measure, F.coalesce(own, usual)).alias("aggregation"), F.when(~measure, size).alias("cardinality")
    )


def semantic_gate(roles: DataFrame, least: float = GATE) -> DataFrame:
    """(column, score, kept, reason): columns whose score is below the limit are left out."""
    low = F.col("score") < least
    return roles.select("column", "score", ~low, F.when(low, "LOW_SEMANTIC_CONFIDENCE").alias("reason")).toDF("column", "score", "kept", "reason")


def lookup_pairs(df: DataFrame, candidates: Sequence[tuple[str, str]]) -> DataFrame:
    """(code, label, codes, labels, one_to_one): pairs whose code has one label wherever it stands.

    Rows where either is null are not looked at; a label with a single value names nothing.
    All candidates are grouped in one pass.
    """
    rows = [
        F.struct(F.lit(a).alias("code"), F.lit(b).alias("label"), ref(a).cast("string").alias("x"), ref(b).cast("string").alias("y"))
        for a, b in candidates
    ]
    if not rows:
        return df.sparkSession.createDataFrame([], "code string, label string, codes long, labels long, one_to_one boolean")
    pairs = df.select(F.inline(F.array(*rows))).where("x IS NOT NULL AND y IS NOT NULL").groupBy("code", "label", "x").agg(
        F.min("y").alias("y"), F.max("y").alias("last")
    )
    single = pairs.groupBy("code", "label").agg(
        F.count(F.lit(1)).alias("codes"), F.count_distinct("y").alias("labels"), F.bool_and(F.col("y") == F.col("last")).alias("fits")
    )
    known = single.where("fits AND labels > 1")
    return known.select("code", "label", "codes", "labels", (F.col("codes") == F.col("labels")).alias("one_to_one"))
