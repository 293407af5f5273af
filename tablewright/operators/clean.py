"""Cleaning steps, each a DataFrame in and a DataFrame out, and the audit of what they change."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.functions import text
from tablewright.functions.columns import (
    count_if,
    long_values,
    numeric_columns,
    per_column,
    ref,
    share,
    string_columns,
    value_counts,
    with_scalar,
)
from tablewright.functions.ordered import carry
from tablewright.functions.quantiles import quantile_row
from tablewright.operators.validate import digest, duplicate_rows


def audit(df: DataFrame, action: str, changes: dict[str, Column]) -> DataFrame:
    """(action, column, rows_affected): how many values a step changes.

    A step that gives another type changes every value that it can read; a value it
    cannot read is kept beside the result and is no change.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    made = {f.name: f.dataType for f in df.select(*[v.alias(c) for c, v in changes.items()]).schema}

    def changed(c: str, new: Column) -> Column:
        if made[c] != kinds[c]:
            return new.isNotNull()
        return ~ref(c).eqNullSafe(new)

    rows = [
        F.struct(
            F.lit(action).alias("action"),
            F.lit(c).alias("column"),
            count_if(changed(c, new)).alias("rows_affected"),
        )
        for c, new in changes.items()
    ]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def audit_rows(before: DataFrame, after: DataFrame, action: str) -> DataFrame:
    """The audit row of a step that removes rows."""
    count = F.count(F.lit(1)).alias("n")
    return before.agg(count).select(
        F.lit(action).alias("action"),
        F.lit(None).cast("string").alias("column"),
        (F.col("n") - after.agg(count).scalar()).alias("rows_affected"),
    )


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def clean_name(name: str) -> str:
    return re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "", name.strip()))


def normalize_headers(df: DataFrame) -> DataFrame:
    """Plain column names; a name that is taken, in whatever case, gets a numbered suffix."""
    taken: set[str] = set()
    names = []
    for c in df.columns:
        base = clean_name(c) or "column"
        name, n = base, 1
        while name.lower() in taken:
            n += 1
            name = f"{base}_{n}"
        taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def _match_shares(df: DataFrame, columns: Sequence[str], match: Callable[[Column], Column]) -> dict[str, float]:
    """Share of the non-null values of each column that match; one row is fetched."""
    if not columns:
        return {}
    stats = per_column(
        df, columns, {"hit": lambda c: count_if(match(c)), "present": lambda c: F.count(c)}
    )
    return {r["column"]: (r["hit"] / r["present"] if r["present"] else 0.0) for r in stats.collect()}


def infer_cast_datetime(df: DataFrame, min_share: float = 0.5) -> DataFrame:
    """Text columns that look like dates become timestamps; what does not parse is kept in ``<column>_unparsed``."""
    shares = _match_shares(df, string_columns(df), lambda c: c.rlike(text.ISO_OR_DAY_FIRST))
    return _parsed(df, [c for c, s in shares.items() if s > min_share], text.as_timestamp)


def infer_cast_numeric(df: DataFrame, min_share: float = 0.75) -> DataFrame:
    """Text columns of numbers with $, % or commas become doubles; other text is kept in ``<column>_unparsed``."""

    def bare(c: Column) -> Column:
        return text.tidy_spaces(F.regexp_replace(c, "[$%,]", ""))

    shares = _match_shares(df, string_columns(df), lambda c: bare(c).rlike(text.SIGNED_NUMBER))
    return _parsed(df, [c for c, s in shares.items() if s > min_share], lambda c: text.guarded_double(bare(c)))


def _known(c: str) -> Column:
    """The column as double, NaN as null."""
    x = ref(c).cast("double")
    return F.when(~F.isnan(x), x)


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's median, or 0 when the column is all null."""
    marked = with_scalar(df, quantile_row(df, columns, [0.5]), "_mid")
    fills = {c: F.coalesce(_known(c), F.col("_mid.q")[c][0], F.lit(0.0)) for c in columns}
    return marked.withColumns(fills).drop("_mid")


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, mode): the most frequent text, the smallest one on ties."""
    counts = value_counts(df, columns)
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"))


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the column's most frequent value, or Unknown in a text column without any."""
    modes = column_modes(df, columns).agg(
        F.map_from_entries(F.collect_list(F.struct("column", "mode"))).alias("m")
    )
    marked = with_scalar(df, modes, "_mode")
    texts = set(string_columns(df))
    fills = {}
    for c in columns:
        mode = F.col("_mode.m")[c].cast(df.schema[c].dataType)
        fills[c] = F.coalesce(ref(c), mode, *([F.lit("Unknown")] if c in texts else []))
    return marked.withColumns(fills).drop("_mode")


def impute_ffill_bfill(
    df: DataFrame, column: str, order_by: Sequence[str], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Nulls take the previous value in order, then the next one, within a key if one is given.

    ``order_by`` should identify a row (of its key).
    """
    return carry(
        carry(df, column, order_by, partition_by), column, order_by, partition_by, backward=True
    )


def clip_iqr(df: DataFrame, columns: Sequence[str], width: float = 1.5) -> DataFrame:
    """Values are limited to [Q1 - width IQR, Q3 + width IQR]; nulls stay null, NaN becomes null."""
    marked = with_scalar(df, quantile_row(df, columns, [0.25, 0.75]), "_iqr")
    clipped = {}
    for c in columns:
        q = F.col("_iqr.q")[c]
        reach = (q[1] - q[0]) * width
        clipped[c] = F.when(
            _known(c).isNotNull(), F.least(F.greatest(_known(c), q[0] - reach), q[1] + reach)
        )
    return marked.withColumns(clipped).drop("_iqr")


def _each(df: DataFrame, columns: Sequence[str], step: Callable[[Column], Column]) -> DataFrame:
    return df.withColumns({c: step(ref(c)) for c in columns})


def trim_collapse_whitespace(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _each(df, columns, text.tidy_spaces)


def empty_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _each(df, columns, text.blank_to_null)


def _parsed(df: DataFrame, columns: Sequence[str], parse: Callable[[Column], Column]) -> DataFrame:
    """Parsed values in place, and the text that did not parse beside them."""
    out = {}
    for c in columns:
        value = parse(ref(c))
        out[c] = value
        out[f"{c}_unparsed"] = F.when(value.isNull(), ref(c))
    return df.withColumns(out) if out else df


def normalize_boolean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _parsed(df, columns, text.as_boolean)


def normalize_date(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Timestamps; text that is no date is kept in ``<column>_unparsed``."""
    return _parsed(df, columns, text.as_timestamp)


def date_changes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that parse as a date but are not written YYYY-MM-DD."""
    return per_column(
        df,
        columns,
        {
            "rows_affected": lambda c: count_if(
                text.as_timestamp(c).isNotNull()
                & (c != F.date_format(text.as_timestamp(c), "yyyy-MM-dd"))
            )
        },
    )


def case_style(name: str, role: str = "dimension") -> str:
    if role in ("code", "status"):
        return "upper"
    return "lower" if "email" in name.lower() else "title"


def standardize_case(df: DataFrame, styles: dict[str, str]) -> DataFrame:
    """Column -> title, upper or lower."""
    return df.withColumns({c: text.to_case(ref(c), s) for c, s in styles.items()})


def parse_currency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _parsed(df, columns, text.as_currency)


def parse_percent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _parsed(df, columns, text.as_percent)


def parse_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _parsed(df, columns, text.as_number)


# in order of precedence: a value counts for the first kind it fits
CONVERSIONS: dict[str, Callable[[Column], Column]] = {
    "boolean": lambda c: F.when(
        F.lower(text.tidy_spaces(c)).isin("true", "t", "yes", "y", "1"), F.lit(True)
    ).when(F.lower(text.tidy_spaces(c)).isin("false", "f", "no", "n", "0"), F.lit(False)),
    "percent": text.as_percent,
    "currency": text.as_money,
    "date": text.as_timestamp,
    "number": text.as_number,
}


def conversion_kind(c: Column) -> Column:
    out = None
    for kind, parse in CONVERSIONS.items():
        hit = parse(c).isNotNull()
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out


def conversion_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kind, n, present): how many values of each column fit each kind; kind null for none."""
    kinds = df.select(
        *[F.when(text.blank_to_null(ref(c)).isNotNull(), F.coalesce(conversion_kind(ref(c)), F.lit(""))).alias(c) for c in columns]
    )
    counts = value_counts(kinds, columns)
    total = Window.partitionBy("column")
    return counts.select(
        "column", F.when(F.col("value") != "", F.col("value")).alias("kind"), "n", F.sum("n").over(total).alias("present")
    )


def convert_type(df: DataFrame, columns: Sequence[str], min_share: float = 0.30) -> DataFrame:
    """Text columns become the kind most of their convertible values have.

    A column is converted when at least two values and ``min_share`` of them fit. Text
    that does not fit the kind is kept in ``<column>_unparsed``. The kinds decide the
    schema, so a few counts per column are fetched first.
    """
    order = list(CONVERSIONS)
    fits: dict[str, list[tuple[int, int, str]]] = {c: [] for c in columns}
    present: dict[str, int] = {}
    for r in conversion_shares(df, columns).collect():
        present[r["column"]] = r["present"]
        if r["kind"] is not None:
            fits[r["column"]].append((-r["n"], order.index(r["kind"]), r["kind"]))
    out = df
    for c in columns:
        n = -sum(f[0] for f in fits[c])
        if fits[c] and n >= max(2, min_share * present[c]):
            out = _parsed(out, [c], CONVERSIONS[min(fits[c])[2]])
    return out


def standardize_units(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Weights in kilograms and lengths in metres, by the words in the column name.

    Text that is not a number with a known unit is kept in ``<column>_unparsed``.
    """
    out = df
    for c in columns:
        units = text.unit_scale(c)
        if units:
            out = _parsed(out, [c], lambda v, u=units: text.in_base_unit(v, u))
    return out


def validate_email(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _each(df, columns, text.as_email)


def normalize_phone(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _each(df, columns, text.as_phone)


def missingness_indicator(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A flag per column; nulls of text columns go to the bucket Unknown."""
    texts = set(string_columns(df))
    out = {f"{c}_is_missing": ref(c).isNull() for c in columns}
    out |= {c: F.coalesce(ref(c), F.lit("Unknown")) for c in columns if c in texts}
    return df.withColumns(out)


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def _case_variants(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, affected): texts that another text equals but for case and outer blanks. Digests stand for the texts."""
    folded = [text.blank_to_null(ref(c)) for c in columns]
    sides = [
        F.struct(
            F.lit(c).alias("column"), digest(F.lower(text.tidy_spaces(there))).alias("key"), digest(there).alias("value")
        )
        for c, there in zip(columns, folded, strict=True)
    ]
    long = df.select(F.inline(F.array(*sides))).where("key IS NOT NULL")
    varied = long.groupBy("column", "key").agg((F.min("value") != F.max("value")).alias("varied"))
    return varied.groupBy("column").agg(count_if(F.col("varied")).alias("affected"))


def detect_cleaning_issues(df: DataFrame) -> DataFrame:
    """Issue rows (id, column, severity, action, affected) judged on every value.

    Blank text is missing. One aggregate counts everything that a value shows by itself;
    copies, spellings and outliers take a pass each.
    """
    texts, numbers = string_columns(df), numeric_columns(df)
    none = F.lit(0).cast("long")
    at = {c: i for i, c in enumerate(df.columns)}
    # each reading of a value is a column below the counts, so that no count writes it out again
    there = {c: text.blank_to_null(ref(c)) if c in texts else ref(c) for c in df.columns}
    first = df.select(
        *[there[c].alias(f"there{i}") for c, i in at.items()],
        *[ref(c).alias(f"own{at[c]}") for c in texts],
        *[text.tidy_spaces(ref(c)).alias(f"tidy{at[c]}") for c in texts],
    )
    read = first.select("*", *[conversion_kind(F.col(f"there{at[c]}")).alias(f"kind{at[c]}") for c in texts])

    def of(c: str) -> Column:
        value, is_text = F.col(f"there{at[c]}"), c in texts
        own, tidy, kind = (F.col(f"{k}{at[c]}") if is_text else None for k in ("own", "tidy", "kind"))
        phone = (
            value.rlike(r"^[\s+()\d.-]+$")
            & F.length(F.regexp_replace(value, "[^0-9]", "")).between(7, 15)
            & (text.as_phone(value) != value)
            & kind.isNull()
        ) if is_text else None
        return F.struct(
            F.lit(c).alias("column"),
            F.count(F.lit(1)).alias("rows"),
            count_if(value.isNull()).alias("missing"),
            (F.count(value) if is_text else none).alias("present"),
            (count_if(own != tidy) if is_text else none).alias("padded"),
            (count_if(own.isNotNull() & value.isNull()) if is_text else none).alias("empty"),
            (count_if(kind.isNotNull()) if is_text else none).alias("fit"),
            (count_if(value.contains("@") & text.as_email(value).isNull()) if is_text else none).alias("bad_mail"),
            (count_if(phone) if is_text else none).alias("phone"),
        )

    counts = read.agg(F.array(*[of(c) for c in df.columns]).alias("rows")).select(F.inline("rows"))
    found = F.array(
        F.struct(
            F.lit("nulls").alias("kind"), F.lit("warning").alias("severity"), F.lit("missingness_indicator").alias("action"),
            F.when(F.col("missing") >= F.col("rows") * 0.10, F.col("missing")).otherwise(0).alias("affected"),
        ),
        *[
            F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"), F.lit(a).alias("action"), n.alias("affected"))
            for k, s, a, n in [
                ("whitespace", "info", "strip_whitespace", F.col("padded")),
                ("empty", "info", "empty_to_null", F.col("empty")),
                ("convert", "info", "convert_type",
                 F.when(F.col("fit") >= F.greatest(F.lit(2.0), F.col("present") * 0.3), F.col("fit")).otherwise(0)),
                ("email", "warning", "validate_email", F.col("bad_mail")),
                ("phone", "info", "normalize_phone", F.col("phone")),
            ]
        ],
    )
    shape = ["id", "column", "severity", "action", "affected"]
    own = counts.select("column", F.inline(found)).where("affected > 0").select(
        F.concat("kind", F.lit("_"), "column").alias("id"), "column", "severity", "action", F.col("affected").cast("long")
    )
    copies = duplicate_rows(df).where("surplus > 0").select(
        F.lit("duplicate_rows").alias("id"),
        F.lit(None).cast("string").alias("column"),
        F.when(share(F.col("surplus"), F.col("rows")) > 0.05, "warning").otherwise("info").alias("severity"),
        F.lit("drop_duplicates").alias("action"),
        F.col("surplus").cast("long").alias("affected"),
    )
    out = own.select(*shape).unionByName(copies)
    if texts:
        varied = _case_variants(df, texts).where("affected > 0")
        out = out.unionByName(
            varied.select(
                F.concat(F.lit("case_"), "column").alias("id"), "column", F.lit("info").alias("severity"),
                F.lit("standardize_case").alias("action"), F.col("affected").cast("long"),
            )
        )
    if numbers:
        far = outside_fences(df, numbers).where((F.col("affected") > 0) & (share(F.col("affected"), F.col("rows")) < 0.10))
        out = out.unionByName(
            far.select(
                F.concat(F.lit("outliers_"), "column").alias("id"), "column", F.lit("info").alias("severity"),
                F.lit("flag_only").alias("action"), F.col("affected").cast("long"),
            )
        )
    return out


def outside_fences(df: DataFrame, columns: Sequence[str], width: float = 1.5) -> DataFrame:
    """(column, rows, present, low, high, affected): values beyond ``width`` IQR of the quartiles."""
    marked = with_scalar(df.select(*[_known(c).alias(c) for c in columns]), quantile_row(df, columns, [0.25, 0.75]), "_iqr")
    rows = []
    for c in columns:
        q = F.col("_iqr.q")[c]
        low, high = q[0] - (q[1] - q[0]) * width, q[1] + (q[1] - q[0]) * width
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("rows"),
                F.count(ref(c)).alias("present"),
                F.max(low).alias("low"),
                F.max(high).alias("high"),
                count_if((ref(c) < low) | (ref(c) > high)).alias("affected"),
            )
        )
    return marked.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


ACTIONS: dict[str, Callable[[DataFrame, list[str]], DataFrame]] = {
    "drop_duplicates": lambda df, cols: drop_duplicate_rows(df),
    "flag_only": lambda df, cols: df,
    "drop_columns": drop_columns,
    "impute_median": impute_median,
    "impute_mode": impute_mode,
    "missingness_indicator": missingness_indicator,
    "strip_whitespace": trim_collapse_whitespace,
    "empty_to_null": empty_to_null,
    "standardize_case": lambda df, cols: _each(df, cols, lambda c: F.lower(text.tidy_spaces(c))),
    "convert_type": convert_type,
    "validate_email": validate_email,
    "normalize_phone": normalize_phone,
}
NEEDS_NO_DECISION = {"flag_only", "drop_duplicates"}


def apply_approved(
    df: DataFrame, approved: Sequence[tuple[str, str | None]], decisions: dict[tuple[str, str | None], str]
) -> DataFrame:
    """Apply the (action, column) pairs the caller approved, in order.

    Every pair but flags and row de-duplication needs a recorded decision text.
    """
    for step in approved:
        action, column = step
        if action not in NEEDS_NO_DECISION and not decisions.get(step):
            raise ValueError(f"no decision recorded for {step}")
        df = ACTIONS[action](df, [] if column is None else [column])
    return df
