"""Operators on small tables with hand-checked results."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.functions import text
from tablewright.functions.ordered import average_ranks, carry
from tablewright.functions.quantiles import exact_quantiles
from tablewright.operators import clean, explore, keys, profile, quality, segments, series, validate
from tablewright.sources import tables


def column(spark, values, kind="string", name="c"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, {name} {kind}")


def values(df, name="c"):
    return [r[name] for r in df.orderBy("i").collect()]


# ordered values


def test_average_ranks_with_a_value_that_half_of_the_rows_hold(spark):
    x = [5.0] * 50 + [float(i) for i in range(49)] + [None, float("nan")]
    got = {r.value: (r.n, r.rank, r.total) for r in average_ranks(column(spark, x, "double"), ["c"]).collect()}
    known = sorted(v for v in x if v is not None and v == v)
    for v in set(known):
        places = [i + 1 for i, w in enumerate(known) if w == v]
        assert got[v] == (len(places), sum(places) / len(places), len(known))


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(i % 7), i, 1.0) for i in range(100)] + [(None, None, None)], "a double, b int, c double")
    got = {r.column: r.q for r in exact_quantiles(df, ["a", "b", "c"], [0.0, 0.25, 0.5, 1.0]).collect()}
    assert got == {"a": [0.0, 1.0, 3.0, 6.0], "b": [0.0, 24.75, 49.5, 99.0], "c": [1.0, 1.0, 1.0, 1.0]}


@pytest.mark.parametrize("backward", [False, True])
def test_carry(spark, backward):
    big = 2**53
    rows = [(big + i, None if i % 5 else i, "k", i) for i in range(60)] + [(None, 999, "k", 7)]
    df = spark.createDataFrame(rows, "at long, v int, bucket string, _range int").repartition(5)
    got = {r["at"]: (r.v, r.bucket, r._range) for r in carry(df, "v", ["at"], backward=backward).collect()}
    assert len(got) == 61
    for i in range(60):
        want = i - i % 5 if not backward else (i + 4) // 5 * 5
        if backward and want > 55:
            # nulls come first in the order, so they are no later rows
            want = None
        assert got[big + i] == (want, "k", i), i
    assert got[None] == (999, "k", 7)


def test_carry_stays_inside_a_key(spark):
    rows = [(k, i, (i if i == 3 else None)) for k in "ab" for i in range(40)] + [("c", i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i int, v int").repartition(6)
    got = {(r.k, r.i): r.v for r in clean.impute_ffill_bfill(df, "v", ["i"], ["k"]).collect()}
    assert all(got[k, i] == 3 for k in "ab" for i in range(40))
    assert all(got["c", i] is None for i in range(5))


# parsing


@pytest.mark.parametrize(
    "parse, value, want",
    [
        (text.as_currency, "12D", None), (text.as_currency, "3f", None), (text.as_currency, "NaN", None),
        (text.as_currency, "Infinity", None), (text.as_currency, "$1,000.00", 1000.0), (text.as_currency, "-$50.00", -50.0),
        (text.as_percent, "12.5 %", 0.125), (text.as_percent, "12D%", None), (text.as_number, "\t12\n", 12.0),
        (text.as_number, "1,234.5", 1234.5), (text.as_number, "1e5", None), (text.as_email, "\tUser@x.com\n", "user@x.com"),
        (text.tidy_spaces, " a   b ", "a b"), (text.as_boolean, " Enabled ", True), (text.as_boolean, "2", None),
    ],
)
def test_parsers(spark, parse, value, want):
    assert spark.range(1).select(parse(F.lit(value)).alias("x")).first().x == want


@pytest.mark.parametrize(
    "value, day",
    [
        ("1/5/2026", (2026, 1, 5)), ("2026-1-5", (2026, 1, 5)), ("2026-01-01T10:00:00Z", (2026, 1, 1)),
        ("2026-01-01T10:00:00.123", (2026, 1, 1)), ("2026-01-01 10:00:00", (2026, 1, 1)), ("Jan 5, 2026", (2026, 1, 5)),
        ("January 5 2026", (2026, 1, 5)), ("05-Jan-2026", (2026, 1, 5)), ("5 jan 2026", (2026, 1, 5)), ("25/12/2026", (2026, 12, 25)),
        ("2026/02/03", (2026, 2, 3)), ("02-05-2026", (2026, 2, 5)),
    ],
)
def test_dates(spark, value, day):
    assert spark.range(1).select(text.as_timestamp(F.lit(value)).alias("x")).first().x.date() == datetime.date(*day)


@pytest.mark.parametrize("value", ["invalid", "99/99/2026", "", "2026", "12"])
def test_no_dates(spark, value):
    assert spark.range(1).select(text.as_timestamp(F.lit(value)).alias("x")).first().x is None


def test_change_counts(spark):
    spaces = column(spark, ["  a ", "b", "c  d", "e\t", "f"])
    booleans = column(spark, ["yes", "no", "Y", "N", "true", "false", "active", "disabled"])
    currency = column(spark, ["$120.00", "€1,500.50", "-$50.00", "invalid"])
    for df, parse, n in ((spaces, text.tidy_spaces, 3), (booleans, text.as_boolean, 8), (currency, text.as_currency, 3)):
        assert clean.audit(df, "x", {"c": parse(F.col("c"))}).first().rows_affected == n
    assert values(clean.normalize_boolean(booleans, ["c"])) == [True, False, True, False, True, False, True, False]
    assert values(clean.parse_currency(currency, ["c"])) == [120.0, 1500.5, -50.0, None]
    assert values(clean.parse_currency(currency, ["c"]), "c_unparsed") == [None, None, None, "invalid"]


def test_units(spark):
    got = clean.standardize_units(column(spark, ["10kg", "500g", "5 lbs", "invalid"], name="weight_col"), ["weight_col"])
    assert values(got, "weight_col") == [10.0, 0.5, pytest.approx(5 / 2.20462), None]
    assert values(got, "weight_col_unparsed") == [None, None, None, "invalid"]


# cleaning


@pytest.mark.parametrize(
    "names, want",
    [(["a", "a_2", "a "], ["a", "a_2", "a_3"]), (["Qty!", "qty"], ["Qty", "qty_2"]), (["?", "!"], ["column", "column_2"])],
)
def test_headers_stay_apart(spark, names, want):
    assert clean.normalize_headers(spark.createDataFrame([tuple(range(len(names)))], names)).columns == want


def test_convert_type_loses_nothing(spark):
    df = column(spark, ["F", "O", "P", "F", "O", "no", None, ""])
    got = clean.convert_type(df, ["c"])
    assert values(got) == [False, None, None, False, None, False, None, None]
    assert values(got, "c_unparsed") == [None, "O", "P", None, "O", None, None, ""]


def test_imputation_of_empty_columns(spark):
    df = spark.createDataFrame([(0, None, None, None), (1, None, None, None)], "i long, x int, s string, d double")
    assert [tuple(r) for r in clean.impute_mode(df, ["x", "s"]).orderBy("i").collect()] == [(0, None, "Unknown", None), (1, None, "Unknown", None)]
    assert values(clean.impute_median(df, ["d"]), "d") == [0.0, 0.0]


def test_nan_is_missing(spark):
    df = column(spark, [1.0, 2.0, 3.0, 4.0, 100.0, float("nan"), None], "double")
    assert values(clean.clip_iqr(df, ["c"])) == [1.0, 2.0, 3.0, 4.0, 7.0, None, None]
    pair = df.withColumn("e", F.col("c") * 2)
    assert explore.correlation_matrix(pair, ["c", "e"]).first().n == 5
    assert profile.numeric_summary(df, ["c"]).first().n == 5


def test_every_detected_action_can_be_applied(spark):
    df = spark.createDataFrame(
        [(f" T{i % 3} ", "yes" if i % 2 else None, "a@b" if i % 4 else "u@x.org", "555.010.1234", float(i)) for i in range(40)] * 2,
        "t string, b string, m string, p string, x double",
    )
    issues = clean.detect_cleaning_issues(df).collect()
    assert {i.action for i in issues} >= {"drop_duplicates", "strip_whitespace", "convert_type", "validate_email", "normalize_phone", "missingness_indicator"}
    steps = [(i.action, i.column) for i in issues]
    assert clean.apply_approved(df, steps, {s: "agreed" for s in steps}).count() == 40
    with pytest.raises(ValueError):
        clean.apply_approved(df, [("convert_type", "b")], {})


def test_dates_are_no_phone_numbers(spark):
    df = column(spark, ["2026-01-01", "2026-01-02", "01-02-2026"] * 5)
    assert not [r for r in clean.detect_cleaning_issues(df).collect() if r.action == "normalize_phone"]


# tables, validation, exploration


def test_results_are_replaced(spark, tmp_path):
    path = str(tmp_path / "r")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    tables.write_result(df, path, "one")
    tables.write_result(df, path, "two")
    tables.write_result(df, path, "one")
    assert tables.read_result(spark, path, "one").count() == 2 and tables.read_result(spark, path, "two").count() == 2


@pytest.mark.parametrize("encoding, mark", [("utf-8", b""), ("utf-8-sig", b""), ("utf-16", b"")])
def test_csv(spark, tmp_path, encoding, mark):
    path = tmp_path / "x.csv"
    path.write_bytes(mark + 'id,val\n1,"say ""hi"", now é �"\n\n2,"two\nlines"\n'.encode(encoding))
    rows = tables.read_csv(spark, str(path), multi_line=True).collect()
    assert [(r[0], r[1]) for r in rows] == [(1, 'say "hi", now é �'), (2, "two\nlines")]


def test_empty_csv(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "e.csv"))


def test_headers_have_one_shape(spark):
    df = spark.createDataFrame([(1,)], "a int")
    some, none = validate.check_headers(df, ["b?", "b?"]), validate.check_headers(df)
    assert some.columns == none.columns and none.count() == 0
    assert some.unionByName(none).count() == 2


def test_numbers_among_texts(spark):
    assert validate.check_mixed_types(column(spark, ["12D", "3f", "NaN", "x"])).count() == 0
    assert validate.check_mixed_types(column(spark, ["12", "x"])).first().affected == 1


def test_validate_scans_at_most_three_times(spark, small):
    plan = validate.validate(tables.read_table(spark, small, "orders"))._jdf.queryExecution().optimizedPlan().toString()
    # one aggregate, copies, distinct texts, and the first row
    assert plan.count("Relation [") <= 4


def test_all_periods_and_measures_come_back(spark):
    start = datetime.date(2000, 1, 1)
    df = spark.createDataFrame([(start + datetime.timedelta(days=31 * i), float(i)) for i in range(80)], "d date, x double")
    trend = explore.period_mean_trend(df, "d", "x").collect()
    assert len(trend) >= 78 and max(r.period for r in trend).year == 2006
    wide = df.select(*[F.col("x").alias(f"m{i}") for i in range(9)])
    assert explore.basic_kpis(wide, wide.columns).count() == 3 + 2 * 9


def test_empty_choices(spark):
    df = spark.createDataFrame([(1.0, "")], "x double, s string")
    assert explore.correlation_matrix(df, ["x"]).count() == 0
    assert explore.domain_kpis(df, "Manufacturing").count() == 0
    kpi = explore.kpi_aggregate(df, [{"name": "Notes", "column": "s", "aggregation": "count"}])
    assert {r.kpi: r.value for r in kpi.collect()} == {"Total Records": 1.0, "Notes": 0.0}


# keys, quality, series, segments


def test_composite_key(spark):
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (2, 1, "y"), (2, 2, "y")], "A int, B int, C string")
    assert [tuple(r) for r in keys.composite_keys(df, ["A", "B", "C"]).orderBy("a").collect()] == [("A", "B"), ("B", "C")]
    assert keys.primary_key(df).count() == 0
    found = {(r.determinant, r.dependent) for r in keys.functional_dependencies(df, ["A", "B", "C"]).collect()}
    assert found == {("A", "C"), ("C", "A")}


def test_hierarchy_with_two_parents(spark):
    df = spark.createDataFrame([("Phones", "A"), ("Phones", "B"), ("TVs", "A"), (None, "C")], "child string, parent string")
    assert tuple(keys.check_hierarchy(df, "child", "parent").first()) == (1, "Phones")


def test_rules(spark):
    df = spark.createDataFrame([(1, 0), (-1, 2), (3, -1), (None, 1)], "price int, quantity int")
    got = quality.rule_violations(df, {"p": quality.non_negative("price"), "q": quality.positive("quantity")})
    assert {r.rule: (r.checked, r.broken) for r in got.collect()} == {"p": (3, 1), "q": (4, 2)}


def test_series(spark):
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(40) if i not in (10, 11)]
    df = spark.createDataFrame([(d, 100.0 - i) for i, d in enumerate(days)], "d date, x double")
    buckets = series.period_buckets(df, "d", "x", "day")
    assert series.trend_class(buckets).first().trend == "flat"
    assert [(r.days) for r in series.time_gaps(buckets, "day").collect()] == [3]
    assert series.change_point(buckets).count() == 1
    assert series.period_growth(buckets).where("growth_pct IS NULL").count() == 1
    assert series.linear_forecast(buckets, 2).orderBy("step").first().linear == pytest.approx(62.0)


def test_chi_square_of_independent_columns(spark):
    df = spark.createDataFrame([(a, b) for a in "xy" for b in "uv" for _ in range(10)], "a string, b string")
    assert tuple(segments.chi_square(df, "a", "b").first()) == (0.0, 1, 40)
