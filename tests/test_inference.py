"""Tests with p-values, collinearity and forecasts: constants, plain versions, awkward tables."""

from __future__ import annotations

import datetime
import math
import random

import numpy as np
import pytest

from tablewright.functions import distributions as dist
from tablewright.functions.gram import gram
from tablewright.operators import explore, forecast, inference, segments, series


@pytest.mark.parametrize(
    ("p", "want"),
    [
        (dist.t_two_sided(2.2281388519649385, 10), 0.05),
        (dist.t_two_sided(1.959963984540054, 1e9), 0.05),
        (dist.t_two_sided(12.706204736432095, 1), 0.05),
        (dist.chi2_upper(3.841458820694124, 1), 0.05),
        (dist.chi2_upper(18.307038053275146, 10), 0.05),
        (dist.f_upper(4.9646027437307145, 1, 10), 0.05),
        (dist.f_upper(3.3258345304130112, 5, 10), 0.05),
        (dist.normal_two_sided(2.5758293035489004), 0.01),
        (dist.beta_regularised(2.0, 3.0, 0.5), 0.6875),
        (dist.gamma_upper(0.5, 0.5), math.erfc(math.sqrt(0.5))),
    ],
)
def test_tails_equal_published_constants(p, want):
    assert abs(p - want) < 1e-6


@pytest.mark.parametrize(("x", "want"), [(1.3580986393225507, 0.05), (1.2238478702170825, 0.10), (1.6276236115189503, 0.01), (0.5, 0.9639452436648751)])
def test_kolmogorov_tail(x, want):
    n = 1e14
    assert abs(dist.kolmogorov_two_sided(x / math.sqrt(n), n) - want) < 1e-6


def frame(spark, rows, *names):
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def test_gram_of_columns_with_gaps(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) + [1e8, 0, -5, 3]
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = 7.0
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    got = {(r.a, r.b): r for r in explore.correlation_matrix(frame(spark, rows, *"abcd")).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}  # d has no spread
    for (a, b), r in got.items():
        both = x[:, ["abcd".index(a), "abcd".index(b)]]
        both = both[~np.isnan(both).any(axis=1)]
        assert r.n == len(both) and abs(r.r - np.corrcoef(both.T)[0, 1]) < 1e-6
    known = x[~np.isnan(x).any(axis=1)]
    cov = {(r.a, r.b): r.covariance for r in explore.covariance_matrix(frame(spark, rows, *"abcd")).collect()}
    assert len(cov) == 10
    want = np.cov((known - known.mean(axis=0)).T)
    assert all(abs(v - want["abcd".index(a), "abcd".index(b)]) < 1e-6 for (a, b), v in cov.items())


def test_two_hundred_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 200))
    df = frame(spark, [tuple(map(float, r)) for r in x], *[f"c{i}" for i in range(200)])
    assert gram(df, df.columns).count() == 200 * 201 // 2
    got = {r.column: r.vif for r in inference.vif(df, df.columns).collect()}
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    assert all(abs(got[f"c{i}"] - want[i]) < 1e-6 for i in range(200))


def test_vif_of_collinear_constant_and_few_rows(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=50), rng.normal(size=50)
    rows = [(float(x), float(y), float(x + y), 3.0) for x, y in zip(a, b)]
    got = {r.column: r.vif for r in inference.vif(frame(spark, rows, *"abcd"), list("abcd")).collect()}
    assert got == {"a": 999.0, "b": 999.0, "c": 999.0, "d": 1.0}
    assert [tuple(r) for r in inference.vif(frame(spark, rows, *"abcd"), ["a"]).collect()] == [("a", 1.0)]
    few = frame(spark, rows[:4], *"abcd")
    assert {r.vif for r in inference.vif(few, ["a", "b"]).collect()} == {1.0}
    assert {r.vif for r in inference.vif(few.limit(0), ["a", "b"]).collect()} == {1.0}


def plain_ranks(v):
    order = sorted(v)
    return [order.index(x) + (order.count(x) + 1) / 2 for x in v]


def test_correlation_test_on_ties_and_nulls(spark):
    rng = random.Random(8)
    rows = [(float(rng.randint(0, 4)), float(rng.randint(0, 9)), 1.0, None if i % 3 else float(i)) for i in range(60)]
    rows = [(x, x + y if i % 5 else None, z, w) for i, (x, y, z, w) in enumerate(rows)]
    df = frame(spark, rows, *"abcd")
    pairs = [("a", "b"), ("a", "c"), ("b", "d")]
    for method, ranked in (("pearson", lambda v: v), ("spearman", plain_ranks)):
        got = {(r.a, r.b): r for r in inference.correlation_test(df, pairs, method).collect()}
        for a, b in pairs:
            both = [(r["abcd".index(a)], r["abcd".index(b)]) for r in rows]
            both = [p for p in both if None not in p]
            r = got[a, b]
            assert r.n == len(both)
            if b == "c":
                assert (r.r, r.p, r.significant) == (0.0, 1.0, False)
                continue
            want = np.corrcoef(ranked([p[0] for p in both]), ranked([p[1] for p in both]))[0, 1]
            assert abs(r.r - want) < 1e-9
            t = want * math.sqrt((r.n - 2) / (1 - want**2))
            assert abs(r.p - dist.t_two_sided(t, r.n - 2)) < 1e-9
    chosen = inference.correlation_test(df.limit(0), pairs).collect()
    assert {(r.n, r.r, r.p) for r in chosen} == {(0, 0.0, 1.0)}
    line = frame(spark, [(float(i), 2.0 * i) for i in range(20)], "x", "y")
    assert [(r.r, r.p) for r in inference.correlation_test(line, [("x", "y")]).collect()] == [(1.0, 0.0)]


def test_normality_of_a_bell_and_of_its_square(spark):
    rng = np.random.default_rng(5)
    bell = rng.normal(size=4000)
    df = frame(spark, [(float(x), float(x * x), 2.0, float(i) if i < 7 else None) for i, x in enumerate(bell)], "bell", "square", "flat", "few")
    got = {r.column: r for r in inference.normality(df, df.columns).collect()}
    assert got["bell"].normal and got["bell"].near_normal
    assert not got["square"].normal and not got["square"].near_normal
    assert not got["flat"].normal and got["flat"].k2 is None
    assert not got["few"].normal and got["few"].n == 7
    ks = {r.column: r for r in inference.normality_ks(df, df.columns).collect()}
    z = np.sort((bell - bell.mean()) / (bell.std(ddof=1) + 1e-9))
    law = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
    at = np.arange(1, 4001) / 4000
    assert abs(ks["bell"].d - max((at - law).max(), (law - at + 1 / 4000).max())) < 1e-12
    assert ks["bell"].normal and not ks["square"].normal and "flat" not in ks
    assert inference.normality_ks(df.limit(0), ["bell"]).count() == 0


def test_mann_whitney_equals_known_value(spark):
    rows = [("a", v) for v in (19.0, 22.0, 16.0, 29.0, 24.0)] + [("b", v) for v in (20.0, 11.0, 17.0, 12.0)] + [("c", 1.0), (None, 3.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    (r,) = inference.mann_whitney_u(df, "g", "a", "b", "v").collect()
    assert (r.u, r.n_a, r.n_b) == (17.0, 5, 4)
    assert abs(r.p - 0.11134688653314041) < 1e-9
    (back,) = inference.mann_whitney_u(df, "g", "b", "a", "v").collect()
    assert back.u == 3.0 and abs(back.p - r.p) < 1e-12
    same = spark.createDataFrame([("a", 1.0)] * 3 + [("b", 1.0)] * 3, "g string, v double")
    assert [r.p for r in inference.mann_whitney_u(same, "g", "a", "b", "v").collect()] == [1.0]
    assert inference.mann_whitney_u(df, "g", "a", "missing", "v").count() == 0


def test_the_test_of_groups_follows_their_shape(spark):
    rng = np.random.default_rng(6)
    normal = [(g, float(v)) for g, m in (("a", 0), ("b", 1), ("c", 2)) for v in rng.normal(m, 1, 200)]
    skewed = [(g, float(math.exp(v))) for g, v in normal]

    def method(rows):
        return inference.choose_group_test(spark.createDataFrame(rows, "g string, v double"), "g", "v").first()["method"]

    two = [r for r in normal if r[0] != "c"]
    assert method(two) == "t_test" and method(normal) == "anova"
    assert method(skewed) == "kruskal" and method([r for r in skewed if r[0] != "c"]) == "mann_whitney"
    assert method(two + [("tiny", 1.0)] * 2) == "t_test"
    assert method([r for r in normal if r[0] == "a"]) == "none"
    assert method(two + [("small", float(i)) for i in range(5)]) == "kruskal"
    for rows, name in ((two, "t_test"), (normal, "anova"), (skewed, "kruskal")):
        (r,) = inference.compare_groups(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()
        assert r.method == name and r.significant and r.p < 1e-6
    none = spark.createDataFrame([], "g string, v double")
    assert inference.compare_groups(none, "g", "v").count() == 0


def test_anova_keeps_its_digits_for_large_means(spark):
    rows = [(g, 1e8 + k + 0.1 * (i % 7)) for k, g in enumerate("abc") for i in range(70)]
    small = [(g, v - 1e8) for g, v in rows]
    f = [segments.anova_f(spark.createDataFrame(r, "g string, v double"), "g", "v").first()["f"] for r in (rows, small)]
    assert abs(f[0] / f[1] - 1) < 1e-5


def days(n):
    return [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(n)]


def test_linear_trend(spark):
    rows = [("up", d, float(i)) for i, d in enumerate(days(12))] + [("down", d, -0.5 * i + (i % 2)) for i, d in enumerate(days(30))]
    rows += [("level", d, 1.0) for d in days(12)] + [("short", d, float(i)) for i, d in enumerate(days(9))] + [("noise", d, float(i * 7919 % 13)) for i, d in enumerate(days(40))]
    rows += [("slow", d, 0.0005 * i) for i, d in enumerate(days(20))]
    df = spark.createDataFrame(rows, "k string, period date, mean double")
    got = {r.k: r for r in inference.linear_trend_test(df, ["k"]).collect()}
    assert {k: r.direction for k, r in got.items()} == {
        "up": "growth", "down": "decline", "level": "stable", "short": "stable", "noise": "stable", "slow": "plateau",
    }
    assert abs(got["up"].slope - 1) < 1e-12 and got["up"].p == 0.0 and abs(got["up"].r2 - 1) < 1e-12
    assert got["short"].slope is None and got["short"].n == 9
    assert inference.linear_trend_test(df.limit(0), ["k"]).count() == 0


def plain_best(v, steps):
    """Hold-out of the last periods, one step at a time."""

    def line(x):
        n = len(x)
        if n == 1:
            return 0.0, x[0]
        m = (n - 1) / 2
        slope = sum((i - m) * y for i, y in enumerate(x)) / sum((i - m) ** 2 for i in range(n))
        return slope, sum(x) / n - slope * m

    def weighted(x):
        x = x[-3:]
        while len(x) < 3:
            x = [sum(x) / len(x), *x]
        return 0.5 * x[2] + 0.3 * x[1] + 0.2 * x[0]

    def level(x):
        out = x[0]
        for y in x[1:]:
            out = 0.3 * y + 0.7 * out
        return out

    def mean(x):
        return sum(x[-3:]) / len(x[-3:])

    def repeated(f):
        def run(x, k):
            x = list(x)
            for _ in range(k):
                x.append(f(x))
            return x[-k:]

        return run

    def lines(x, k):
        slope, start = line(x)
        return [start + slope * (len(x) + i) for i in range(k)]

    methods = {
        "moving_average": repeated(mean),
        "weighted_moving_average": repeated(weighted),
        "exponential_smoothing": lambda x, k: [level(x)] * k,
        "linear_regression": lines,
    }
    n = len(v)
    held = max(1, min(3, math.floor(n * 0.3)))
    scores = {m: sum(abs((v[i] - f(v[:i], 1)[0]) / (v[i] or 1)) for i in range(n - held, n)) / held for m, f in methods.items()}
    best = min(methods, key=lambda m: scores[m])
    rest = [v[i] - methods[best](v[:i], 1)[0] for i in range(1, n)]
    spread = float(np.std(rest))
    return [
        (best, scores[best], max(0.0, x), max(0.0, x - 1.96 * spread * math.sqrt(h)), x + 1.96 * spread * math.sqrt(h))
        for h, x in enumerate(methods[best](v, steps), 1)
    ]


SERIES = {
    "line": [10.0 + 3 * i for i in range(12)],
    "level": [5.0] * 8,
    "falling": [50.0 - 12 * i for i in range(6)],
    "zero": [0.0, 0.0, 1.0, 0.0, 2.0],
    "four": [4.0, 8.0, 1.0, 9.0],
    "wave": [20 + 10 * math.sin(i) for i in range(25)],
    "noise": [float(i * 7919 % 31) for i in range(40)],
}


def monthly(spark, every):
    rows = [(k, datetime.date(2020 + i // 12, 1 + i % 12, 1), x) for k, v in every.items() for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "k string, period date, total double").repartition(5)


def test_best_of_four_equals_a_plain_version(spark):
    found = forecast.forecast_best_of_four(monthly(spark, SERIES), 4, "month", ["k"]).collect()
    assert len(found) == 4 * len(SERIES)
    for k, v in SERIES.items():
        rows = sorted((r for r in found if r.k == k), key=lambda r: r.step)
        for r, (method, mape, x, low, high) in zip(rows, plain_best(v, 4), strict=True):
            assert r.method == method, k
            assert np.allclose((r.mape, r.predicted, r.lower, r.upper), (mape, x, low, high), atol=1e-8)
            n = len(v) - 1 + r.step
            assert r.period == datetime.date(2020 + n // 12, 1 + n % 12, 1)


def test_short_series_and_none(spark):
    short = {"three": [3.0, 6.0, 9.0], "one": [7.0]}
    rows = {(r.k, r.step): r for r in forecast.forecast_best_of_four(monthly(spark, short), 2, "month", ["k"]).collect()}
    assert (rows["three", 2].predicted, rows["one", 1].predicted) == (6.0, 7.0)
    assert abs(rows["three", 1].lower - 4.2) < 1e-9 and rows["one", 1].confidence == 0.5
    none = monthly(spark, {"x": [1.0]}).limit(0)
    assert forecast.forecast_best_of_four(none, 2, "month", ["k"]).count() == 0
    assert forecast.forecast_holt(none, 2, "month", ["k"]).count() == 0
    alone = forecast.forecast_best_of_four(monthly(spark, {"line": SERIES["line"]}), 2).orderBy("step").collect()
    assert [round(r.predicted, 6) for r in alone] == [46.0, 49.0]


def test_holt_equals_a_plain_version(spark):
    every = SERIES | {"one": [7.0], "two": [3.0, 5.0]}
    found = {(r.k, r.method, r.step): r for r in forecast.forecast_holt(monthly(spark, every), 3, "month", ["k"]).collect()}
    assert len(found) == 9 * len(every)
    for k, v in every.items():
        level, trend = v[0], v[1] - v[0] if len(v) > 1 else 0.0
        smooth = v[0]
        for x in v[1:]:
            before = level
            level = 0.4 * x + 0.6 * (level + trend)
            trend = 0.2 * (level - before) + 0.8 * trend
            smooth = 0.3 * x + 0.7 * smooth
        width = max(1, min(6, len(v) // 2))
        mean = sum(v[-width:]) / width
        for h in (1, 2, 3):
            for method, x, base, scale in (("holt", level + h * trend, level, math.sqrt(h)), ("moving_average", mean, mean, 1.0), ("smoothing", smooth, smooth, math.sqrt(h))):
                spread = float(np.std(v)) if len(v) > 1 else abs(base) * 0.1
                r = found[k, method, h]
                assert np.allclose((r.predicted, r.lower, r.upper), (x, x - 1.96 * spread * scale, x + 1.96 * spread * scale), atol=1e-8), (k, method)


def test_buckets_feed_the_forecast(spark):
    rows = [(datetime.datetime(2024, 1 + i % 5, 3), 1.0) for i in range(50)] + [(None, 5.0), (datetime.datetime(2024, 1, 1), None)]
    buckets = series.period_buckets(spark.createDataFrame(rows, "d timestamp, v double"), "d", "v", "month")
    assert {round(r.predicted, 6) for r in forecast.forecast_best_of_four(buckets, 3).collect()} == {10.0}
