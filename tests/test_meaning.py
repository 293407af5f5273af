"""Semantic types, roles, rules, scores, duplicates and drivers on small tables."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions.components import components
from tablewright.operators import drivers, duplicates, quality, rules, semantics, series
from tablewright.session import new_path


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("alike", [0.88, 0.7])
def test_spelling_pairs_equal_all_pairs(spark, alike):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(60)}
    for w in list(words):
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + "d" + w[i:], w[:i] + "d" + w[i + 1 :]]))
    words.discard("")
    values = spark.createDataFrame([("c", w) for w in sorted(words)], "column string, value string")
    got = {(r.a, r.b): r.edits for r in duplicates.spelling_pairs(values, alike).collect()}
    ordered = sorted(words)
    want = {
        (a, b): edits(a, b)
        for i, a in enumerate(ordered)
        for b in ordered[i + 1 :]
        if edits(a, b) <= int((1 - alike) * max(len(a), len(b)) + 1e-9)
    }
    assert got == want and want


def test_spelling_groups_and_report(spark):
    names = ["Automobile"] * 5 + [" automobile "] * 2 + ["Automobiles"] * 3 + ["Automobiless", "Furniture", "Household", "Machinery", None, "  "]
    rows = [(i % 3, n) for i, n in enumerate(names)] + [(7, "Furniture")] * 2
    df = spark.createDataFrame(rows, "k int, segment string")
    got = {r.value: (r.n, r.group) for r in duplicates.spelling_groups(df, ["segment"]).collect()}
    assert got == {"Automobile": (5, "Automobile"), "automobile": (2, "Automobile"), "Automobiles": (3, "Automobile"), "Automobiless": (1, "Automobile")}
    report = {r.kind: r for r in duplicates.duplicate_report(df, ["k"]).collect()}
    assert (report["spellings"].groups, report["spellings"].affected) == (1, 11)
    surplus = len(rows) - len(set(rows))
    assert (report["rows"].affected, report["rows"].column, report["rows"].risk) == (surplus, None, "low")
    assert (report["keys"].affected, report["keys"].column) == (len(rows) - 4, "k")
    assert duplicates.duplicate_report(df.limit(0), ["k"]).count() == 0
    few = spark.createDataFrame([("abcdefghij",), ("abcdefghik",)], "s string")
    assert duplicates.spelling_groups(few, ["s"]).count() == 0  # two values only


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)}


def mixed(spark, n=60):
    rows = [
        (
            i, 1000.5 + i * i, ["low", "mid", "high"][i % 3], "yes" if i % 2 else "No", f"2024-01-{1 + i % 28:02d}", f"{i % 100}%",
            f"$ {i * 3}", -89.5 + 3 * i % 178, "some longer text about item number " + str(i), None, i % 2, datetime.date(2024, 1, 1),
        )
        for i in range(n)
    ]
    return spark.createDataFrame(
        rows,
        "id long, price double, level string, flag string, day string, part string, money string, lat double, note string, gone string, bit int, at date",
    )


def test_semantic_types(spark):
    got = {r.column: (r.semantic_type, r.confidence) for r in semantics.classify_semantic_type(mixed(spark)).collect()}
    kinds = {c: k for c, (k, _) in got.items()}
    assert kinds["day"] == "DATETIME" and kinds["at"] == "DATETIME"
    assert kinds["lat"] == "GEOGRAPHIC" and kinds["level"] == "CATEGORICAL" and kinds["note"] == "TEXT"
    assert got["gone"] == ("CATEGORICAL", 0.1)
    assert kinds["id"] in ("NUMERIC_DISCRETE", "GEOGRAPHIC", "PERCENTAGE")
    hints = {"flag": ["BOOLEAN"], "price": ["MONETARY"], "id": ["IDENTIFIER"], "part": ["PERCENTAGE"]}
    hinted = {r.column: r.semantic_type for r in semantics.classify_semantic_type(mixed(spark).select("flag", "price", "part"), hints).collect()}
    assert hinted["flag"] == "BOOLEAN" and hinted["part"] == "PERCENTAGE"
    none = semantics.classify_semantic_type(mixed(spark).limit(0)).collect()
    assert {(r.semantic_type, r.confidence) for r in none} == {("CATEGORICAL", 0.1)}


def test_roles_and_what_contradicts_them(spark):
    df = mixed(spark)
    got = {r.column: (r.column_type, r.role, round(r.score, 6)) for r in semantics.column_roles(df, {"level": ["status"], "price": ["currency"]}).collect()}
    assert got["id"] == ("identifier", "key", 0.9)
    assert got["price"] == ("currency", "measure", 0.85)
    assert got["level"] == ("categorical", "status", 0.8)
    assert got["flag"] == ("boolean", "status", 0.9)
    assert got["bit"] == ("boolean", "status", 0.8)
    assert got["day"] == ("temporal", "dimension", 0.8) and got["at"] == ("temporal", "dimension", 0.9)
    assert got["note"] == ("identifier", "key", 0.85)
    assert got["gone"] == ("categorical", "dimension", 0.4)
    claims = spark.createDataFrame(
        [("level", "numeric", "measure", 0.7), ("bit", "identifier", "key", 0.5), ("lat", "numeric", "measure", 0.4), ("price", "categorical", "dimension", 0.9), ("id", "identifier", "key", 0.9)],
        "column string, column_type string, role string, score double",
    )
    said = {r.column: (r.column_type, r.role, round(r.score, 6), r.contradiction) for r in semantics.role_contradictions(df, claims, ["lat"]).collect()}
    assert said["level"] == ("categorical", "dimension", 0.2, "measure_of_texts")
    assert said["bit"] == ("categorical", "dimension", 0.2, "repeated_key")
    assert said["lat"] == ("numeric", "measure", 0.3, "negative_amounts")
    assert said["price"] == ("numeric", "measure", 0.6, "continuous_dimension")
    assert said["id"] == ("identifier", "key", 0.9, None)
    parts = {r.column: (r.part, r.aggregation, r.cardinality) for r in semantics.measures_and_dimensions(df, semantics.column_roles(df), {"price": "max"}).collect()}
    assert parts["price"] == ("measure", "max", None) and parts["level"] == ("dimension", None, "low")
    assert "id" not in parts and "note" not in parts
    gate = {r.column: (r.kept, r.reason) for r in semantics.semantic_gate(semantics.column_roles(df)).collect()}
    assert gate["gone"] == (False, "LOW_SEMANTIC_CONFIDENCE") and gate["id"] == (True, None)


def test_lookup_pairs(spark):
    rows = [(1, "one", "x"), (2, "two", "x"), (1, "one", "x"), (3, "two", "x"), (None, "none", "x"), (4, None, "x")]
    df = spark.createDataFrame(rows, "code int, label string, same string")
    got = {(r.code, r.label): (r.codes, r.labels, r.one_to_one) for r in semantics.lookup_pairs(df, [("code", "label"), ("label", "code"), ("code", "same")]).collect()}
    assert got == {("code", "label"): (3, 2, False)}
    assert semantics.lookup_pairs(df, []).count() == 0


def test_rules_are_learned_kept_and_applied(spark):
    df = spark.createDataFrame([(1, 0.0, "it's", 2), (5, 2.0, "b\\c", 9)], "a int, b double, s string, c int")
    found = rules.learn_rules(df, df.columns, [("a", "c"), ("c", "a")])
    assert set(found) == {"a_positive", "b_non_negative", "c_positive", "a_known", "b_known", "s_known", "c_known", "s_listed", "a_before_c"}
    store = new_path(spark, "rules")
    assert rules.stored_rules(spark, store, "x").count() == 0
    assert rules.apply_rules(df, store, "x").count() == 0
    assert rules.save_rules(spark, store, "x", found) == 1
    assert rules.save_rules(spark, store, "other", {"k": "a > 0"}) == 1
    assert rules.save_rules(spark, store, "x", {"a_positive": "a > 0", "about_gone": "gone > 0"}) == 2
    assert {r.broken for r in rules.apply_rules(df, store, "x", 1).collect()} == {0}
    later = spark.createDataFrame([(0, None, "it's", 2), (5, -1.0, "new", 9), (None, 1.0, "b\\c", 1)], "a int, b double, s string, c int")
    got = {r.rule: (r.version, r.checked, r.broken) for r in rules.apply_rules(later, store, "x", 1).collect()}
    assert got["a_positive"] == (1, 2, 1) and got["b_non_negative"] == (1, 2, 1) and got["s_listed"] == (1, 3, 1)
    assert got["a_known"] == (1, 3, 1) and got["a_before_c"] == (1, 2, 0)
    newest = {r.rule: (r.version, r.checked, r.applied) for r in rules.apply_rules(later, store, "x").collect()}
    assert newest == {"a_positive": (2, 2, True), "about_gone": (2, None, False)}
    assert rules.learn_rules(df.limit(0), df.columns) == {}


def test_weighted_score(spark):
    rows = [(float(i % 10), "x" if i % 2 else None) for i in range(100)] + [(1000.0, "y")]
    df = spark.createDataFrame(rows, "v double, s string")
    broken = quality.rule_violations(df, {"bad": "v < 100", "good": "v >= 0"})
    (r,) = quality.quality_score_weighted(df, ["v"], broken, ["v", "s"]).collect()
    assert abs(r.completeness - 100 * 152 / 202) < 1e-9
    assert abs(r.uniqueness - 100 * 11 / 101) < 1e-9
    assert abs(r.consistency - 100 * (1 - 1 / 101)) < 1e-9
    assert (r.validity, r.type_alignment) == (90.0, 50.0)
    want = 0.25 * r.completeness + 0.15 * r.uniqueness + 0.2 * (r.consistency + r.validity + r.type_alignment)
    assert r.score == round(want)
    (none,) = quality.quality_score_weighted(df.limit(0), ["v"], broken.limit(0), ["v"]).collect()
    assert (none.score, none.completeness, none.validity) == (0, 0.0, 0.0)


def test_outlier_classes(spark):
    base = [(float(i % 7), float(i % 7), 1.0, 1.0) for i in range(400)]
    rows = base + [(900.0, 900.0, 40.0, 9.0), (30.0, None, 40.0, 9.0)]
    df = spark.createDataFrame(rows, "reading double, other double, sales double, quantity double")
    got = {r.column: (r.kind, r.action, r.affected) for r in quality.outlier_classify(df, ["reading", "other", "sales"], ["reading"], ["sales"], "quantity").collect()}
    assert got["reading"] == ("sensor_error", "delete_rows", 2) and got["other"] == ("entry_error", "delete_rows", 1)
    assert got["sales"][0] == "entry_error"  # 14 deviations off
    mild = spark.createDataFrame([(float(i % 7), 1.0) for i in range(40)] + [(16.0, 9.0)] * 2 + [(None, None)], "sales double, quantity double")
    assert [r.kind for r in quality.outlier_classify(mild, ["sales"], amounts=["sales"], quantity="quantity").collect()] == ["promotion"]
    assert [(r.kind, r.confidence) for r in quality.outlier_classify(mild, ["sales"], amounts=["sales"]).collect()] == [("business_event", 0.75)]
    assert [r.kind for r in quality.outlier_classify(mild, ["sales"]).collect()] == ["legitimate"]
    assert quality.outlier_classify(mild.limit(0), ["sales"]).count() == 0


def planted(spark):
    rng = random.Random(1)
    rows = []
    for i in range(2000):
        region, shop, day = rng.choice("NSEW"), rng.choice("abcde"), rng.choice("123")
        value = 100 + rng.random() + (200 if region == "N" and shop == "a" else 0)
        rows.append((region, shop, day, "only", value, None if i % 50 else 1.0))
    return spark.createDataFrame(rows, "region string, shop string, day string, same string, value double, gap double").repartition(4)


def test_drilldown_finds_the_planted_pair(spark):
    df = planted(spark)
    got = drivers.root_cause_drilldown(df, "value", ["day", "region", "shop", "same"], 300.0).collect()
    lead = {(r.level, r.under, r.dimension): (r.under_value, r.value) for r in got if r["rank"] == 1}
    assert lead[1, None, "region"] == (None, "N") and lead[1, None, "shop"] == (None, "a")
    assert lead[2, "region", "shop"] == ("N", "a") and lead[2, "shop", "region"] == ("a", "N")
    assert all(d != "same" for _, _, d in lead)
    assert {r.level for r in got} == {1, 2} and max(r["rank"] for r in got) <= 5
    assert drivers.root_cause_drilldown(df, "value", ["region"], 105.0).count() == 0  # not far off
    assert drivers.root_cause_drilldown(df.limit(0), "value", ["region"], 300.0).count() == 0
    assert drivers.root_cause_drilldown(df, "value", ["same"], 300.0).count() == 0


def test_attribution_goes_by_priority(spark):
    rows = [(float(i % 10), float(i % 10), float(i % 10), "ok") for i in range(200)]
    odd = [(900.0, 99.0, 99.0, "ok"), (901.0, 0.0, 99.0, "Failed"), (902.0, 0.0, 0.0, "TRUE"), (903.0, 99.0, 0.0, "ok"), (904.0, None, None, None)]
    df = spark.createDataFrame(rows + odd + [(None, 1.0, 1.0, "ok")], "v double, promo double, volume double, flag string")
    got = {r.v: (r.cause, list(r.support)) for r in drivers.anomaly_attribution(df, "v", ["promo"], ["volume"], ["flag"]).collect()}
    assert got == {
        900.0: ("promo", ["promo", "volume"]), 901.0: ("business_event", ["volume"]), 902.0: ("operational", ["flag"]),
        903.0: ("unknown", []), 904.0: ("unknown", []),
    }
    assert drivers.anomaly_attribution(df.limit(0), "v", ["promo"]).count() == 0
    assert {r.cause for r in drivers.anomaly_attribution(df, "v").collect()} == {"unknown"}


def test_evidence_and_importance(spark):
    df = planted(spark).withColumn("half", F.col("value") / 2).withColumn("flat", F.lit(1.0))
    found = drivers.evidence_table(df, "value", 300.0, ["region", "shop", "same"], ["half", "flat", "gap"], spark.range(3))
    rows = {(r.kind, r.target): r for r in found.collect()}
    assert set(rows) == {("segment", "region"), ("segment", "shop"), ("correlation", "half"), ("distribution", "value"), ("recurrence", "value")}
    assert rows["correlation", "half"].strength == "strong" and abs(rows["correlation", "half"].value - 1) < 1e-9
    assert rows["distribution", "value"].strength == "strong" and rows["distribution", "value"].detail > 90
    assert (rows["recurrence", "value"].strength, rows["recurrence", "value"].value) == ("moderate", 3.0)
    weights = {r.column: r for r in drivers.driver_importance(found).collect()}
    assert set(weights) == {"region", "shop", "half"}
    assert sum(r.importance for r in weights.values()) <= 100 + 1e-9 and weights["half"].significant
    none = drivers.evidence_table(df.limit(0), "value", 1.0, ["region"], ["half"])
    assert none.count() == 0 and drivers.driver_importance(none).count() == 0


def test_finding_pool_with_and_without_keys(spark):
    start = datetime.date(2024, 1, 1)
    rows = [("a", start + datetime.timedelta(days=i), 100.0 + (400 if i == 5 else 0) + (300 if i == 9 else 0)) for i in range(20)]
    rows += [("b", start + datetime.timedelta(days=i), 10.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, period date, total double")
    trends, odd = series.trend_class(df, ["k"]), series.period_anomalies(df, ["k"])
    got = drivers.finding_pool(df, trends, odd, ["k"]).orderBy("rank").collect()
    assert [(r.k, r.kind, r.period.day) for r in got] == [("a", "peak", 6), ("a", "anomaly", 10)]
    one = df.where("k = 'a'").drop("k")
    alone = drivers.finding_pool(one, series.trend_class(one), series.period_anomalies(one)).orderBy("rank").collect()
    assert [(r.kind, r.period.day) for r in alone] == [("peak", 6), ("anomaly", 10)]
    none = one.limit(0)
    assert drivers.finding_pool(none, series.trend_class(none), series.period_anomalies(none)).count() == 0


def test_trees_rank_the_planted_driver_first(spark):
    rng = np.random.default_rng(3)
    x, noise, kind = rng.normal(size=800), rng.normal(size=800), rng.integers(0, 3, 800)
    rows = [
        (float(1000 if v > 2 else v), float(v), float(n), "abc"[k], float(10 * k + 0.1 * n), f"text {i}", None if i % 4 else 1.0)
        for i, (v, n, k) in enumerate(zip(x, noise, kind))
    ]
    df = spark.createDataFrame(rows, "target double, cause double, noise double, kind string, by_kind double, free string, gap double")
    (r,) = drivers.outlier_driver_tree(df, "target", ["noise", "cause", "gap"]).collect()
    assert (r.driver, r.relation) == ("cause", "higher") and r.importance > 0.9
    outside = df.where("target < 500").approxQuantile("cause", [0.5], 0.0)[0]
    assert r.median_outliers > 2 and abs(r.median_others - outside) < 0.1
    assert drivers.outlier_driver_tree(df, "noise", ["gap"]).count() == 0  # few outliers and no driver
    assert drivers.outlier_driver_tree(df.limit(0), "target", ["cause"]).count() == 0
    first = drivers.feature_importance(df, "by_kind", ["noise", "kind", "free", "cause", "gap"]).collect()
    assert [f.feature for f in first][0] == "kind" and first[0].importance > 0.8 and [f.rank for f in first] == [1, 2, 3, 4, 5]
    again = drivers.feature_importance(df, "by_kind", ["noise", "kind", "free", "cause", "gap"]).collect()
    assert first == again
    assert drivers.feature_importance(df.limit(14), "by_kind", ["noise"]).count() == 0


def test_tail_findings(spark):
    df = spark.createDataFrame([(float(i) ** 2, 5.0, float(-i)) for i in range(30)] + [(None, None, None)], "a double, b double, c double")
    got = {r.column: r for r in drivers.tail_findings(df, ["a", "b", "c"]).collect()}
    assert set(got) == {"a"} and abs(got["a"].observed - np.quantile([i * i for i in range(30)], 0.9)) < 1e-9
    assert drivers.tail_findings(df.limit(0), ["a"]).count() == 0
