"""Base counts against a plain version, verdicts on planted outliers."""

from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.llm import quality, textstats
from tests.llm.fixtures import documents, empty, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    if not text:
        return (0,) * 6
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(w),
        sum(map(len, w)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(inside),
    )


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #|\n\t é😀", max_size=80))
def test_counts(text):
    assert textstats.counts(text) == plain(text)


def test_judged_rows(spark):
    docs = documents(spark)
    by_text = {}
    for r in docs.where("length(text) < 5000 OR text IS NULL").collect():
        by_text.setdefault(r.doc_id, []).append(plain(r.text))
    got = quality.judged(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id in by_text:
            row = (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words)
            assert row in by_text[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert quality.judged(empty(spark)).count() == 0


def test_outliers_go_and_clean_documents_stay(spark):
    """A tenth of a group is junk; a group may be small or have no variance."""
    rng = random.Random(8)
    rows = []
    for i in range(600):
        n = rng.randint(20, 200)
        text = words(rng, n)
        if i % 10 == 0:
            text = " ".join(x + rng.choice(["###", "&&&", "***"]) for x in text.split(" "))
        rows.append((i, text, "en", "a" if i < 500 else f"s{i % 40}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert all(got[i].kept for i in range(600) if i % 10)
    assert not any(got[i].kept for i in range(0, 500, 10))
    kept = quality.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}


def test_estimate_equals_a_plain_c_step(spark):
    """With the whole group inside, the estimate is the group's moments."""
    import numpy as np

    rng = np.random.default_rng(1)
    t = rng.integers(-500, 500, (300, 4))
    rows = spark.createDataFrame([("en", "a", *map(int, r)) for r in t], "lang string, source string, t0 long, t1 long, t2 long, t3 long")
    centre, precision, _ = quality._fit(300, t.sum(0), [(t[:, i] * t[:, j]).sum() for i, j in quality.PAIRS], 1.0)
    want = np.cov(t.T / quality.SCALE, bias=True) + np.diag(np.square(quality.FLOORS))
    assert np.allclose(np.linalg.inv(np.array(precision).reshape(4, 4)), want)
    assert np.allclose(centre, t.mean(0) / quality.SCALE)
    found = quality.estimates(rows).collect()
    assert len(found) == 1


def junk_verdicts(spark, junk):
    """(verdicts on clean rows, on junk rows) of a group of 200 varied clean texts and the given junk."""
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randint(40, 200)), "en", "a") for i in range(200)]
    rows += [(1000 + i, text, "en", "a") for i, text in enumerate(junk(rng))]
    found = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in found)
    return [r.kept for r in found if r.doc_id < 1000], [r.kept for r in found if r.doc_id >= 1000]


def marked(rng, n=80):
    return " ".join(x + rng.choice(["###", "&&&", "***"]) for x in words(rng, n).split(" "))


def test_a_third_of_junk_copies_goes(spark):
    clean, junk = junk_verdicts(spark, lambda rng: [marked(rng)] * 100)
    assert all(clean) and not any(junk)


def test_a_third_of_junk_of_one_kind_goes(spark):
    clean, junk = junk_verdicts(spark, lambda rng: [marked(rng, rng.randint(40, 200)) for _ in range(100)])
    assert all(clean) and not any(junk)


def test_most_rows_are_copies_of_a_clean_text(spark):
    clean, copies = junk_verdicts(spark, lambda rng: [words(rng, 100)] * 500)
    assert all(clean) and all(copies)


def test_moderate_outliers_in_each_statistic(spark):
    """One odd document for each statistic in a group whose documents have no symbols and no repeats."""
    rng = random.Random(10)
    fresh = lambda n: words(rng, n).split(" ")
    long_words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(100)]
    symbols = [w + "#" if i % 4 == 0 else w for i, w in enumerate(fresh(100))]
    lines = "\n".join(" ".join(fresh(12)) + "\nabcd\nefghi\ncd\ngabcj" for _ in range(30))
    passage = fresh(9)
    repeated = fresh(40) + passage + fresh(40) + passage + fresh(2)
    odd = [" ".join(long_words), " ".join(symbols), lines, " ".join(repeated)]
    rows = [(i, words(rng, rng.randint(40, 200)), "en", "a") for i in range(200)]
    rows += [(1000 + i, text, "en", "a") for i, text in enumerate(odd)]
    found = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not any(r.base_failed for r in found)
    assert all(r.kept for r in found if r.doc_id < 1000)
    assert not [r.doc_id for r in found if r.doc_id >= 1000 and r.kept]
