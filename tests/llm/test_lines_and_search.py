"""Line dedup and ranked search, each against a plain version and its SQL."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import lexical, linededup, queries
from tests.llm.fixtures import documents, empty
from tests.oracle import assert_same

WHITE = " \t\n\x0b\x0c\r"
LINES = [
    (1, "Shared line of words\nown one of the first\nshort\n  SHARED LINE of words \t"),
    (2, "shared line of words\nshort\nown one of the second"),
    (3, "shared line of words"),
    (4, None),
    (5, ""),
    (6, "ÄÄÄÄÄÄÄÄÄ\nééééééééééé"),
    (7, "ÄÄÄÄÄÄÄÄÄ\nééééééééééé\nÉÉÉÉÉÉÉÉÉÉÉ"),
    (8, "repeated in one row only\nrepeated in one row only"),
    (9, "one id, two rows\nfirst of nine"),
    (9, "one id, two rows\nsecond of nine"),
    (None, "without an id but shared"),
    (None, "without an id but shared\nshared line of words"),
    (10, "\n\n\n"),
    (11, "line " * 100_000 + "\n" + "shared line of words\nlast one here"),
    ((1 << 53) + 1, "big ids are kept apart"),
    ((1 << 53) + 2, "big ids are kept apart\nand not rounded"),
]


def plain_lines(rows):
    def key(line):
        k = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WHITE))
        return k if len(k) >= 10 else None

    order = lambda i: (i is None, i or 0)
    ids = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if key(line):
                ids[key(line)].add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) is None or min(ids[key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def found_lines(df):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in linededup.unrepeated_lines(df).collect())


@pytest.mark.parametrize("parts", [1, 5])
def test_lines_equal_a_plain_version(spark, parts):
    df = spark.createDataFrame(LINES, "doc_id long, text string").repartition(parts)
    assert found_lines(df) == plain_lines(LINES)


def test_lines_of_awkward_documents(spark):
    docs = documents(spark)
    assert found_lines(docs) == plain_lines([(r.doc_id, r.text) for r in docs.collect()])
    clash = docs.withColumnsRenamed({"rank": "_at", "before": "n_lines", "key": "lost_at"})
    out = linededup.unrepeated_lines(clash)
    assert set(out.columns) == {*clash.columns, "n_dropped"}
    assert out.count() == docs.count()
    assert linededup.unrepeated_lines(empty(spark)).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    df = spark.createDataFrame(LINES, "doc_id long, text string")
    monkeypatch.setattr(linededup, "filter_size", lambda n: linededup.SEGMENT_BITS)
    many = [(1000 + i, "\n".join(f"line number {i} {j} of many" for j in range(500))) for i in range(200)]
    df = df.union(spark.createDataFrame(many, "doc_id long, text string"))
    assert found_lines(df) == plain_lines(LINES + many)


def test_filter_holds_what_two_tasks_and_one_task_repeat(spark):
    rows = [(i, f"only in document number {i}\nin every document the same") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bits = linededup.twice_filter(F.col("text"), df)
    key = linededup._hashes([b"in every document the same"])
    for places in linededup._places(key, 8 * len(bits)):
        assert bits[places[0] >> np.uint64(3)] >> int(places[0] & np.uint64(7)) & 1
    # bits that stand for a repeated key, and very few met by chance
    assert int(np.unpackbits(bits).sum()) <= 4


def test_lines_equal_sql(spark, small):
    query = queries.QUERIES["op13_linededup"]
    assert assert_same(query.run(spark, small), query.sql, small) > 0


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def plain_search(docs, items, best=10):
    counted = [(i, Counter(words_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n_docs, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words_of(t))
    out = Counter()
    for item, terms in asked.items():
        scores = []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // length
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms & c.keys()
            )
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:best], 1):
            out[item, rank, i, -score] += 1
    return out


def found_search(docs, items, best=10):
    return Counter(tuple(r) for r in lexical.search(docs, items, best).collect())


ITEMS = [(1, "one TWO changed"), (2, "same line here"), (2, "abc de"), (None, "中文 repeated id"), (3, None), (4, "..."), (5, "nowhere-to-be-found")]


@pytest.mark.parametrize(("leading", "rows"), [(256, 32_768), (1, 7)])
def test_search_equals_a_plain_version(spark, monkeypatch, leading, rows):
    monkeypatch.setattr(lexical, "LEADING", leading)
    monkeypatch.setattr(lexical, "BLOCK_ROWS", rows)
    monkeypatch.setattr(lexical, "ROWS_AT_ONCE", 5)
    docs = documents(spark)
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    items = ITEMS + [(100 + i, t[:300]) for i, t in plain if i and t and i >= 100]
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert found_search(docs, frame) == plain_search(plain, items)
    assert found_search(docs, frame, 3) == plain_search(plain, items, 3)


def test_search_ties_blocks_and_large_ids(spark, monkeypatch):
    rows = [((1 << 53) + i, "tie of all words") for i in range(40)] + [(None, "tie of all words"), (1, "tie of other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    frame = spark.createDataFrame(ITEMS + [(9, "all tie")], "item_id long, text string")
    want = plain_search(rows, ITEMS + [(9, "all tie")])
    assert found_search(docs, frame) == want
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", 3)
    assert found_search(docs, frame) == want


def test_search_of_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(empty(spark), items).count() == 0
    assert lexical.search(documents(spark), items.limit(0)).count() == 0


def test_strata_skip_only_what_cannot_be_in_the_result():
    rng = np.random.default_rng(3)
    m = np.sort(rng.integers(10, 60, 400))
    row = np.repeat(np.arange(400), 20)
    term = np.concatenate([rng.choice(50, 20, replace=False) for _ in range(400)])
    tf = rng.integers(1, 6, len(row))
    block = lexical.Strata(m, row, term, tf)
    weights = rng.integers(1, 9000, 50)
    impact = lexical.SCALE * tf // (1000 * tf + 8 * m[row])
    for _ in range(20):
        terms = np.sort(rng.choice(50, 6, replace=False))
        want = np.zeros(400, np.int64)
        np.add.at(want, row, np.where(np.isin(term, terms), weights[term] * impact, 0))
        found, scores = block.search(terms, weights[terms], 1, 10)
        assert (want[found] == scores).all()
        tenth = np.sort(want)[-10]
        assert set(np.flatnonzero(want >= tenth)) <= set(found)


def test_search_equals_sql(spark, small):
    query = queries.QUERIES["op12_lexical"]
    assert assert_same(query.run(spark, small), query.sql, small) > 0
