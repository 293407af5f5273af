"""Near-duplicates against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tablewright.llm import minhash
from tablewright.llm.components import components
from tests.llm.fixtures import documents, empty, words


def shingles(text):
    w = text.encode().lower().split() if text else []
    if len(w) >= 4:
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)}
    return {tuple(w)} if w else set()


def brute(rows):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows; a repeated id is one node."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            common = len(a & b)
            if a and b and 100 * common >= 80 * (len(a) + len(b) - common):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = brute([r for r in rows if r[0] is not None])
    got = minhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)
    assert sorted(r.n_shingles for r in got) == sorted(len(shingles(t)) for _, t in rows)


def test_awkward_documents(spark):
    check(documents(spark))
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_many_near_copies_around_the_limit(spark, monkeypatch):
    """A family whose members lie on both sides of 0.8, in buckets that are compared in blocks."""
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 6)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(3)
    base = words(rng, 90).split(" ")
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = words(rng, 1)
        rows.append((i * 3 % 151, " ".join(w)))
    rows += [(1000 + i, words(rng, 80)) for i in range(30)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 180)] + [(500, 500), (7, 6), (7, 6)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert all(find(x) == c for x, c in got.items())
    assert set(got) == {x for a, b in edges if a != b for x in (a, b)}


def test_distinct_documents(spark):
    docs = documents(spark)
    kept = {r.doc_id for r in minhash.near_duplicates(docs).where("kept").collect()}
    out = minhash.distinct_documents(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} - {None} == kept - {None}


def test_two_words_in_all():
    """A chunk that holds fewer words than a shingle, alone and before a text of over a megabyte."""
    import pandas as pd

    assert [len(x) for x in minhash.shingle_sets(["one two"])] == [1]
    assert minhash.shingle_sets(["one two", "a b c d e"])[0] == minhash.shingle_sets(["one two"])[0]
    pdf = pd.DataFrame({"doc_id": [1, 2], "text": ["one two", "some words " * 120_000]})
    assert [n for out in minhash._features()(iter([pdf])) for n in out["n_shingles"]] == [1, 2]


def test_ids_beyond_doubles_beside_a_null(spark):
    big = 1 << 53
    rows = [(big + 1, "one two three four five six"), (None, "seven eight nine ten eleven"), (big + 3, "one two three four five six"), (big + 5, "w x y z a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert {(big + 1, big + 1, True), (big + 3, big + 1, False), (big + 5, big + 5, True)} <= got
    clash = docs.withColumnsRenamed({}).withColumn("_gone", F.lit(1))
    kept = minhash.distinct_documents(clash)
    assert kept.columns == clash.columns and {r.doc_id for r in kept.collect()} == {big + 1, big + 5, None}
