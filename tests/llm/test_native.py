"""Sharding and mixing."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import mixing, queries, sharding
from tests.llm.fixtures import documents, empty
from tests.oracle import assert_same


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_shards_differ_by_one_row_and_match_the_mixture(spark, shards):
    docs = documents(spark)
    rows = sharding.shard(docs, shards).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    # strata: each source's share of a shard is off by less than the interleaving's step
    totals, got = Counter(r.source for r in rows), Counter((r.shard, r.source) for r in rows)
    for s in range(shards):
        for source, n in totals.items():
            assert abs(got[s, source] - n / shards) <= 2


def test_shard_does_not_depend_on_partitions(spark):
    one = {tuple(r) for r in sharding.shard(documents(spark, 1)).collect()}
    assert {tuple(r) for r in sharding.shard(documents(spark, 7)).collect()} == one
    assert sharding.shard(empty(spark)).count() == 0


def brute_targets(sizes, weights=(3.0, 1.0, 2.0)):
    """Excess reshared by weight until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        left = budget - sum(2 * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        target = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target | {s: 2.0 * sizes[s] for s in stopped}
        stopped |= over


def test_mix_targets_and_takings(spark):
    rows = mixing.mix(documents(spark)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    want = brute_targets(sizes)
    taken, biggest = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s]
    again = Counter(tuple(r) for r in mixing.mix(documents(spark, 5)).collect())
    assert again == Counter(tuple(r) for r in rows)
    assert mixing.mix(empty(spark)).count() == 0


def test_smaller_budgets_are_nested(spark):
    docs = documents(spark)
    small = {r.doc_id: r.copies for r in mixing.mix(docs, budget_share=0.4).collect()}
    large = {r.doc_id: r.copies for r in mixing.mix(docs, budget_share=0.9).collect()}
    assert all(large[d] >= c for d, c in small.items())


def test_mixed_documents_repeat_whole_rows(spark):
    docs = documents(spark)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +want


def test_mix_query_equals_sql(spark, small):
    q = queries.QUERIES["op9_mixing"]
    assert assert_same(q.run(spark, small), q.sql, small) == 200


def test_mixed_documents_keep_columns_of_any_name(spark):
    docs = documents(spark).withColumnsRenamed({"rank": "_of", "key": "_passes", "before": "_below", "n_chars": "_copy"})
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id for r in out.select("doc_id").collect()}
    assert taken <= {r.doc_id for r in docs.select("doc_id").collect()} and taken


@pytest.mark.parametrize("shards", [3, 40])
def test_shards_and_slots_equal_a_plain_sort(spark, shards):
    docs = documents(spark)
    keyed = docs.select("*", F.xxhash64(F.lit(sharding.SEED), "doc_id").alias("h")).collect()
    rows = []
    for r in keyed:
        data = (r.text or "").encode()
        rows.append((r.h, r.doc_id, len(data) + 16, zlib.crc32(data), r.source))
    bits = sharding.range_bits(len(rows))
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[4]].append(r)
    ranked = []
    for source, own in by_source.items():
        own.sort(key=lambda r: ((r[0] & (1 << 64) - 1) >> 64 - bits, r[0], r[1] is not None, r[1] or 0, r[2], r[3]))
        ranked += [((2 * p - 1) / (2 * len(own)), source is None, source or "", p, r) for p, r in enumerate(own, 1)]
    ranked.sort(key=lambda x: x[:4])
    n = len(ranked)
    want = Counter((r[1], r[2], r[3], at * shards // n, at - -(-(at * shards // n) * n // shards)) for at, (*_, r) in enumerate(ranked))
    got = Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, shards).collect())
    assert got == want
