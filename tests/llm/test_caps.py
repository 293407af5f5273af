"""Near-duplicate vectors against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from tablewright.llm import caps


def vectors(spark, kind="float"):
    rng = np.random.default_rng(4)
    rows, centre = [], rng.normal(size=(6, 24))
    for i in range(600):
        v = centre[i % 6] + rng.normal(size=24) * (0.12 if i % 6 < 3 else 0.9)
        rows.append(v.tolist())
    rows += [rows[0], rows[0], (np.array(rows[0]) * 4).tolist(), (np.array(rows[1]) * -1).tolist()]
    rows += [None, [0.0] * 24, [1.0] * 23 + [None], [1.0] * 23 + [float("nan")], [1.0] * 23 + [float("inf")], []]
    rows += [[1.0, 0.0], [1.0, 0.01], [5.0], [2.0], [1e-30] * 24, [1e30] * 24]
    data = [(i * 7 % 617, v, 1, "x") for i, v in enumerate(rows)]
    return spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, label int, rep string").repartition(3)


def brute(rows):
    unit = {}
    for r in rows:
        v = r.embedding
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / max(map(abs, v))
            unit[r.vec_id] = x / np.linalg.norm(x)
    ids = sorted(unit)
    links = {i: set() for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.95:
                links[i].add(j)
                links[j].add(i)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min([label[i], *[label[j] for j in links[i]]])
            changed |= low != label[i]
            label[i] = low
    return links, label


@pytest.mark.parametrize("kind, block", [("float", 512), ("double", 16)])
def test_links_and_components(spark, monkeypatch, kind, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    monkeypatch.setattr(caps, "LARGE", block // 8)
    df = vectors(spark, kind)
    links, label = brute(df.collect())
    got = caps.near_vectors(df).collect()
    assert len(got) == df.count()
    found = sum(r.n_links for r in got)
    true = sum(map(len, links.values()))
    assert found <= true and found >= 0.99 * true
    for r in got:
        assert r.n_links <= len(links.get(r.vec_id, ()))
        assert r.component_id == label.get(r.vec_id, r.vec_id)
        assert r.kept == (r.vec_id == r.component_id)


def test_empty(spark):
    assert caps.near_vectors(vectors(spark).limit(0)).count() == 0


@pytest.mark.parametrize("cosine, least", [(0.9501, 0.98), (0.97, 0.99), (0.99, 1.0)])
def test_recall_at_the_limit(cosine, least):
    """Pairs of exactly one cosine in 64 dimensions: how many share a filter."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=(500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(500, 64))
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    code = caps.ProductCode(64, caps.codes_for(50_000))
    first = set(zip(*map(np.ndarray.tolist, code.decode(a)), strict=True))
    shared = {r for r, f in zip(*map(np.ndarray.tolist, code.decode(b)), strict=True) if (r, f) in first}
    assert len(shared) >= least * 500
    lists = np.bincount(code.decode(a)[0])
    assert lists.min() >= caps.LIST


def test_ids_beyond_doubles_beside_a_null(spark):
    big = 1 << 53
    rows = [(big + 1, [1.0, 0.0, 0.0]), (None, [0.0, 1.0, 0.0]), (big + 3, [1.0, 0.001, 0.0]), (big + 5, [0.0, 0.0, 1.0]), (None, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = {(r.vec_id, r.n_links, r.component_id) for r in caps.near_vectors(vectors).collect()}
    assert {(big + 1, 1, big + 1), (big + 3, 1, big + 1), (big + 5, 0, big + 5)} <= got
