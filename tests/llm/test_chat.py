"""Tool calls: linking, order, validation, canonical JSON."""

from __future__ import annotations

import json
import random

import pytest

from tablewright.llm import chat, queries
from tests.oracle import assert_same

SCHEMAS = {
    "add": {
        "type": "object",
        "required": ["a", "b"],
        "additionalProperties": False,
        "properties": {"a": {"type": "number"}, "b": {"type": "integer", "minimum": 0}, "t": {"enum": ["x", None]}},
    },
    "list": {"type": "object", "properties": {"xs": {"type": "array", "maxItems": 2, "items": {"type": "string", "pattern": "^a"}}}},
}


@pytest.mark.parametrize(
    "value, text",
    [
        ({"b": 1, "a": [True, None, "é\n\"\\"]}, '{"a":[true,null,"é\\n\\"\\\\"],"b":1}'),
        ({"ﬀ": 1, "😀": 2}, '{"😀":2,"ﬀ":1}'),
        ([1.0, -0.0, 0.5, 1e21, 1e-7, 1.5e-9, 1e20, 123456789012345680000.0], "[1,0,0.5,1e+21,1e-7,1.5e-9,100000000000000000000,123456789012345683968]"),
        ({}, "{}"),
    ],
)
def test_canonical(value, text):
    out = chat.canonical(value)
    assert json.loads(out) == json.loads(json.dumps(value))
    assert out == text


@pytest.mark.parametrize(
    "name, value, n",
    [
        ("add", {"a": 1.5, "b": 2}, 0),
        ("add", {"a": 1, "b": 2.0, "t": None}, 0),
        ("add", {"a": True, "b": -1, "c": 0}, 3),
        ("add", [], 1),
        ("list", {"xs": ["a", "b", "ab"]}, 2),
        ("list", {"more": 1}, 0),
    ],
)
def test_errors(name, value, n):
    assert len(chat.errors(value, SCHEMAS[name])) == n


CALLS = "conv_id long, call_id string, position long, name string, arguments string, depends_on array<string>, level int"


def calls(spark):
    ok = '{"b": 1, "a": 2}'
    rows = [
        (1, "a", 9, "add", ok, []),
        (1, "b", 1, "add", ok, ["a"]),
        (1, "c", 2, "add", ok, ["a", "b", "b", "gone"]),
        (1, "d", 3, "none", ok, None),
        (2, "a", 0, "add", "{broken", ["b"]),
        (2, "b", 1, "add", None, ["a"]),
        (2, "c", 2, "add", '{"a": NaN, "b": 1}', ["b"]),
        (2, "d", 3, "list", '{"xs": ["a"]}', ["d"]),
        (3, "x", 5, "list", "{}", []),
        (3, "x", 4, "add", ok, ["x2"]),
        (3, "x2", 6, "list", json.dumps({"xs": ["a" * 100_000]}), []),
        (None, None, 0, "add", ok, []),
    ]
    return spark.createDataFrame([(*r, 7) for r in rows], CALLS).repartition(3)


def results(spark):
    rows = [(1, "a", "3"), (1, "b", None), (3, "x", "second"), (3, "x", "first"), (4, "lost", "r"), (None, None, "null id")]
    return spark.createDataFrame([(*r, "s") for r in rows], "conv_id long, call_id string, content string, status string")


def test_transcript(spark):
    got = {(r.conv_id, r.call_id): r for r in chat.transcript(calls(spark), results(spark), SCHEMAS).collect()}
    assert len(got) == 12
    assert {k: r.level for k, r in got.items()} == {
        (1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (2, "a"): None, (2, "b"): None, (2, "c"): None,
        (2, "d"): None, (3, "x"): 1, (3, "x2"): 0, (None, None): 0, (4, "lost"): None,
    }
    assert got[1, "c"].missing == 1 and got[1, "b"].missing == 0
    assert {k for k, r in got.items() if r.status == "linked"} == {(1, "a"), (1, "b"), (3, "x"), (None, None)}
    assert got[4, "lost"].status == "orphan"
    assert (got[3, "x"].content, got[3, "x"].n_results, got[3, "x"].n_calls) == ("first", 2, 2)
    assert {k for k, r in got.items() if r.errors} == {(1, "d"), (2, "a"), (2, "b"), (2, "c")}
    assert got[1, "a"].json == '{"arguments":{"a":2,"b":1},"id":"a","name":"add","result":"3"}'
    assert got[2, "a"].json == '{"arguments":null,"id":"a","name":"add","result":null}'


def test_empty(spark):
    none = chat.transcript(calls(spark).limit(0), results(spark).limit(0), SCHEMAS)
    assert none.count() == 0


def test_query_equals_sql(spark, small):
    q = queries.QUERIES["op2_tool_calls"]
    assert assert_same(q.run(spark, small), q.sql, small) > 0


def plain_levels(deps):
    """Longest chain of each call; None on a cycle or behind one."""
    found = {}
    while True:
        ready = [c for c, ds in deps.items() if c not in found and all(d in found for d in ds if d in deps)]
        if not ready:
            return {c: found.get(c) for c in deps}
        for c, level in [(c, max((found[d] + 1 for d in deps[c] if d in deps), default=0)) for c in ready]:
            found[c] = level


def shapes():
    """Chains, trees, diamonds, ladders, cycles and calls behind them."""
    rng = random.Random(2)
    out = {
        "chain": {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(300)},
        "ladder": {f"c{i}": [f"c{i - 1}", f"c{i - 2}"] if i > 1 else [] for i in range(40)},
        "ring": {f"c{i}": [f"c{(i + 1) % 7}"] for i in range(7)} | {"behind": ["c3"], "free": [], "mixed": ["c1", "free"]},
        "self": {"a": ["a"], "b": ["a"], "c": []},
        "gone": {"a": ["x", "y"], "b": ["a", "x"]},
    }
    for k in range(6):
        n = 60
        out[f"random{k}"] = {f"c{i}": rng.sample([f"c{j}" for j in range(i)], min(i, rng.choice([0, 1, 1, 1, 2, 3]))) for i in range(n)}
    return out


@pytest.mark.parametrize("most", [20_000, 0])
def test_levels_of_all_shapes(spark, most):
    every = shapes()
    rows = [(k, c, d) for k, deps in enumerate(every.values()) for c, d in deps.items()]
    got = chat.levels(spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>").repartition(4), most).collect()
    assert len(got) == len(rows)
    have = {(r.conv_id, r.call_id): (r.level, r.missing) for r in got}
    for k, deps in enumerate(every.values()):
        want = plain_levels(deps)
        for c, ds in deps.items():
            assert have[k, c] == (want[c], len(set(ds) - deps.keys())), (k, c)


def test_a_chain_of_5000_takes_few_rounds(spark, monkeypatch):
    writes = []
    monkeypatch.setattr(chat, "stored", lambda df, name, real=chat.stored: writes.append(name) or real(df, name))
    rows = [(1, f"c{i}", [f"c{i - 1}"] if i else []) for i in range(5000)]
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, depends_on array<string>").repartition(4)
    got = {r.call_id: r.level for r in chat.levels(calls, 100).collect()}
    assert got == {f"c{i}": i for i in range(5000)}
    assert writes.count("ready") <= 15
