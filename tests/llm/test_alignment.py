"""Alignment of two tokenizers against a plain version that asks them for whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import alignment, queries
from tests.llm.fixtures import documents, empty, words


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(*alignment.default_paths())


def plain_tokens(pair, text):
    """Ids of both sides for the whole text, or none."""
    if not text:
        return [], []
    want = (" " + text).encode("utf-8")
    both = [side.ids(text) for side in pair.sides]
    for side, ids in zip(pair.sides, both, strict=True):
        if b"".join(side.bytes_of[i] for i in ids) != want:
            return [], []
    return both


def plain_groups(pair, text):
    a, b = plain_tokens(pair, text)
    ends = []
    for side, ids in zip(pair.sides, (a, b), strict=True):
        at, out = 0, []
        for i in ids:
            at += len(side.bytes_of[i])
            out.append(at)
        ends.append(out)
    common = sorted(set(ends[0]) & set(ends[1]))
    groups, low = [], 0
    for cut in common:
        groups.append(tuple([i for i, e in zip(ids, end, strict=True) if low < e <= cut] for ids, end in zip((a, b), ends, strict=True)))
        low = cut
    return groups


def plain_scores(pair, rows):
    all_groups = [plain_groups(pair, t) for _, t in rows]
    count = Counter(p for g in all_groups for p in {(x, y) for xs, ys in g for x in xs for y in ys})
    highest = Counter()
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    out = Counter()
    for (i, _), groups in zip(rows, all_groups, strict=True):
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out[
            i,
            sum(len(g[0]) for g in groups),
            sum(len(g[1]) for g in groups),
            len(groups),
            len(links),
            sum(count[x] == highest[x[0]] for x in links),
            sum(count[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ] += 1
    return out


def found(docs):
    return Counter(tuple(r) for r in alignment.scored(docs).collect())


ODD = [
    " ", "\n", "\t", "a", " a", "a ", "a  ", "  a", "a\n", "\na", "\n\n a \n", "a\tb c\t\td", "a b  c", "tab\t", "x \n y\n \nz",
    "it's we'll I'M 12 345 x1y2 ...!? -- a-b", "▁", "one ▁two", "<|endoftext|> <s> </s> <unk> <0x41>", "中文 字符 日本語", "😀 é é ß", "\x00 \x1c \x1f a\x1cb",
    " x  y　z ​", "a\r\nb \r c", "ﬁ ligature Ⅷ ½", "word " * 50, "\n".join("line one" for _ in range(30)), "x" * 3000, "xy" * 2000 + " z",
]


def test_ids_equal_those_of_whole_texts(pair):
    rng = random.Random(4)
    chars = "ab 's\n\t .,1é中😀▁-\r"
    texts = ODD + ["".join(rng.choice(chars) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    want = [plain_tokens(pair, t) for t in texts]
    for at_once in (1, 1000):
        got = [x for i in range(0, len(texts), at_once) for x in pair.encode(texts[i : i + at_once])]
        for t, w, g in zip(texts, want, got, strict=True):
            assert [list(np.frombuffer(x, np.uint32)) for x in g] == [list(x) for x in w], repr(t)
    assert pair.encode([None, ""]) == [(b"", b"")] * 2


def test_cache_generations_change_nothing(monkeypatch):
    own = alignment.Pair(*alignment.default_paths())
    monkeypatch.setattr(alignment, "CACHE_BYTES", 2_000)
    monkeypatch.setattr(alignment, "LONGEST_KEPT", 4)
    rng = random.Random(9)
    texts = [words(rng, 20) for _ in range(60)]
    for t in texts + texts:
        assert [list(np.frombuffer(x, np.uint32)) for x in own.encode([t])[0]] == [list(x) for x in plain_tokens(own, t)]
    assert len(own.young) + len(own.old) < 200


@pytest.mark.parametrize("seed", range(5))
def test_coalescing_equals_common_boundaries(seed):
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.append(rng.choice(np.arange(1, 500), n, replace=False), 500)) for n in (200, 120)]
    sizes = [np.diff(np.append(0, c)) for c in cuts]
    groups = alignment.coalesced(*sizes)
    common = np.intersect1d(*cuts)
    assert len(groups.n_a) == len(groups.n_b) == len(common)
    for side, of in zip(cuts, (groups.of_a, groups.of_b), strict=True):
        assert (of == np.searchsorted(common, side)).all()


@pytest.mark.parametrize("large", [4096, 2])
def test_scores_equal_a_plain_version(spark, pair, monkeypatch, large):
    monkeypatch.setattr(alignment, "LARGE", large)
    docs = documents(spark).select("doc_id", F.substring("text", 1, 20_000).alias("text"))
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)] + [((1 << 53) + 1, "big id"), (None, "no id")], "doc_id long, text string")
    all_ = docs.union(more)
    assert found(all_) == plain_scores(pair, [tuple(r) for r in all_.collect()])


def test_rare_pairs_that_are_not_sent(spark, pair, monkeypatch):
    monkeypatch.setattr(alignment, "PAIRS_SENT", 40)
    monkeypatch.setattr(alignment, "PAIRS_AT_ONCE", 100)
    monkeypatch.setattr(alignment, "SLICE", 300)
    docs = documents(spark).select("doc_id", F.substring("text", 1, 2_000).alias("text"))
    assert found(docs) == plain_scores(pair, [tuple(r) for r in docs.collect()])


def test_whole_texts_without_segments(spark, pair, monkeypatch):
    own = alignment.Pair(*alignment.default_paths())
    own.splits = False
    assert own.encode(ODD) == pair.encode(ODD)


def test_alignments_are_the_groups(spark, pair):
    texts = [*ODD, None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in alignment.alignments(df).collect():
        groups = plain_groups(pair, texts[r.doc_id])
        assert [(list(g.a), list(g.b)) for g in r.groups] == [tuple(map(list, g)) for g in groups]
        assert all(g.end == sum(len(pair.sides[0].bytes_of[i]) for h in r.groups[: k + 1] for i in h.a) for k, g in enumerate(r.groups))


def test_very_long_and_empty_tables(spark):
    rows = alignment.scored(documents(spark)).collect()
    assert len(rows) == documents(spark).count()
    assert next(r for r in rows if r.doc_id == 12).n_a > 1000
    assert alignment.scored(empty(spark)).count() == 0


def test_query(spark, small, pair):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = Counter(tuple(r) for r in queries.QUERIES["op11_alignment"].run(spark, small).collect())
    assert rows == plain_scores(pair, [tuple(r) for r in docs.collect()])
