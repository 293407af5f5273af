"""Ranked search of many queries over all documents, by an index in strata of length.

A document's normaliser m depends on its number of terms alone. Documents of equal m are a
stratum; inside a stratum a term's postings are ordered by tf, highest first, so that the
impact (10^9 tf) div (1000 tf + 8 m) is computed once for each run of equal tf, and the
first run bounds the rest. A query's bound in a stratum is the sum of weight times the
highest impact of its terms there. Strata are visited in the order of their bounds: the
leading ones give a threshold, the score of the tenth best document so far, and the others
are visited only if their bound reaches it. So nothing that could be in the result is left.

The first pass reads each text once and stores (doc_id, n, terms, tfs) of the terms that
some query has; the numbers N, L and the document frequencies follow from that table. In
the second pass each task sorts its part of the table by m, builds the strata in blocks of
bounded size, and hands out its best documents per query, ten at most; a window picks from
these. Queries go in blocks of TERMS_AT_ONCE (query, term) pairs, the only data that is
broadcast; any number of queries takes more blocks over the stored table.

Defined cases: a null or empty text has no terms and is not counted in N; items without
terms or without a match have no rows; rows that repeat an item_id are one item with the
terms of all, and a null item_id is an item; rows that repeat a doc_id are ranked each, and
a null doc_id comes after all others among equal scores; other columns are not read; empty
tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stored

BEST = 10
TERMS_AT_ONCE = 250_000
#: Rows of one block of the index, and postings.
BLOCK_ROWS, BLOCK_POSTINGS = 32_768, 2_000_000
#: Documents that the leading strata hold at least, before the others are held against a threshold.
LEADING = 256
ROWS_AT_ONCE = 200
SCALE, TF, LENGTH = 1_000_000_000, 1000, 8

# a term is a run of ASCII letters and digits and of anything beyond ASCII; A-Z are lower-cased
_LETTER = [chr(c).isalnum() for c in range(128)] + [True] * 128
FOLDED = bytes(ord(chr(c).lower()) if c < 128 and ok else c if ok else 32 for c, ok in enumerate(_LETTER))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLDED).split(b" ") if text else []


def _words(text: bytes | None) -> list[bytes]:
    return [w for w in terms_of(text) if w]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) distinct."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(set(_words(t.as_py()))) for t in batch.column("text")]
            at = np.repeat(np.arange(batch.num_rows), [len(w) for w in words])
            flat = pa.array([x for w in words for x in w], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(at)), flat], names=["item_id", "term"])

    texts = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(split, "item_id long, term binary").distinct()


def _counted(vocabulary):
    """(doc_id, n, terms, tfs): all terms counted, those of the vocabulary listed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        size = len(known) + 1
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                words = [_words(t.as_py()) for t in part.column("text")]
                n = np.array([len(w) for w in words], np.int64)
                flat = np.fromiter((known.get(x, -1) for w in words for x in w), np.int64, int(n.sum()))
                row = np.repeat(np.arange(len(words), dtype=np.int64), n)
                met, tf = np.unique((row * size + flat)[flat >= 0], return_counts=True)
                ends = np.searchsorted(met, np.arange(len(words) + 1, dtype=np.int64) * size)
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(n),
                        pa.ListArray.from_arrays(offsets, pa.array(met % size, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())),
                    ],
                    names=["doc_id", "n", "terms", "tfs"],
                ).filter(pa.array(n > 0))

    return count


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    sizes = ends - starts
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


class Strata:
    """A block of the index: postings by term, stratum and falling tf."""

    def __init__(self, m: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray):
        """``m`` ascends over the block's rows; ``row``, ``term`` and ``tf`` are its postings."""
        self.rows = len(m)
        levels, stratum_of = np.unique(m, return_inverse=True)
        self.sizes = np.bincount(stratum_of)
        stratum = stratum_of[row]
        order = np.lexsort((row, -tf, stratum, term))
        self.doc, term, stratum, tf = row[order], term[order], stratum[order], tf[order].astype(np.int64)
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (term[1:] != term[:-1]) | (stratum[1:] != stratum[:-1])
        run = new.copy()
        run[1:-1] |= tf[1:] != tf[:-1]
        at = np.flatnonzero(run)
        impact = SCALE * tf[at[:-1]] // (TF * tf[at[:-1]] + LENGTH * levels[stratum[at[:-1]]])
        self.impact = np.repeat(impact, np.diff(at))
        edge = np.flatnonzero(new)
        self.begin, self.end = edge[:-1], edge[1:]
        self.stratum, self.highest = stratum[self.begin], self.impact[self.begin]
        self.term = term[self.begin]

    def entries(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The (term, stratum) entries of ``terms``, and the place in ``terms`` of each."""
        low, high = np.searchsorted(self.term, terms), np.searchsorted(self.term, terms, "right")
        return _spans(low, high), np.repeat(np.arange(len(terms)), high - low)

    def search(self, terms: np.ndarray, weights: np.ndarray, least: int, best: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) that can be among the ``best`` if the threshold so far is ``least``."""
        entry, which = self.entries(terms)
        weight = weights[which]
        bound = np.zeros(len(self.sizes), np.int64)
        np.add.at(bound, self.stratum[entry], weight * self.highest[entry])
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] >= least]
        cut = int(np.searchsorted(np.cumsum(self.sizes[order]), LEADING)) + 1
        scores = np.zeros(self.rows, np.int64)
        for leading in (True, False):
            visited = np.zeros(len(bound), bool)
            visited[order[:cut] if leading else order[cut:][bound[order[cut:]] >= least]] = True
            mine = visited[self.stratum[entry]]
            begin, end = self.begin[entry[mine]], self.end[entry[mine]]
            spots = _spans(begin, end)
            np.add.at(scores, self.doc[spots], np.repeat(weight[mine], end - begin) * self.impact[spots])
            found = np.flatnonzero(scores >= least)
            if len(found) > best:
                least = max(least, int(np.partition(scores[found], -best)[-best]))
        found = found[scores[found] >= least]
        return found, scores[found]


def _ranked(queries, best: int):
    """The best documents of each query in this task; ``queries``: term ids and weights per query."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        none = np.empty(0, np.int64)
        tops = [(none, none, none) for _ in asked]  # score, without id, id

        def take(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts)
            ids = rows.column("doc_id")
            missing = pc.is_null(ids).to_numpy().astype(np.int64)
            ids = pc.fill_null(ids, 0).to_numpy()
            flat = [pc.list_flatten(rows.column(c)).to_numpy() for c in ("terms", "tfs")]
            lengths = pc.list_value_length(rows.column("terms")).to_numpy()
            block = Strata(rows.column("m").to_numpy(), np.repeat(np.arange(len(ids)), lengths), *flat)
            for i, (terms, weights) in enumerate(asked):
                top = tops[i]
                least = max(1, int(top[0][-1])) if len(top[0]) == best else 1
                found, scores = block.search(terms, weights, least, best)
                if len(found):
                    joined = [np.concatenate(x) for x in zip(top, (scores, missing[found], ids[found]), strict=True)]
                    order = np.lexsort((joined[2], joined[1], -joined[0]))[:best]
                    tops[i] = tuple(x[order] for x in joined)

        held, n_rows, postings = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                held.append(part)
                n_rows += part.num_rows
                postings += pc.sum(pc.list_value_length(part.column("terms"))).as_py() or 0
                if n_rows >= BLOCK_ROWS or postings >= BLOCK_POSTINGS:
                    take(held)
                    held, n_rows, postings = [], 0, 0
        if held:
            take(held)
        sizes = [len(t[0]) for t in tops]
        if sum(sizes):
            score, missing, ids = (np.concatenate(x) for x in zip(*tops, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(tops), dtype=np.int32), sizes)),
                    pa.array(ids, pa.int64(), mask=missing == 1),
                    pa.array(score),
                ],
                names=["query", "doc_id", "score"],
            )

    return rank


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def _block(docs: DataFrame, pairs: list, best: int) -> DataFrame:
    """(item_id, doc_id, score): some best documents of each task, for one block of queries."""
    spark = docs.sparkSession
    words = sorted({bytes(p["term"]) for p in pairs})
    vocabulary = {w: i for i, w in enumerate(words)}
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    counted = texts.mapInArrow(
        _counted(spark.sparkContext.broadcast(vocabulary)), "doc_id long, n long, terms array<int>, tfs array<int>"
    )
    index = stored(counted, "lexical-index")
    total = index.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("words")).first()
    frequency = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(len(words), np.int64)
    for term, df in frequency.collect():  # as many as the block's terms at most
        weights[term] = weight(total["rows"], df)
    by_item: dict = {}
    for item, term in pairs:
        by_item.setdefault(item, []).append(vocabulary[bytes(term)])
    asked = []
    for terms in by_item.values():
        ids = np.array(sorted(terms))
        ids = ids[weights[ids] > 0]
        asked.append((ids, weights[ids]))
    names = spark.createDataFrame(list(enumerate(by_item)), "number int, item_id long")
    m = F.expr(f"10 + (cast(90 as decimal(20, 0)) * n * {total['rows']}) div {total['words'] or 1}").cast("long")
    placed = index.withColumn("m", F.lit(10).cast("long") if not total["rows"] else m)
    found = placed.sortWithinPartitions("m").mapInArrow(
        _ranked(spark.sparkContext.broadcast(asked), best), "query int, doc_id long, score long"
    )
    return found.join(F.broadcast(names), F.col("query") == F.col("number")).select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of every item."""
    pairs = stored(item_terms(items), "query-terms")
    blocks = max(1, -(-pairs.count() // TERMS_AT_ONCE))
    parts = []
    for k in range(blocks):
        block = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()  # about TERMS_AT_ONCE
        parts.append(_block(docs, block, best))
    found = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
