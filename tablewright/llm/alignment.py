"""Alignment of the tokens of two tokenizers over the same texts, by coalescing intervals.

A token covers an interval of the text's bytes. The tokens of both sides are sorted by
start; the running maximum of their ends tells where groups break: where a start reaches
it, no token crosses, so both sides have a boundary there. Every token of A in a group is
linked with every token of B in it. A slice of many texts is one run of intervals, since
texts end where both sides end.

The first pass encodes each text once and stores per document its distinct linked id pairs
with their number, and the digest of its groups. Pairs are counted over all documents from
that table, first per task. A pair that is in many documents is needed everywhere, a rare
one in few places: the pairs in at least one of PAIRS_SENT parts of all rows, which are
PAIRS_SENT at most, are broadcast, and only the others are shuffled to meet their counts.

Encoding goes by segments that end where neither side's tokens can go over: before a blank
or a line break that follows other text. Both tokenizers are asked for many unknown
segments at once; a worker keeps the ids of segments it has met, in two generations of
CACHE_BYTES together. Whether no token of B goes over such a place is checked against the
vocabulary; one that has such pieces is asked for whole texts.

Defined cases: null and empty texts, and those that either side does not give back byte by
byte after a blank, have no tokens and zeros; rows that repeat a doc_id are rows of their
own, and each counts as a document; null doc_ids stay null; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored

MARK = "▁"
CACHE_BYTES = 160 << 20
#: Longer segments are not kept.
LONGEST_KEPT = 200
#: Segments asked for at once, and characters of texts in one run of intervals.
SEGMENTS_AT_ONCE, SLICE = 500, 1 << 20
#: Larger groups are linked by their distinct ids.
LARGE = 4096
PAIRS_SENT = 1 << 20
PAIRS_AT_ONCE = 1 << 23
#: A run of white space and what follows it up to the next blank or line break after other text.
SEGMENT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*\Z)?|\s+")


class ByteLevel:
    """A byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # a printable byte stands for itself, the others follow each other from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        value = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        entries = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = [b""] * (max(self.tokenizer.get_vocab().values()) + 1)
        for entry, i in entries.items():
            if all(c in value for c in entry):
                self.bytes_of[i] = bytes(value[c] for c in entry)
        self.splits = True

    def ids(self, text: str) -> list[int]:
        """The ids of a blank and ``text``."""
        return self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids


class Pieces:
    """A sentencepiece model file; it puts the blank before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of, self.splits = [], True
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            if self.model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes_of.append(piece.replace(MARK, " ").encode("utf-8"))
                if re.search(r"\S[ \n]", piece.replace(MARK, " ")):
                    self.splits = False

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both sides' tokenizers, and the ids of segments they were asked for."""

    def __init__(self, a: str, b: str):
        self.sides = (ByteLevel(a), Pieces(b))
        self.lengths = [np.array([len(x) for x in s.bytes_of], np.int64) for s in self.sides]
        self.size_b = len(self.sides[1].bytes_of)
        self.splits = all(s.splits for s in self.sides)
        width = len(str(max(map(len, self.lengths))))
        # decimal digits of every id, filled up with zero bytes
        self.digits = np.array([str(i) for i in range(max(map(len, self.lengths)))], f"S{width}").view(np.uint8).reshape(-1, width)
        self.young: dict[str, tuple | None] = {}
        self.old: dict[str, tuple | None] = {}
        self.bytes = 0

    def _whole(self, text: str) -> tuple[bytes, bytes] | None:
        """Both sides' ids (32-bit) of a blank and ``text``, null where they do not give it back."""
        out = []
        for side in self.sides:
            ids = side.ids(text)
            if b"".join(map(side.bytes_of.__getitem__, ids)) != b" " + text.encode("utf-8"):
                return None
            out.append(np.array(ids, np.uint32).tobytes())
        return out[0], out[1]

    def _alone(self, segment: str) -> tuple[bytes, bytes] | None:
        # asked for behind a letter, which is cut off again
        both, lead = self._whole("a" + segment), self._whole("a")
        if both is None:
            return None
        for whole, cut in zip(both, lead, strict=True):
            if whole[: len(cut)] != cut:
                raise ValueError("tokens go over the end of a segment")
        return tuple(whole[len(cut) :] for whole, cut in zip(both, lead, strict=True))

    def _together(self, segments: list[str]) -> list[tuple | None]:
        """Segments that end with something else than white space, one after the other."""
        whole = self._whole("a" + "".join(segments))
        if whole is None:
            return [self._alone(s) for s in segments]
        ends = 2 + np.cumsum([0] + [len(s.encode("utf-8")) for s in segments])
        parts = []
        for data, lengths in zip(whole, self.lengths, strict=True):
            upto = np.cumsum(lengths[np.frombuffer(data, np.uint32)])
            cuts = np.searchsorted(upto, ends)
            if (upto[cuts] != ends).any():
                raise ValueError("tokens go over the end of a segment")
            cuts = (cuts + 1) * 4
            parts.append([data[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist())])
        return list(zip(*parts, strict=True))

    def _keep(self, segment: str, ids: tuple | None) -> None:
        self.young[segment] = ids
        self.bytes += 300 + 2 * len(segment) + (len(ids[0]) + len(ids[1]) if ids else 0)

    def learn(self, segments: set[str]) -> dict[str, tuple | None]:
        """Ids of segments that are not in the young generation; those too long to keep are returned."""
        unknown, odd = [], {}
        for s in segments:
            if s in self.old:
                self._keep(s, self.old[s])
            elif len(s) > LONGEST_KEPT:
                odd[s] = self._alone(s)
            elif s[-1].isspace():
                self._keep(s, self._alone(s))
            else:
                unknown.append(s)
        for i in range(0, len(unknown), SEGMENTS_AT_ONCE):
            part = unknown[i : i + SEGMENTS_AT_ONCE]
            for s, ids in zip(part, self._together(part), strict=True):
                self._keep(s, ids)
        return odd

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Both sides' ids of each text; empty where it has no tokens."""
        none = (b"", b"")
        if not self.splits:
            return [(self._whole(t) or none) if t else none for t in texts]
        # a text of white space alone has no letter before it
        split = [SEGMENT.findall(" " + t) if t and not t.isspace() else [] for t in texts]
        if self.bytes > CACHE_BYTES // 2:
            self.young, self.old, self.bytes = {}, self.young, 0
        odd = self.learn(set().union(*split) - self.young.keys())
        known = _Both(self.young, odd).__getitem__ if odd else self.young.__getitem__
        out = []
        for text, segments in zip(texts, split, strict=True):
            if text and not segments:
                out.append(self._whole(text) or none)
                continue
            ids = list(map(known, segments))
            try:
                out.append((b"".join([x[0] for x in ids]), b"".join([x[1] for x in ids])))
            except TypeError:  # a segment without ids
                out.append(none)
        return out


class _Both(dict):
    """A small dictionary before a large one."""

    def __init__(self, large: dict, small: dict):
        super().__init__(small)
        self.large = large

    def __missing__(self, key):
        return self.large[key]


@dataclass
class Groups:
    """Coalesced intervals: the group of every token, ascending, and the groups' tokens per side."""

    of_a: np.ndarray
    of_b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray


def coalesced(lengths_a: np.ndarray, lengths_b: np.ndarray) -> Groups:
    """Groups of the tokens of two sides that cover the same bytes."""
    end_a, end_b = np.cumsum(lengths_a), np.cumsum(lengths_b)
    start = np.concatenate([end_a - lengths_a, end_b - lengths_b])
    side = np.zeros(len(start), np.int8)
    side[len(end_a) :] = 1
    order = np.lexsort((side, start))
    reached = np.maximum.accumulate(np.concatenate([end_a, end_b])[order])
    breaks = np.zeros(len(order), np.int64)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    of_a, of_b = group[: len(end_a)], group[len(end_a) :]
    n = int(breaks.sum()) + 1 if len(order) else 0
    return Groups(of_a, of_b, np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n))


def _before(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _linked(a: np.ndarray, b: np.ndarray, groups: Groups, row: np.ndarray, size_b: int, room: int):
    """(key, times): links as row * room + a * size_b + b, with their number in large groups."""
    large = groups.n_a * groups.n_b > LARGE
    first_b = _before(groups.n_b)
    partners = np.where(large, 0, groups.n_b)[groups.of_a]
    total = int(partners.sum())
    spot = np.arange(total) + np.repeat(first_b[groups.of_a] - _before(partners), partners)
    key = np.repeat(row * room + a * size_b, partners) + b[spot]
    keys, times = [key], [np.ones(total, np.int64)]
    first_a = _before(groups.n_a)
    for g in np.flatnonzero(large):
        i, j = first_a[g], first_b[g]
        x, nx = np.unique(a[i : i + groups.n_a[g]], return_counts=True)
        y, ny = np.unique(b[j : j + groups.n_b[g]], return_counts=True)
        keys.append((row[i] * room + x[:, None] * size_b + y).ravel())
        times.append((nx[:, None] * ny).ravel())
    return np.concatenate(keys), np.concatenate(times) if large.any() else None


def _rows(pair: Pair, encoded: list[tuple[bytes, bytes]]) -> dict[str, list | pa.Array]:
    """The columns of one slice of documents."""
    counts = [np.array([len(x[i]) // 4 for x in encoded], np.int64) for i in (0, 1)]
    a, b = (np.frombuffer(b"".join([x[i] for x in encoded]), np.uint32).astype(np.int64) for i in (0, 1))
    groups = coalesced(pair.lengths[0][a], pair.lengths[1][b])
    rows = len(encoded)
    row = np.repeat(np.arange(rows), counts[0])
    # groups of each document: documents without tokens have none
    firsts = np.searchsorted(row, np.arange(rows + 1))
    group_at = np.append(groups.of_a, len(groups.n_a))[firsts]
    links = np.concatenate([[0], np.cumsum(groups.n_a * groups.n_b)])
    room = len(pair.lengths[0]) * pair.size_b
    key, times = _linked(a, b, groups, row, pair.size_b, room)
    if times is None:
        key = np.sort(key)
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        key, times = key[edge], np.diff(np.append(edge, len(key)))
    else:
        key, where = np.unique(key, return_inverse=True)
        summed = np.zeros(len(key), np.int64)
        np.add.at(summed, where, times)
        times = summed
    offsets = pa.array(np.searchsorted(key, np.arange(rows + 1) * room), pa.int32())
    return {
        "n_a": pa.array(counts[0]),
        "n_b": pa.array(counts[1]),
        "n_groups": pa.array(np.diff(group_at)),
        "n_links": pa.array(np.diff(links[group_at])),
        "groups_sha256": pa.array(_digests(pair, a, b, groups, counts)),
        "pairs": pa.ListArray.from_arrays(offsets, pa.array(key % room, pa.int64())),
        "times": pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
    }


def _digests(pair: Pair, a: np.ndarray, b: np.ndarray, groups: Groups, counts) -> list[str]:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each document, '' without tokens."""
    width = pair.digits.shape[1]
    text = np.zeros((len(a) + len(b), width + 1), np.uint8)
    at_a = np.arange(len(a)) + _before(groups.n_b)[groups.of_a]
    at_b = np.arange(len(b)) + np.cumsum(groups.n_a)[groups.of_b]
    for ids, at, of, end in ((a, at_a, groups.of_a, "|"), (b, at_b, groups.of_b, ";")):
        text[at, :width] = pair.digits[ids]
        text[at, width] = ord(",")
        text[at[np.flatnonzero(np.append(of[1:] != of[:-1], True))] if len(of) else at, width] = ord(end)
    ends = np.concatenate([[0], np.cumsum(counts[0] + counts[1])]).tolist()
    out = []
    for i, j in zip(ends, ends[1:]):
        flat = text[i:j].ravel()
        out.append(hashlib.sha256(flat[flat != 0].tobytes()[:-1]).hexdigest() if j > i else "")
    return out


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(paths: tuple[str, str]) -> Pair:
    """The worker's tokenizers for two vocabulary files."""
    if paths not in _PAIRS:
        _PAIRS[paths] = Pair(*paths)
    return _PAIRS[paths]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about SLICE characters."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    part = (np.cumsum(sizes) - sizes) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for i, j in zip(edges, edges[1:]):
        if j > i:
            yield batch.slice(i, j - i)


LINKS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def linked(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per document: numbers, digest of the groups, and its distinct pairs (a * size of B + b)."""
    paths = paths or default_paths()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(paths)
        for batch in batches:
            for part in _slices(batch):
                columns = _rows(pair, pair.encode(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_pydict({"row": part.column("row"), "doc_id": part.column("doc_id")} | columns)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text")
    return texts.mapInArrow(align, LINKS)


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, groups): per document the groups as (start, end, a, b), bytes of a blank and the text."""
    paths = paths or default_paths()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(paths)
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                ids = [np.frombuffer(x, np.uint32) for x in pair.encode(part.column("text").to_pylist())[0]]
                sizes = [n[x] for n, x in zip(pair.lengths, ids, strict=True)]
                groups = coalesced(*sizes)
                ends = np.cumsum(sizes[0])[np.cumsum(groups.n_a) - 1]
                lists = []
                for x, n in zip(ids, (groups.n_a, groups.n_b), strict=True):
                    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                    lists.append(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))))
                starts = np.concatenate([[0], ends])[:-1]
                rows = pa.StructArray.from_arrays([pa.array(starts), pa.array(ends), *lists], names=["start", "end", "a", "b"])
                whole = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), whole], names=["doc_id", "groups"])

    schema = "doc_id long, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, schema)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, n): in how many documents of the task each pair is, from time to time."""
    held, size = [], 0

    def done():
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], names=["pair", "n"])

    for batch in batches:
        held.append(pc.list_flatten(batch.column("pairs")).to_numpy())
        size += len(held[-1])
        if size > PAIRS_AT_ONCE:
            yield done()
            held, size = [], 0
    if size:
        yield done()


def pair_counts(links: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): documents that hold the pair linked; ``best`` if no pair of its A id has more."""
    partial = links.select("pairs").mapInArrow(_counted, "pair long, n long")
    counts = stored(partial.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a = F.expr(f"pair div {size_b}")
    # a row per id of A's vocabulary
    highest = counts.groupBy(a.alias("a")).agg(F.max("n").alias("highest"))
    met = counts.withColumn("_a", a).join(F.broadcast(highest), F.col("_a") == F.col("a"))
    return stored(met.select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pair-bests")


def _met(sent):
    """Per document the sums over pairs that were sent, and the pairs that were not."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = sent.value
        for batch in batches:
            column = batch.column("pairs")
            flat, times = pc.list_flatten(column).to_numpy(), pc.list_flatten(batch.column("times")).to_numpy()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy())])
            spot = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
            known = pairs[spot] == flat if len(pairs) else np.zeros(len(flat), bool)
            sums = []
            for values in (n, best):
                of = np.where(known, times * values[spot], 0) if len(pairs) else np.zeros(len(flat), np.int64)
                sums.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(of)])[ends])))
            offsets = pa.array(np.concatenate([[0], np.cumsum(~known)])[ends], pa.int32())
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~known])) for x in (flat, times)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *sums, *rest], names=["row", "count_sum", "n_best", "pairs", "times"])

    return meet


def scored(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark, paths = docs.sparkSession, paths or default_paths()
    links = stored(linked(docs, paths), "token-links")
    counts = pair_counts(links, len(Pieces(paths[1]).bytes_of))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # their counts sum to the total at most, so they are PAIRS_SENT at most
    sent = counts.where(F.col("n") >= -(-total // PAIRS_SENT)).orderBy("pair").toArrow()
    columns = tuple(sent.column(c).combine_chunks().cast(pa.int64()).to_numpy() for c in ("pair", "n", "best"))
    shared = spark.sparkContext.broadcast(columns)
    schema = "row long, count_sum long, n_best long, pairs array<long>, times array<long>"
    met = stored(links.select("row", "pairs", "times").mapInArrow(_met(shared), schema), "links-met")
    rare = met.select("row", F.inline(F.arrays_zip("pairs", "times"))).join(
        counts.where(F.col("n") < -(-total // PAIRS_SENT)).withColumnRenamed("pair", "p"), F.col("pairs") == F.col("p")
    )
    sums = rare.select("row", (F.col("times") * F.col("n")).alias("count_sum"), (F.col("times") * F.col("best").cast("long")).alias("n_best"))
    sums = sums.unionByName(met.select("row", "count_sum", "n_best"))
    by_row = sums.groupBy(F.col("row").alias("r")).agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    joined = links.drop("pairs", "times").join(by_row, F.col("row") == F.col("r"))
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
