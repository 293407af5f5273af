"""Lines that several documents share, kept in the first of them only.

Two Bloom filters hold the lines' keys that were met once and those met a second time.
Every task sorts the bits of its own keys and writes, by segment of the filter, the bits
it set and the bits it set again; a segment is merged by streaming over these rows: a bit
that two tasks set belongs to the second filter. A key whose bits are all in the second
filter is a suspect. Only suspects are shuffled, as digests of 16 bytes: those with a
smallest and a different largest document are confirmed, and the smallest one keeps its
lines. Only documents with a suspect are shuffled to meet what they lose; the others are
passed on where they were read.

The filters have ``BITS_A_KEY`` bits per line between LEAST_BITS and MOST_BITS, so what
is collected and broadcast (the second filter) is at most MOST_BITS / 8 bytes. With more
lines than that fits, the filter lets more lines through, at most all of them; then a
digest per line is shuffled. Results are the same at any fill.

A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys
shorter than LEAST_LENGTH code points stay wherever they are.

Defined cases: a null text stays null and counts as one empty line, as an empty text does;
rows that repeat a doc_id are one document and may share lines; rows without a doc_id are
one document that comes after all others; a line that a document repeats stays there as
often as it stands if it stays at all; other columns are kept whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import free_names, stored

LEAST_LENGTH = 10
BITS_A_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 28
SEGMENT_BITS = 1 << 16
#: Keys whose bits a task sorts at once.
KEYS_AT_ONCE = 2_000_000
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
LAST_ID = (1 << 63) - 1


def line_key(line: bytes) -> bytes | None:
    """The key of a line, null if it is too short to count. Lower case of bytes is A-Z only."""
    key = line.strip(WHITE).lower()
    if len(key) < LEAST_LENGTH:
        return None
    if len(key) < 4 * LEAST_LENGTH and not key.isascii() and len(key.decode("utf-8", "replace")) < LEAST_LENGTH:
        return None
    return key


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _keys(text: bytes | None) -> set[bytes]:
    keys = set(map(line_key, text.split(b"\n"))) if text else set()
    keys.discard(None)
    return keys


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two different bits of each key."""
    first = hashes & np.uint64(bits - 1)
    step = (hashes >> np.uint64(32)) % np.uint64(bits - 1) + np.uint64(1)
    return first, (first + step) & np.uint64(bits - 1)


def _filter_rows(hashes: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """(segment, once, again): the places of set bits in each segment, as 32-bit numbers."""
    places, times = np.unique(np.concatenate(_places(np.concatenate(hashes), bits)), return_counts=True)
    again = places[times > 1]
    edges = np.arange(0, bits + 1, SEGMENT_BITS, dtype=np.uint64)
    cut, cut_again = np.searchsorted(places, edges), np.searchsorted(again, edges)
    rows = [(s, places[a:b], again[c:d]) for s, (a, b, c, d) in enumerate(zip(cut, cut[1:], cut_again, cut_again[1:])) if b > a]
    mask = np.uint64(SEGMENT_BITS - 1)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([s for s, _, _ in rows], pa.int32()),
            *[pa.array([(x[i] & mask).astype("<u4").tobytes() for x in rows], pa.binary()) for i in (1, 2)],
        ],
        names=["segment", "once", "again"],
    )


def _built(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(_hashes(_keys(text.as_py())))
                size += len(held[-1])
                if size >= KEYS_AT_ONCE:
                    yield _filter_rows(held, bits)
                    held, size = [], 0
        if size:
            yield _filter_rows(held, bits)

    return build


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second filter's segments from rows sorted by segment."""
    at, once, again = None, None, None

    def done():
        return pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int32()), pa.array([np.packbits(again, bitorder="little").tobytes()], pa.binary())],
            names=["segment", "bits"],
        )

    for batch in batches:
        for row in range(batch.num_rows):
            segment = batch.column(0)[row].as_py()
            if segment != at:
                if at is not None and again.any():
                    yield done()
                at, once, again = segment, np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
            new, twice = (np.frombuffer(batch.column(i)[row].as_py(), "<u4") for i in (1, 2))
            again[new[once[new]]] = True
            again[twice] = True
            once[new] = True
    if at is not None and again.any():
        yield done()


def filter_size(lines: int) -> int:
    """Bits of one filter: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (lines * BITS_A_KEY).bit_length()))


def twice_filter(text: Column, docs: DataFrame) -> np.ndarray:
    """The filter of keys that more than one row holds, as bytes of eight bits."""
    n = docs.agg(F.sum(line_count(text))).first()[0] or 0
    bits = filter_size(n)
    rows = docs.select(text.cast("binary").alias("text")).mapInArrow(_built(bits), "segment int, once binary, again binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    merged = rows.repartition(parts, "segment").sortWithinPartitions("segment").mapInArrow(_merged, "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for segment, data in merged.collect():  # MOST_BITS / 8 bytes at most
        out[segment * SEGMENT_BITS // 8 : (segment + 1) * SEGMENT_BITS // 8] = np.frombuffer(data, np.uint8)
    return out


def line_count(text: Column) -> Column:
    """Lines of a text; one for a null or empty one."""
    whole = F.coalesce(text, F.lit(""))
    return (F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long")


def _suspects(spark, bits: np.ndarray):
    """A function of a binary text: the digests of its keys that the filter holds."""
    shared = spark.sparkContext.broadcast(bits)

    @F.arrow_udf(T.ArrayType(T.BinaryType()))
    def suspects(texts: pa.Array) -> pa.Array:
        held = shared.value
        out = []
        for text in texts:
            keys = list(_keys(text.as_py()))
            inside = np.ones(len(keys), bool)
            for places in _places(_hashes(keys), 8 * len(held)):
                inside &= (held[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1
            out.append([digest(keys[i]) for i in np.flatnonzero(inside)])
        return pa.array(out, pa.list_(pa.binary()))

    return suspects


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_dropped", T.LongType())]))
def _without(texts: pa.Array, drops: pa.Array) -> pa.Array:
    kept, dropped = [], []
    for text, drop in zip(texts, drops, strict=True):
        gone, lines = set(drop.as_py() or ()), text.as_py()
        if not gone:
            kept.append(lines)
            dropped.append(0)
            continue
        lines = lines.split(b"\n")
        keys = map(line_key, lines)
        stay = [line for line, key in zip(lines, keys, strict=True) if key is None or digest(key) not in gone]
        kept.append(b"\n".join(stay))
        dropped.append(len(lines) - len(stay))
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(dropped, pa.int64())], names=["text", "n_dropped"]
    )


def _lost(marked: DataFrame) -> DataFrame:
    """(at, row, drops): the digests that each document loses. ``marked``: at, row, digest."""
    spans = marked.groupBy("digest").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last")
    shared = stored(spans.select(F.col("digest").alias("shared"), "first"), "shared-lines")
    lost = marked.join(shared, F.col("digest") == F.col("shared")).where("at > first")
    return lost.groupBy("at", "row").agg(F.collect_set("digest").alias("drops"))


def unrepeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the lines dropped from ``text``, and the columns n_lines and n_dropped.

    Columns of these two names in ``docs`` are replaced.
    """
    spark = docs.sparkSession
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("n_lines", "n_dropped")])
    at, row, drops, found, out, lost_at, lost_row = free_names(docs, "at", "row", "drops", "found", "out", "lost_at", "lost_row")
    suspects = _suspects(spark, twice_filter(F.col("text"), docs))(F.col("text").cast("binary"))
    # rows of one doc_id are told apart by their text, so that an id with many rows is many small groups
    placed = docs.withColumns({at: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), row: F.xxhash64("text")})
    marked = placed.select(F.col(at).alias("at"), F.col(row).alias("row"), F.explode(suspects).alias("digest"))
    lost = stored(_lost(stored(marked, "suspect-lines")), "lost-lines")
    lost = lost.select(F.col("at").alias(lost_at), F.col("row").alias(lost_row), F.col("drops").alias(drops))
    flagged = placed.withColumn(found, F.size(suspects))
    whole = flagged.where(F.col(found) == 0).withColumns({"n_lines": line_count(F.col("text")), "n_dropped": F.lit(0).cast("long")})
    met = flagged.where(F.col(found) > 0).join(
        lost, (F.col(at) == F.col(lost_at)) & (F.col(row) == F.col(lost_row)), "left"
    )
    cut = met.withColumn(out, _without(F.col("text").cast("binary"), F.col(drops))).withColumns(
        {"n_lines": line_count(F.col("text")), "n_dropped": F.col(out)["n_dropped"], "text": F.col(out)["text"]}
    )
    names = [*docs.columns, "n_lines", "n_dropped"]
    return whole.select(*[f"`{c}`" for c in names]).unionByName(cut.select(*[f"`{c}`" for c in names]))
