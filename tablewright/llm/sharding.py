"""Proportional stratified interleaving into shards.

Rows of each source are put in a seeded random order; the row at place r of a
source with n rows has the fractional rank (r - 1/2) / n. In the order of that
fraction every stretch of the table holds the sources in the proportions of the
whole, so cutting it into equal stretches gives shards that match the mixture.

No task sorts a source or the table. Places are counted in two steps: hash ranges
split every source evenly, whatever its size, and give running counts; inside a
range, rows are numbered by a window. Fractions are dealt out the same way by
equal steps of the fraction, each of which holds about as many rows as any other.

Defined cases: a null source is a source; a null text has 0 bytes and crc 0; rows
that agree in source, doc_id and text are interchangeable; an empty table gives
an empty result; other columns of the input are not touched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import stored

SHARDS = 40
SEED = 20_24
ROWS_IN_RANGE = 10_000
LEAST_RANGES = 1_024


def range_bits(rows: int) -> int:
    """Bits of the hash that name a range: about ROWS_IN_RANGE rows of the table in each."""
    return max(LEAST_RANGES, rows // ROWS_IN_RANGE).bit_length()


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) for every row of ``docs``.

    Shards differ by one row at most; slots of a shard run from 0 without gaps.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            "doc_id",
            "source",
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(F.lit(seed), "doc_id").alias("hash"),
        ),
        "shard-rows",
    )
    total = rows.count()
    bits = range_bits(total)
    rows = rows.withColumn("range", F.shiftrightunsigned("hash", 64 - bits))

    # running counts: one row per source and range
    counts = rows.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("source").alias("_source"),
        F.col("range").alias("_range"),
        F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("source")).alias("of"),
    )
    inside = Window.partitionBy("source", "range").orderBy("hash", "doc_id", "size", "text_crc32")
    ranked = (
        rows.withColumn("in_range", F.row_number().over(inside))
        .join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("range") == F.col("_range")))
        .select(
            "doc_id",
            "source",
            "size",
            "text_crc32",
            "hash",
            (F.col("before") + F.col("in_range")).alias("place"),
            "of",
        )
        .withColumn("fraction", (F.col("place") * 2 - 1) / (F.col("of") * 2))
    )
    steps = 1 << bits
    ranked = stored(
        ranked.withColumn("step", F.floor(F.col("fraction") * steps)), "shard-ranks"
    )
    taken = ranked.groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    # one row per step
    earlier = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    starts = taken.select(
        F.col("step").alias("_step"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    in_step = Window.partitionBy("step").orderBy(
        "fraction", F.col("source").asc_nulls_last(), "place"
    )
    at = F.col("start") + F.col("in_step") - 1
    number = F.expr(f"CAST(at * {shards} DIV {max(total, 1)} AS INT)")
    first = F.expr(f"(shard * CAST({total} AS BIGINT) + {shards - 1}) DIV {shards}")
    return (
        ranked.withColumn("in_step", F.row_number().over(in_step))
        .join(starts, F.col("step") == F.col("_step"))
        .withColumn("at", at.cast("long"))
        .withColumn("shard", number)
        .withColumn("slot", F.col("at") - first)
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )
