"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed pseudo-random position in [0, 2^48) that depends on its
id and the seed alone. A source takes whole passes over its documents while its
target allows, and for the rest all documents below a threshold position. The
threshold comes from histograms of size by the leading bits of the position: the
bucket in which the running sum crosses the rest is refined by its next bits,
alone, and nothing is sorted. A larger rest gives a higher threshold, so the
selections for growing budgets are nested.

Defined cases: a null source is a source of its own, ordered last; a null text has
size 0; a null doc_id has a position of its own; documents whose positions share
the leading 36 bits (repeated rows do) are taken or left together; a source
without words has target 0; an empty table gives an empty mix. Columns of the
input other than the named ones are not touched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import free_names, stored, word_count

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET_SHARE = 1.5
MOST_PASSES = 2.0
SEED = "mix-1"
POSITION_BITS, LEVEL_BITS, LEVELS = 48, 12, 3


def position(doc_id: Column, seed: str = SEED) -> Column:
    """48 bits of an md5 of seed and id, as a long."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def source_targets(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    most_passes: float = MOST_PASSES,
) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    Targets are ``level * weight``, stopped at ``most_passes * source_size``; the
    level is the one at which they sum to the budget. Sources in the order in which
    they reach their stop give the level of each step by running sums, which is what
    resharing the excess by weight until none is above comes to.
    """
    # one row per source: the windows below see no documents
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("at", F.row_number().over(in_order)).withColumn(
        "weight", F.element_at(kinds, ((F.col("at") - 1) % len(weights) + 1).cast("int"))
    )
    stop = F.col("source_size") * most_passes
    everything = Window.partitionBy(F.lit(0))
    by_stop = Window.orderBy("stop_level", "at")
    stops = (
        weighed.withColumn("stop", stop)
        .withColumn("stop_level", F.col("stop") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(everything) * budget_share)
        .withColumn(
            "stopped_before",
            F.coalesce(
                F.sum("stop").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)
            ),
        )
        .withColumn(
            "weight_left",
            F.sum("weight").over(by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        )
        .withColumn("level", (F.col("budget") - F.col("stopped_before")) / F.col("weight_left"))
    )
    # the first source that the level of its step does not stop sets the level of all
    free = F.when(F.col("level") <= F.col("stop_level"), F.struct("stop_level", "at", "level"))
    level = F.min(free).over(everything)["level"]
    return stops.select(
        "source",
        "source_size",
        F.least(F.col("stop"), F.coalesce(level * F.col("weight"), F.col("stop"))).alias("target"),
    )


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, passes, below): the prefix of positions each source adds.

    ``rows`` has (source, size, position). A source's documents are all taken
    ``passes`` times, and those whose leading 36 bits are less than ``below`` once more.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    state = targets.withColumn("passes", whole.cast("long")).select(
        "source",
        "source_size",
        "target",
        "passes",
        (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"),
        F.lit(0).cast("long").alias("prefix"),
        F.lit(0).cast("long").alias("before"),
    )
    for level in range(1, LEVELS + 1):
        shift = POSITION_BITS - LEVEL_BITS * level
        state = stored(_refined(rows, state, shift, level == LEVELS), f"mix-level{level}")
    return state.select("source", "source_size", "target", "passes", F.col("prefix").alias("below"))


def _refined(rows: DataFrame, state: DataFrame, shift: int, last: bool) -> DataFrame:
    """The state with the prefix longer by one level."""
    keys = state.select(F.col("source").alias("of"), F.col("prefix").alias("inside"))
    bucket = F.shiftright("position", shift)
    in_bucket = rows.join(
        keys,
        F.col("source").eqNullSafe(F.col("of"))
        & (F.shiftright("position", shift + LEVEL_BITS) == F.col("inside")),
    )
    sums = in_bucket.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
    # at most 4096 buckets a source
    run = Window.partitionBy("source").orderBy("bucket")
    placed = (
        sums.withColumn("upto", F.sum("n").over(run))
        .withColumnsRenamed({"source": "of"})
        .join(state, F.col("of").eqNullSafe(F.col("source")))
        .withColumn("upto", F.col("before") + F.col("upto"))
    )
    crossing = placed.where(F.col("upto") > F.col("rest")).groupBy(F.col("of")).agg(
        F.min(F.struct("bucket", "upto", "n")).alias("at")
    )
    joined = state.join(crossing, F.col("source").eqNullSafe(F.col("of")), "left")
    before = F.col("at.upto") - F.col("at.n")
    # no crossing: the source has no words, or rounding put the rest at its very end
    after_all = F.shiftleft(F.col("prefix") + 1, LEVEL_BITS) - 1
    if last:
        nearer = (F.col("at.upto") - F.col("rest")) < (F.col("rest") - before)
        prefix = F.col("at.bucket") + F.when(nearer, 1).otherwise(0)
        after_all = after_all + 1
    else:
        prefix = F.col("at.bucket")
    return joined.select(
        "source",
        "source_size",
        "target",
        "passes",
        "rest",
        F.when(F.col("source_size") > 0, F.coalesce(prefix, after_all)).otherwise(0).cast("long").alias("prefix"),
        F.coalesce(before, F.col("before")).cast("long").alias("before"),
    )


def mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken): one row per document."""
    rows = stored(
        docs.select(
            "doc_id",
            "source",
            word_count(F.col("text")).alias("size"),
            position(F.col("doc_id"), seed).alias("position"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    cuts = thresholds(rows, stored(source_targets(sizes, **options), "mix-targets"))
    cuts = cuts.withColumnRenamed("source", "of")
    joined = rows.join(cuts, F.col("source").eqNullSafe(F.col("of")))
    low = F.shiftright("position", POSITION_BITS - LEVEL_BITS * LEVELS) < F.col("below")
    copies = (F.col("passes") + F.when(low, 1).otherwise(0)).cast("int")
    return joined.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (F.col("size") * copies).alias("taken"),
    )


def mixed_documents(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it.

    Copies follow from a document's source and position alone, so the texts meet only
    the thresholds, one row per source, and are not shuffled.
    """
    rows = stored(
        docs.select(
            "source",
            word_count(F.col("text")).alias("size"),
            position(F.col("doc_id"), seed).alias("position"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    of, passes, below, copy = free_names(docs, "of", "passes", "below", "copy")
    cuts = thresholds(rows, stored(source_targets(sizes, **options), "mix-targets")).select(
        F.col("source").alias(of), F.col("passes").alias(passes), F.col("below").alias(below)
    )
    low = F.shiftright(position(F.col("doc_id"), seed), POSITION_BITS - LEVEL_BITS * LEVELS) < F.col(below)
    copies = (F.col(passes) + F.when(low, 1).otherwise(0)).cast("int")
    repeated = docs.join(cuts, docs["source"].eqNullSafe(F.col(of))).where(copies > 0)
    return repeated.withColumn(copy, F.explode(F.array_repeat(F.lit(1), copies))).select(
        *[docs[c] for c in docs.columns]
    )
