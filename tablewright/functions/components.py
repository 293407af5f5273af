"""Connected components by alternating large-star and small-star.

Each round replaces the edges by others that connect the same nodes and lie nearer
to stars around the smallest node of each component. A round is two grouped minima
joined back to the edges; a node with very many neighbours is one row on the small
side of these joins, and the side with the neighbours can be split anywhere. Edges
go to the shared folder after each round; the driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        both.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n"))
        .where("b > a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` has a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.withColumnRenamed("a", "n"), F.col("a") == F.col("n")).where("b > m")
    return (
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(least.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    Loops and repeated edges do no harm; without edges the result is empty.
    """
    state = stored(
        edges.select(
            F.greatest(left, right).alias("a"), F.least(left, right).alias("b")
        )
        .where("a > b")
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        found = state.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"),
        ).first()
        if (found["n"], found["h"]) == mark or found["n"] == 0:
            break
        mark = (found["n"], found["h"])
        state = stored(_small_star(_large_star(state)), "edges")
    stars = state.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
