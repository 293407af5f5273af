"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction; it catches the vectors whose cosine with it exceeds a level,
a cap of the sphere. Directions are structured random product codes: the space is
turned at random and cut into three blocks, each block has a code of random unit
vectors, and a direction is one of these per block. So very many filters are described
by few numbers, and the ones a vector exceeds are list-decoded by a search over blocks
that leaves a branch as soon as what is left cannot reach the level. Vectors that share
a filter meet and are verified in double precision.

The number of filters follows the number of vectors, so that a filter holds about one
vector of uniform data; the level is lowered for each vector until it exceeds LIST filters. A
pair with cosine 0.95 then shares none with a probability below one in a thousand, and
nearer pairs practically never (measured recall in the tests and the README).

Equal vectors are one class, so copies are not expanded to pairs. A
filter with many members is split into blocks of BLOCK, every pair of which is a group of
its own: no filter is a task, and no partner is dropped.

Defined cases: vectors that are null, empty or zero or that hold null or non-finite
components link with nothing: no links, a component of their own; vectors of different
lengths do not link; vec_id is the identity of a vector, rows that repeat it with the same
vector count as links of each other; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import in_groups, stored
from tablewright.llm.components import components

SIMILARITY = 0.95
PARTS = 3
LIST = 28
LEAST_CODES = 8
BLOCK = 512
#: In a filter with more members, a pair is left to the smallest filter that its ends share.
LARGE = 32
SEED = 77


def codes_for(vectors: int) -> int:
    """Code words per block: the filters, their third power, are LIST times the vectors."""
    return max(LEAST_CODES, math.ceil((vectors * LIST) ** (1 / PARTS)))


class ProductCode:
    """The filters for one dimension: turned blocks, their codes and the level."""

    def __init__(self, dimension: int, codes: int, wanted: float = LIST, seed: int = SEED):
        rng = np.random.Generator(np.random.PCG64([seed, dimension, codes]))
        self.parts = min(PARTS, dimension)
        self.turn = np.linalg.qr(rng.normal(size=(dimension, dimension)))[0]
        self.cuts = np.linspace(0, dimension, self.parts + 1).astype(int)
        self.codes = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            words = rng.normal(size=(codes, b - a))
            self.codes.append(words / np.linalg.norm(words, axis=1, keepdims=True))
        share = min(0.5, wanted / float(codes) ** self.parts)
        # the cosine of a unit vector with a random direction is about normal with variance 1/d
        self.start = (NormalDist().inv_cdf(1 - share) + 1.0) / math.sqrt(dimension)
        self.step = 0.15 / math.sqrt(dimension)
        self.size, self.wanted = codes, min(wanted, codes**self.parts)

    def exceeded(self, products: list[np.ndarray], level: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of all filters with a cosine of ``level`` or more."""
        n = len(products[0])
        most = [p.max(axis=1) for p in products]
        rows, names, sums = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
        for i, p in enumerate(products):
            rest = sum((most[j] for j in range(i + 1, self.parts)), np.zeros(n))
            out = [(rows[:0], names[:0], sums[:0])]
            # in slices: a branch of each row by each code word
            for s in range(0, len(rows), 4096):
                r = rows[s : s + 4096]
                total = sums[s : s + 4096, None] + p[r]
                at, word = np.nonzero(total + rest[r][:, None] >= level * math.sqrt(self.parts))
                out.append((r[at], names[s : s + 4096][at] * self.size + word, total[at, word]))
            rows, names, sums = (np.concatenate(x) for x in zip(*out, strict=True))
        return rows, names

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter): for each row all filters above the highest level that gives enough of them.

        Levels go down in equal steps, so a list is at most about twice as long as wanted.
        """
        turned = vectors @ self.turn
        products = [turned[:, a:b] @ c.T for a, b, c in zip(self.cuts[:-1], self.cuts[1:], self.codes, strict=True)]
        left, level, out = np.arange(len(vectors)), self.start, []
        while len(left):
            rows, names = self.exceeded([p[left] for p in products], level)
            enough = np.bincount(rows, minlength=len(left)) >= self.wanted
            take = enough[rows]
            out.append((left[rows[take]], names[take]))
            left, level = left[~enough], level - self.step
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (left, left)


def usable(vector) -> bool:
    """Whether a vector can link with any: finite throughout and not zero."""
    return vector is not None and len(vector) > 0 and bool(np.isfinite(vector).all()) and bool(np.any(vector))


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Stored vectors of one dimension in unit length and double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _raw(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if v is None else np.asarray(v, dtype=np.float64) for v in batch.column("embedding").to_pylist()]
            fit = [usable(x) for x in rows]
            # ids stay in Arrow: pandas would turn a column with a null into doubles
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array([len(x) if ok else None for x, ok in zip(rows, fit, strict=True)], pa.int32()),
                    pa.array([(x + 0.0).astype(kind).tobytes() if ok else None for x, ok in zip(rows, fit, strict=True)], pa.binary()),
                ],
                names=["vec_id", "dimension", "raw"],
            )

    return run


def _caught(codes: int, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, ProductCode] = {}
        for pdf in batches:
            for start in range(0, len(pdf), 1000):
                for dimension, part in pdf.iloc[start : start + 1000].groupby("dimension"):
                    code = known.setdefault(dimension, ProductCode(dimension, codes))
                    rows, names = code.decode(unit_rows(list(part["raw"]), kind))
                    yield pd.DataFrame(
                        {"dimension": np.int32(dimension), "filter": names, "rep": part["rep"].to_numpy()[rows]}
                    )

    return run


def _close_pairs(
    reps: np.ndarray, blocks: np.ndarray, crossing: bool, units: np.ndarray, least: float, before: np.ndarray | None
):
    """(a, b) with a < b: pairs of the group's vectors at ``least`` or more that this group owns."""
    cosine = units @ units.T
    near = np.triu(cosine >= least, 1)
    i, j = np.nonzero(near if before is None else near & ~before)
    if crossing:  # pairs inside one block belong to the group of that block alone
        own = blocks[i] != blocks[j]
        i, j = i[own], j[own]
    a, b = np.minimum(reps[i], reps[j]), np.maximum(reps[i], reps[j])
    return a[a != b], b[a != b]


def _met_before(group: pd.DataFrame) -> np.ndarray | None:
    """Which pairs of a large group also share a smaller filter; they are found there."""
    if group["filters"].iat[0] is None:
        return None
    own = group["filter"].iat[0]
    lists = [np.asarray(x) for x in group["filters"]]
    at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    names = np.concatenate(lists)
    at, names = at[names < own], names[names < own]
    known, column = np.unique(names, return_inverse=True)
    shares = np.zeros((len(lists), len(known)), np.float32)
    shares[at, column] = 1
    return shares @ shares.T > 0


def _met(least: float, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, size = [], 0
        for group in in_groups(batches, ["dimension", "filter", "first", "second"]):
            units = unit_rows(group["raw"].tolist(), kind)
            crossing = group["first"].iat[0] != group["second"].iat[0]
            found.append(
                _close_pairs(
                    group["rep"].to_numpy(), group["block"].to_numpy(), crossing, units, least, _met_before(group)
                )
            )
            size += len(found[-1][0])
            if size > 50_000:
                yield _distinct_pairs(found)
                found, size = [], 0
        if size:
            yield _distinct_pairs(found)

    return run


def _distinct_pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return pd.DataFrame({"a": a, "b": b}).drop_duplicates()


def links(classes: DataFrame, kind: str, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b), a < b: linked classes of (rep, dimension, raw), each pair once."""
    spark = classes.sparkSession
    codes = codes_for(classes.count())
    caught = stored(
        classes.select("rep", "dimension", "raw").mapInPandas(
            _caught(codes, kind), "dimension int, filter long, rep long"
        ),
        "caught",
    )
    sizes = caught.groupBy("dimension", "filter").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = caught.join(sizes, ["dimension", "filter"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = shared.withColumn("blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    )
    groups = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "dimension",
        "filter",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
        "block",
        "rep",
        "n",
    )
    # a vector's filters, at most a few times LIST; needed where many pairs would be found again
    lists = caught.groupBy("rep").agg(F.collect_list("filter").alias("filters")).withColumnRenamed("rep", "l")
    groups = groups.join(lists, (F.col("n") > LARGE) & (F.col("rep") == F.col("l")), "left").drop("l", "n")
    raws = classes.select(F.col("rep").alias("r"), "raw")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    met = (
        groups.join(raws, F.col("rep") == F.col("r"))
        .drop("r")
        .repartition(parts, "dimension", "filter", "first", "second")
        .sortWithinPartitions("dimension", "filter", "first", "second")
    )
    pairs = met.select("dimension", "filter", "first", "second", "block", "rep", "filters", "raw").mapInPandas(
        _met(similarity, kind), "a long, b long"
    )
    return pairs.distinct()


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = stored(
        vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(
            _raw(kind), "vec_id long, dimension int, raw binary"
        ),
        "vectors",
    )
    classes = stored(
        rows.where("raw IS NOT NULL")
        .groupBy("raw")
        .agg(F.min("vec_id").alias("rep"), F.first("dimension").alias("dimension"), F.count(F.lit(1)).alias("members"))
        .where("rep IS NOT NULL"),
        "vector-classes",
    )
    found = stored(links(classes, kind, similarity), "vector-links")
    both = found.select("a", "b").unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = classes.select(F.col("rep").alias("w"), "members")
    others = both.join(weight, F.col("b") == F.col("w")).groupBy("a").agg(F.sum("members").alias("others"))
    named = (
        classes.join(others.withColumnRenamed("a", "o"), F.col("rep") == F.col("o"), "left")
        .join(components(found), F.col("rep") == F.col("node"), "left")
        .select(
            F.col("raw").alias("u"),
            (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    placed = rows.join(named, F.col("raw") == F.col("u"), "left")
    component = F.when(F.col("raw").isNull(), F.col("vec_id")).otherwise(F.col("component"))
    return placed.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
