"""Near-duplicate documents: MinHash with banding, exact verification, components.

Documents with the same shingle set are one class and are represented by their
smallest id. A class has 160 universal hash minima in 32 bands of 5; a pair with
similarity 0.8 shares no band with probability 3e-6. Classes that share a band key
form a bucket. A pair is verified on the full shingle sets if at least 0.6 of the
minima agree, which a pair at 0.8 misses with a probability below 1e-9.

Pairs come in two steps. First every class is compared with the smallest one of its
bucket (a star) in the first 8 bands, and the verified pairs give components; near
copies, however many, mostly fall together here. Then, in every bucket of all bands
that holds several components, each class outside the bucket's largest component is
compared with the classes of the other components: in small buckets as rows of pairs, in
large ones block by block with the sets at hand, so that only links leave a task. After that every pair of a bucket
has either been compared or lies inside one component, so no link of a bucket is lost,
and no group of near copies is expanded to pairs.

Defined cases: a null or wordless text has an empty set and is linked with nothing;
with fewer words than a shingle the whole sequence is the one shingle; rows that
repeat a doc_id all take its component; a null doc_id is never a representative
unless its class has none, and then its component is null; an empty table gives an
empty result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm.common import bloom_filtered_joins, free_names, in_groups, released, stored
from tablewright.llm.components import components

BANDS, ROWS = 32, 5
SHINGLE = 4
SIMILARITY = 80  # per cent
LEAST_ESTIMATE = 0.6
#: Bands whose buckets give the first components.
FIRST_BANDS = 8
#: Larger buckets are compared in blocks of BLOCK classes, smaller ones by rows of pairs.
SMALL_BUCKET, BLOCK = 16, 256
CHUNK = 1 << 20

_SEEDS = np.random.Generator(np.random.PCG64(811))
FACTORS = _SEEDS.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OFFSETS = _SEEDS.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
PLACES = _SEEDS.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles.

    bytes.lower() and bytes.split() know A-Z and the six ASCII white space bytes only.
    """
    words = [t.encode("utf-8").lower().split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words])
    flat = [x for w in words for x in w]
    if not flat:
        return [np.empty(0, np.uint64) for _ in texts]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=False)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for i in range(min(k, n)):
        rolled[: n - i] += hashes[i:] * PLACES[i] if i else hashes * PLACES[0]
    rolled = _mixed(rolled)
    out, start = [], 0
    for c in counts:
        if c >= k:
            out.append(np.unique(rolled[start : start + c - k + 1]))
        elif c:
            few = hashes[start : start + c]
            out.append(_mixed((few * PLACES[8 : 8 + c]).sum(dtype=np.uint64, keepdims=True) + np.uint64(c)))
        else:
            out.append(np.empty(0, np.uint64))
        start += c
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    """160 minima of universal hashes (a x + b mod 2^64, upper half)."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[None, i : i + 2048] * FACTORS[:, None]
        part += OFFSETS[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low >> np.uint64(32)


def _chunks(pdf: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """Row ranges of about a megabyte of text."""
    ends = pdf[column].str.len().fillna(0).cumsum() // CHUNK
    for _, part in pdf.groupby(ends.to_numpy()):
        yield part


def _features(k: int = SHINGLE):
    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _chunks(pdf, "text"):
                sizes, digests, keys, signatures = [], [], [], []
                for shingles in shingle_sets(part["text"].tolist(), k):
                    sizes.append(len(shingles))
                    if not len(shingles):
                        digests.append(None)
                        keys.append(None)
                        signatures.append(None)
                        continue
                    low = minima(shingles)
                    key = np.zeros(BANDS, np.uint64)
                    for r in range(ROWS):
                        key = _mixed(key + low.reshape(BANDS, ROWS)[:, r] * PLACES[r] + np.arange(BANDS, dtype=np.uint64))
                    digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    keys.append(key.view(np.int64))
                    signatures.append((low & np.uint64(0xFFFF)).astype("<u2").tobytes())
                yield pd.DataFrame(
                    {"doc_id": part["doc_id"].array, "n_shingles": sizes, "digest": digests, "keys": keys, "signature": signatures}
                )

    return extract


_FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("signature", pa.binary())]
)


def _with_whole_ids(run):
    """``run``, a function of frames, on record batches: a null among the ids does not make them doubles."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch.column("doc_id").to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            yield pd.DataFrame({"doc_id": ids, "text": batch.column("text").to_pylist()})

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(frames(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _FEATURES], schema=_FEATURES)

    return on_batches


def features(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, digest, keys, signature) of every row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        released(_with_whole_ids(_features(k))), "doc_id long, n_shingles long, digest binary, keys array<long>, signature binary"
    )


@F.pandas_udf(T.DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal minima of two signatures."""
    if not len(a):
        return pd.Series([], dtype=float)
    x = np.frombuffer(b"".join(a), "<u2").reshape(len(a), -1)
    y = np.frombuffer(b"".join(b), "<u2").reshape(len(b), -1)
    return pd.Series((x == y).mean(axis=1))


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs worth verifying."""
    left = classes.select(F.col("rep").alias("a"), F.col("signature").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("signature").alias("sb"))
    known = pairs.join(left, "a").join(right, "b")
    return known.where(agreement("sa", "sb") >= LEAST_ESTIMATE).select("a", "b")


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): the smallest class of each bucket with each other one."""
    heads = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("head")).where("n > 1")
    pairs = members.join(heads.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).where("rep > head")
    return pairs.select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()


def _open_buckets(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, key, rep, group, major, n) of the buckets that hold several groups.

    A class that is in no group is one by itself; ``major`` is the bucket's largest group.
    """
    busy = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    named = (
        members.join(busy.select(F.col("key").alias("k"), "n"), F.col("key") == F.col("k"))
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select("band", "key", "rep", F.coalesce("component", "rep").alias("group"), "n")
    )
    sizes = named.groupBy("key", "group").agg(F.count(F.lit(1)).alias("m"))
    mixed = (
        sizes.groupBy("key")
        .agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("m", "group"))["group"].alias("major"))
        .where("groups > 1")
        .select(F.col("key").alias("k"), "major")
    )
    return named.join(mixed, F.col("key") == F.col("k")).select("band", "key", "rep", "group", "major", "n")


def _across(narrow: DataFrame) -> DataFrame:
    """(a, b): pairs of small open buckets whose ends lie in different groups."""
    minor = narrow.where(F.col("group") != F.col("major")).select(
        F.col("key").alias("k"), F.col("rep").alias("a"), F.col("group").alias("ga")
    )
    return (
        narrow.join(minor, F.col("key") == F.col("k"))
        .where((F.col("group") != F.col("ga")) & ((F.col("group") == F.col("major")) | (F.col("a") < F.col("rep"))))
        .select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"))
        .distinct()
    )


def _sets(k: int = SHINGLE):
    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _chunks(pdf, "text"):
                sets = [x.tobytes() for x in shingle_sets(part["text"].tolist(), k)]
                yield pd.DataFrame({"rep": part["doc_id"].to_numpy(), "shingles": sets})

    return sets_of


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between different groups of large buckets, block by block.

    A pair belongs to the first band in which its ends share a key, so it is compared once.
    """
    for rows in in_groups(batches, ["key", "first", "second"]):
        band, crossing = int(rows["band"].iat[0]), rows["first"].iat[0] != rows["second"].iat[0]
        reps, groups, blocks = (rows[c].to_numpy() for c in ("rep", "group", "block"))
        keys = np.stack(rows["keys"].to_list())[:, :band]
        low = np.frombuffer(b"".join(rows["signature"]), "<u2").reshape(len(rows), -1)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        sizes = np.array([len(x) for x in sets])
        found = []
        for i in np.flatnonzero(groups != rows["major"].iat[0]):
            other = groups != groups[i]
            # of two outside the largest group, one asks
            other &= (groups == rows["major"].iat[0]) | (reps > reps[i])
            if crossing:
                other &= blocks != blocks[i]
            other &= 100 * np.minimum(sizes, sizes[i]) >= SIMILARITY * np.maximum(sizes, sizes[i])
            j = np.flatnonzero(other)
            j = j[(low[j] == low[i]).mean(axis=1) >= LEAST_ESTIMATE]
            j = j[~(keys[j] == keys[i]).any(axis=1)]
            for k in j:
                common = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
                if 100 * common >= SIMILARITY * (sizes[i] + sizes[k] - common):
                    found.append((min(reps[i], reps[k]), max(reps[i], reps[k])))
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])


def _wide_links(wide: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(a, b): the links between groups of the buckets that are too large for rows of pairs."""
    parts = int(wide.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ends = stored(wide.select(F.col("rep").alias("r")).distinct().withColumn("asked", F.lit(1)), "wide-ends").where("asked > 0")
    sets = docs.join(ends, F.col("doc_id") == F.col("r")).select("doc_id", "text").mapInPandas(
        _sets(k), "rep long, shingles binary"
    )
    known = classes.select("rep", "keys", "signature").join(sets, "rep")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = (
        wide.withColumn("blocks", blocks)
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("first", F.least("block", "other"))
        .withColumn("second", F.greatest("block", "other"))
        .drop("n", "blocks", "other")
    )
    rows = (
        placed.join(known, "rep")
        .repartition(parts, "key", "first", "second")
        .sortWithinPartitions("key", "first", "second")
    )
    return rows.mapInPandas(_compared, "a long, b long")


def _judged(k: int = SHINGLE):
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _chunks(pdf, "ta"):
                keep = []
                for x, y in zip(shingle_sets(part["ta"].tolist(), k), shingle_sets(part["tb"].tolist(), k), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= SIMILARITY * (len(x) + len(y) - common))
                yield part.loc[keep, ["a", "b"]]

    return judge


def _verified(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The stored pairs whose full sets are similar enough. ``docs``: doc_id, text of representatives.

    Inside ``bloom_filtered_joins`` only texts of ends (and few others) are shuffled.
    """
    ends = stored(
        pairs.select(F.inline(F.array(
            F.struct("a", "b", F.col("a").alias("end"), F.lit(1).alias("asked")),
            F.struct("a", "b", F.col("b").alias("end"), F.lit(1).alias("asked")),
        ))),
        "pair-ends",
    ).where("asked > 0")
    texts = ends.join(docs, F.col("end") == F.col("doc_id")).select("a", "b", "end", "text")
    first = texts.where("end = a").select("a", "b", F.col("text").alias("ta"))
    second = texts.where("end = b").select(F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("text").alias("tb"))
    met = first.join(second, (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2")))
    return met.select("a", "b", "ta", "tb").mapInPandas(_judged(k), "a long, b long")


def linked_classes(docs: DataFrame, seen: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(node, component) over class representatives; ``seen`` are the stored features."""
    classes = stored(
        seen.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("signature").alias("signature"))
        .where("rep IS NOT NULL"),
        "classes",
    )
    members = classes.select("rep", F.posexplode("keys").alias("band", "key"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    near = stored(_estimated(_stars(members.where(F.col("band") < FIRST_BANDS)), classes), "star-pairs")
    with bloom_filtered_joins(docs.sparkSession):
        links = stored(_verified(near, texts, k), "links")
    first = stored(components(links), "components")
    open_ = stored(_open_buckets(members, first), "open-buckets")
    rest = _across(open_.where(F.col("n") <= SMALL_BUCKET)).join(near, ["a", "b"], "left_anti")
    more = stored(_estimated(rest, classes), "cross-pairs")
    wide = open_.where(F.col("n") > SMALL_BUCKET)
    found = first.select(F.col("node").alias("a"), F.col("component").alias("b"))
    with bloom_filtered_joins(docs.sparkSession):
        if not more.isEmpty():
            found = found.unionByName(stored(_verified(more, texts, k), "links"))
        if not wide.isEmpty():
            found = found.unionByName(stored(_wide_links(wide, classes, texts, k), "links"))
    return stored(components(found), "components")


def near_duplicates(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``, by shingles of ``k`` words."""
    seen = stored(features(docs, k), "features")
    found = linked_classes(docs, seen, k)
    classes = seen.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    named = classes.join(found, F.col("rep") == F.col("node"), "left").select(
        F.col("digest").alias("d"), F.coalesce("component", "rep").alias("component")
    )
    # both sides lie in files, so that Spark can split the copies of one text between tasks
    named = stored(named, "named-classes")
    placed = seen.select("doc_id", "n_shingles", "digest").join(named, F.col("digest") == F.col("d"), "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return placed.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def distinct_documents(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """The documents that stay, whole: one id of each component.

    Rows without a doc_id stay, since nothing tells them apart. The ids that go are few,
    so they are what the texts are joined with.
    """
    (name,) = free_names(docs, "gone")
    gone = near_duplicates(docs, k).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name))
    gone = stored(gone.distinct(), "gone")
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(name), "left_anti")
