"""What the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import stored

__all__ = [
    "WORD", "bloom_filtered_joins", "documents", "free_names", "give_back", "in_groups", "in_parts", "released", "same", "split_at_blanks", "stored", "strung",
    "text_sizes", "word_count",
]

#: A word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null."""
    return a.eqNullSafe(b)


def documents(spark, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for working columns that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name)
        out.append(name)
    return out


def in_groups(batches: Iterator[pd.DataFrame], columns: Sequence[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that agree in ``columns``, which arrive sorted by them.

    A group may span batches; only the last one of a batch is held back.
    """
    held: pd.DataFrame | None = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        key = pdf[list(columns)].to_numpy()
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(pdf)]
        for start, end in zip(edges[:-2], edges[1:-1], strict=True):
            if end - start > 1:
                yield pdf.iloc[start:end]
        held = pdf.iloc[edges[-2] :]
    if held is not None and len(held) > 1:
        yield held


def give_back() -> None:
    """Give memory that the worker no longer uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        # what numpy and Python have freed stays with the C library otherwise
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def released(run):
    """``run``, a function of record batches, giving unused memory back when its task is over.

    A worker serves many tasks, and what one of them took for its batches would stay with it.
    """

    def with_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return with_release


#: Bytes of text, or of ids, that a task works on at a time.
PART_BYTES = 4 << 20


def in_parts(batch: pa.RecordBatch, sizes: np.ndarray, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of about ``most`` bytes; ``sizes``: those of the rows. A larger row is a range by itself or ends one."""
    at = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), batch.num_rows]
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > start:
            yield batch.slice(start, end - start)


def text_sizes(texts: pa.Array) -> np.ndarray:
    """Bytes of each text; 0 for null."""
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def split_at_blanks(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """What stands between the blanks of ``texts``: ends of each text, numbers of the strings, the distinct strings."""
    split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    coded = split.values.dictionary_encode()
    return split.offsets.to_numpy(), coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()


def strung(own: list[bytes], numbers: np.ndarray, ends: np.ndarray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and where each text's begin and end.

    ``own``: the ids of the distinct strings; ``numbers``, ``ends``: as ``split_at_blanks`` gives them.
    """
    width = np.dtype(dtype).itemsize
    at = np.zeros(len(own) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) // width, out=at[1:])
    table = pa.LargeListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(own), dtype)))
    taken = table.take(pa.array(numbers))
    return taken.values.to_numpy(), taken.offsets.to_numpy()[ends]


BLOOM = "spark.sql.optimizer.runtime.bloomFilter"


@contextmanager
def bloom_filtered_joins(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside filter their large side by a Bloom filter of the other side's keys.

    Spark does this by itself from certain sizes on. Its filter has 8 MB at most, whatever
    the number of keys; too many keys only make it let more rows through. It asks for a
    comparison on the side that gives the keys, and takes that side for the small one; so
    the comparison must not be on the key itself.
    """
    wanted = {f"{BLOOM}.enabled": "true", f"{BLOOM}.applicationSideScanSizeThreshold": "0", f"{BLOOM}.creationSideThreshold": "1t"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
