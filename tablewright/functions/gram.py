"""Sums and cross products of all pairs of many columns, in one pass over the rows.

Each task multiplies its batches as matrices of doubles and hands out one row per pair of
columns; Spark adds these rows. The number of rows that are shuffled is tasks times pairs,
whatever the number of rows of the table, and no expression grows with the pairs. Columns
are shifted by their means first, so that large means lose no digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import number

PARTIAL = "a string, b string, n long, sa double, sb double, qa double, qb double, p double"


def _multiplied(names: list[str], shift: list[float], whole: bool):
    """Per task the sums over rows where both columns of a pair are known."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(shift)
        n, s, q, p = (np.zeros((k, k)) for _ in range(4))
        seen = 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - np.array(shift)
            known = ~np.isnan(x)
            if whole:
                x, known = x[known.all(axis=1)], known[known.all(axis=1)]
            x = np.where(known, x, 0.0)
            mask = known.astype(float)
            n += mask.T @ mask
            s += x.T @ mask
            q += (x * x).T @ mask
            p += x.T @ x
            seen += len(x)
        if seen:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[x] for x in i], pa.string()),
                    pa.array([names[x] for x in j], pa.string()),
                    pa.array(n[i, j].astype(np.int64)),
                    *[pa.array(v) for v in (s[i, j], s[j, i], q[i, j], q[j, i], p[i, j])],
                ],
                names=["a", "b", "n", "sa", "sb", "qa", "qb", "p"],
            )

    return multiply


def gram(df: DataFrame, columns: Sequence[str], whole: bool = False) -> DataFrame:
    """(a, b, n, sa, sb, qa, qb, p): per pair of columns in their order, itself included.

    ``n`` counts the rows where both are known; over these are the sums of each column, of
    its squares, and of the products, after the column's mean is taken off. With ``whole``
    only rows count where all columns are known.
    """
    columns = list(columns)
    numbers = df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(columns)])
    # a few numbers per column; a column of one value is shifted by it, which leaves exact zeros
    ends = numbers.agg(*[F.struct(F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high")) for c in numbers.columns]).first()
    means = [e["low"] if e["low"] == e["high"] else e["mean"] for e in ends]
    shift = [float(m) if m is not None and np.isfinite(m) else 0.0 for m in means]
    partial = numbers.mapInArrow(_multiplied(columns, shift, whole), PARTIAL)
    return partial.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "p")])


def covariance(of: str = "p", a: str = "sa", b: str = "sb") -> Column:
    """Sum of products about the means, of a row of ``gram``."""
    return F.col(of) - F.try_divide(F.col(a) * F.col(b), F.col("n"))


def correlation() -> Column:
    """Pearson's coefficient of a row of ``gram``; null without spread."""
    spread = covariance("qa", "sa", "sa") * covariance("qb", "sb", "sb")
    r = covariance() / F.sqrt(spread)
    return F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def _inflation(cap: float):
    def invert(pdf: pd.DataFrame) -> pd.DataFrame:
        names = list(dict.fromkeys([*pdf["a"], *pdf["b"]]))
        at = {c: i for i, c in enumerate(names)}
        r = np.eye(len(names))
        for a, b, x in zip(pdf["a"], pdf["b"], pdf["r"], strict=True):
            r[at[a], at[b]] = r[at[b], at[a]] = x
        if np.linalg.cond(r) < 1e10:
            found = np.diag(np.linalg.inv(r))
        else:
            # some column follows from others: each against the rest by least squares
            found = np.empty(len(names))
            for i in range(len(names)):
                rest = np.arange(len(names)) != i
                weights = np.linalg.lstsq(r[np.ix_(rest, rest)], r[rest, i], rcond=1e-10)[0]
                left = 1 - float(r[rest, i] @ weights)
                found[i] = 1 / left if left > 1 / cap else cap
        return pd.DataFrame({"column": names, "vif": np.clip(found, 1.0, cap)})

    return invert


def inflation(correlations: DataFrame, cap: float) -> DataFrame:
    """(column, vif): the diagonal of the inverse of a correlation matrix of (a, b, r) rows.

    The matrix has as many rows as there are columns; one task holds it.
    """
    return correlations.groupBy().applyInPandas(_inflation(cap), "column string, vif double")
