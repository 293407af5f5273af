"""Quality rules: base rules, then robust multivariate outliers per language and source.

A document that passes the base rules is a vector of four transformed statistics:
log mean word length (drawn towards the group's mean by 100 words, since a short
text says little), log(1 + 10 symbols per word), share of repeated lines and share
of repeated words. For each language and source the centre and the covariance are
minimum-covariance-determinant estimates: C-steps from two starts (medians with
median deviations, and plain moments), each step taking the half of the group,
(n + 5) // 2, that lies nearest to the last estimate; the start with the smaller
determinant wins. A text counts once in the estimate, however many copies of it there
are, so up to half of a group's distinct texts may be junk. Documents whose squared
Mahalanobis distance exceeds CUTOFF, a chi-square quantile, are rejected.

Every step runs over all documents of all groups at once. A step sums counts and
moments by group and distance bin, with partial sums in every task, so a group of
any size is a few hundred rows; the bin that crosses the half (1/16 of an octave of
1 + d^2) enters with the weight that fills it. Statistics are integers (1/1024), so the
sums do not depend on their order and reruns agree. The covariance is made that of the
whole by the consistency factor for as many statistics as vary, and wider in a small
group (Hardin and Rocke: the limit is then one of F, not of chi-square). Only a
statistic whose robust spread is below LEAST_SPREADS, mostly one that is zero in most
documents, gets that spread; there its limit is about 4.8 times that spread.

Defined cases: null or empty text has no words and fails the base rules; a null
language or source is a group of its own; in a group too small to tell, statistics that
vary reject nothing; repeated rows get the same verdict;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.llm import textstats
from tablewright.llm.common import free_names, give_back, stored

LEAST_WORDS, MOST_REPEATED = 10, 20
STATISTICS = ["t0", "t1", "t2", "t3"]
SCALE = 1024
#: Spread that rounding to 1/SCALE gives each statistic; keeps covariances regular.
FLOORS = (12**-0.5 / SCALE,) * 4
#: Taken where a statistic's robust spread is smaller.
LEAST_SPREADS = (0.005, 0.15, 0.1, 0.035)
PRIOR_WORDS = 100
STEPS = 5
#: Share of clean documents beyond the cutoff, for normal statistics.
TAIL = 1e-4
PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
KEYS = ["lang", "source"]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def _falling(f, target: float, low: float, high: float) -> float:
    """Where ``f``, which falls, takes ``target``."""
    for _ in range(100):
        x = (low + high) / 2
        low, high = (x, high) if f(x) > target else (low, x)
    return x


def chi2_above(x: float, df: int) -> float:
    """Probability that chi-square exceeds ``x``; whole degrees of freedom."""
    above = math.erfc(math.sqrt(x / 2)) if df % 2 else math.exp(-x / 2)
    for k in range(2 - df % 2, df, 2):
        above += (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return above


#: The chi-square quantile of four statistics, 23.5.
CUTOFF = _falling(lambda x: chi2_above(x, 4), TAIL, 0.0, 100.0)


@lru_cache(100_000)
def consistency(share: float, varying: int) -> float:
    """Makes the covariance of the inner share of a normal sample that of the whole."""
    if share >= 1 or not varying:
        return 1.0
    x = _falling(lambda x: chi2_above(x, varying), 1 - share, 0.0, 200.0)
    return share / (1 - chi2_above(x, varying + 2))


def half(n: float) -> float:
    """Documents in the fit of a group of n."""
    return min(n, (n + 5) // 2)


def _freedom(n: float, p: int) -> float:
    """Degrees of freedom of the half sample's covariance (Croux and Haesbroeck's variance)."""
    outer = 1 - half(n) / n
    if outer <= 0:
        return n - 1
    x = _falling(lambda x: chi2_above(x, p), outer, 0.0, 200.0)
    inner = 1 - outer
    c2, c3 = (chi2_above(x, p + k) / 2 - 0.5 for k in (2, 4))
    factor = consistency(inner, p)
    b1 = -2 * factor * c3 / inner
    b2 = 0.5 + factor / inner * (c3 - x / p * (c2 + inner / 2))
    v1 = inner * b1**2 * (outer * (factor * x / p - 1) ** 2 - 1)
    v1 -= 2 * c3 * factor**2 * (3 * (b1 - p * b2) ** 2 + (p + 2) * b2 * (2 * b1 - p * b2))
    v2 = n * (b1 * (b1 - p * b2) * inner) ** 2 * factor**2
    return 2 * v2 / (factor**2 * v1)


@lru_cache(100_000)
def widening(n: float, varying: int) -> float:
    """By how much the F limit of a group of n documents exceeds CUTOFF; without limit if it is too small."""
    if not varying:
        return 1.0
    freedom = _freedom(n, varying)
    if freedom <= 3.1:
        return 1e9
    d = freedom - 3

    def above(log_f: float) -> float:
        rest = d / (d + 4 * math.exp(log_f))
        return rest ** (d / 2) * (1 + d / 2 * (1 - rest))

    wider = 4 * freedom / d * math.exp(_falling(above, TAIL, -5.0, 200.0)) / CUTOFF
    return min(max(1.0, wider), 1e9)


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counts(texts: pa.Array) -> pa.Array:
    """Counts of each text, one text at a time; the rows themselves stay where they are."""
    sides = zip(*[textstats.counts(t.as_py()) for t in texts], strict=True) if len(texts) else [[] for _ in COUNTS]
    counted = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in sides], names=COUNTS)
    give_back()
    return counted


#: Spark would count anew in every filter on a count.
_counts = _counts.asNondeterministic()


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, digest of the text, counts and base_failed of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), "lang", "source", "text")
    digest = F.unhex(F.md5(F.col("text").cast("binary")))
    return counted_rows(rows).select("*", digest.alias("digest")).drop("text")


def counted_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (no column named like a count) with the counts of its column ``text``."""
    (found,) = free_names(docs, "counts")
    counted = docs.withColumn(found, _counts(F.col(text)))
    rows = counted.select(*docs.columns, *[F.col(found)[c].alias(c) for c in COUNTS])
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )
    return rows.withColumn("base_failed", failed)


def _with(rows: DataFrame, side: DataFrame) -> DataFrame:
    """``side``, a row per group, joined to its documents; null equals null."""
    renamed = side.withColumnsRenamed({k: f"_{k}" for k in KEYS})
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    return rows.join(renamed, match[0] & match[1]).drop(*[f"_{k}" for k in KEYS])


def group_means(counted: DataFrame) -> DataFrame:
    """(lang, source, mean_chars): mean word length over documents that passed the base rules."""
    fit = counted.where("NOT base_failed")
    return fit.groupBy(*KEYS).agg((F.sum("word_chars") / F.sum("n_words")).alias("mean_chars"))


def vectors(counted: DataFrame, means: DataFrame) -> DataFrame:
    """Rows that passed the base rules, with their four statistics as integers."""
    rows = _with(counted.where("NOT base_failed"), means)
    words = F.col("n_words").cast("double")
    raw = [
        F.log((F.col("word_chars") + PRIOR_WORDS * F.col("mean_chars")) / (words + PRIOR_WORDS)),
        F.log1p(10 * F.col("n_symbols") / words),
        F.col("n_dup_lines") / F.col("n_lines"),
        F.col("n_repeat_words") / words,
    ]
    return rows.select(
        *[c for c in counted.columns if c != "base_failed"],
        *[F.round(x * SCALE).cast("long").alias(t) for x, t in zip(raw, STATISTICS, strict=True)],
    )


def _fit(n: float, sums: Sequence[float], products: Sequence[float], share: float, widened: float = 0):
    """(centre, precision, log determinant) of the moments of a group's inner share, in units of the statistics.

    ``widened``: the group's size, if the precision is to be that of the last step.
    """
    mean = np.array(sums, float) / n
    cov = np.zeros((4, 4))
    for (i, j), v in zip(PAIRS, products, strict=True):
        cov[i, j] = cov[j, i] = v / n - mean[i] * mean[j]
    cov /= SCALE**2
    least = np.square(LEAST_SPREADS)
    varying = int((consistency(share, 4) * np.diag(cov) >= least).sum())
    cov *= consistency(share, varying)

    def regular(c: np.ndarray) -> np.ndarray:
        return c + np.diag(np.maximum(least - np.diag(c), 0) + np.square(FLOORS))

    logdet = float(np.linalg.slogdet(regular(cov))[1])
    if widened:
        cov = cov * widening(widened, varying)
    return list(mean / SCALE), [float(x) for x in np.linalg.inv(regular(cov)).ravel()], logdet


ESTIMATE = "lang string, source string, start int, centre array<double>, precision array<double>, logdet double"


def _fitted(last: bool = False):
    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (r.lang, r.source, r.start, *_fit(r.n, r.sums, r.products, r.n / r.size, r.size if last else 0))
                for r in pdf.itertuples()
            ]
            yield pd.DataFrame(rows, columns=["lang", "source", "start", "centre", "precision", "logdet"])

    return fit


def _moments() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("n"),
        *[F.sum(t).alias(f"s{i}") for i, t in enumerate(STATISTICS)],
        *[F.sum(F.col(f"t{i}") * F.col(f"t{j}")).alias(f"p{i}{j}") for i, j in PAIRS],
    ]


def _as_arrays(sums: DataFrame) -> DataFrame:
    return sums.select(
        *KEYS,
        "start",
        F.col("n").cast("double").alias("n"),
        F.col("size").cast("double").alias("size"),
        F.array(*[F.col(f"s{i}").cast("double") for i in range(4)]).alias("sums"),
        F.array(*[F.col(f"p{i}{j}").cast("double") for i, j in PAIRS]).alias("products"),
    )


def _middle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Start from (lang, source, middles) with middles[statistic] = median, median deviation."""
    for pdf in batches:
        rows = []
        for r in pdf.itertuples():
            m = np.array([list(x) for x in r.middles], float) / SCALE
            cov = np.diag(np.square(np.maximum(1.4826 * m[:, 1], LEAST_SPREADS)))
            rows.append(
                (r.lang, r.source, 0, list(m[:, 0]), [float(x) for x in np.linalg.inv(cov).ravel()],
                 float(np.linalg.slogdet(cov)[1]))
            )
        yield pd.DataFrame(rows, columns=["lang", "source", "start", "centre", "precision", "logdet"])


def _middles(rows: DataFrame) -> DataFrame:
    """Exact medians by value counts; values are integers, a group has few thousand of them."""
    values = F.array(*[F.struct(F.lit(i).alias("at"), F.col(t).alias("value")) for i, t in enumerate(STATISTICS)])
    counts = rows.select(*KEYS, F.inline(values)).groupBy(*KEYS, "at", "value").agg(F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy(*KEYS, "at")

    def middle(value: str) -> Column:
        return F.min(F.when(F.col("upto") >= F.col("all") * 0.5, F.col(value)))

    run = counts.withColumn("upto", F.sum("n").over(group.orderBy("value"))).withColumn("all", F.sum("n").over(group))
    off = run.withColumn("median", middle("value").over(group)).withColumn("off", F.abs(F.col("value") - F.col("median")))
    off = off.withColumn("upto", F.sum("n").over(group.orderBy("off")))
    per = off.groupBy(*KEYS, "at").agg(F.array(F.first("median"), middle("off")).alias("m"))
    return per.groupBy(*KEYS).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "m"))), lambda x: x["m"]).alias("middles")
    )


def squared_distance() -> Column:
    """Of the row's statistics from ``centre`` under ``precision``."""
    gap = [F.col(f"t{i}") / SCALE - F.col("centre")[i] for i in range(4)]
    out = F.lit(0.0)
    for i, j in PAIRS:
        term = gap[i] * gap[j] * F.col("precision")[4 * i + j]
        out = out + (term if i == j else 2 * term)
    return out


def _c_step(rows: DataFrame, estimates: DataFrame, last: bool = False) -> DataFrame:
    """New estimates from the nearest half of every group, for every start."""
    near = _with(rows, estimates).withColumn(
        "bin", F.floor(16 * F.log2(1 + F.greatest(squared_distance(), F.lit(0.0))))
    )
    bins = near.groupBy(*KEYS, "start", "bin").agg(*_moments())
    group = Window.partitionBy(*KEYS, "start")
    inner = (
        bins.withColumn("before", F.sum("n").over(group.orderBy("bin")) - F.col("n"))
        .withColumn("size", F.sum("n").over(group))
        .withColumn("half", F.least("size", F.floor((F.col("size") + 5) / 2)))
        .where("before < half")
        .withColumn("whole", F.col("before") + F.col("n") <= F.col("half"))
    )
    names = ["n", *[f"s{i}" for i in range(4)], *[f"p{i}{j}" for i, j in PAIRS]]
    # one bin at most is not whole, so no sum of fractions depends on its order
    part = (F.col("half") - F.col("before")) / F.col("n")

    def taken(x: str) -> Column:
        whole = F.coalesce(F.sum(F.when(F.col("whole"), F.col(x))), F.lit(0))
        return (whole + F.coalesce(F.max(F.when(~F.col("whole"), F.col(x) * part)), F.lit(0.0))).alias(x)

    summed = inner.groupBy(*KEYS, "start").agg(F.max("size").alias("size"), *[taken(x) for x in names])
    return _as_arrays(summed).mapInPandas(_fitted(last), ESTIMATE)


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """(lang, source, centre, precision): the robust estimate of every group."""
    plain = rows.groupBy(*KEYS).agg(*_moments()).withColumn("start", F.lit(1)).withColumn("size", F.col("n"))
    state = _middles(rows).mapInPandas(_middle, ESTIMATE).unionByName(
        _as_arrays(plain).mapInPandas(_fitted(), ESTIMATE)
    )
    state = stored(state, "mcd")
    for step in range(steps):
        state = stored(_c_step(rows, state, step == steps - 1), "mcd")
    best = F.min_by(F.struct("centre", "precision"), F.struct("logdet", "start"))
    return state.groupBy(*KEYS).agg(best.alias("best")).select(*KEYS, "best.centre", "best.precision")


def distinct_texts(rows: DataFrame) -> DataFrame:
    """The statistics of each group's texts, those of copies once."""
    return rows.select(*KEYS, *STATISTICS, "digest").distinct().drop("digest")


def judged(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """``docs``' doc_id, lang, source, counts, base_failed, distance and kept, for every row."""
    counted = stored(text_counts(docs), "quality-counts")
    rows = stored(vectors(counted, group_means(counted)), "quality-vectors")
    found = stored(estimates(stored(distinct_texts(rows), "quality-texts")), "quality-estimates")
    passed = _with(rows, found).withColumn("distance", squared_distance())
    names = [c for c in counted.columns if c not in ("base_failed", "digest")]
    good = passed.select(*names, F.lit(False).alias("base_failed"), "distance", (F.col("distance") <= cutoff).alias("kept"))
    bad = counted.where("base_failed").select(
        *names, "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept")
    )
    return good.unionByName(bad)


def kept_documents(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The documents that pass, whole, with their own columns.

    The verdict of a document follows from its own text and two rows of its group, so
    the texts are counted a second time where they lie instead of being shuffled to
    their verdicts.
    """
    counted = stored(text_counts(docs), "quality-counts")
    means = stored(group_means(counted), "quality-means")
    texts = stored(distinct_texts(vectors(counted, means)), "quality-texts")
    found = stored(estimates(texts), "quality-estimates")
    names = {c: f"_doc_{i}" for i, c in enumerate(docs.columns)}
    here = docs.select(*[F.col(c).alias(n) for c, n in names.items()], *KEYS)
    good = _with(vectors(counted_rows(here, names["text"]), means), found).where(squared_distance() <= cutoff)
    return good.select(*[F.col(n).alias(c) for c, n in names.items()])
