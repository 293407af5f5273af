"""A training corpus from raw documents: rules, near-duplicates, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's documents. All but the last keep the columns of
documents, whatever they are called beside doc_id, text, lang and source; an empty table
gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import minhash, mixing, quality, sentencepieces
from tablewright.session import stored

#: Words of a shingle; the query op8_minhash has its own number.
SHINGLE = 5
#: Segments that token_ids keeps in each worker; the executors' memory also holds what earlier stages left.
KEPT_BYTES = 32 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    A null or empty text fails the base rules; a null language or source is a group of its
    own; repeated rows get the same verdict and stay as often as they stand.
    """
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Rows that share that id stay, as do rows without an id and texts without a word.
    """
    return minhash.distinct_documents(docs, SHINGLE)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them, up to twice.

    A null source is a source; rows of one id are taken or left together.
    """
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_ids, ids) of every row of the mix; a text of any length is encoded whole."""
    ids = sentencepieces.encoded(docs, kept=KEPT_BYTES)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL cannot express the robust estimates, the components and the segmentation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
