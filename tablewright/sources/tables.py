"""Readers, writers and row-level access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import float_columns, ref

def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder; filters and projections reach the scan."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


#: First bytes of a file that name its encoding.
MARKS = [(b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")]


def mark_encoding(spark: SparkSession, path: str) -> str:
    """The encoding a byte order mark names, else UTF-8; the first bytes of one file are read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(hadoop)
    if found and found[0].isDirectory():
        found = [f for f in files.listStatus(found[0].getPath()) if not f.getPath().getName().startswith(("_", "."))]
    if not found:
        return "UTF-8"
    stream = files.open(found[0].getPath())
    try:
        head = bytes(b for b in (stream.read() for _ in range(3)) if b >= 0)
    finally:
        stream.close()
    return next((name for mark, name in MARKS if head.startswith(mark)), "UTF-8")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    sep: str | None = None,
    encoding: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Delimited text with a header row; quotes inside quotes are doubled.

    Without a schema the types are inferred, which costs a scan; pass the stored
    schema on reruns. Without an encoding the byte order mark decides, else UTF-8.
    ``multi_line`` allows line breaks inside quotes, at the price that a file is
    not split. Blank lines are skipped and an empty file is an error.
    """
    if sep is None:
        sep = "\t" if path.rstrip("/").endswith((".tsv", ".txt")) else ","
    encoding = encoding or mark_encoding(spark, path)
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line or encoding.startswith("UTF-16"))
    )
    found = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    if not found.columns:
        raise ValueError(f"no rows in {path}")
    return found


def header_names(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """The header as written, before Spark makes repeated names unique."""
    first = spark.read.option("header", False).option("sep", sep).csv(path).limit(1).first()
    return [] if first is None else [v or "" for v in first]


def preview(df: DataFrame, order_by: list[str], n: int = 5) -> DataFrame:
    """The first rows under an explicit order, as text with nulls shown empty."""
    top = df.orderBy(*[ref(o) for o in order_by]).limit(n)
    return top.select(*[F.coalesce(ref(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows holding ``text`` in any column, whatever the case."""
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for c in df.columns:
        hit = hit | F.coalesce(F.lower(ref(c).cast("string")).contains(needle), F.lit(False))
    return df.where(hit)


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating-point column."""
    clean = {}
    for c in float_columns(df):
        unfit = F.isnan(ref(c)) | (F.abs(ref(c)) == F.lit(float("inf")))
        clean[c] = F.when(~unfit, ref(c))
    return df.withColumns(clean) if clean else df


def write_result(df: DataFrame, path: str, dataset_id: str) -> None:
    """Put a result into the table at ``path``: one partition per dataset, replaced on a rerun."""
    df.withColumn("dataset_id", F.lit(dataset_id)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("dataset_id").parquet(path)


def read_result(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("dataset_id") == dataset_id).drop("dataset_id")
