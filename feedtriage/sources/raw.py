"""The landing zone: one row per fetched payload.

Fetching is left to whatever fills the landing zone. Accepted layouts:
``files``   source=<name>/page_ord=<n>/<any file>, one payload per file;
``parquet`` and ``json`` tables with the columns of ``schema.RAW``. Prefer a
table for many small payloads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedtriage.schema import RAW


def decode_payload(content: Column) -> Column:
    """Bytes to text: UTF-8 unless an XML declaration names Latin-1."""
    utf8 = F.make_valid_utf8(content.cast("string"))
    latin = F.rlike(F.substring(utf8, 1, 200), F.lit(r'(?i)^\s*<\?xml[^>]*encoding=["\']iso-8859-1'))
    return F.when(latin, F.decode(content, "ISO-8859-1")).otherwise(utf8)


def _from_files(df: DataFrame) -> DataFrame:
    return df.select(F.col("source").cast("string").alias("source"),
                     F.col("page_ord").cast("int").alias("page_ord"),
                     F.col("modificationTime").alias("fetched_at"),
                     decode_payload(F.col("content")).alias("body"))


def read_landing(spark: SparkSession, path: str, layout: str = "files") -> DataFrame:
    """raw(source, page_ord, fetched_at, body); unreadable files are skipped."""
    reader = spark.read.option("ignoreCorruptFiles", "true")
    if layout == "files":
        return _from_files(reader.format("binaryFile").load(path))
    return reader.schema(RAW).format(layout).load(path)


def read_landing_stream(spark: SparkSession, path: str, layout: str = "json",
                        max_files: int | None = None) -> DataFrame:
    """The landing zone as a stream of the same rows."""
    reader = spark.readStream.schema(RAW).format(layout)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path)


def page_failures(pages: DataFrame, failed: Column, error: str) -> DataFrame:
    return pages.where(failed).select("source", "page_ord", F.lit(error).alias("error"))
