"""Stage counters of a run, in total and per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

STAGES = ["fetched", "in_window", "undated", "prefiltered", "classified_interesting",
          "low_relevance", "new_items", "duplicates"]


def stage_rows(df: DataFrame, **flags: Column) -> DataFrame:
    """(source, one boolean per stage): stages not named are false."""
    return df.select("source", *[
        F.coalesce(flags.get(s, F.lit(False)), F.lit(False)).alias(s) for s in STAGES])


def funnel(rows: DataFrame, by: str = "source") -> DataFrame:
    """One row per source and the grand total (null source)."""
    return rows.rollup(by).agg(*[F.count_if(F.col(s)).alias(s) for s in STAGES])


def fetch_counts(entries: DataFrame) -> DataFrame:
    """Fetched, kept and undated entries per source."""
    return entries.groupBy("source").agg(
        F.count(F.lit(1)).alias("fetched"), F.count_if("in_window").alias("in_window"),
        F.count_if(F.col("in_window") & F.col("undated")).alias("undated"))


def windowed_counts(articles: DataFrame, width: str = "4 hours", by: str = "source",
                    time_col: str = "published") -> DataFrame:
    """Items per source and time window; works on batch and streaming input."""
    return (articles.groupBy(F.window(time_col, width).alias("w"), by)
            .agg(F.count(F.lit(1)).alias("items"))
            .select(F.col("w.start").alias("window_start"), by, "items"))
