"""Items per source and time window as a stream with bounded state.

The watermark closes old windows, so Spark keeps open ones only. A batch writes the windows
it changed to a folder of its own, which a repeated batch overwrites; of each window the
last batch counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def save_batch(counted: DataFrame, batch_id: int, path: str) -> None:
    counted.write.mode("overwrite").parquet(f"{path}/counts/batch={batch_id}")


def count_stream(articles: DataFrame, path: str, width: str = "4 hours", delay: str = "1 day",
                 by: str = "source", time_col: str = "published", arrived_col: str = "fetched_at") -> StreamingQuery:
    """Count all that has arrived into the table at ``path``, batch by batch, then stop.

    Undated rows count, apart from the others, in the window they arrived in; rows without
    either time are dropped, and so are rows later than ``delay`` whose window is closed.
    The stream's checkpoint lies below ``path``, so a table belongs to one stream.
    """
    rows = articles.select(F.coalesce(time_col, arrived_col).alias("at"), by, F.col(time_col).isNull().alias("undated"))
    counted = (rows.withWatermark("at", delay).groupBy(F.window("at", width).alias("w"), by, "undated")
               .agg(F.count(F.lit(1)).alias("items")).select(F.col("w.start").alias("window_start"), by, "undated", "items"))
    return (counted.writeStream.outputMode("update").foreachBatch(lambda df, i: save_batch(df, i, path))
            .option("checkpointLocation", f"{path}/stream").trigger(availableNow=True).start())


def late_rows(query: StreamingQuery) -> int:
    """Groups of rows (after counting within tasks) that came after their window was closed."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def read_counts(spark: SparkSession, path: str, by: str = "source") -> DataFrame:
    """(window_start, by, undated, items): the newest count of every window, closed or open."""
    rows = spark.read.parquet(f"{path}/counts")
    return rows.groupBy("window_start", by, "undated").agg(F.max_by("items", "batch").alias("items"))
