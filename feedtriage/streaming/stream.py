"""Incremental runs over an arriving landing zone."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from feedtriage.operators import store
from feedtriage.plans.config import JobConfig
from feedtriage.plans.job import Models, commit, run
from feedtriage.scratch import Scratch


def run_stream(spark: SparkSession, cfg: JobConfig, raw_stream: DataFrame, checkpoint: str,
               now: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
               models: Models | None = None) -> StreamingQuery:
    """Process everything that has arrived, batch by batch, then stop.

    Each micro-batch is one run against the store. Its batch id is stored with
    the commit, so a batch that Spark repeats after a failure is skipped or
    overwrites its half-written rows. The window is by wall clock, not by
    watermark: late items are dropped by ``since``, undated ones are kept. State
    is the store itself, since one item has several keys and all-time memory.
    """
    cfg.validate()
    known: list[str] = []

    def stream_id() -> str:
        """Spark's id of the query, which its checkpoint keeps: batches of another
        checkpoint have other names, though their numbers start at 0 again."""
        if not known:
            known.append(spark.read.json(f"{checkpoint}/metadata").select("id").first().id)
        return known[0]

    def process(batch: DataFrame, batch_id: int) -> None:
        name = f"{stream_id()}-{batch_id:012d}"
        if store.is_committed(spark, cfg.store_path, name):
            return
        landed = Scratch(spark, "batch")
        raw = landed.save(batch, "raw")
        if raw.n_rows:
            result = run(spark, cfg, raw, now(), models=models)
            commit(spark, result, name)
            result.scratch.clear()
        landed.clear()

    return (raw_stream.writeStream.foreachBatch(process)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def bounded_url_dedup(articles: DataFrame, delay: str = "1 day",
                      time_col: str = "published") -> DataFrame:
    """Stream without repeated URLs inside the watermark: layer 1 with bounded state only.

    Undated rows have no place in the watermark and pass through.
    """
    dated = (articles.where(F.col(time_col).isNotNull()).withWatermark(time_col, delay)
             .dropDuplicatesWithinWatermark(["url"]))
    return dated.unionByName(articles.where(F.col(time_col).isNull()))
