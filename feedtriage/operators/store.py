"""The all-time store of reported items: append-only batches with late CVE ids.

Layout below one root: ``records/batch=…`` (new rows), ``backfills/batch=…``
(id, cve) and ``commits/batch=…``. A batch counts once its commit row exists, so
a run that is repeated overwrites its own half-written folders and a commit
costs what the batch costs, not what the store costs.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedtriage.functions import text as X
from feedtriage.operators.numbering import dense_index
from feedtriage.schema import SEEN
from feedtriage.scratch import Scratch

_BATCH = T.StructField("batch", T.StringType())
_BACKFILL = T.StructType([T.StructField("id", T.LongType()), T.StructField("cve", T.StringType())])


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _read_part(spark: SparkSession, root: str, name: str, schema: T.StructType) -> DataFrame:
    with_batch = T.StructType(schema.fields + [_BATCH])
    path = f"{root}/{name}"
    if not path_exists(spark, path):
        return spark.createDataFrame([], with_batch)
    return spark.read.schema(with_batch).option("basePath", path).parquet(path)


def committed_batches(spark: SparkSession, root: str) -> DataFrame:
    return _read_part(spark, root, "commits",
                      T.StructType([T.StructField("run_ts", T.TimestampType())]))


def is_committed(spark: SparkSession, root: str, batch: str) -> bool:
    return not committed_batches(spark, root).where(F.col("batch") == F.lit(batch)).isEmpty()


def read_seen(spark: SparkSession, root: str) -> DataFrame:
    """Committed records with their backfilled CVE ids."""
    batches = committed_batches(spark, root).select("batch").distinct()
    records = _read_part(spark, root, "records", SEEN).join(batches, "batch", "left_semi")
    added = _read_part(spark, root, "backfills", _BACKFILL).join(batches, "batch", "left_semi")
    return backfill_cves(records.select(*SEEN.fieldNames()), added.select("id", "cve"))


def import_seen(df: DataFrame) -> DataFrame:
    """Rows whose CVE ids are JSON text and whose times are ISO text, as a store table."""
    return df.withColumns({
        "cve_ids": X.cves_from_json(F.col("cve_ids")),
        "first_seen_at": F.col("first_seen_at").cast("timestamp"),
    }).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SEEN.fields])


def backfill_rows(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """(id, cve): CVE ids of duplicates to add to the record they matched."""
    matched = decisions.where(F.col("matched_record_id").isNotNull()).select(
        "seq", F.col("matched_record_id").alias("id"))
    return (items.select("seq", F.explode("cve_ids").alias("cve")).join(matched, "seq")
            .select("id", F.upper("cve").alias("cve")).where(F.col("cve").isNotNull()).distinct())


def backfill_cves(seen: DataFrame, added: DataFrame) -> DataFrame:
    """Store with (id, cve) rows united into the CVE sets; unknown ids change nothing."""
    sets = added.groupBy("id").agg(F.collect_set(F.upper("cve")).alias("_added"))
    merged = X.cve_set(F.concat(X.cve_set(F.col("cve_ids")),
                                F.coalesce("_added", F.array().cast("array<string>"))))
    return (seen.join(sets, "id", "left").withColumn("cve_ids", merged).drop("_added")
            .select(*seen.columns))


def new_records(new_items: DataFrame, next_id: int | Column, run_ts: datetime | Column,
                scratch: Scratch) -> DataFrame:
    """Store rows of new items, ids dense from ``next_id`` in ``seq`` order."""
    rows = new_items.select(
        "seq", X.or_empty(F.col("category")).alias("category"), "vendor", "product",
        "vuln_class", X.or_empty(F.col("canonical_key")).alias("canonical_key"),
        X.cve_set(F.col("cve_ids")).alias("cve_ids"),
        X.or_empty(X.first_non_empty(F.col("summary"), F.col("one_line"))).alias("description"),
        X.or_empty(F.col("title")).alias("title"), X.or_empty(F.col("source")).alias("source"),
        X.or_empty(F.col("url")).alias("url"),
        F.lit(run_ts).cast("timestamp").alias("first_seen_at"))
    return dense_index(rows, [F.col("seq")], "id", scratch, next_id).select(*SEEN.fieldNames())


def next_record_id(seen: DataFrame) -> int:
    return (seen.agg(F.max("id")).first()[0] or 0) + 1


def append_seen(seen: DataFrame, new_items: DataFrame, run_ts: datetime | Column,
                scratch: Scratch | None = None) -> DataFrame:
    """Store with the new items appended."""
    scratch = scratch or Scratch(seen.sparkSession, "append")
    fresh = new_records(new_items, next_record_id(seen), run_ts, scratch)
    return seen.select(*SEEN.fieldNames()).unionByName(fresh)


def commit_batch(spark: SparkSession, root: str, batch: str, records: DataFrame,
                 backfills: DataFrame, run_ts: datetime) -> None:
    """Write one batch; readers see it only after its commit row."""
    backfills.write.mode("overwrite").parquet(f"{root}/backfills/batch={batch}")
    records.write.mode("overwrite").parquet(f"{root}/records/batch={batch}")
    write_commit(spark, root, batch, run_ts)


def write_commit(spark: SparkSession, root: str, batch: str, run_ts: datetime) -> None:
    """The row that makes a batch count."""
    stamp = spark.createDataFrame([(run_ts,)], "run_ts timestamp").coalesce(1)
    stamp.write.mode("overwrite").parquet(f"{root}/commits/batch={batch}")


def compact_seen(spark: SparkSession, root: str, new_root: str, run_ts: datetime) -> None:
    """Copy the store to a new root as a single batch with the backfills applied."""
    empty = spark.createDataFrame([], _BACKFILL)
    commit_batch(spark, new_root, "compacted", read_seen(spark, root), empty, run_ts)


def latest(seen: DataFrame, n: int = 100) -> DataFrame:
    """Newest ``n`` records, newest first."""
    return seen.orderBy(F.desc("first_seen_at"), F.desc("id")).limit(n)
