"""Lookups of new items in the all-time store, as joins.

The store side is always reduced to one row per key with a partial aggregate
before the join, so a key that fills a large part of the store costs one row,
and a key that fills a large part of the batch only sits on the splittable side.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from feedtriage.functions import text as X
from feedtriage.operators.running import newest_before
from feedtriage.scratch import Scratch


def distinct_cves(c: Column) -> Column:
    """Upper-cased ids in item order, first occurrence kept."""
    upper = F.filter(F.transform(c, F.upper), lambda x: x.isNotNull())
    return F.coalesce(F.array_distinct(upper), F.array().cast("array<string>"))


def url_seen(items: DataFrame, seen: DataFrame, keep: str = "new") -> DataFrame:
    """Items whose URL is not ('new') or is ('seen') in the store."""
    urls = seen.select("url").distinct()
    return items.join(urls, "url", "left_anti" if keep == "new" else "left_semi")


def cve_first_match(items: DataFrame, seen: DataFrame) -> DataFrame:
    """(seq, record_id): first item CVE that is stored, and its lowest record id."""
    wanted = items.select("seq", F.posexplode(distinct_cves(F.col("cve_ids"))).alias("pos", "cve"))
    stored = (seen.select("id", F.explode(X.cve_set(F.col("cve_ids"))).alias("cve"))
              .groupBy("cve").agg(F.min("id").alias("id")))
    best = F.min(F.struct("pos", "id"))
    return wanted.join(stored, "cve").groupBy("seq").agg(best["id"].alias("record_id"))


def key_first_match(items: DataFrame, seen: DataFrame) -> DataFrame:
    """(seq, record_id): lowest record id with the same non-empty key."""
    stored = (seen.where(F.col("canonical_key") != "").groupBy("canonical_key")
              .agg(F.min("id").alias("record_id")))
    return items.join(stored, "canonical_key").select("seq", "record_id")


def recent_records(seen: DataFrame, run_ts: datetime | Column, window_days: int,
                   ordered: bool = False) -> DataFrame:
    """Records first seen within the window before ``run_ts``, newest first on request."""
    start = F.lit(run_ts).cast("timestamp") - F.make_dt_interval(days=F.lit(window_days))
    out = seen.where(F.col("first_seen_at") >= start)
    return out.orderBy(F.desc("first_seen_at"), F.desc("id")) if ordered else out


def candidate_records(seen: DataFrame, accepted: DataFrame, run_ts: datetime | Column,
                      window_days: int) -> DataFrame:
    """Recent stored records and the items accepted in this run (null id), as one table."""
    pending = accepted.select(
        F.lit(None).cast("long").alias("id"), "category", "vendor", "product", "vuln_class",
        "canonical_key", "cve_ids",
        X.first_non_empty(F.col("summary"), F.col("one_line")).alias("description"),
        "title", "source", "url", F.col("published").alias("first_seen_at"))
    return recent_records(seen, run_ts, window_days).select(*pending.columns).unionByName(pending)


def identity_blocks(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns and block: one row for each CVE id and for the key of a row."""
    cves = F.transform(distinct_cves(F.col("cve_ids")), lambda c: F.concat(F.lit("c:"), c))
    key = F.filter(F.array(F.concat(F.lit("k:"), F.nullif("canonical_key", F.lit("")))), lambda k: k.isNotNull())
    return df.select(*keep, F.explode(F.concat(cves, key)).alias("block"))


def window_candidates(item_blocks: DataFrame, record_blocks: DataFrame, hours: float, scratch: Scratch) -> DataFrame:
    """(seq, block, id, record_at): for each item and block the newest record of the block
    in the ``hours`` up to the item's time, both ends included.

    item_blocks(seq, at, block), record_blocks(id, at, block). Of records of one time the
    highest id counts. Items without a time, or without such a record, have no row. A block
    and a stretch of time may hold any number of rows: they are dealt by ranges of time.
    """
    items = item_blocks.where(F.col("at").isNotNull()).select("block", "seq", "at").distinct()
    found = newest_before(items, record_blocks.where(F.col("id").isNotNull()).select("block", "id", "at").distinct(), ["block"], scratch)
    start = F.col("at") - F.make_dt_interval(secs=F.lit(hours * 3600).cast("decimal(18,6)"))
    return found.where(F.col("record_at") >= start).select("seq", "block", "id", "record_at")


def recent_key_match(items: DataFrame, seen: DataFrame, run_ts: datetime | Column,
                     window_days: int) -> DataFrame:
    """(seq, record_id): newest recent record with the same non-empty key."""
    newest = F.max(F.struct("first_seen_at", "id"))
    stored = (recent_records(seen, run_ts, window_days).where(F.col("canonical_key") != "")
              .groupBy("canonical_key").agg(newest["id"].alias("record_id")))
    return items.join(stored, "canonical_key").select("seq", "record_id")


def record_by_id(seen: DataFrame, record_id: int) -> DataFrame:
    return seen.where(F.col("id") == F.lit(record_id))
