"""Running values along an order, and as-of matches, for groups of any size.

A window function sorts each group in one task. Here rows are dealt by ranges of (group,
order), so a large group lies in many tasks: each takes the running value within its range,
and the ranges' totals, one row for each range that a group touches, carry it onwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from feedtriage.scratch import Scratch

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def running_value(df: DataFrame, keys: list[str], order: list[str], value: str, name: str,
                  scratch: Scratch, how: Callable[[Column], Column] = F.max,
                  combine: Callable[..., Column] = F.greatest) -> DataFrame:
    """Add ``name``: ``how`` (max or min) of ``value`` over the rows before a row in its group.

    ``combine`` is the same for two columns. ``order`` has to be total within a group; a null
    key is a group as any other. Rows before the first value have null.
    """
    by = [*keys, *order]
    position = F.monotonically_increasing_id()
    placed = scratch.save(df.repartitionByRange(*by).sortWithinPartitions(*by)
                          .withColumn("_range", F.shiftright(position, _ROW_BITS)), f"ranges-{name}")
    totals = placed.groupBy("_range", *keys).agg(how(value).alias("_total"))
    # a group's ranges follow each other; there are as many rows as ranges it touches
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = (totals.withColumn("_carried", how("_total").over(earlier)).drop("_total")
               .where(F.col("_carried").isNotNull()))
    carried = carried.select(*[F.col(c).alias(f"_c_{i}") for i, c in enumerate(["_range", *keys])], "_carried")
    same = F.lit(True)
    for i, c in enumerate(["_range", *keys]):
        same = same & F.col(c).eqNullSafe(F.col(f"_c_{i}"))
    before = W.partitionBy("_range", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = placed.withColumn("_own", how(value).over(before))
    return (own.join(carried, same, "left").withColumn(name, combine("_own", "_carried"))
            .select(*df.columns, name))


def running_count(df: DataFrame, keys: list[str], order: list[str], name: str, scratch: Scratch) -> DataFrame:
    """Add ``name``: how many rows of its group come before a row."""
    ones = df.withColumn("_one", F.lit(1).cast("long"))
    both = lambda own, carried: F.coalesce(own, F.lit(0)) + F.coalesce(carried, F.lit(0))
    return running_value(ones, keys, order, "_one", name, scratch, F.sum, both).drop("_one")


def newest_before(items: DataFrame, records: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """items(keys, seq, at) with the newest of records(keys, id, at) at or before an item's
    time: ``id`` and ``record_at``, null without one. Of records of one time the highest id
    counts. One row for each row of items; (keys, at, seq) has to be unique in them.
    """
    none = F.lit(None).cast("long")
    found = F.struct(F.col("at").alias("record_at"), F.col("id").cast("long").alias("id"))
    both = (records.where(F.col("at").isNotNull()).select(*keys, "at", F.lit(0).alias("kind"), F.col("id").cast("long").alias("who"), found.alias("found"))
            .unionByName(items.select(*keys, "at", F.lit(1).alias("kind"), F.col("seq").cast("long").alias("who"),
                                      F.when(none.isNotNull(), F.struct(F.col("at").alias("record_at"), none.alias("id"))).alias("found"))))
    ran = running_value(both, keys, ["at", "kind", "who"], "found", "newest", scratch)
    return (ran.where(F.col("kind") == 1)
            .select(*keys, F.col("who").alias("seq"), "at", F.col("newest.id").alias("id"), F.col("newest.record_at").alias("record_at")))
