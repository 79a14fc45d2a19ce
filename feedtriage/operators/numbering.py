"""Dense numbering of a distributed table in a given order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from feedtriage.scratch import Scratch

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def dense_index(df: DataFrame, order: list[Column], name: str, scratch: Scratch,
                start: int | Column = 0) -> DataFrame:
    """Add ``name`` = start, start + 1, … in ``order`` without a one-task window.

    The rows are range-partitioned and sorted once and written; the offsets come
    from the per-partition counts (one row per partition, so broadcast is safe).
    ``order`` must be total for the numbering to be repeatable.
    """
    position = F.monotonically_increasing_id()
    ordered = (df.repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("_part", F.shiftright(position, _ROW_BITS))
               .withColumn("_row", position.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))))
    ordered = scratch.save(ordered, f"order-{name}")
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    first = start if isinstance(start, Column) else F.lit(start)
    return (ordered.join(F.broadcast(offsets), "_part")
            .withColumn(name, (F.col("_before") + F.col("_row") + first).cast("long"))
            .drop("_part", "_row", "_before"))
