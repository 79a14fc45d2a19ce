"""Bounded samples of labelled texts, and the split that keeps rows out of training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Rows whose labels are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, bound: int) -> DataFrame:
    """doc_id, text and y of about ``bound`` rows at most twice that, by a hash of the id;
    all labelled rows if there are fewer. Null labels and ids are left out; of several
    labels of one id the largest counts. The ids of the sample fit into a broadcast."""
    usable = (labels.select("doc_id", F.col(label).cast("int").alias("y"))
              .where("doc_id is not null and y is not null").where(~held_out(F.col("doc_id"), parts, part)))
    every = max(1, usable.count() // bound)
    chosen = (usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0)
              .groupBy("doc_id").agg(F.max("y").alias("y")))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
