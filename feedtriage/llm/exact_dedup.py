"""Exact dedup by skew-safe combining, in DataFrame functions only.

Copies are combined three times, and each time rows meet only if their whole
normalised text is equal, as the text itself is a grouping key:

1. locally: the map side of the aggregation combines the copies of one task;
2. per salted digest: a digest with many rows is dealt over several salts;
3. globally: the winners of the salts of such a digest are combined.

A digest that fits into one salt needs no third step, so its text is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedtriage.scratch import Scratch

#: Runs of these become one space before texts are compared.
WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                rows_per_salt: int = 5_000, hot_digests: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; all empty texts are one group. The smallest id of a
    group stays; a null id comes after all others, and of rows with the same id and
    text one stays. Other columns are not read. An empty table gives an empty result.

    A digest is hot beyond ``rows_per_salt`` rows and beyond 1/``hot_digests`` of all
    rows, so there are at most ``hot_digests`` of them and their list can be broadcast.
    """
    spark = docs.sparkSession
    body = normalised(F.col(text_col))
    rows = (docs.select(F.col(id_col).alias("doc_id"), body.alias("body"))
            .withColumn("digest", F.unhex(F.sha2("body", 256))))
    floor = max(rows_per_salt, -(-docs.count() // hot_digests))
    hot = (rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > floor)
           .select("digest", F.ceil(F.col("n") / rows_per_salt).cast("long").alias("salts")))
    salted = (rows.join(F.broadcast(hot), "digest", "left")
              .withColumn("salt", F.when(F.col("salts").isNotNull(),
                                         F.pmod(F.xxhash64("doc_id"), F.col("salts"))).otherwise(0)))
    # An id is kept with its null flag, so that null ids sort last and are not lost.
    entry = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    winners = (salted.groupBy("digest", "salts", "salt", "body")
               .agg(F.array_sort(F.collect_list(entry)).alias("ids"))
               .select("digest", "salt", F.when(F.col("salts").isNotNull(), F.col("body")).alias("hot_body"),
                       F.col("ids")[0].alias("first"), F.size("ids").cast("long").alias("n"), "ids"))
    winners = Scratch(spark, "exact-dedup").save(winners, "salts")
    cold = (winners.where(F.col("hot_body").isNull())
            .select("digest", "first", "ids", F.col("first").alias("keep"), F.col("n").alias("group_size")))
    across = winners.where(F.col("hot_body").isNotNull())
    # What was found of a whole text goes back to its salts, so that the ids of one text never
    # meet in one task.
    whole = (across.groupBy("digest", "hot_body")
             .agg(F.min("first").alias("keep"), F.sum("n").alias("group_size"), F.collect_list("salt").alias("salts"))
             .select("digest", F.xxhash64("hot_body").alias("mark"), F.explode("salts").alias("salt"), "keep", "group_size"))
    merged = (across.withColumn("mark", F.xxhash64("hot_body")).join(whole, ["digest", "mark", "salt"])
              .select("digest", "first", "ids", "keep", "group_size"))
    out = cold.unionByName(merged).select(
        "digest", "first", "keep", "group_size", F.posexplode("ids").alias("pos", "entry"))
    return out.select(
        F.col("entry.doc_id").alias("doc_id"), F.col("keep.doc_id").alias("keep_id"), "group_size",
        ((F.col("pos") == 0) & (F.col("first") == F.col("keep"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
