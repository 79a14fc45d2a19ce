"""A model's word on blocked pairs: do the two name the same thing?

Answers are kept in an append-only cache, by a hash of what was asked. A pair is asked about
once, whatever run it comes up in; a call that fails, or whose answer says neither yes nor
no, leaves nothing behind and is asked again next time. Answers depend on the pair alone, so
they are links as any other for the dedup.

Layout: ``answers/batch=…`` (key, same) and ``commits/batch=…``, whose row makes a batch
count. A batch that is repeated before its commit overwrites itself; a committed one is
never written again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from feedtriage.functions import text as X
from feedtriage.operators import store
from feedtriage.operators.classify import response_json
from feedtriage.operators.model import ModelFn, with_model
from feedtriage.scratch import Scratch

_ANSWER = T.StructType([T.StructField("key", T.StringType()), T.StructField("same", T.BooleanType())])


def pair_prompt(item: str, record: str) -> Column:
    """What is asked about an item and a record, two struct columns."""
    def shown(c: str) -> list[Column]:
        cves = X.first_non_empty(F.array_join(F.col(f"{c}.cve_ids"), ","), F.lit("none"))
        return [F.lit("key="), X.or_empty(F.col(f"{c}.canonical_key")), F.lit(" cves="), cves,
                F.lit("\ntitle: "), X.or_empty(F.col(f"{c}.title"))]
    return F.concat(F.lit("Do these name the same issue? Answer yes or no.\n\nA: "), *shown(item),
                    F.lit("\n\nB: "), *shown(record))


def yes_or_no(answer: Column) -> Column:
    """True or false of an answer that begins with yes or no, or of the ``same`` field of a
    JSON object in it; null otherwise."""
    word = F.lower(F.regexp_extract(X.strip(answer), r"^[\"'*]*([A-Za-z]+)", 1))
    field = F.try_variant_get(response_json(answer), "$.same", "boolean")
    return F.when(word == "yes", F.lit(True)).when(word == "no", F.lit(False)).otherwise(field)


def cached_answers(spark: SparkSession, root: str) -> DataFrame:
    """(key, same) of committed batches, one row a key."""
    batches = store.committed_batches(spark, root).select("batch").distinct()
    rows = store._read_part(spark, root, "answers", _ANSWER).join(batches, "batch", "left_semi")
    return rows.groupBy("key").agg(F.min("same").alias("same"))


def ask_pairs(prompts: DataFrame, cache_root: str, batch: str, make_fn: Callable[[], ModelFn],
              run_ts: datetime, scratch: Scratch | None = None, batch_size: int = 64) -> DataFrame:
    """``prompts`` (any columns, and prompt) with ``same``: what the cache says, or the model,
    whose answers are then in the cache. Null where the model did not say.

    Equal prompts are asked once. The call runs the model, so it is made once for a batch;
    ``batch`` that is committed already asks nothing.
    """
    spark = prompts.sparkSession
    scratch = scratch or Scratch(spark, "pair-model")
    keyed = scratch.save(prompts.withColumn("key", F.sha2("prompt", 256)), "prompts")
    if not store.is_committed(spark, cache_root, batch):
        asked = keyed.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("prompt").alias("prompt"))
        asked = asked.join(cached_answers(spark, cache_root).select("key"), "key", "left_anti")
        answers = with_model(asked, "prompt", "answer", make_fn, batch_size)
        answers = answers.select("key", yes_or_no(F.col("answer")).alias("same")).where(F.col("same").isNotNull())
        answers.write.mode("overwrite").parquet(f"{cache_root}/answers/batch={batch}")
        store.write_commit(spark, cache_root, batch, run_ts)
    return keyed.join(cached_answers(spark, cache_root), "key", "left").drop("key")


def model_pairs(candidates: DataFrame, items: DataFrame, seen: DataFrame, cache_root: str, batch: str,
                make_fn: Callable[[], ModelFn], run_ts: datetime, scratch: Scratch | None = None) -> DataFrame:
    """pairs(seq, cand_seq, record_id, score) of the blocked candidates(seq, id) of items and
    records that the model calls the same."""
    asked = F.struct("title", "canonical_key", "cve_ids")
    rows = (candidates.select("seq", "id").distinct()
            .join(items.select("seq", asked.alias("a")), "seq").join(seen.select("id", asked.alias("b")), "id"))
    said = ask_pairs(rows.select("seq", "id", pair_prompt("a", "b").alias("prompt")), cache_root, batch, make_fn, run_ts, scratch)
    return said.where("same").select("seq", F.lit(None).cast("long").alias("cand_seq"), F.col("id").alias("record_id"), F.lit(1.0).alias("score"))
