"""Queries of the semantic layer over the given tables: candidates, similar rows, a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedtriage.operators import dedup, matching, pair_model, similarity
from feedtriage.operators.indexed_store import IndexedStore
from feedtriage.plans import driver_tables as T
from feedtriage.scratch import Scratch

WINDOW_HOURS = 6


def _texts(spark, d):
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text")


def jaccard_pairs(spark, d):
    """Documents with the class of equal token sets and the group that links reach."""
    scratch = Scratch(spark, "jaccard-pairs")
    rows = similarity.Texts(_texts(spark, d), None, scratch=scratch)
    found = similarity.similar_groups(*rows.links(), scratch)
    out = _texts(spark, d).select("seq").join(found.withColumnRenamed("id", "seq"), "seq", "left")
    return out.select(F.col("seq").alias("doc_id"), F.coalesce("class_id", "seq").alias("class_id"), F.coalesce("group_id", "seq").alias("group_id"))


def cosine_pairs(spark, d):
    """Vectors with the class of equal directions and the group that links reach."""
    scratch = Scratch(spark, "cosine-pairs")
    items = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), "embedding")
    found = similarity.similar_groups(*similarity.Vectors(items, None, scratch=scratch).links(), scratch)
    out = items.select("seq").join(found.withColumnRenamed("id", "seq"), "seq", "left")
    return out.select(F.col("seq").alias("vec_id"), F.coalesce("group_id", "seq").alias("group_id"))


def dedup_similar_texts(spark, d):
    """The dedup of a batch with similar texts as its third layer."""
    items = T.document_items(spark, d).withColumnRenamed("summary", "text")
    return similarity.dedup_similar(items).select("seq", "is_duplicate", "reason")


def _blocks(spark, d):
    """Items and records in blocks by CVE id, key and language; a language is a large block."""
    lang = lambda: F.concat(F.lit("l:"), F.split_part("canonical_key", F.lit(":"), F.lit(1)))
    items = T.document_items(spark, d).withColumn("at", F.col("published"))
    seen = T.page_records(spark, d).withColumn("at", F.col("first_seen_at"))
    both = lambda df, c: matching.identity_blocks(df, c, "at").unionByName(df.select(c, "at", lang().alias("block")))
    return both(items, "seq"), both(seen, "id")


def window_candidates(spark, d):
    found = matching.window_candidates(*_blocks(spark, d), WINDOW_HOURS, Scratch(spark, "window"))
    return found.select("seq", "block", "id", T.clock(F.col("record_at")).alias("record_at"))


def _same_first_word():
    """Stand-in for a model: yes if both titles begin with the same word."""
    def answer(prompt: str) -> str:
        titles = [line.removeprefix("title: ") for line in prompt.split("\n") if line.startswith("title: ")]
        return "Yes." if titles[0].split(" ")[0] == titles[1].split(" ")[0] else "no"
    return lambda prompts: [answer(p) for p in prompts]


def model_pairs(spark, d):
    """What the stand-in says on the newest candidate of each block."""
    scratch = Scratch(spark, "model-pairs")
    candidates = matching.window_candidates(*_blocks(spark, d), WINDOW_HOURS, scratch)
    found = pair_model.model_pairs(candidates, T.document_items(spark, d), T.page_records(spark, d), f"{scratch.root}/cache", "first",
                                   _same_first_word, T.RUN_TS, scratch)
    return found.select("seq", "record_id")


def _levels(spark, d, scratch):
    """The pages as a store of many batches, merged in levels; the last batch adds each record's
    number as a CVE id to the record before."""
    levels = IndexedStore(spark, f"{scratch.root}/levels", fanout=3)
    records, none = scratch.save(T.page_records(spark, d), "records"), spark.createDataFrame([], "id long, cve string")
    last = records.agg(F.max("id")).first()[0]
    for k in range(7):
        levels.append(f"b{k}", records.where((F.col("id") > k * last // 7) & (F.col("id") <= (k + 1) * last // 7)), none)
    added = records.select((F.col("id") - 1).alias("id"), F.concat(F.lit("cve-2023-"), (F.col("id") + 10000).cast("string")).alias("cve"))
    levels.append("added", records.limit(0), added.where("id > 0"))
    return levels


def store_levels(spark, d):
    """All records of the store in levels, with the ids added to them."""
    rows = _levels(spark, d, Scratch(spark, "levels")).seen()
    return rows.select("id", "canonical_key", F.array_join("cve_ids", ",").alias("cves"), "url", T.clock(F.col("first_seen_at")).alias("first_seen_at"))


def store_index_dedup(spark, d):
    """Decisions by the index of the store in levels."""
    scratch = Scratch(spark, "index")
    return dedup.match_store(T.document_items(spark, d), index=_levels(spark, d, scratch), scratch=scratch)


QUERIES = {f.__name__: f for f in (jaccard_pairs, cosine_pairs, dedup_similar_texts, window_candidates, model_pairs,
                                  store_levels, store_index_dedup)}
