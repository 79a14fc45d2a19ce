"""Queries over the given tables: a plug-in source, counts of a stream, long candidate lists."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from feedtriage.operators import classify, model
from feedtriage.plans import driver_tables as T
from feedtriage.plans.config import SourceConfig
from feedtriage.schema import RAW
from feedtriage.scratch import Scratch
from feedtriage.sources import json_feed, plugin, registry
from feedtriage.streaming import counts

SINCE = datetime(2024, 1, 1, 3, 0, tzinfo=timezone.utc)
PAGE_LINES = 20


def plugin_source(spark, d):
    """Documents landed as compressed files of JSON feeds, read by a kind written in Python."""
    scratch = Scratch(spark, "plugin")
    item = F.struct("title", "url", F.col("summary").alias("content_text"),
                    F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date_published"))
    feeds = T.document_articles(spark, d).select(F.to_json(F.struct(
        F.lit("https://jsonfeed.org/version/1.1").alias("version"), F.array(item).alias("items"))).alias("value"))
    feeds.write.option("compression", "gzip").text(f"{scratch.root}/landed")
    registry.register_plugin(json_feed.KIND, plugin.ByLine(json_feed.parse))  # a file holds many documents
    source = SourceConfig("documents", json_feed.KIND, options={"path": f"{scratch.root}/landed"})
    entries, _ = registry.union_sources(spark.createDataFrame([], RAW), [source], SINCE, T.RUN_TS)
    return entries.where("in_window").select("source", "title", "url", "summary", T.clock(F.col("published")).alias("published"), "undated")


def windowed_counts_upsert(spark, d):
    """Counts of the articles as they arrive in four files, the undated ones by their arrival."""
    scratch = Scratch(spark, "upsert")
    articles = T.document_articles(spark, d).select("seq", "source", "published", F.lit(T.RUN_TS).alias("fetched_at"))
    landed = scratch.save(articles.repartition(4, "seq"), "landed")
    stream = spark.readStream.schema(landed.schema).option("maxFilesPerTrigger", 1).parquet(landed._scratch_path)
    # The files are in no order of time, so a window may change as long as there are files.
    counts.count_stream(stream, f"{scratch.root}/table", delay="4000 days").awaitTermination()
    return counts.read_counts(spark, f"{scratch.root}/table").select(
        T.clock(F.col("window_start")).alias("window_start"), "source", "undated", "items")


def _language_links(spark, d):
    """The first document of each language with all records of that language."""
    lang = F.split_part("canonical_key", F.lit(":"), F.lit(1)).alias("lang")
    first = T.document_items(spark, d).select("seq", lang).groupBy("lang").agg(F.min("seq").alias("seq"))
    return first.join(T.page_records(spark, d).select("id", lang), "lang").select("seq", "id")


def candidate_pages(spark, d):
    """Long candidate lists on pages, newest first across all of them."""
    blocks = model.candidate_blocks(_language_links(spark, d), T.page_records(spark, d), PAGE_LINES, Scratch(spark, "pages"))
    return blocks.select("seq", "page", "block", F.array_join(F.col("candidate_ids").cast("array<string>"), ",").alias("ids"))


def _first_seventh():
    """Stand-in for a model: the first offered record whose number is divisible by seven."""
    def answer(prompt: str) -> str:
        lines = prompt.split("ALREADY-REPORTED ITEMS:\n")[1].split("\n")
        ids = [int(line[1:line.index("]")]) for line in lines if line.startswith("[") and "] key=" in line]
        found = next((i for i in ids if i % 7 == 0), None)
        return '{"match_id": %s}' % ("null" if found is None else found)
    return lambda prompts: [answer(p) for p in prompts]


def candidate_answer(spark, d):
    """The one record that the answers on an item's pages come to."""
    blocks = model.candidate_blocks(_language_links(spark, d), T.page_records(spark, d), PAGE_LINES, Scratch(spark, "pages"))
    prompts = model.match_prompts(T.document_items(spark, d), blocks)
    answers = classify.parse_match(model.with_model(prompts, "prompt", "response", _first_seventh), candidates="candidate_ids")
    return model.first_answer(answers).select("seq", F.col("match_id").alias("record_id"))


QUERIES = {f.__name__: f for f in (plugin_source, windowed_counts_upsert, candidate_pages, candidate_answer)}
