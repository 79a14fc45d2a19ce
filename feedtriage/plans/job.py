"""The whole triage job: landed payloads to new records, report, feed and funnel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedtriage.functions import text as X
from feedtriage.operators import classify, dedup, feed, filters, funnel, model, report, store
from feedtriage.operators.indexed_store import IndexedStore
from feedtriage.operators.numbering import dense_index
from feedtriage.plans.config import JobConfig
from feedtriage.schema import ORDER_COLUMNS
from feedtriage.scratch import Scratch
from feedtriage.sources.registry import sources_table, union_sources


@dataclass
class Models:
    """Factories of the caller's batch functions; None uses the keyword heuristics.

    ``similar`` may map (items, seen) to pairs(seq, cand_seq, record_id, score) for the
    semantic layer; ``similarity.similar_articles`` does so by the articles' words.
    """

    classify: Callable[[], model.ModelFn] | None = None
    summarise: Callable[[], model.ModelFn] | None = None
    similar: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    batch_size: int = 64


@dataclass
class RunResult:
    """Tables of one run. Nothing is persisted before ``commit``.

    The tables read ``scratch``; clear it when they are no longer needed.
    """

    config: JobConfig
    run_ts: datetime
    entries: DataFrame
    source_errors: DataFrame
    items: DataFrame
    decisions: DataFrame
    new_items: DataFrame
    records: DataFrame
    backfills: DataFrame
    report: DataFrame
    funnel: DataFrame
    scratch: Scratch
    index: IndexedStore | None = None


def classify_articles(articles: DataFrame, models: Models,
                      terms: dict[str, list[str]]) -> DataFrame:
    if models.classify is None:
        return classify.heuristic_classify(articles, **terms)
    asked = articles.withColumn("_prompt", model.article_prompt(F.col("title"), F.col("summary")))
    answered = model.with_model(asked, "_prompt", "_response", models.classify, models.batch_size)
    return classify.parse_classification(answered, "_response").drop("_prompt", "_response")


def run(spark: SparkSession, cfg: JobConfig, raw: DataFrame, run_ts: datetime,
        seen: DataFrame | None = None, models: Models | None = None,
        backfill_visible: bool = True, index: IndexedStore | None = None) -> RunResult:
    """Run all stages over the landed payloads ``raw``.

    ``seen`` defaults to the committed store of the configuration. With an ``index`` the
    store is that one: identities are looked up by token, and its records are only read for
    the semantic layer. Costly stages come last and see only what the cheap ones left.
    """
    cfg.validate()
    models = models or Models()
    scratch = Scratch(spark, "run")
    since = run_ts - timedelta(hours=cfg.since_hours)
    semantic = bool(models.similar and cfg.semantic_dedup)
    if index is not None:
        seen = index.seen() if semantic else None
    elif seen is None:
        seen = store.read_seen(spark, cfg.store_path)

    entries, errors = union_sources(raw, cfg.sources, since, run_ts)
    entries = scratch.save(entries, "entries")
    articles = entries.where("in_window")
    kept = filters.keyword_prefilter(articles, cfg.prefilter, sources_table(spark, cfg.sources))
    classified = scratch.save(classify_articles(kept, models, cfg.classifier_terms), "classified")

    interesting = filters.is_interesting(F.col("category"), cfg.categories)
    low = filters.low_relevance(F.col("relevance"), cfg.min_relevance)
    ties = ["url", "title", "summary"]
    order = [F.col(c) for c in ORDER_COLUMNS + ties]
    items = dense_index(classified.where(interesting & ~low).withColumn("urls", F.array("url")),
                        order, "seq", scratch)

    pairs = models.similar(items, seen) if semantic else None
    decisions = dedup.greedy_dedup(
        items, seen, pairs=pairs, run_ts=run_ts, window_days=cfg.dedup_window_days,
        backfill_visible=backfill_visible, scratch=scratch, index=index)

    fresh = items.join(decisions.where(~F.col("is_duplicate")).select("seq"), "seq", "left_semi")
    new_items = scratch.save(model.summarise(fresh, models.summarise, models.batch_size), "new")

    rows = (funnel.stage_rows(entries, fetched=F.lit(True), in_window=F.col("in_window"),
                              undated=F.col("in_window") & F.col("undated"))
            .unionByName(funnel.stage_rows(classified, prefiltered=F.lit(True),
                                           classified_interesting=interesting,
                                           low_relevance=interesting & low))
            .unionByName(funnel.stage_rows(
                items.select("seq", "source").join(decisions, "seq"),
                new_items=~F.col("is_duplicate"), duplicates=F.col("is_duplicate"))))
    return RunResult(
        config=cfg, run_ts=run_ts, entries=entries, source_errors=errors, items=items,
        decisions=decisions, new_items=new_items,
        records=store.new_records(new_items, index.state.next_id if index else store.next_record_id(seen), run_ts, scratch),
        backfills=store.backfill_rows(decisions, items),
        report=report.report_rows(new_items, run_ts.date(), cfg.report_name, scratch),
        funnel=funnel.funnel(rows), scratch=scratch, index=index)


def outbox_rows(result: RunResult) -> DataFrame:
    cfg = result.config
    return report.outbox(result.report, cfg.priority, cfg.quiet_heartbeat)


def refresh_feed(spark: SparkSession, cfg: JobConfig, run_ts: datetime, index: IndexedStore | None = None) -> None:
    """Rewrite the feed file from the committed store."""
    seen = store.read_seen(spark, cfg.store_path) if index is None else index.seen()
    newest = store.latest(seen, cfg.feed.max_items)
    entries = feed.feed_entries(newest, cfg.feed.name)
    document = feed.feed_document(entries, run_ts, cfg.feed.title, cfg.feed.name,
                                  cfg.feed.site_url)
    feed.write_feed(document, cfg.feed.path)


def commit(spark: SparkSession, result: RunResult, batch: str) -> bool:
    """Persist a run as one batch; a batch that is already committed is left alone.

    Sources and pages that failed go beside the store, in ``<store>-errors``.

    The outbox is written before the commit row, so a crash in between repeats
    the batch instead of losing its messages.
    """
    cfg, index = result.config, result.index
    done = store.is_committed(spark, cfg.store_path, batch) if index is None else index.state.last_batch == batch
    if done:
        if cfg.feed.enabled:  # the first try may have ended before it
            refresh_feed(spark, cfg, result.run_ts, index)
        return False
    result.source_errors.write.mode("overwrite").parquet(f"{cfg.store_path}-errors/batch={batch}")
    if cfg.outbox_path:
        report.write_outbox(outbox_rows(result), f"{cfg.outbox_path}/batch={batch}")
    if index is None:
        store.commit_batch(spark, cfg.store_path, batch, result.records, result.backfills, result.run_ts)
    else:
        index.append(batch, result.records, result.backfills)
    if cfg.feed.enabled:
        refresh_feed(spark, cfg, result.run_ts, index)
    return True
