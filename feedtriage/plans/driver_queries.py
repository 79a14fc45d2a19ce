"""One query per operator over the given tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import SparkSession, functions as F

from feedtriage.functions import dates as D, text as X
from feedtriage.operators import classify, dedup, feed, filters, funnel, matching, model, report, store
from feedtriage.operators.numbering import dense_index
from feedtriage.plans import driver_tables as T
from feedtriage.plans.config import JobConfig, SourceConfig
from feedtriage.plans.match_queries import QUERIES as MATCH_QUERIES
from feedtriage.plans.job import RunResult, run
from feedtriage.scratch import Scratch
from feedtriage.sources import advisories, kev, registry, rss

UTC = timezone.utc
SINCE = datetime(2024, 1, 1, 3, 0, tzinfo=UTC)


def _text(column: str):
    return F.array_join(column, ",")


# --- text and dates -------------------------------------------------------------

def articles_clean_html(spark, d):
    pages = T.page_articles(spark, d)
    return pages.select("seq", "title", X.article_text(F.col("title"), F.col("summary")).alias("text"))


def scalar_text(spark, d):
    docs = T.document_articles(spark, d)
    cve = F.concat(F.lit("CVE-2024-"), (F.col("n_chars") + 10000).cast("string"))
    noisy = F.concat(F.lit("see "), F.lower(cve), F.lit(" and "), "source")
    return docs.select(
        "seq", X.slug(F.col("title")).alias("slug"), X.slug80(F.col("summary")).alias("slug80"),
        X.normalize_cve(noisy).alias("cve"), X.normalize_cve(F.col("title")).alias("no_cve"),
        X.append_cve(F.concat("source", F.lit(" "), cve), cve).alias("named"),
        X.append_cve(F.col("source"), cve).alias("appended"),
        F.btrim(F.concat(F.lit(" : "), "source", F.lit(": ")), F.lit(": ")).alias("bare"),
        X.opt_string(F.concat(F.lit(" \t"), F.when(F.col("lang") == "en", F.col("source"))
                              .otherwise(F.lit("")), F.lit("\n "))).alias("optional"),
        F.array_join(X.normalize_cve_list(F.array(noisy, F.col("source"), cve)), ",").alias("cves"))


def cve_extract(spark, d):
    docs = T.document_articles(spark, d)
    text = F.concat("summary", F.lit(" cve-2024-"), (F.col("n_chars") + 10000).cast("string"),
                    F.lit(" CVE-2023-"), (F.length("title") + 10000).cast("string"),
                    F.lit(" Cve-2024-"), (F.col("n_chars") + 10000).cast("string"),
                    F.lit(" CVE-2024-"), F.length("source").cast("string"))
    return docs.select("seq", F.array_join(X.cves_in_text(text), ",").alias("cves"))


def date_parsing(spark, d):
    ev = T.table(spark, d, "events")
    mail = F.concat(F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.when(
        F.col("event_type") == "click", " +0200").when(F.col("event_type") == "view", " EST")
        .otherwise(" GMT"))
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(
        F.col("event_type") == "click", "-01:00").otherwise("Z"))
    return ev.select(
        "event_id", T.clock(D.feed_timestamp(mail)).alias("mail"),
        T.clock(D.feed_timestamp(iso)).alias("iso"),
        T.clock(D.day_timestamp(F.date_format("ts", "yyyy-MM-dd"))).alias("day"),
        D.iso_timestamp(F.col("props")).isNull().alias("bad"), D.rfc3339(F.col("ts")).alias("rfc3339"),
        D.rfc3339(F.date_trunc("second", F.col("ts"))).alias("whole"))


def next_page_links(spark, d):
    pages = T.table(spark, d, "pages")
    head = F.concat(F.lit("<"), "url", F.when(F.col("url").startswith("https"), '>; rel="next"')
                    .otherwise('>; rel="prev"'))
    return pages.select("page_id", X.next_page_link(head).alias("next"))


def header_safe_titles(spark, d):
    pages = T.page_articles(spark, d)
    title = F.concat(F.lit("“"), "title", F.lit("” — ‘ok’… "))
    return pages.select("seq", X.header_safe(title).alias("title"))


# --- sources --------------------------------------------------------------------

def rss_source(spark, d):
    rows = rss.rss_articles(T.feed_payloads(spark, d), SINCE, T.RUN_TS)
    return rows.select(F.col("page_ord").alias("seq"), "source", "title", "url", "summary",
                       T.clock(F.col("published")).alias("published"))


def rss_partly_broken(spark, d):
    """Feeds that are not well formed: entities that XML does not know, lone ampersands and
    brackets, prefixes nobody declared, CDATA that looks like markup, and every third one cut
    off in an entry."""
    docs = T.table(spark, d, "documents")
    link = lambda part: F.concat(F.lit("https://feeds.example/"), F.col("doc_id").cast("string"), F.lit(part))
    item = lambda part, text, rest="": F.concat(
        F.lit(f"<item><title>{text}</title><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><link>"), link(part),
        F.lit(f"</link>{rest}</item>"))
    body = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>'),
        item("/a", "<![CDATA[AT&T & co]]>", "<description><![CDATA[an <item>n</item> &amp; more]]></description>"),
        item("/b", "fish&nbsp;&copy; & chips &lt; 3 < 4 &#8364;&#1;", '<!-- <item> --><media:thumbnail url="x"/><dc:creator>me</dc:creator>'),
        F.when(F.col("doc_id") % 3 == 0, F.lit("<item><title>cut")).otherwise(
            F.concat(item("/c", "three"), F.lit("</channel></rss>"))))
    raw = docs.select("source", F.col("doc_id").cast("int").alias("page_ord"), F.lit(T.RUN_TS).alias("fetched_at"),
                      body.alias("body"))
    none = F.lit(None).cast("string")
    kept = rss.rss_articles(raw, SINCE, T.RUN_TS).select("page_ord", "entry_ord", "url", "title", "summary", none.alias("error"))
    lost = rss.rss_errors(raw).select("page_ord", F.lit(None).cast("int").alias("entry_ord"), none.alias("url"),
                                      none.alias("title"), none.alias("summary"), "error")
    return kept.unionByName(lost)


def _order_pages(spark, d, broken):
    """Landed advisory pages, one per order, of two fetches for each priority."""
    rows = T.table(spark, d, "orders")
    entry = F.struct(F.concat(F.lit("https://orders.example/"), F.col("o_orderkey").cast("string")).alias("html_url"),
                     F.lit("critical").alias("severity"), F.lit("2024-01-20T00:00:00Z").alias("published_at"))
    fetch = F.when(F.col("o_orderkey") % 2 == 0, F.lit(T.RUN_TS)).otherwise(F.lit(SINCE))
    return rows.select(F.col("o_orderpriority").alias("source"), F.col("o_orderkey").cast("int").alias("page_ord"),
                       fetch.alias("fetched_at"), F.when(broken, "no list").otherwise(F.to_json(F.array(entry))).alias("body"))


def advisory_two_fetches(spark, d):
    """A broken page hides the later pages of its own fetch only."""
    key = F.col("o_orderkey")
    raw = _order_pages(spark, d, (key % 2 == 1) & (key > 3000) & (key % 101 == 0))
    return advisories.advisory_articles(raw, SINCE).select("source", "page_ord", "url")


def advisory_many_pages(spark, d):
    """All landed pages count, unless a cap is named, which reports what it leaves out."""
    raw = _order_pages(spark, d, F.lit(False))
    kept = advisories.advisory_articles(raw, SINCE).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    left_out = advisories.advisory_errors(raw, 500).groupBy("source").agg(F.count(F.lit(1)).alias("beyond_cap"))
    return kept.join(left_out, "source")


def catalogue_source(spark, d):
    rows = kev.kev_articles(T.catalogue_payloads(spark, d), datetime(2024, 1, 16, 9, tzinfo=UTC))
    return rows.select("source", "title", "url", "summary",
                       T.clock(F.col("published")).alias("published"))


def advisory_source(spark, d):
    rows = advisories.advisory_articles(T.advisory_payloads(spark, d),
                                        datetime(1997, 1, 1, tzinfo=UTC), ["1-urgent", "2-High"])
    return rows.select("source", "title", "url", "summary",
                       T.clock(F.col("published")).alias("published"))


def source_errors(spark, d):
    """Payloads that are not feeds: the raw pages and documents are not XML."""
    raw = (T.table(spark, d, "documents").select(
        "source", F.col("doc_id").cast("int").alias("page_ord"), F.lit(T.RUN_TS).alias("fetched_at"),
        F.col("text").alias("body")))
    return rss.rss_errors(raw).groupBy("source", "error").agg(F.count(F.lit(1)).alias("payloads"))


def _sources() -> list[SourceConfig]:
    """Twenty feeds; the last ten bypass the keyword gate, one is off, one is unknown."""
    names = [f"src{i}" for i in range(20)]
    return [SourceConfig(n, bypass_prefilter=i >= 10, enabled=i != 5,
                         type="gopher" if i == 6 else "rss") for i, n in enumerate(names)]


def source_dimension(spark, d):
    dim = filters.enabled_sources(registry.sources_table(spark, _sources()))
    docs = T.document_articles(spark, d)
    return (docs.join(dim, docs["source"] == dim["name"]).groupBy("name", "type", "source_ord",
                                                                 "bypass_prefilter")
            .agg(F.count(F.lit(1)).alias("documents")))


def union_order(spark, d):
    """Bag union of two sources with the dense processing order."""
    pages = T.page_articles(spark, d).select(F.lit(0).alias("source_ord"), "seq", "url")
    docs = T.document_articles(spark, d).select(F.lit(1).alias("source_ord"), "seq", "url")
    both = pages.unionByName(docs).withColumnRenamed("seq", "entry_ord")
    return dense_index(both, [F.col("source_ord"), F.col("entry_ord")], "seq",
                       Scratch(spark, "union"))


def store_import(spark, d):
    ev = T.event_records(spark, d)
    stored = F.when(F.col("source") == "view", F.lit("oops")).otherwise(
        F.concat(F.lit('["cve-2024-'), (F.col("id") + 10000).cast("string"),
                 F.lit('", "CVE-1999-0001", "cve-1999-0001"]')))
    raw = ev.withColumns({"cve_ids": stored, "first_seen_at": D.rfc3339(F.col("first_seen_at"))})
    return store.import_seen(raw).select(
        "id", _text("cve_ids").alias("cves"), T.clock(F.col("first_seen_at")).alias("first_seen_at"))


# --- filters --------------------------------------------------------------------

def lookback_instant(spark, d):
    rows = filters.lookback(T.document_articles(spark, d), SINCE, run_ts=T.RUN_TS)
    return rows.select("seq", "source", T.clock(F.col("published")).alias("published"))


def lookback_day(spark, d):
    rows = filters.lookback(T.table(spark, d, "lineitem"), datetime(1999, 6, 17, 15, tzinfo=UTC),
                            "l_shipdate", "day", keep_null=False)
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), T.clock(F.min("l_shipdate")).alias("first"))


def lookback_early_stop(spark, d):
    """The lists are in an order that times do not follow, and some times are missing."""
    ev = T.table(spark, d, "events").withColumn("ts", F.when(F.col("event_id") % 50 != 0, F.col("ts")))
    rows = filters.lookback_early_stop(ev, datetime(2024, 1, 2, tzinfo=UTC), ["user_id", "event_id"],
                                       "event_type", "ts")
    return rows.select("event_type", "event_id")


def enabled_category(spark, d):
    """Of two reportable categories only one is enabled."""
    return filters.category_gate(T.document_items(spark, d), ["red_team"]).select("seq", "category")


def keyword_prefilter(spark, d):
    return filters.keyword_prefilter(T.document_articles(spark, d), T.PREFILTER).select("seq")


def prefilter_bypass(spark, d):
    dim = registry.sources_table(spark, _sources())
    rows = filters.keyword_prefilter(T.document_articles(spark, d), T.PREFILTER, dim)
    return rows.select("seq", "source")


def relevance_fail_open(spark, d):
    rows = filters.category_gate(T.document_items(spark, d), ["vulnerability", "red_team"])
    return filters.relevance_gate(rows, 3).select("seq", "category", "relevance")


def severity_allow_list(spark, d):
    rows = T.table(spark, d, "orders")
    return (rows.where(filters.severity_allowed(F.col("o_orderpriority"), ["1-urgent", "5-Low"]))
            .select("o_orderkey", "o_orderpriority"))


def page_cap(spark, d):
    rows = T.table(spark, d, "conversations")
    return filters.page_cap(rows, 3, "turn").select("conv_id", "turn", "role")


# --- classification and model ---------------------------------------------------

def heuristic_classify(spark, d):
    docs = T.document_articles(spark, d)
    docs = docs.withColumn("summary", F.when(F.col("lang") == "es", F.concat(
        "summary", F.lit(" cve-2024-"), (F.col("n_chars") + 10000).cast("string")))
        .otherwise(F.col("summary")))
    rows = classify.heuristic_classify(docs, **T.CORPUS_TERMS)
    return rows.select("seq", "category", "canonical_key", "one_line", "is_zero_or_nday",
                       _text("cve_ids").alias("cves"), "relevance")


def model_response_parse(spark, d):
    ev = T.table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    s = lambda c: F.col(c).cast("string")
    plain = F.concat(F.lit('{"category": " Vulnerability ", "relevance": '), k,
                     F.lit(', "vendor": " Acme '), k, F.lit('", "cve_ids": ["cve-2024-'),
                     (F.col("event_id") + 10000).cast("string"),
                     F.lit('", "none"], "one_line": "line '), s("event_id"), F.lit('"}'))
    fenced = F.concat(F.lit("Sure.\n```json\n{\"category\": \"red_team\", \"relevance\": \""), k,
                      F.lit('", "canonical_key": " U:'), s("user_id"), F.lit(' "}\n```\nDone'))
    prose = F.concat(F.lit('I think {"category": "gossip", "relevance": 4.7, "product": "P '), k,
                     F.lit('", "cve_ids": "x CVE-2023-0001", "is_zero_or_nday": true} fits'))
    broken = F.concat(F.lit('{"category": "vulnerability", "vendor": "'), "event_type")
    response = (F.when(F.col("event_type") == "click", plain).when(F.col("event_type") == "view", fenced)
                .when(F.col("event_type") == "signup", prose)
                .when(F.col("event_type") == "error", broken))
    rows = ev.select("event_id", F.concat(F.lit("Event "), s("event_id")).alias("title"),
                     response.alias("response"))
    rows = classify.parse_classification(rows)
    return rows.select("event_id", "category", "canonical_key", "one_line", "is_zero_or_nday",
                       "vendor", "product", "vuln_class", _text("cve_ids").alias("cves"), "relevance")


def match_response_parse(spark, d):
    ev = T.table(spark, d, "events")
    s = F.col("user_id").cast("string")
    response = (F.when(F.col("event_type") == "click", F.concat(F.lit('{"match_id": '), s, F.lit("}")))
                .when(F.col("event_type") == "view", F.concat(F.lit('It is {"match_id": " '), s, F.lit('"}')))
                .when(F.col("event_type") == "signup", F.lit('{"match_id": true}'))
                .when(F.col("event_type") == "error", F.lit('{"match_id": null}')))
    rows = ev.select("event_id", response.alias("response"))
    return classify.parse_match(rows).select("event_id", "match_id")


def _echo():
    return lambda prompts: [f"re: {p}" for p in prompts]


def model_answers(spark, d):
    """The model surface with a stand-in function."""
    rows = T.table(spark, d, "conversations").withColumn(
        "prompt", model.article_prompt(F.col("role"), F.col("text")))
    return model.with_model(rows, "prompt", "answer", _echo, 64).select("conv_id", "turn", "answer")


def _cve_links(spark, d):
    """(seq, id) of documents and pages naming the same CVE id."""
    a = T.document_items(spark, d).select(
        "seq", F.explode(matching.distinct_cves(F.col("cve_ids"))).alias("cve"))
    b = T.page_records(spark, d).select("id", F.explode("cve_ids").alias("cve"))
    return a.join(b, "cve").select("seq", "id").distinct()


def match_prompts(spark, d):
    blocks = model.candidate_blocks(_cve_links(spark, d), T.page_records(spark, d))
    rows = model.match_prompts(T.document_items(spark, d), blocks)
    return rows.select("seq", "page", "prompt")


def summaries(spark, d):
    rows = T.document_items(spark, d).withColumn(
        "summary", F.when(F.col("category") == "other", F.lit("")).otherwise(F.col("summary")))
    return model.summarise(rows).select("seq", "summary")


# --- lookups and dedup ----------------------------------------------------------

def url_anti_join(spark, d):
    return matching.url_seen(T.document_items(spark, d), T.page_records(spark, d)).select("seq", "url")


def url_semi_join(spark, d):
    rows = matching.url_seen(T.document_items(spark, d), T.page_records(spark, d), "seen")
    return rows.select("seq", "url")


def cve_first_match(spark, d):
    return matching.cve_first_match(T.document_items(spark, d), T.page_records(spark, d))


def key_first_match(spark, d):
    return matching.key_first_match(T.document_items(spark, d), T.page_records(spark, d))


def recent_key_match(spark, d):
    return matching.recent_key_match(T.document_items(spark, d), T.page_records(spark, d),
                                     T.RUN_TS, 25)


def recent_candidates(spark, d):
    rows = matching.recent_records(T.event_records(spark, d), T.RUN_TS, 10)
    return rows.select("id", T.clock(F.col("first_seen_at")).alias("first_seen_at"))


def candidate_union(spark, d):
    rows = matching.candidate_records(T.page_records(spark, d), T.document_items(spark, d),
                                      T.RUN_TS, 25)
    return rows.select("id", "canonical_key", "title", _text("cve_ids").alias("cves"), "url",
                       T.clock(F.col("first_seen_at")).alias("first_seen_at"))


def record_by_id(spark, d):
    newest = T.page_records(spark, d)
    return matching.record_by_id(newest, 42).select("id", "title", "url")


def store_dedup(spark, d):
    return dedup.match_store(T.document_items(spark, d), T.page_records(spark, d))


def greedy_dedup(spark, d):
    return dedup.greedy_dedup(T.document_items(spark, d))


def dedup_reasons(spark, d):
    return dedup.greedy_dedup(T.document_items(spark, d), T.page_records(spark, d),
                              backfill_visible=False)


def dedup_backfill_run(spark, d):
    return dedup.greedy_dedup(T.document_items(spark, d), T.page_records(spark, d))


def dedup_semantic_key(spark, d):
    size = lambda url: F.concat(F.lit("size:"), F.element_at(F.split(url, "/"), -1))
    items = T.document_items(spark, d).withColumn("sem", size(F.col("url")))
    seen = T.page_records(spark, d).withColumn("sem", size(F.col("url")))
    return dedup.greedy_dedup(items, seen, semantic_key="sem", run_ts=T.RUN_TS, window_days=25)


def dedup_semantic_pairs(spark, d):
    return dedup.greedy_dedup(T.document_items(spark, d), T.page_records(spark, d),
                              pairs=T.document_pairs(spark, d), run_ts=T.RUN_TS, window_days=25)


def dedup_line_items(spark, d):
    """The largest table against the orders: counts per reason."""
    rows = dedup.greedy_dedup(T.lineitem_items(spark, d), T.order_records(spark, d))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("items"),
                                      F.count("matched_record_id").alias("matched"))


# --- store ----------------------------------------------------------------------

def cve_backfill(spark, d):
    items = T.document_items(spark, d)
    hits = matching.cve_first_match(items, T.page_records(spark, d)).select(
        "seq", F.col("record_id").alias("matched_record_id"))
    added = store.backfill_rows(hits, items)
    rows = store.backfill_cves(T.page_records(spark, d), added)
    return rows.select("id", _text("cve_ids").alias("cves"))


def store_append_ids(spark, d):
    rows = store.append_seen(T.page_records(spark, d), T.document_items(spark, d), T.RUN_TS)
    return rows.select("id", "category", "canonical_key", _text("cve_ids").alias("cves"),
                       "description", "title", "url",
                       T.clock(F.col("first_seen_at")).alias("first_seen_at"))


def latest_n(spark, d):
    return store.latest(T.event_records(spark, d), 100).select(
        "id", "title", T.clock(F.col("first_seen_at")).alias("first_seen_at"))


# --- outputs --------------------------------------------------------------------

def report_rows(spark, d):
    return report.report_rows(T.document_items(spark, d), T.RUN_TS.date())


def report_empty(spark, d):
    none = T.document_items(spark, d).where(F.col("relevance") > 5)
    return report.report_rows(none, T.RUN_TS.date())


def report_size(spark, d):
    return report.report_count(report.report_rows(T.document_items(spark, d), T.RUN_TS.date()))


def outbox(spark, d):
    rows = report.report_rows(T.document_items(spark, d), T.RUN_TS.date())
    return report.outbox(rows, "high").select("position", "title", "tags", "priority", "delivered")


def primary_urls(spark, d):
    rows = T.document_items(spark, d)
    urls = F.when(F.col("category") == "other", F.array().cast("array<string>")).otherwise(F.col("urls"))
    return rows.select("seq", report.primary_url(urls, F.col("url")).alias("primary_url"))


def feed_entries(spark, d):
    rows = feed.feed_entries(store.latest(T.event_records(spark, d), 100))
    return rows.select("entry_id", "title", "url", "published", "updated", "category", "content")


def feed_updated(spark, d):
    return feed.feed_updated(T.event_records(spark, d), T.RUN_TS)


def feed_document(spark, d):
    entries = feed.feed_entries(store.latest(T.event_records(spark, d), 100))
    return feed.feed_document(entries, T.RUN_TS, "Feed triage")


def fetch_counts(spark, d):
    return funnel.fetch_counts(rss.rss_entries(T.feed_payloads(spark, d), SINCE, T.RUN_TS))


def windowed_source_counts(spark, d):
    rows = T.table(spark, d, "events").withColumnsRenamed({"ts": "published", "event_type": "source"})
    return funnel.windowed_counts(rows, "4 hours").select(
        T.clock(F.col("window_start")).alias("window_start"), "source", "items")


def windowed_source_counts_stream(spark, d):
    """The same counts by a stream over the events file."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
              .select(F.col("ts").cast("timestamp").alias("published"),
                      F.col("event_type").alias("source")))
    scratch = Scratch(spark, "counts")
    saved = []
    query = (funnel.windowed_counts(stream, "4 hours").writeStream.outputMode("complete")
             .foreachBatch(lambda df, i: saved.append(scratch.save(df, f"batch-{i}")))
             .option("checkpointLocation", f"{scratch.root}/stream").trigger(availableNow=True).start())
    query.awaitTermination()
    return saved[-1].select(T.clock(F.col("window_start")).alias("window_start"), "source", "items")


# --- whole runs -----------------------------------------------------------------

def corpus_config() -> JobConfig:
    hours = int((T.RUN_TS - SINCE).total_seconds() // 3600)
    return JobConfig(sources=_sources(), since_hours=hours, prefilter=T.PREFILTER,
                     classifier_terms=T.CORPUS_TERMS, min_relevance=3)


def triage(spark: SparkSession, d: str) -> RunResult:
    """The whole job over landed feed payloads, with the pages as the store."""
    return run(spark, corpus_config(), T.feed_payloads(spark, d), T.RUN_TS,
               seen=T.page_records(spark, d))


def triage_run(spark, d):
    return triage(spark, d).new_items.select("seq", "source", "title", "url", "category",
                                             "canonical_key", "relevance")


def triage_report(spark, d):
    return triage(spark, d).report


def funnel_by_source(spark, d):
    return triage(spark, d).funnel


QUERIES = {f.__name__: f for f in (
    articles_clean_html, scalar_text, cve_extract, date_parsing, next_page_links,
    header_safe_titles, rss_source, rss_partly_broken, catalogue_source, advisory_source,
    advisory_two_fetches, advisory_many_pages, source_errors, enabled_category,
    source_dimension, union_order, store_import, lookback_instant, lookback_day,
    lookback_early_stop, keyword_prefilter, prefilter_bypass, relevance_fail_open,
    severity_allow_list, page_cap, heuristic_classify, model_response_parse,
    match_response_parse, model_answers, match_prompts, summaries, url_anti_join,
    url_semi_join, cve_first_match, key_first_match, recent_key_match, recent_candidates,
    candidate_union, record_by_id, store_dedup, greedy_dedup, dedup_reasons,
    dedup_backfill_run, dedup_semantic_key, dedup_semantic_pairs, dedup_line_items,
    cve_backfill, store_append_ids, latest_n, report_rows, report_empty, report_size,
    outbox, primary_urls, feed_entries, feed_updated, feed_document, fetch_counts,
    windowed_source_counts, windowed_source_counts_stream, triage_run, triage_report,
    funnel_by_source)} | MATCH_QUERIES
