"""The given tables seen as articles, items, store records and landed payloads."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedtriage.functions import text as X
from feedtriage.operators.numbering import dense_index
from feedtriage.schema import CLASSIFICATION, SEEN
from feedtriage.scratch import Scratch

EPOCH = 1_704_067_200  # 2024-01-01 00:00 UTC
RUN_TS = datetime(2024, 2, 1, tzinfo=timezone.utc)

# Keyword lists made of words that the given texts hold.
CORPUS_TERMS = dict(red_team_terms=["license", "mail"], vuln_terms=["ung", "ción", "ement"],
                    high_terms=["the ", "license"], low_terms=["sch", "que"],
                    zero_day_terms=["tion", "heit"])
PREFILTER = {"legal": ["License"], "contact": ["@", "MAIL"], "word": ["heit"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; times without a zone are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def clock(c: Column) -> Column:
    """Timestamp as text, so that both engines compare the same thing."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def first_line(text: Column) -> Column:
    return F.split_part(text, F.lit("\n"), F.lit(1))


def document_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One article per document: first line as title; Spanish ones have no date."""
    at = F.timestamp_seconds(F.lit(EPOCH) + F.col("doc_id") * 60)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), "source", first_line(F.col("text")).alias("title"),
        F.concat(F.lit("https://feed.example/"), "lang", F.lit("/"),
                 F.col("n_chars").cast("string")).alias("url"),
        F.col("text").alias("summary"),
        F.when(F.col("lang") != "es", at).alias("published"), "lang", "n_chars")


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("seq"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source"),
        X.clean_html(F.regexp_extract("html", "<title>(.*?)</title>", 1)).alias("title"), "url",
        X.clean_html(F.col("html")).alias("summary"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("page_id") * 60).alias("published"))


def _identity_cves(lang: Column, n: Column, length: Column) -> Column:
    by_size = F.concat(F.lit("CVE-2024-"), (n + 10000).cast("string"))
    by_title = F.concat(F.lit("cve-2023-"), (length + 10000).cast("string"))
    return (F.when(lang.isin("en", "de"), F.array(by_size, by_title))
            .when(lang == "fr", F.array(by_title)).otherwise(F.array().cast("array<string>")))


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified items: identity from language, size and title length; relevance from labels."""
    docs = document_articles(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq"), "quality", "toxic")
    length = F.length("title")
    category = (F.when(F.col("lang").isin("en", "fr"), "vulnerability")
                .when(F.col("lang") == "de", "red_team").otherwise("other"))
    made = docs.join(labels, "seq", "left").withColumns({
        "category": category,
        "canonical_key": F.concat("lang", F.lit(":"), length.cast("string")),
        "one_line": F.substring("title", 1, 140),
        "is_zero_or_nday": F.coalesce(F.col("toxic") == 1, F.lit(False)),
        "vendor": F.when(F.col("lang") == "de", F.col("source")),
        "product": F.when(F.col("lang") == "fr", F.concat(F.lit("p-"), "source")),
        "vuln_class": F.when(F.col("lang") == "en", F.lit("rce")),
        "affected_component": F.lit(None).cast("string"),
        "cve_ids": _identity_cves(F.col("lang"), F.col("n_chars"), length),
        "severity": F.when(F.col("quality") == 1, F.lit("high")),
        "relevance": (F.col("quality") * 4 + 1).cast("int"),
        "urls": F.when(F.col("lang") == "de", F.array("url", F.concat("url", F.lit("?alt"))))
                 .otherwise(F.array("url"))})
    return made.select("seq", "source", "title", "url", "summary", "published",
                       *CLASSIFICATION.fieldNames(), "urls")


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store records from the pages; their paths hold the language and a number."""
    path = "/([a-z]{2})/([0-9]+)"
    title = F.regexp_extract("html", "<title>(.*?)</title>", 1)
    lang, number = F.regexp_extract("url", path, 1), F.regexp_extract("url", path, 2)
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "pages").select(
        (F.col("page_id") + 1).alias("id"),
        F.when(lang == "de", "red_team").otherwise("vulnerability").alias("category"),
        none.alias("vendor"), none.alias("product"),
        F.when(lang == "en", F.lit("rce")).alias("vuln_class"),
        F.concat(lang, F.lit(":"), F.length(title).cast("string")).alias("canonical_key"),
        F.array(F.concat(F.lit("CVE-2024-"), (number.cast("long") + 10000).cast("string")))
         .alias("cve_ids"),
        title.alias("description"), title.alias("title"),
        F.regexp_extract("url", "^https?://([^/]+)", 1).alias("source"),
        F.concat(F.lit("https://feed.example/"), lang, F.lit("/"), number).alias("url"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("page_id") * 3600).alias("first_seen_at"))
    return rows.select(*SEEN.fieldNames())


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store records from the events: many rows with real times."""
    text = lambda v: F.lit(v).cast("string")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", "vulnerability")
         .when(F.col("event_type") == "click", "red_team").otherwise(F.col("event_type"))
         .alias("category"),
        text(None).alias("vendor"), text(None).alias("product"),
        F.when(F.col("value") > 50, "big").alias("vuln_class"),
        F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("canonical_key"),
        F.when(F.col("event_type") == "error", F.array(F.concat(
            F.lit("CVE-2024-"), (F.col("event_id") + 10000).cast("string"))))
         .otherwise(F.array().cast("array<string>")).alias("cve_ids"),
        F.col("props").alias("description"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("title"),
        F.col("event_type").alias("source"),
        F.concat(F.lit("https://events.example/?id="), F.col("event_id").cast("string"),
                 F.lit("&u="), F.col("user_id").cast("string")).alias("url"),
        F.col("ts").alias("first_seen_at")).select(*SEEN.fieldNames())


def lineitem_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items from the line items: hub keys (orders), shared URLs and CVE ids."""
    rows = table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber"]
    order += [c for c in rows.columns if c not in order]
    rows = dense_index(rows, [F.col(c) for c in order], "seq", Scratch(spark, "lineitems"))
    rows = rows.select("seq", F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"),
                       F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f"))
    s = lambda n: F.col(n).cast("string")
    return rows.select(
        "seq", F.concat(F.lit("https://parts.example/"), s("p"), F.lit("/"), s("s")).alias("url"),
        F.when(F.col("f") == "R", F.array(F.concat(F.lit("CVE-2024-"), s("p"))))
         .otherwise(F.array().cast("array<string>")).alias("cve_ids"),
        F.concat(F.lit("order:"), s("o")).alias("canonical_key"))


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store records from the urgent orders' customers, for the line items."""
    s = lambda n: F.col(n).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("https://orders.example/"), s("o_orderkey")).alias("url"),
        F.when(F.col("o_orderstatus") == "F", F.array(F.concat(F.lit("CVE-2024-"), s("o_custkey"))))
         .otherwise(F.array().cast("array<string>")).alias("cve_ids"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("order:"), s("o_orderkey")))
         .otherwise(F.lit("")).alias("canonical_key"),
        F.col("o_orderdate").alias("first_seen_at"))


def document_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity pairs: each document with the document or page its size points at."""
    docs = table(spark, sf_dir, "documents")
    score = F.lit(1.0) / (1 + F.length(first_line(F.col("text"))))
    return docs.select(
        F.col("doc_id").alias("seq"),
        F.when(F.col("lang") != "fr", F.col("n_chars")).alias("cand_seq"),
        F.when(F.col("lang") == "fr", F.col("n_chars")).alias("record_id"), score.alias("score"))


def feed_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed RSS payloads, one per document."""
    docs = document_articles(spark, sf_dir)
    body = F.concat(
        F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>c</title><item><title>'),
        X.xml_text(F.col("title")), F.lit("</title><link>"), "url",
        F.lit("</link><description>"), X.xml_text(F.col("summary")), F.lit("</description>"),
        X.or_empty(F.concat(F.lit("<pubDate>"), F.date_format("published", "dd MMM yyyy HH:mm:ss"),
                            F.lit(" +0000</pubDate>"))),
        F.lit("</item></channel></rss>"))
    return docs.select("source", F.col("seq").cast("int").alias("page_ord"),
                       F.lit(RUN_TS).alias("fetched_at"), body.alias("body"))


def catalogue_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed catalogue payloads, one per part."""
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")
    entry = F.struct(
        F.concat(F.lit("CVE-2024-"), (F.col("p_partkey") + 10000).cast("string")).alias("cveID"),
        F.col("p_brand").alias("vendorProject"),
        F.when(F.col("p_type") != "SMALL", F.col("p_name")).alias("product"),
        F.concat(F.lit(": "), F.col("p_type"), F.lit(" : ")).alias("vulnerabilityName"),
        day.alias("dateAdded"), F.col("p_name").alias("shortDescription"),
        F.when(F.col("p_size") > 25, F.concat(F.lit(" replace "), "p_name"))
         .alias("requiredAction"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("Known")).otherwise(F.lit("Unknown"))
         .alias("knownRansomwareCampaignUse"))
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("source"), F.col("p_partkey").cast("int").alias("page_ord"),
        F.lit(RUN_TS).alias("fetched_at"),
        F.to_json(F.struct(F.lit(1).alias("count"), F.array(entry).alias("vulnerabilities")))
         .alias("body"))


def advisory_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed advisory pages, one per order."""
    s = lambda n: F.col(n).cast("string")
    package = lambda eco, name: F.struct(F.struct(eco.alias("ecosystem"), name.alias("name"))
                                         .alias("package"))
    advisory = F.struct(
        F.concat(F.lit("GHSA-"), s("o_orderkey")).alias("ghsa_id"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("CVE-2024-"), s("o_orderkey")))
         .alias("cve_id"),
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit(" order "), s("o_orderkey")))
         .alias("summary"),
        F.concat(F.lit(" by customer "), s("o_custkey"), F.lit(" ")).alias("description"),
        F.col("o_orderpriority").alias("severity"),
        F.concat(F.lit("https://orders.example/"), s("o_orderkey")).alias("html_url"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"),
        F.array(package(F.lit("z"), s("o_custkey")),
                package(F.lit(None).cast("string"), F.col("o_orderstatus")),
                package(F.lit("z"), s("o_custkey"))).alias("vulnerabilities"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("source"), F.lit(0).alias("page_ord"),
        F.lit(RUN_TS).alias("fetched_at"), F.to_json(F.array(advisory)).alias("body"))
