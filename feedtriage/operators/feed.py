"""Atom feed of the newest stored records."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from feedtriage.functions import dates as D, text as X
from feedtriage.operators.report import by_category

# Category labels and the feed namespace.
CATEGORY_LABELS = {"vulnerability": "vulnerability", "red_team": "red-team"}
ATOM_NAMESPACE = "http://www.w3.org/2005/Atom"


def category_label(category: Column) -> Column:
    return by_category(category, CATEGORY_LABELS, category)


def _paragraph(inner: Column) -> Column:
    return F.when(inner != "", F.concat(F.lit("<p>"), inner, F.lit("</p>")))


def entry_html(label: Column) -> Column:
    """Entry body: label and ids, description, link and source. Text is escaped."""
    c = F.col
    shown = lambda n: X.xml_text(F.nullif(c(n), F.lit("")))
    meta = F.concat_ws(" · ", X.xml_text(label), shown("vuln_class"),
                       F.nullif(X.xml_text(F.array_join("cve_ids", ", ")), F.lit("")))
    link = F.concat(F.lit('<a href="'), shown("url"), F.lit('">Read more</a>'))
    footer = F.concat_ws(" · ", link, F.concat(F.lit("Source: "), shown("source")))
    return F.concat_ws("", F.concat(F.lit("<p><em>"), meta, F.lit("</em></p>")),
                       _paragraph(X.or_empty(shown("description"))), _paragraph(footer))


def feed_entries(records: DataFrame, name: str = "feedtriage") -> DataFrame:
    """Entry columns of store records; the id depends on the record id only."""
    label = X.or_empty(category_label(F.col("category")))
    stamp = D.rfc3339(F.col("first_seen_at"))
    return records.select(
        F.col("id"), F.col("first_seen_at"),
        F.concat(F.lit(f"urn:{name}:item:"), F.col("id").cast("string")).alias("entry_id"),
        X.or_empty(X.first_non_empty(F.col("title"), F.col("product"),
                                     F.col("canonical_key"))).alias("title"),
        F.col("url"), stamp.alias("published"), stamp.alias("updated"),
        label.alias("category"), entry_html(label).alias("content"))


def feed_updated(records: DataFrame, run_ts: datetime | Column) -> DataFrame:
    """(updated): newest record, or the run time of an empty feed."""
    newest = F.coalesce(F.max("first_seen_at"), F.lit(run_ts).cast("timestamp"))
    return records.agg(D.rfc3339(newest).alias("updated"))


def _element(tag: str, text: Column) -> Column:
    return F.concat(F.lit(f"  <{tag}>"), X.xml_text(text), F.lit(f"</{tag}>\n"))


def feed_document(entries: DataFrame, run_ts: datetime | Column, title: str,
                  name: str = "feedtriage", site_url: str | None = None) -> DataFrame:
    """One row (document) holding the whole feed.

    ``entries`` is the newest-N selection, so the document is bounded by N.
    """
    link = F.when(F.col("url") != "", F.struct(F.col("url").alias("_href"),
                                               F.lit("alternate").alias("_rel")))
    entry = F.struct(
        "title", F.col("entry_id").alias("id"), "published", "updated", link.alias("link"),
        F.struct(F.col("category").alias("_term")).alias("category"),
        F.struct(F.lit("html").alias("_type"), F.col("content").alias("_VALUE")).alias("content"))
    xml = F.to_xml(entry, {"rowTag": "entry"})
    parts = entries.select("first_seen_at", "id", xml.alias("xml"))
    newest_first = F.array_sort(F.collect_list(F.struct(
        (-F.unix_micros("first_seen_at")).alias("age"), (-F.col("id")).alias("rid"), "xml")))
    updated = D.rfc3339(F.coalesce(F.max("first_seen_at"), F.lit(run_ts).cast("timestamp")))
    own = X.xml_text(F.lit(site_url)) if site_url else F.lit(None).cast("string")
    head = F.concat(
        F.lit(f'<?xml version="1.0" encoding="utf-8"?>\n<feed xmlns="{ATOM_NAMESPACE}">\n'),
        _element("title", F.lit(title)),
        _element("id", F.lit(site_url or f"urn:{name}:feed")),
        _element("generator", F.lit(name)), _element("updated", updated),
        X.or_empty(F.concat(F.lit('  <link href="'), own, F.lit('" rel="self"/>\n'))))
    body = F.transform(newest_first, lambda e: F.concat(e["xml"], F.lit("\n")))
    return parts.agg(F.concat(head, F.array_join(body, ""), F.lit("</feed>\n")).alias("document"))


def write_feed(document: DataFrame, path: str) -> None:
    """Write the one document row to a single UTF-8 file, making parent folders."""
    spark = document.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(target, True)
    try:
        stream.write(bytearray(document.first()["document"].encode("utf-8")))
    finally:
        stream.close()
