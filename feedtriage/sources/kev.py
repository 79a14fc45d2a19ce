"""The known-exploited-vulnerabilities catalogue (JSON)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from feedtriage.functions import dates as D, text as X
from feedtriage.schema import KEV_PAYLOAD

_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
_SCHEMA = KEV_PAYLOAD[:-1] + ", _broken:string>"
# Texts of the article made from a catalogue entry.
DETAIL_URL = "https://nvd.nist.gov/vuln/detail/"
LEAD = "CISA KEV — actively exploited. "


def kev_article(entry: Column) -> dict[str, Column]:
    """Title, url and summary of one catalogue entry; url is null without an id."""
    part = lambda n: X.strip(X.or_empty(entry[n]))
    cve = part("cveID")
    whole = F.concat(part("vendorProject"), F.lit(" "), part("product"), F.lit(": "),
                     part("vulnerabilityName"))
    title = X.strip(F.btrim(whole, F.lit(": ")))
    action = F.concat(F.lit("Required action: "), F.nullif(part("requiredAction"), F.lit("")))
    ransom = F.when(F.lower(X.or_empty(entry["knownRansomwareCampaignUse"])) == "known",
                    F.lit("Known ransomware campaign use."))
    details = F.concat_ws(" | ", F.nullif(part("shortDescription"), F.lit("")), action, ransom)
    return {
        "title": X.strip(X.append_cve(title, cve)),
        "url": F.concat(F.lit(DETAIL_URL), F.nullif(cve, F.lit(""))),
        "summary": F.concat(F.lit(LEAD), cve, F.lit(". "), details),
    }


def kev_entries(raw: DataFrame, since: datetime) -> DataFrame:
    """All catalogue entries; kept are those added on the day of ``since`` or later."""
    rows = (raw.withColumn("_doc", F.from_json("body", _SCHEMA, _OPTIONS))
            .select("source", "fetched_at", "page_ord",
                    F.posexplode("_doc.vulnerabilities").alias("entry_ord", "e")))
    made = kev_article(F.col("e"))
    rows = rows.withColumn("published", D.day_timestamp(F.col("e.dateAdded")))
    inside = F.col("published").cast("date") >= F.lit(since).cast("date")
    return (rows.select("source", *[c.alias(n) for n, c in made.items()], "published",
                        "fetched_at", "page_ord", "entry_ord",
                        F.coalesce(inside, F.lit(False)).alias("_inside"))
            .withColumn("in_window", F.col("_inside") & F.col("url").isNotNull())
            .withColumn("undated", F.lit(False)).drop("_inside"))


def kev_errors(raw: DataFrame) -> DataFrame:
    doc = raw.withColumn("_doc", F.from_json("body", _SCHEMA, _OPTIONS))
    failed = F.col("_doc").isNull() | F.col("_doc._broken").isNotNull()
    return doc.where(failed).select("source", "page_ord",
                                    F.lit("catalogue could not be parsed").alias("error"))


def kev_articles(raw: DataFrame, since: datetime) -> DataFrame:
    return kev_entries(raw, since).where("in_window").drop("in_window", "undated")
