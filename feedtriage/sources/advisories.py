"""Paged package-advisory listings (JSON arrays, newest first)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from feedtriage.functions import dates as D, text as X
from feedtriage.operators.filters import lookback_early_stop, page_cap, severity_allowed
from feedtriage.schema import ADVISORY_PAGE
from feedtriage.scratch import small
from feedtriage.sources.raw import page_failures

# Defaults and texts of the article made from an advisory.
DEFAULT_SEVERITIES = ["critical"]
NO_TITLE = "GitHub advisory"
DESCRIPTION_CHARS = 500
MAX_PACKAGES = 8


def package_names(vulnerabilities: Column) -> Column:
    """Sorted distinct 'ecosystem/name' (or 'name'); entries without a name are dropped."""
    def label(v: Column) -> Column:
        eco = F.nullif(v["package"]["ecosystem"], F.lit(""))
        name = F.nullif(v["package"]["name"], F.lit(""))
        return F.when(eco.isNotNull(), F.concat(eco, F.lit("/"), name)).otherwise(name)
    names = F.filter(F.transform(vulnerabilities, label), lambda x: x.isNotNull())
    return F.coalesce(F.array_sort(F.array_distinct(names)), F.array().cast("array<string>"))


def advisory_article(adv: Column) -> dict[str, Column]:
    """Title, url and summary of one advisory; url is null without a page link."""
    part = lambda n: X.strip(X.or_empty(adv[n]))
    cve = part("cve_id")
    packages = F.array_join(F.slice(package_names(adv["vulnerabilities"]), 1, MAX_PACKAGES), ", ")
    return {
        "title": X.append_cve(X.first_non_empty(part("summary"), adv["ghsa_id"], F.lit(NO_TITLE)),
                              cve),
        "url": F.nullif(part("html_url"), F.lit("")),
        "summary": F.concat_ws(
            " ", F.concat(F.lit("GitHub Security Advisory. Severity: "), part("severity"),
                          F.lit(".")),
            F.nullif(cve, F.lit("")),
            F.nullif(F.substring(part("description"), 1, DESCRIPTION_CHARS), F.lit("")),
            F.concat(F.lit("Affected: "), F.nullif(packages, F.lit("")))),
    }


def _pages(raw: DataFrame) -> DataFrame:
    is_list = F.rlike("body", F.lit(r"^\s*\["))
    return raw.withColumn("_page", F.when(is_list, F.from_json("body", ADVISORY_PAGE)))


def advisory_entries(raw: DataFrame, since: datetime,
                     severities: list[str] | Column = DEFAULT_SEVERITIES,
                     max_pages: int | Column | None = None,
                     early_stop: bool = False) -> DataFrame:
    """All advisories of the pages that count: before the first broken page of their
    fetch, and below the cap if there is one.

    Kept are dated advisories in the window with an allowed severity and a link.
    ``early_stop`` also drops everything after the first one of a fetch that is too old.
    """
    pages = _pages(raw if max_pages is None else page_cap(raw, max_pages))
    broken = (pages.where(F.col("_page").isNull())
              .groupBy(F.col("source").alias("_s"), F.col("fetched_at").alias("_f"))
              .agg(F.min("page_ord").alias("_broken")))
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("fetched_at").eqNullSafe(F.col("_f"))
    pages = (pages.join(small(broken), same, "left").drop("_s", "_f")
             .where(F.col("_broken").isNull() | (F.col("page_ord") < F.col("_broken"))))
    allow = severities if isinstance(severities, list) else severities.alias("_allow")
    keep = ["source", "fetched_at", "page_ord"]
    # Times are read inside the array, so that later filters do not read them again.
    dated = F.transform("_page", lambda e: F.struct(
        e.alias("e"), D.iso_timestamp(e["published_at"]).alias("published")))
    rows = pages.select(*keep, *([] if isinstance(allow, list) else [allow]),
                        F.posexplode(dated).alias("entry_ord", "_x"))
    rows = rows.select("*", "_x.e", "_x.published").drop("_x")
    if early_stop:
        rows = lookback_early_stop(rows, since, ["page_ord", "entry_ord"], by=["source", "fetched_at"])
    allowed = severity_allowed(F.col("e.severity"),
                               allow if isinstance(allow, list) else F.col("_allow"))
    made = advisory_article(F.col("e"))
    inside = F.coalesce((F.col("published") >= F.lit(since)) & allowed, F.lit(False))
    return (rows.select("source", *[c.alias(n) for n, c in made.items()], "published",
                        "fetched_at", "page_ord", "entry_ord", inside.alias("_inside"))
            .withColumn("in_window", F.col("_inside") & F.col("url").isNotNull())
            .withColumn("undated", F.lit(False)).drop("_inside"))


def advisory_errors(raw: DataFrame, max_pages: int | Column | None = None) -> DataFrame:
    """Pages that are no list, and pages that a cap leaves out."""
    broken = page_failures(_pages(raw), F.col("_page").isNull(), "page could not be parsed")
    if max_pages is None:
        return broken
    limit = max_pages if isinstance(max_pages, Column) else F.lit(max_pages)
    return broken.unionByName(page_failures(raw, F.col("page_ord") >= limit, "page beyond max_pages"))


def advisory_articles(raw: DataFrame, since: datetime,
                      severities: list[str] = DEFAULT_SEVERITIES,
                      max_pages: int | None = None, early_stop: bool = False) -> DataFrame:
    return (advisory_entries(raw, since, severities, max_pages, early_stop)
            .where("in_window").drop("in_window", "undated"))
