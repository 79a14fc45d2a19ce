"""Report messages of a run and the notification outbox."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from feedtriage.functions import text as X
from feedtriage.operators.numbering import dense_index
from feedtriage.scratch import Scratch

# Notification tags and order of the categories.
CATEGORY_TAGS = {"vulnerability": "shield,rotating_light", "red_team": "dart,crossed_swords"}
CATEGORY_RANK = {"vulnerability": 0, "red_team": 1}
DEFAULT_TAGS, DEFAULT_RANK = "newspaper", 2


def by_category(category: Column, values: dict, default: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), default)


def primary_url(urls: Column, url: Column) -> Column:
    return F.coalesce(F.try_element_at(urls, F.lit(1)), url)


def _joined(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def link_line(urls: Column) -> Column:
    """'[Read more](u)' for one link, a numbered list for several."""
    numbered = F.transform(urls, lambda u, i: F.concat(
        F.lit("["), (i + 1).cast("string"), F.lit("]("), u, F.lit(")")))
    several = F.concat(F.lit("Sources: "), F.array_join(numbered, " · "))
    single = F.concat(F.lit("[Read more]("), F.try_element_at(urls, F.lit(1)), F.lit(")"))
    return F.when(F.size(urls) == 1, single).otherwise(several)


def message_columns() -> dict[str, Column]:
    """Title, body and tags of one item."""
    c = F.col
    relevance = F.when(c("relevance") != 0, F.concat(
        F.lit("relevance "), c("relevance").cast("string"), F.lit("/5")))
    meta = _joined(" · ", F.when(c("is_zero_or_nday"), F.lit("zero/n-day")), relevance,
                   c("severity"), c("vuln_class"), F.array_join("cve_ids", ", "))
    urls = F.when(F.size("urls") > 0, c("urls")).otherwise(F.array("url"))
    body = F.concat_ws(
        "\n\n", F.when(meta != "", F.concat(F.lit("_"), meta, F.lit("_"))),
        X.or_empty(X.first_non_empty(c("summary"), c("one_line"))), link_line(urls))
    return {
        "title": X.or_empty(X.first_non_empty(
            c("product"), c("vendor"), c("canonical_key"), c("title"))),
        "body": body,
        "tags": by_category(c("category"), CATEGORY_TAGS, F.lit(DEFAULT_TAGS)),
    }


def report_rows(items: DataFrame, report_date: date | Column, name: str = "Feed triage",
                scratch: Scratch | None = None) -> DataFrame:
    """Messages (position, title, body, tags) of the new items, in report order.

    Vulnerabilities first, then red team, then the rest; most relevant first
    (unscored last), then ``seq``. Without items there is one heartbeat row, at
    position 0.
    """
    scratch = scratch or Scratch(items.sparkSession, "report")
    made = message_columns()
    rank = by_category(F.col("category"), CATEGORY_RANK, F.lit(DEFAULT_RANK))
    rows = items.select("seq", rank.alias("rank"),
                        (-F.coalesce("relevance", F.lit(0))).alias("minus_relevance"),
                        *[col.alias(n) for n, col in made.items()])
    order = [F.col("rank"), F.col("minus_relevance"), F.col("seq")]
    numbered = (dense_index(rows, order, "position", scratch, 1)
                .select("position", "title", "body", "tags"))
    day = F.date_format(F.lit(report_date).cast("date"), "yyyy-MM-dd")
    heartbeat = items.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit(0).cast("long").alias("position"),
        F.concat(F.lit(f"{name} "), day, F.lit(" - 0 new")).alias("title"),
        F.lit("No new vulnerabilities or red-team items in the last run.").alias("body"),
        F.lit("shield").alias("tags"))
    return numbered.unionByName(heartbeat)


def report_count(report: DataFrame) -> DataFrame:
    """(count, is_empty) of a report; the heartbeat does not count."""
    n = F.count_if(F.col("position") > 0)
    return report.agg(n.alias("count"), (n == 0).alias("is_empty"))


def outbox(report: DataFrame, priority: str = "default", heartbeat: bool = False) -> DataFrame:
    """Messages to deliver: header-safe titles; the heartbeat only if asked for."""
    rows = report if heartbeat else report.where(F.col("position") > 0)
    return rows.select("position", X.header_safe(F.col("title")).alias("title"), "body", "tags",
                       F.lit(priority).alias("priority"), F.lit("yes").alias("markdown"),
                       F.lit(False).alias("delivered"))


def write_outbox(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
