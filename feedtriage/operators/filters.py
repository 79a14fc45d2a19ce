"""Row filters: look-back windows, keyword gate, severity, category, relevance."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from feedtriage.functions import text as X
from feedtriage.scratch import small

INTERESTING = ["vulnerability", "red_team"]


def lookback(df: DataFrame, since: datetime | Column, col: str = "published",
             grain: str = "instant", keep_null: bool = True,
             run_ts: datetime | Column | None = None) -> DataFrame:
    """Rows at or after ``since``, by instant or by whole day.

    Undated rows are kept when ``keep_null``, and get ``run_ts`` when it is given.
    """
    when, limit = F.col(col), F.lit(since)
    if grain == "day":
        inside = when.cast("date") >= limit.cast("date")
    else:
        inside = when >= limit
    df = df.where(when.isNull() | inside) if keep_null else df.where(inside)
    if keep_null and run_ts is not None:
        df = df.withColumn(col, F.coalesce(when, F.lit(run_ts).cast("timestamp")))
    return df


def lookback_early_stop(df: DataFrame, since: datetime | Column, order: list[str],
                        by: str | list[str] = "source", col: str = "published") -> DataFrame:
    """Rows of a newest-first list up to its first old row; undated rows are skipped.

    The stop position is one partial aggregate per list, so a long list is not
    pulled into one sorted window, and a checked broadcast brings it to the rows.
    """
    old = F.col(col) < F.lit(since)
    place = F.struct(*order)
    keys = [by] if isinstance(by, str) else by
    stops = (df.where(old).groupBy(*[F.col(k).alias(f"_by_{k}") for k in keys])
             .agg(F.min(place).alias("_stop")))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in keys])
    joined = df.join(small(stops), same, "left")
    before = F.col("_stop").isNull() | (place < F.col("_stop"))
    return joined.where(before & F.col(col).isNotNull()).drop("_stop", *[f"_by_{k}" for k in keys])


def page_cap(df: DataFrame, max_pages: int | Column, col: str = "page_ord") -> DataFrame:
    """Newest ``max_pages`` pages of each source."""
    return df.where(F.col(col) < (max_pages if isinstance(max_pages, Column) else F.lit(max_pages)))


def severity_allowed(col: Column, severities: list[str] | Column) -> Column:
    """Case-insensitive allow-list test; null counts as ''."""
    level = F.lower(X.or_empty(col))
    if isinstance(severities, Column):
        return F.array_contains(F.transform(severities, F.lower), level)
    return level.isin([s.lower() for s in severities])


def prefilter_terms(groups: dict[str, list[str]] | list[str]) -> list[str]:
    if isinstance(groups, dict):
        groups = [t for terms in groups.values() for t in terms]
    return [t.lower() for t in groups]


def passes_prefilter(text: Column, groups: dict[str, list[str]] | list[str]) -> Column:
    """Any term of any group is a substring of the text; no terms keeps all."""
    terms = prefilter_terms(groups)
    return X.matches_any(F.lower(text), terms) if terms else F.lit(True)


def with_bypass(df: DataFrame, sources: DataFrame, out: str = "bypass") -> DataFrame:
    """Attach the source's bypass flag; unknown sources do not bypass.

    The dimension has one row per configured source, so it is broadcast.
    """
    flags = (sources.where("bypass_prefilter").select(F.col("name").alias("_name"))
             .distinct().withColumn(out, F.lit(True)))
    joined = df.join(F.broadcast(flags), df["source"] == flags["_name"], "left").drop("_name")
    return joined.withColumn(out, F.coalesce(out, F.lit(False)))


def keyword_prefilter(df: DataFrame, groups: dict[str, list[str]] | list[str],
                      sources: DataFrame | None = None) -> DataFrame:
    """Keyword gate over title and summary; bypass sources skip it."""
    keep = passes_prefilter(X.article_text(F.col("title"), F.col("summary")), groups)
    if sources is None:
        return df.where(keep)
    return with_bypass(df, sources, "_bypass").where(F.col("_bypass") | keep).drop("_bypass")


def is_interesting(category: Column, categories: list[str] | None = None) -> Column:
    """Reportable category that is also enabled."""
    allowed = [c for c in INTERESTING if categories is None or c in categories]
    return F.coalesce(category.isin(allowed), F.lit(False)) if allowed else F.lit(False)


def category_gate(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    return df.where(is_interesting(F.col("category"), categories))


def low_relevance(relevance: Column, minimum: int) -> Column:
    """Scored and below the minimum; unscored rows are never low."""
    return F.coalesce(relevance < F.lit(minimum), F.lit(False))


def relevance_gate(df: DataFrame, minimum: int) -> DataFrame:
    return df.where(~low_relevance(F.col("relevance"), minimum))


def enabled_sources(sources: DataFrame) -> DataFrame:
    return sources.where("enabled")
