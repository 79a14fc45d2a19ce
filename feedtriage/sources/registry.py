"""Source types by name, and the union of all configured sources."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedtriage.plans.config import SourceConfig
from feedtriage.functions import text as X
from feedtriage.schema import SOURCES
from feedtriage.sources import advisories, kev, plugin, rss

# type -> (entries(raw, since, run_ts), errors(raw)). ``raw`` carries the source's
# configuration in the columns ``options`` and ``source_ord``.
EntryFn = Callable[[DataFrame, datetime, datetime], DataFrame]
_REGISTRY: dict[str, tuple[EntryFn, Callable[[DataFrame], DataFrame]]] = {}


def register_source(kind: str, entries: EntryFn, errors: Callable[[DataFrame], DataFrame]) -> None:
    _REGISTRY[kind] = (entries, errors)


#: Kinds written in Python: their sources name the folder of their files in ``options["path"]``.
_PLUGINS: dict[str, plugin.Parse] = {}


def register_plugin(kind: str, parse: plugin.Parse) -> None:
    _PLUGINS[kind] = parse


def _plugin_source(spark: SparkSession, s: SourceConfig, since: datetime, run_ts: datetime) -> tuple[DataFrame, DataFrame]:
    """(entries, errors) of one source of a kind written in Python; a file is a page."""
    plugin.register_format(spark, s.type, _PLUGINS[s.type])
    rows = spark.read.format(s.type).load(s.options["path"]).withColumn("source", F.lit(s.name))
    # Files are told apart by a hash of their path, as a page's number is.
    rows = rows.withColumn("page_ord", F.hash("file"))
    inside = F.col("published").isNull() | (F.col("published") >= F.lit(since))
    entries = rows.where(F.col("error").isNull()).select(
        "source", X.clean_html(F.coalesce("title", F.lit("(no title)"))).alias("title"), "url", X.clean_html(F.col("summary")).alias("summary"),
        F.coalesce("published", F.lit(run_ts).cast("timestamp")).alias("published"), "fetched_at", "page_ord", "entry_ord",
        (inside & F.col("url").isNotNull()).alias("in_window"), F.col("published").isNull().alias("undated"))
    return entries, rows.where(F.col("error").isNotNull()).select("source", "page_ord", "error")


def _advisory_entries(raw: DataFrame, since: datetime, run_ts: datetime) -> DataFrame:
    listed = F.from_json(F.col("options")["severities"], "array<string>")
    severities = F.coalesce(listed, F.array(*[F.lit(s) for s in advisories.DEFAULT_SEVERITIES]))
    stops = F.coalesce(F.col("options")["early_stop"] == "true", F.lit(False))
    whole = advisories.advisory_entries(raw.where(~stops), since, severities, _max_pages())
    return whole.unionByName(advisories.advisory_entries(raw.where(stops), since, severities, _max_pages(), True))


def _max_pages():
    """The cap that the source's options name, else none."""
    return F.coalesce(F.col("options")["max_pages"].try_cast("int"), F.lit(2 ** 31 - 1))


def _advisory_errors(raw: DataFrame) -> DataFrame:
    return advisories.advisory_errors(raw, _max_pages())


register_source("rss", rss.rss_entries, rss.rss_errors)
register_source("cisa_kev", lambda raw, since, run_ts: kev.kev_entries(raw, since), kev.kev_errors)
register_source("github_advisories", _advisory_entries, _advisory_errors)


def sources_table(spark: SparkSession, sources: list[SourceConfig]) -> DataFrame:
    """The source dimension, one row per configured source; option values as text."""
    text = lambda v: v if isinstance(v, str) else json.dumps(v)
    return spark.createDataFrame(
        [(s.name, s.type, s.url, s.enabled, s.bypass_prefilter,
          {k: text(v) for k, v in s.options.items()}, i) for i, s in enumerate(sources)], SOURCES)


def union_sources(raw: DataFrame, sources: list[SourceConfig], since: datetime,
                  run_ts: datetime) -> tuple[DataFrame, DataFrame]:
    """(entries, source_errors) of all enabled sources of a known type.

    Entries carry source_ord, fetched_at, page_ord and entry_ord, the processing
    order. The dimension is as long as the configuration, so it is broadcast and no
    payload is shuffled by its source.
    """
    spark = raw.sparkSession
    enabled = sources_table(spark, sources).where("enabled")
    dim = enabled.select(F.col("name").alias("_name"), "type", "options", "source_ord")
    tagged = raw.join(F.broadcast(dim), raw["source"] == dim["_name"]).drop("_name")
    wanted = {s.type for s in sources if s.enabled}
    order = enabled.select(F.col("name").alias("_name"), "source_ord")
    parts, problems = [], []
    for kind in sorted(wanted & set(_REGISTRY)):
        entries, errors = _REGISTRY[kind]
        mine = tagged.where(F.col("type") == kind)
        parts.append(entries(mine, since, run_ts))
        problems.append(errors(mine))
    for s in sources:
        if s.enabled and s.type in _PLUGINS:
            entries, errors = _plugin_source(spark, s, since, run_ts)
            parts.append(entries)
            problems.append(errors)
    missing = enabled.where(F.col("type").isin(list(_REGISTRY))).join(
        raw.select(F.col("source").alias("name")).distinct(), "name", "left_anti")
    unknown = enabled.where(~F.col("type").isin([*_REGISTRY, *_PLUGINS]))
    for rows, text in ((missing, "no payload"), (unknown, "unknown source type")):
        problems.append(rows.select(F.col("name").alias("source"),
                                    F.lit(None).cast("int").alias("page_ord"),
                                    F.lit(text).alias("error")))
    if not parts:
        parts.append(rss.rss_entries(tagged.where(F.lit(False)), since, run_ts))
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    entries = union(parts)
    entries = entries.join(F.broadcast(order), entries["source"] == order["_name"]).drop("_name")
    return entries, union(problems)
