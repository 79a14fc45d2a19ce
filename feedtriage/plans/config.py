"""Job settings."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class ConfigError(ValueError):
    """The settings cannot describe a job."""


@dataclass
class SourceConfig:
    name: str
    type: str = "rss"
    url: str = ""
    enabled: bool = True
    bypass_prefilter: bool = False
    options: dict[str, Any] = field(default_factory=dict)


@dataclass
class FeedConfig:
    enabled: bool = False
    path: str = "public/atom.xml"
    max_items: int = 100
    title: str = "Feed triage"
    name: str = "feedtriage"
    site_url: str | None = None


@dataclass
class JobConfig:
    sources: list[SourceConfig] = field(default_factory=list)
    since_hours: int = 24
    categories: list[str] = field(default_factory=lambda: ["vulnerability", "red_team"])
    prefilter: dict[str, list[str]] = field(default_factory=dict)
    classifier_terms: dict[str, list[str]] = field(default_factory=dict)
    min_relevance: int = 1
    semantic_dedup: bool = True
    dedup_window_days: int = 45
    store_path: str = "data/seen"
    outbox_path: str | None = None
    report_name: str = "Feed triage"
    priority: str = "default"
    quiet_heartbeat: bool = False
    feed: FeedConfig = field(default_factory=FeedConfig)

    def enabled_sources(self) -> list[SourceConfig]:
        return [s for s in self.sources if s.enabled]

    def validate(self) -> "JobConfig":
        problems = [
            (not self.enabled_sources(), "no source is enabled"),
            (self.since_hours <= 0, "since_hours must be above 0"),
            (not self.categories, "enable at least one category"),
            (not 1 <= self.min_relevance <= 5, "min_relevance must lie in 1..5"),
        ]
        for wrong, message in problems:
            if wrong:
                raise ConfigError(message)
        return self


def config_from_dict(raw: dict[str, Any]) -> JobConfig:
    """Settings from a parsed configuration file; absent keys take the defaults."""
    raw = dict(raw or {})
    sources = [SourceConfig(
        name=c["name"], type=c.get("type", "rss"), url=c.get("url", ""),
        enabled=c.get("enabled", True), bypass_prefilter=c.get("bypass_prefilter", False),
        options=c.get("options") or {}) for c in raw.pop("connectors", raw.pop("sources", []))]
    feed = FeedConfig(**(raw.pop("feed", None) or {}))
    model = raw.pop("llm", None) or {}
    notify = raw.pop("ntfy", None) or {}
    if "semantic_dedup" in model:
        raw["semantic_dedup"] = model["semantic_dedup"]
    for key in ("priority", "quiet_heartbeat"):
        if key in notify:
            raw[key] = notify[key]
    if "database" in raw:
        raw["store_path"] = raw.pop("database")
    known = {k: v for k, v in raw.items() if k in JobConfig.__dataclass_fields__}
    return JobConfig(sources=sources, feed=feed, **known).validate()
