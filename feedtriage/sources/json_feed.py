"""JSON feeds: a source kind written in Python. A file holds one feed document a line."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

KIND = "json_feed"


def _time(value) -> datetime | None:
    """An RFC 3339 time, in UTC where it names no zone; None if it is none."""
    try:
        at = datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return None
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def parse(body: bytes) -> Iterator[tuple[str | None, str | None, str | None, datetime | None]]:
    """(title, url, summary, published) of all items; items that are no objects are left out.

    The summary is the item's own, else its text, else its HTML; the time is that of
    publication, else of the last change. A line that is no feed is an error."""
    for line in body.decode("utf-8").split("\n"):
        if not line.strip():
            continue
        feed = json.loads(line)
        if not isinstance(feed, dict) or not isinstance(feed.get("items"), list):
            raise ValueError("a document without items")
        for item in feed["items"]:
            if isinstance(item, dict):
                texts = (_text(item.get(k)) for k in ("summary", "content_text", "content_html"))
                yield (_text(item.get("title")), _text(item.get("url")) or _text(item.get("external_url")),
                       next((t for t in texts if t), None), _time(item.get("date_published")) or _time(item.get("date_modified")))
