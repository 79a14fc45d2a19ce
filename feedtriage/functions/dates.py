"""Lenient timestamp parsing and RFC 3339 rendering (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Hour offsets of the zone names allowed in mail-style dates.
ZONE_OFFSETS = {
    "UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000",
    "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500",
    "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700",
}


def iso_timestamp(c: Column) -> Column:
    """ISO-8601 to a timestamp; no zone means UTC, bad text gives null."""
    shaped = F.rlike(c, F.lit(r"^\d{4}-\d{2}-\d{2}"))
    return F.try_to_timestamp(F.when(shaped, c))


def day_timestamp(c: Column) -> Column:
    """YYYY-MM-DD to midnight UTC; bad text gives null."""
    shaped = F.rlike(c, F.lit(r"^\d{4}-\d{1,2}-\d{1,2}$"))
    return F.try_to_timestamp(F.when(shaped, c), F.lit("yyyy-M-d"))


def rfc822_timestamp(c: Column) -> Column:
    """Mail-style date ('Tue, 07 Jul 2026 13:01:01 +0200') to a timestamp."""
    zones = F.create_map(*[F.lit(x) for kv in ZONE_OFFSETS.items() for x in kv])
    bare = F.trim(F.regexp_replace(c, r"^\s*[A-Za-z]{3,9},?\s+(?=\d)", ""))
    bare = F.regexp_replace(bare, r"\s+", " ")
    name = F.upper(F.regexp_extract(bare, r" ([A-Za-z]{1,3})$", 1))
    offset = F.try_element_at(zones, name)
    clock = F.regexp_replace(bare, r" ([A-Za-z]{1,3}|[+-]\d{2}:?\d{2})$", "")
    numeric = F.replace(F.regexp_extract(bare, r" ([+-]\d{2}:?\d{2})$", 1), F.lit(":"), F.lit(""))
    zone = F.coalesce(offset, F.nullif(numeric, F.lit("")), F.lit("+0000"))
    text = F.concat(F.initcap(F.lower(clock)), F.lit(" "), zone)
    patterns = ["d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx",
                "d MMM yy HH:mm:ss xx", "d MMM yy HH:mm xx", "d MMM yyyy xx"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in patterns])


def feed_timestamp(c: Column) -> Column:
    return F.coalesce(rfc822_timestamp(c), iso_timestamp(F.trim(c)))


def rfc3339(c: Column) -> Column:
    """2026-07-07T13:01:01+00:00, with microseconds only when there are any."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssxxx")
    fine = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return F.when(F.unix_micros(c) % F.lit(1_000_000) != 0, fine).otherwise(whole)
