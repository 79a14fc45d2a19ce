"""RSS 2.0, RDF and Atom payloads."""

from __future__ import annotations

import json
from datetime import datetime
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

from feedtriage.functions import dates as D, text as X
from feedtriage.schema import FEED_ENTRY, FEED_PAYLOAD

_OPTIONS = {"ignoreNamespace": "true", "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": "_broken"}
_SCHEMA = FEED_PAYLOAD[:-1] + ", _broken:string>"


def _link(e: Column) -> Column:
    """Text link, else the last alternate href, else a guid that is a link."""
    links = F.coalesce(e["link"], F.array())
    plain = F.filter(links, lambda x: X.strip(X.or_empty(x["_VALUE"])) != "")
    alternate = F.filter(links, lambda x: x["_href"].isNotNull()
                         & (F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"))
    permanent = F.coalesce(F.lower(e["guid"]["_isPermaLink"]), F.lit("true")) != "false"
    return X.first_non_empty(
        X.strip(F.try_element_at(plain, F.lit(1))["_VALUE"]),
        X.strip(F.try_element_at(alternate, F.lit(-1))["_href"]),
        F.when(permanent, X.strip(e["guid"]["_VALUE"])))


def _published(e: Column) -> Column:
    """Publication time, else update time, each from the first readable field."""
    fields = ("pubDate", "published", "issued", "updated", "modified", "date")
    return F.coalesce(*[D.feed_timestamp(e[n]) for n in fields])


# A complete entry of a feed that is not well formed, and where entries begin.
_ENTRY, _ENTRY_START = r"(?s)<(item|entry)[\s>].*?</\1\s*>", r"<(item|entry)[\s>]"
# Stretches that are not markup, whatever they hold; the text of the first kind counts.
_OPAQUE = r"(?s)<!\[CDATA\[(.*?)\]\]>|<!--.*?-->"
# Characters that no XML document may have, also as numbers.
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]"
_CONTROL_NUMBER = r"^#(?:0*(?:[0-8]|1[124-9]|2\d|3[01])|[xX]0*(?:[0-8bBcCeEfF]|1[0-9a-fA-F]));"
_KNOWN_ENTITY = r"^(?:amp|lt|gt|quot|apos|#\d+|#[xX][0-9a-fA-F]+);"
_PREFIX = r"[<\s/]([A-Za-z_][A-Za-z0-9_.-]*):[A-Za-z_]"


def _html_entities() -> Column:
    """Character of each name that HTML has and XML does not."""
    own = ("amp", "lt", "gt", "quot", "apos")
    return F.from_json(F.lit(json.dumps({n: chr(c) for n, c in name2codepoint.items() if n not in own})), "map<string,string>")


def _entities_resolved(markup: Column) -> Column:
    """Markup in which each ampersand begins an entity that XML knows: names of HTML become
    characters, numbers of characters that XML forbids go, other ampersands stand for themselves."""
    names = _html_entities()

    def mended(part: Column, i: Column) -> Column:
        found = F.element_at(names, F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1))
        return (F.when(i == 0, part)
                .when(F.rlike(part, F.lit(_CONTROL_NUMBER)), F.regexp_replace(part, r"^[^;]*;", ""))
                .when(F.rlike(part, F.lit(_KNOWN_ENTITY)), F.concat(F.lit("&"), part))
                .when(found.isNotNull(), F.concat(found, F.regexp_replace(part, r"^[^;]*;", "")))
                .otherwise(F.concat(F.lit("&amp;"), part)))

    return F.array_join(F.transform(F.split(markup, "&", -1), mended), "")


def _mended_markup(body: Column) -> Column:
    """The body with plain text for CDATA sections, without comments, and with entities, lone
    angle brackets and forbidden characters mended outside of them."""
    clean = F.regexp_replace(body, _CONTROL, "")
    outside, inside = F.split(clean, _OPAQUE, -1), F.regexp_extract_all(clean, F.lit(_OPAQUE), 1)
    mend = lambda m: F.regexp_replace(_entities_resolved(m), r"<(?![A-Za-z_/!?])", "&lt;")
    return F.array_join(F.transform(outside, lambda m, i: F.concat(mend(m), F.coalesce(X.xml_text(F.get(inside, i)), F.lit("")))), "")


def parse_feeds(raw: DataFrame) -> DataFrame:
    """Payloads with the parsed feed, and the mended text of those that are not well formed."""
    feed = raw.withColumn("_feed", F.from_xml("body", _SCHEMA, _OPTIONS))
    return feed.withColumn("_mended", F.when(_is_broken(), _mended_markup(F.col("body"))))


def _is_broken() -> Column:
    return F.col("_feed._broken").isNotNull()


def _fragments() -> Column:
    """The complete entries of a broken payload, each cut out of the mended text."""
    return F.regexp_extract_all("_mended", F.lit(_ENTRY), 0)


def _entry_of(fragment: Column) -> Column:
    """The entry of a fragment by itself, with every prefix in it declared; null if it is not
    well formed on its own."""
    prefixes = F.array_except(F.array_distinct(F.regexp_extract_all(fragment, F.lit(_PREFIX), 1)), F.array(F.lit("xml"), F.lit("xmlns")))
    declared = F.array_join(F.transform(prefixes, lambda p: F.concat(F.lit(" xmlns:"), p, F.lit('="urn:'), p, F.lit('"'))), "")
    alone = F.concat(F.lit("<rss"), declared, F.lit("><channel>"), fragment, F.lit("</channel></rss>"))
    named = F.regexp_replace(F.regexp_replace(alone, r"<entry([\s>])", "<item$1"), "</entry", "</item")
    feed = F.from_xml(named, _SCHEMA, _OPTIONS)
    return F.when(feed["_broken"].isNull(), F.try_element_at(feed["channel"]["item"], F.lit(1)))


def rss_entries(raw: DataFrame, since: datetime, run_ts: datetime) -> DataFrame:
    """All entries of feed payloads, with ``in_window`` telling which to keep.

    Of a payload that is not well formed, the complete entries are read one by one, with
    the faults of markup mended that readers of feeds commonly forgive.
    Undated entries are kept and dated now; entries without a link are not.
    """
    feed = parse_feeds(raw)
    found = F.coalesce("_feed.channel.item", "_feed.item", "_feed.entry")
    whole = F.transform(found, lambda e: F.struct(e.alias("e"), F.lit(None).cast("string").alias("text")))
    cut = F.transform(_fragments(), lambda t: F.struct(F.lit(None).cast(FEED_ENTRY).alias("e"), t.alias("text")))
    rows = feed.select("source", "fetched_at", "page_ord",
                       F.posexplode(F.when(_is_broken(), cut).otherwise(whole)).alias("entry_ord", "_x"))
    rows = rows.withColumn("_one", F.array(F.coalesce(
        F.col("_x.e"), F.when(F.col("_x.text").isNotNull(), _entry_of(F.col("_x.text"))))))
    # Time and link are read inside an array, so that later filters do not read them again.
    rows = rows.select("source", "fetched_at", "page_ord", "entry_ord", F.explode(F.transform(
        F.filter("_one", lambda e: e.isNotNull()),
        lambda e: F.struct(e.alias("e"), _published(e).alias("_at"), _link(e).alias("url")))).alias("_y"))
    rows = rows.select("source", "fetched_at", "page_ord", "entry_ord", "_y.*")
    e = F.col("e")
    inside = F.col("_at").isNull() | (F.col("_at") >= F.lit(since))
    text = F.coalesce(e["description"], e["summary"], e["encoded"], e["content"])
    return rows.select(
        "source", X.clean_html(F.coalesce(e["title"], F.lit("(no title)"))).alias("title"), "url",
        X.clean_html(text).alias("summary"),
        F.coalesce("_at", F.lit(run_ts).cast("timestamp")).alias("published"),
        "fetched_at", "page_ord", "entry_ord",
        (inside & F.col("url").isNotNull()).alias("in_window"),
        F.col("_at").isNull().alias("undated"))


def rss_errors(raw: DataFrame) -> DataFrame:
    """Payloads without any entry that could be read, and the number of entries lost in others."""
    feed = parse_feeds(raw).where(F.col("body").isNull() | _is_broken())
    parts = feed.select("source", "fetched_at", "page_ord", F.xxhash64("body").alias("_body"),
                        (F.regexp_count("_mended", F.lit(_ENTRY_START)) - F.size(_fragments())).alias("_cut"),
                        F.explode_outer(_fragments()).alias("_text"))
    good = F.when(F.col("_text").isNotNull(), _entry_of(F.col("_text"))).isNotNull()
    counted = parts.groupBy("source", "fetched_at", "page_ord", "_body").agg(
        F.sum(F.when(good, 1).otherwise(0)).alias("good"),
        (F.sum(F.when(F.col("_text").isNotNull() & ~good, 1).otherwise(0)) + F.coalesce(F.max("_cut"), F.lit(0))).alias("bad"))
    lost = F.concat(F.col("bad").cast("string"), F.lit(" entries could not be parsed"))
    return (counted.where("good = 0 or bad > 0")
            .select("source", "page_ord", F.when(F.col("good") == 0, "feed could not be parsed").otherwise(lost).alias("error")))


def rss_articles(raw: DataFrame, since: datetime, run_ts: datetime) -> DataFrame:
    return rss_entries(raw, since, run_ts).where("in_window").drop("in_window", "undated")
