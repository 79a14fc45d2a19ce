import xml.etree.ElementTree as ET
from datetime import date, datetime, timezone

import pytest
from pyspark.sql import functions as F

from feedtriage.operators import feed, report, store
from feedtriage.operators.numbering import dense_index
from feedtriage.schema import SEEN
from feedtriage.scratch import Scratch

NOW = datetime(2026, 7, 7, 12, 0, tzinfo=timezone.utc)
ITEM = ("seq long, category string, relevance int, product string, vendor string, canonical_key string,"
        " title string, is_zero_or_nday boolean, severity string, vuln_class string,"
        " cve_ids array<string>, summary string, one_line string, url string, urls array<string>,"
        " source string")


def item(seq, **kw):
    base = dict(seq=seq, category="vulnerability", relevance=None, product=None, vendor=None,
                canonical_key=f"key{seq}", title=f"title{seq}", is_zero_or_nday=False, severity=None,
                vuln_class=None, cve_ids=[], summary="sum", one_line="line", url=f"https://x/{seq}",
                urls=[f"https://x/{seq}"], source="src")
    base.update(kw)
    return tuple(base.values())


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def test_dense_index(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    got = dense_index(df, [F.col("x")], "n", Scratch(spark, "t"), 10).orderBy("x").collect()
    assert [r["n"] for r in got] == list(range(10, 5010))


def test_report(spark):
    df = items(spark, item(1, category="red_team", relevance=5), item(2, relevance=2),
               item(3, relevance=5, product="P", is_zero_or_nday=True, severity="high",
                    vuln_class="rce", cve_ids=["CVE-1", "CVE-2"],
                    urls=["https://a", "https://b"]),
               item(4, category="odd", summary=""), item(5, relevance=2))
    rows = report.report_rows(df, date(2026, 7, 7)).orderBy("position").collect()
    assert [r["title"] for r in rows] == ["P", "key2", "key5", "key1", "key4"]
    assert rows[0]["body"] == ("_zero/n-day · relevance 5/5 · high · rce · CVE-1, CVE-2_\n\nsum\n\n"
                               "Sources: [1](https://a) · [2](https://b)")
    assert rows[3]["tags"] == "dart,crossed_swords" and rows[4]["tags"] == "newspaper"
    assert rows[4]["body"] == "line\n\n[Read more](https://x/4)"
    assert tuple(report.report_count(report.report_rows(df, date(2026, 7, 7))).first()) == (5, False)


def test_heartbeat_and_outbox(spark):
    empty = report.report_rows(items(spark).where("false"), date(2026, 7, 7), "N")
    rows = empty.collect()
    assert [(r["title"], r["tags"]) for r in rows] == [("N 2026-07-07 - 0 new", "shield")]
    assert tuple(report.report_count(empty).first()) == (0, True)
    assert report.outbox(empty).count() == 0 and report.outbox(empty, heartbeat=True).count() == 1
    one = report.outbox(report.report_rows(items(spark, item(1, product="a — b")), date(2026, 7, 7)),
                        "high").first()
    assert one["title"] == "a - b" and one["priority"] == "high" and not one["delivered"]


def records(spark, *rows):
    base = dict(id=1, category="vulnerability", vendor=None, product=None, vuln_class="rce",
                canonical_key="k", cve_ids=["CVE-1"], description="a <b> & c", title="T & t",
                source="src", url="https://x/?a=1&b=2", first_seen_at=NOW)
    return spark.createDataFrame([tuple({**base, **r}.values()) for r in rows], SEEN)


def test_feed(spark, tmp_path):
    df = records(spark, dict(id=1), dict(id=2, category="red_team", title="", product="P",
                                         first_seen_at=datetime(2026, 7, 7, 13, tzinfo=timezone.utc)))
    entries = feed.feed_entries(store.latest(df, 10), "n")
    doc = feed.feed_document(entries, NOW, "My <feed>", "n", "https://me")
    path = tmp_path / "deep" / "atom.xml"
    feed.write_feed(doc, str(path))
    root = ET.fromstring(path.read_text(encoding="utf-8"))
    ns = {"a": feed.ATOM_NAMESPACE}
    assert root.find("a:title", ns).text == "My <feed>" and root.find("a:id", ns).text == "https://me"
    assert root.find("a:link", ns).attrib == {"href": "https://me", "rel": "self"}
    assert root.find("a:updated", ns).text == "2026-07-07T13:00:00+00:00"
    found = root.findall("a:entry", ns)
    assert [e.find("a:id", ns).text for e in found] == ["urn:n:item:2", "urn:n:item:1"]
    assert [e.find("a:title", ns).text for e in found] == ["P", "T & t"]
    assert [e.find("a:category", ns).attrib["term"] for e in found] == ["red-team", "vulnerability"]
    assert found[1].find("a:link", ns).attrib["href"] == "https://x/?a=1&b=2"
    assert found[1].find("a:content", ns).text == (
        '<p><em>vulnerability · rce · CVE-1</em></p><p>a &lt;b&gt; &amp; c</p>'
        '<p><a href="https://x/?a=1&amp;b=2">Read more</a> · Source: src</p>')
    empty = feed.feed_document(entries.where("false"), NOW, "t", "n").first()["document"]
    root = ET.fromstring(empty.encode())
    assert root.find("a:id", ns).text == "urn:n:feed" and not root.findall("a:entry", ns)
    assert root.find("a:updated", ns).text == "2026-07-07T12:00:00+00:00"


def test_store(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.read_seen(spark, root).count() == 0
    scratch = Scratch(spark, "t")
    none = spark.createDataFrame([], "id long, cve string")
    first = store.new_records(items(spark, item(7, cve_ids=["cve-9", "CVE-1"]), item(3, summary="")),
                              store.next_record_id(store.read_seen(spark, root)), NOW, scratch)
    store.commit_batch(spark, root, "0", first, none, NOW)
    seen = {r["id"]: r for r in store.read_seen(spark, root).collect()}
    assert seen[1]["title"] == "title3" and seen[1]["description"] == "line"
    assert seen[2]["cve_ids"] == ["CVE-1", "CVE-9"]
    assert store.is_committed(spark, root, "0") and not store.is_committed(spark, root, "1")
    # a half-written batch is not visible, and a repeat replaces it
    first.write.parquet(f"{root}/records/batch=1")
    assert store.read_seen(spark, root).count() == 2
    more = store.new_records(items(spark, item(1)), 3, NOW, scratch)
    added = spark.createDataFrame([(2, "cve-5"), (2, "CVE-9"), (99, "CVE-1")], "id long, cve string")
    store.commit_batch(spark, root, "1", more, added, NOW)
    seen = {r["id"]: r for r in store.read_seen(spark, root).collect()}
    assert sorted(seen) == [1, 2, 3] and seen[2]["cve_ids"] == ["CVE-1", "CVE-5", "CVE-9"]
    store.compact_seen(spark, root, root + "2", NOW)
    again = {r["id"]: r for r in store.read_seen(spark, root + "2").collect()}
    assert again == seen


def test_import(spark):
    df = spark.createDataFrame(
        [(1, "c", None, None, None, "k", '["b","A"]', "", "", "", "u", "2026-07-07T12:00:00+00:00"),
         (2, "c", None, None, None, "k", "oops", "", "", "", "u", "2026-07-07T12:00:00.5+00:00")],
        "id int, category string, vendor string, product string, vuln_class string, canonical_key string,"
        " cve_ids string, description string, title string, source string, url string, first_seen_at string")
    rows = store.import_seen(df).orderBy("id").collect()
    assert rows[0]["cve_ids"] == ["A", "B"] and rows[1]["cve_ids"] == []
    assert store.import_seen(df).schema["first_seen_at"].dataType.simpleString() == "timestamp"
