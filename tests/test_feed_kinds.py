"""Sources written in Python, windowed counts of a stream, candidate pages in one order."""

import gzip
import json
import os
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from feedtriage.operators import model
from feedtriage.plans.config import SourceConfig
from feedtriage.schema import RAW
from feedtriage.sources import json_feed, plugin, registry
from feedtriage.streaming import counts

NOW = datetime(2026, 7, 7, 12, 0, tzinfo=timezone.utc)


def feed(*items):
    return json.dumps({"version": "https://jsonfeed.org/version/1.1", "items": list(items)})


def land(folder, name, text, at):
    body = gzip.compress(text.encode()) if name.endswith(".gz") else text.encode()
    (folder / name).write_bytes(body)
    os.utime(folder / name, (at, at))


def test_items_of_a_json_feed():
    line = feed({"title": "a", "url": "u", "content_text": "t", "date_published": "2026-07-07T10:00:00Z"},
                {"external_url": "x", "content_html": "<p>h</p>", "date_modified": "2026-07-07T12:00:00+02:00"},
                {"title": 3, "url": None, "date_published": "soon"}, "no object")
    at = datetime(2026, 7, 7, 10, tzinfo=timezone.utc)
    assert list(json_feed.parse((line + "\n\n").encode())) == [("a", "u", "t", at), (None, "x", "<p>h</p>", at), (None, None, None, None)]
    assert list(json_feed.parse(b"")) == []


def test_files_are_dealt_by_size():
    files = [(i, f"f{i}", size) for i, size in enumerate([10, 10, 90, 500, 1, 1])]
    assert [[n for n, _ in p.paths] for p in plugin.deal(files, 100)] == [["f0", "f1"], ["f2"], ["f3"], ["f4", "f5"]]


def test_a_plugin_kind_in_a_run(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    land(landed, "one.json", feed({"title": "<b>A</b>", "url": "https://a", "date_published": "2026-07-07T10:00:00Z"},
                                  {"title": "old", "url": "https://o", "date_published": "2026-01-01T00:00:00Z"}, {"title": "no link"}), 100)
    land(landed, "two.json.gz", feed({"url": "https://b"}) + "\n{broken", 200)
    land(landed, "_SUCCESS", "", 300)
    land(landed, "empty.json", "", 300)
    registry.register_plugin(json_feed.KIND, json_feed.parse)
    sources = [SourceConfig("feeds", json_feed.KIND, options={"path": str(landed)}),
               SourceConfig("off", json_feed.KIND, enabled=False, options={"path": "/none"}),
               SourceConfig("none", json_feed.KIND, options={"path": str(tmp_path / "missing")}), SourceConfig("odd", "gopher")]
    entries, errors = registry.union_sources(spark.createDataFrame([], RAW), sources, NOW - timedelta(hours=24), NOW)
    rows = {r.url: r for r in entries.collect()}
    assert {u for u, r in rows.items() if r.in_window} == {"https://a", "https://b"}
    assert rows["https://a"].title == "A" and rows["https://b"].title == "(no title)"
    assert rows["https://b"].undated and not rows["https://a"].undated and rows["https://a"].source_ord == 0
    found = {r.source: r.error for r in errors.collect()}
    assert set(found) == {"feeds", "odd"} and found["feeds"].startswith("JSONDecodeError") and found["odd"] == "unknown source type"


def test_a_plugin_kind_as_a_stream(spark, tmp_path):
    landed = tmp_path / "landed"
    landed.mkdir()
    plugin.register_format(spark, json_feed.KIND, json_feed.parse)

    def arrived():
        stream = spark.readStream.format(json_feed.KIND).load(str(landed))
        query = (stream.writeStream.foreachBatch(lambda df, i: df.select("url").write.mode("append").json(str(tmp_path / "out")))
                 .option("checkpointLocation", str(tmp_path / "stream")).trigger(once=True).start())
        query.awaitTermination()
        return sorted(r.url for r in spark.read.schema("url string").json(str(tmp_path / "out")).collect())

    land(landed, "b.json", feed({"url": "1"}, {"url": "2"}), 100)
    assert arrived() == ["1", "2"]
    land(landed, "a.json", feed({"url": "3"}), 100.5)
    land(landed, "c.json", feed({"url": "4"}), 200)
    assert arrived() == ["1", "2", "3", "4"]
    assert arrived() == ["1", "2", "3", "4"]


def test_counts_of_two_arrivals_keep_open_windows_only(spark, tmp_path):
    landed, table = str(tmp_path / "landed"), str(tmp_path / "table")
    schema = "source string, published timestamp, fetched_at timestamp"
    hour = lambda h: NOW + timedelta(hours=h)

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landed)
        query = counts.count_stream(spark.readStream.schema(schema).parquet(landed), table, "1 hour", "2 hours")
        query.awaitTermination()
        return query

    arrive([("a", hour(h % 50), hour(49)) for h in range(100)] + [("a", None, hour(49)), ("b", None, None)])
    first = {(r.window_start, r.undated): r.items for r in counts.read_counts(spark, table).collect()}
    assert len(first) == 51 and sum(first.values()) == 101
    query = arrive([("a", hour(49), hour(50)), ("a", hour(0), hour(50)), ("a", None, hour(50))])
    state = [op.numRowsTotal for p in query.recentProgress for op in p.stateOperators]
    assert max(state) < 10  # of 51 windows seen
    assert counts.late_rows(query) == 1
    rows = counts.read_counts(spark, table)
    got = {(r.window_start, r.undated): r.items for r in rows.collect()}
    assert sum(got.values()) == 103 and len(got) == 52
    batch = spark.read.parquet(f"{table}/counts").where("batch = 0").drop("batch")
    again = spark.createDataFrame(batch.collect(), batch.schema)
    counts.save_batch(again, 0, table)  # a batch that Spark repeats
    assert {(r.window_start, r.undated): r.items for r in counts.read_counts(spark, table).collect()} == got


def test_pages_of_a_long_list_are_in_one_order(spark):
    seen = spark.sql("""select id, concat('k', id) canonical_key, array('CVE-1') cve_ids, 't' title,
        'd' description, if(id = 7, null, timestamp_seconds(id % 50)) first_seen_at from range(1, 451)""")
    links = spark.sql("select 1L seq, id from range(1, 451) union all select 2L, 3L union all select null, 4L")
    pages = {(r.seq, r.page): r.candidate_ids for r in model.candidate_blocks(links, seen).collect()}
    order = sorted(range(1, 451), key=lambda i: (i == 7, -(i % 50), -i))
    assert [pages[1, k] for k in range(3)] == [order[:200], order[200:400], order[400:]]
    assert pages[2, 0] == [3] and pages[None, 0] == [4]


def test_the_newest_page_that_names_a_record_answers(spark):
    rows = [(1, 0, None), (1, 1, 5), (1, 2, 4), (2, 0, None), (3, 0, 9), (3, 1, 2)]
    answers = spark.createDataFrame(rows, "seq long, page int, match_id long")
    assert {r.seq: r.match_id for r in model.first_answer(answers).collect()} == {1: 5, 2: None, 3: 9}


def test_a_file_by_lines_is_never_held_whole(tmp_path):
    """The same rows as from the whole file, faults too, with a small part of its memory."""
    import tracemalloc
    line = json.dumps({"items": [{"title": "t", "url": "u", "summary": "s" * 2000}]}).encode()
    bodies = {"many": (line + b"\n") * 10_000, "end": line + b"\n" + line, "fault": line + b"\n{}\n" + line,
              "no-text": line * 600 + b"\n\xff" + line, "short": line + b"\xe2\x82", "empty": b"", "blank": b"\n \n"}
    for name, body in bodies.items():
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(body))
    (tmp_path / "cut.gz").write_bytes(gzip.compress(bodies["many"])[:-40])
    part = plugin.deal(plugin.landed_files(str(tmp_path)), 1 << 40)[0]
    whole = list(plugin._read(part, json_feed.parse, str(tmp_path)))
    assert list(plugin._read(part, plugin.ByLine(json_feed.parse), str(tmp_path))) == whole
    tracemalloc.start()
    n = sum(1 for _ in plugin._read(part, plugin.ByLine(json_feed.parse), str(tmp_path)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(whole) and peak < len(bodies["many"]) / 4
