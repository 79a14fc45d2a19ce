from datetime import datetime, timedelta, timezone

import pytest

from feedtriage.operators import store
from feedtriage.operators.indexed_store import IndexedStore
from feedtriage.operators.similarity import similar_articles
from feedtriage.plans.config import ConfigError, FeedConfig, JobConfig, SourceConfig, config_from_dict
from feedtriage.plans.job import Models, commit, outbox_rows, run
from feedtriage.schema import RAW
from feedtriage.sources.raw import read_landing_stream
from feedtriage.streaming.stream import bounded_url_dedup, run_stream
from feedtriage.operators.funnel import windowed_counts

from test_sources import NOW, channel, item


def feed_rows(*sources):
    return [(name, 0, NOW, body) for name, body in sources]


def config(tmp_path, **kw):
    base = dict(sources=[SourceConfig("a"), SourceConfig("b", bypass_prefilter=True)],
                prefilter={"g": ["exploit", "flaw", "beacon"]}, store_path=str(tmp_path / "store"),
                outbox_path=str(tmp_path / "outbox"))
    base.update(kw)
    return JobConfig(**base)


BODIES = (
    ("a", channel(item("Acme flaw CVE-2026-1111", "https://x/1", NOW),
                  item("Acme again", "https://x/2", NOW, "flaw cve-2026-1111"),
                  item("Beacon tricks", "https://x/3", NOW),
                  item("Cooking", "https://x/4", NOW),
                  item("Old flaw", "https://x/5", NOW - timedelta(days=9)))),
    ("b", channel(item("Patch day", "https://x/6", NOW), item("Garden", "https://x/7", NOW),
                  item("Beacon tricks", "https://x/8", NOW))),
)


def totals(result):
    return {r["source"]: r.asDict() for r in result.funnel.collect()}


def test_end_to_end(spark, tmp_path):
    cfg = config(tmp_path, feed=FeedConfig(enabled=True, path=str(tmp_path / "atom.xml")))
    raw = spark.createDataFrame(feed_rows(*BODIES), RAW)
    dry = run(spark, cfg, raw, NOW)
    assert store.read_seen(spark, cfg.store_path).count() == 0
    result = run(spark, cfg, raw, NOW)
    t = totals(result)
    assert t[None] == dict(source=None, fetched=8, in_window=7, undated=0, prefiltered=6,
                           classified_interesting=5, low_relevance=0, new_items=3, duplicates=2)
    assert t["a"]["new_items"] == 2 and t["b"]["duplicates"] == 1 and t["b"]["prefiltered"] == 3
    assert dry.decisions.exceptAll(result.decisions).count() == 0
    assert [r["seq"] for r in result.items.orderBy("seq").collect()] == list(range(5))
    titles = [r["title"] for r in outbox_rows(result).orderBy("position").collect()]
    assert titles == ["acme-flaw-cve-2026-1111", "patch-day", "beacon-tricks"]
    assert commit(spark, result, "0") and not commit(spark, result, "0")
    assert store.read_seen(spark, cfg.store_path).count() == 3
    assert (tmp_path / "atom.xml").read_text().count("<entry>") == 3
    second = run(spark, cfg, raw, NOW)
    assert totals(second)[None]["new_items"] == 0 and totals(second)[None]["duplicates"] == 5
    assert outbox_rows(second).count() == 0
    third = run(spark, cfg, spark.createDataFrame(feed_rows(
        ("a", channel(item("Beacon tricks", "https://x/99", NOW, "CVE-2026-7777")))), RAW), NOW)
    commit(spark, third, "1")
    cves = {r["title"]: r["cve_ids"] for r in store.read_seen(spark, cfg.store_path).collect()}
    assert cves["Beacon tricks"] == ["CVE-2026-7777"]


def test_store_in_levels_decides_as_the_plain_store(spark, tmp_path):
    cfg = config(tmp_path, feed=FeedConfig(enabled=True, path=str(tmp_path / "atom.xml")))
    levels = IndexedStore(spark, str(tmp_path / "levels"), fanout=2)
    later = (("a", channel(item("Acme again CVE-2026-1111 CVE-2026-2222", "https://x/9", NOW), item("New flaw", "https://x/10", NOW))),
             ("b", channel(item("Beacon tricks", "https://x/11", NOW), item("Exploit CVE-2026-2222", "https://x/12", NOW))))
    for batch, bodies in enumerate((BODIES, later)):
        raw = spark.createDataFrame(feed_rows(*bodies), RAW)
        plain, own = run(spark, cfg, raw, NOW), run(spark, cfg, raw, NOW, index=levels)
        assert sorted(map(tuple, plain.decisions.collect())) == sorted(map(tuple, own.decisions.collect()))
        assert commit(spark, plain, str(batch)) and commit(spark, own, str(batch)) and not commit(spark, own, str(batch))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(levels.seen()) == rows(store.read_seen(spark, cfg.store_path))


def test_similar_articles_as_the_semantic_layer(spark, tmp_path):
    body = "Beacon tricks " + " ".join(f"word{i}" for i in range(60))
    cfg = config(tmp_path)
    raw = lambda *items: spark.createDataFrame(feed_rows(("b", channel(*items))), RAW)
    first = run(spark, cfg, raw(item("One flaw", "https://x/1", NOW, body), item("Two flaw", "https://x/2", NOW, body + " end")), NOW,
                models=Models(similar=similar_articles))
    assert sorted(r.reason for r in first.decisions.collect()) == ["", "layer3:semantic"]
    commit(spark, first, "0")
    second = run(spark, cfg, raw(item("One flaw", "https://x/3", NOW, body + " more")), NOW, models=Models(similar=similar_articles))
    assert [(r.reason, r.matched_record_id) for r in second.decisions.collect()] in ([("layer3:semantic", 1)], [("layer2:canonical-key", 1)])


def test_models(spark, tmp_path):
    def classify():
        def fn(prompts):
            out = []
            for p in prompts:
                if "Garden" in p:
                    out.append("no idea")
                elif "again" in p:
                    out.append('{"category":"vulnerability","relevance":1,"canonical_key":"low"}')
                else:
                    out.append('{"category":"vulnerability","relevance":5,"canonical_key":"k%d"}' % len(p))
            return out
        return fn

    def summarise():
        return lambda prompts: ["short" if "Acme flaw" in p else None for p in prompts]

    def similar(items, seen):
        a = items.where("title = 'Acme flaw CVE-2026-1111'").selectExpr("seq cand_seq")
        b = items.where("title = 'Patch day'").selectExpr("seq")
        return b.crossJoin(a).selectExpr("seq", "cand_seq", "cast(null as long) record_id", "0.9 score")

    cfg = config(tmp_path, min_relevance=3)
    raw = spark.createDataFrame(feed_rows(*BODIES), RAW)
    result = run(spark, cfg, raw, NOW, models=Models(classify, summarise, similar))
    t = totals(result)[None]
    assert t["low_relevance"] == 1
    reasons = {r["title"]: r["reason"] for r in result.items.join(result.decisions, "seq").collect()}
    assert reasons["Patch day"] == "layer3:semantic"
    summaries = {r["title"]: r["summary"] for r in result.new_items.collect()}
    assert summaries["Acme flaw CVE-2026-1111"] == "short"


def test_quiet_run(spark, tmp_path):
    cfg = config(tmp_path, quiet_heartbeat=True)
    raw = spark.createDataFrame(feed_rows(("a", channel(item("Cooking", "https://x/4", NOW)))), RAW)
    result = run(spark, cfg, raw, NOW)
    assert totals(result)[None]["prefiltered"] == 0
    assert outbox_rows(result).count() == 1


def test_stream_equals_batches(spark, tmp_path):
    zone = tmp_path / "zone"
    zone.mkdir()
    batches = [BODIES[:1], BODIES[1:], BODIES]
    def land(i, bodies):
        spark.createDataFrame(feed_rows(*bodies), RAW).coalesce(1).write.json(str(tmp_path / f"t{i}"))
        part = next((tmp_path / f"t{i}").glob("part-*.json"))
        (zone / f"{i}.json").write_bytes(part.read_bytes())

    cfg = config(tmp_path, store_path=str(tmp_path / "s1"), outbox_path=None)
    for i, bodies in enumerate(batches):
        land(i, bodies)
        stream = read_landing_stream(spark, str(zone))
        run_stream(spark, cfg, stream, str(tmp_path / "ckpt"), now=lambda: NOW).awaitTermination()
    other = config(tmp_path, store_path=str(tmp_path / "s2"), outbox_path=None)
    for i, bodies in enumerate(batches):
        raw = spark.createDataFrame(feed_rows(*bodies), RAW)
        commit(spark, run(spark, other, raw, NOW), str(i))
    got, want = (sorted(map(tuple, store.read_seen(spark, c.store_path).collect()))
                 for c in (cfg, other))
    assert got == want and len(got) == 3
    # A new checkpoint starts at batch 0 again, but its batches are other ones.
    new = channel(item("New flaw CVE-2026-2222", "https://x/99", NOW))
    land(9, [("a", new)])
    stream = read_landing_stream(spark, str(zone))
    run_stream(spark, cfg, stream, str(tmp_path / "ckpt2"), now=lambda: NOW).awaitTermination()
    assert {r.url for r in store.read_seen(spark, cfg.store_path).collect()} >= {"https://x/99"}


def test_repeated_commit_refreshes_the_feed(spark, tmp_path):
    feed_path = tmp_path / "feed.xml"
    cfg = config(tmp_path, feed=FeedConfig(enabled=True, path=str(feed_path)),
                 sources=[SourceConfig("a"), SourceConfig("b"), SourceConfig("silent")])
    result = run(spark, cfg, spark.createDataFrame(feed_rows(*BODIES), RAW), NOW)
    assert commit(spark, result, "1")
    text = feed_path.read_text()
    feed_path.unlink()
    assert not commit(spark, result, "1") and feed_path.read_text() == text
    errors = spark.read.parquet(f"{cfg.store_path}-errors").collect()
    assert [(r.source, r.error) for r in errors] == [("silent", "no payload")]


def test_sources_are_not_shuffled(spark, tmp_path):
    """No payload or article is moved by the name of its source."""
    from pyspark.sql import functions as F
    from feedtriage.operators import filters
    from feedtriage.sources import registry
    raw = spark.createDataFrame(feed_rows(*BODIES), RAW)
    sources = config(tmp_path).sources
    entries, _ = registry.union_sources(raw, sources, NOW - timedelta(days=1), NOW)
    gated = filters.with_bypass(entries, registry.sources_table(spark, sources))
    stopped = filters.lookback_early_stop(entries, NOW - timedelta(days=1), ["page_ord", "entry_ord"])
    for df in (entries, gated, stopped):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(source" not in plan


def test_stream_counts_and_bounded_dedup(spark, tmp_path):
    rows = [("s", f"https://x/{i % 3}", NOW + timedelta(hours=i)) for i in range(6)]
    rows += [("s", "https://x/0", None), ("s", "https://x/0", None)]
    path = str(tmp_path / "articles")
    df = spark.createDataFrame(rows, "source string, url string, published timestamp")
    df.write.parquet(path)
    stream = spark.readStream.schema(df.schema).parquet(path)
    q = (windowed_counts(stream, "4 hours").writeStream.outputMode("complete").format("memory")
         .queryName("counts").trigger(availableNow=True).start())
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(
        map(tuple, windowed_counts(df, "4 hours").collect()))
    q = (bounded_url_dedup(stream).writeStream.format("memory").queryName("urls")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert spark.table("urls").where("published is not null").count() == 3
    assert spark.table("urls").where("published is null").count() == 2


def test_config():
    with pytest.raises(ConfigError):
        JobConfig().validate()
    for bad in (dict(since_hours=0), dict(categories=[]), dict(min_relevance=6)):
        with pytest.raises(ConfigError):
            JobConfig(sources=[SourceConfig("a")], **bad).validate()
    cfg = config_from_dict({"since_hours": 10, "connectors": [{"name": "a", "url": "u"},
                            {"name": "b", "type": "cisa_kev", "url": "u", "enabled": False}],
                            "llm": {"semantic_dedup": False}, "database": "d"})
    assert [s.name for s in cfg.enabled_sources()] == ["a"] and cfg.since_hours == 10
    assert not cfg.semantic_dedup and cfg.store_path == "d" and cfg.dedup_window_days == 45
