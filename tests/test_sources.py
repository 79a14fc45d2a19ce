import json
from datetime import datetime, timedelta, timezone
from email.utils import format_datetime

from pyspark.sql import functions as F

from feedtriage.plans.config import SourceConfig
from feedtriage.schema import RAW
from feedtriage.sources import advisories, kev, raw as landing, registry, rss

NOW = datetime(2026, 7, 7, 12, 0, tzinfo=timezone.utc)
SINCE = NOW - timedelta(hours=24)


def raw(spark, *bodies):
    return spark.createDataFrame(
        [(s, p, NOW, b) for s, p, b in bodies], RAW)


def item(title, link, at, desc="d"):
    date = f"<pubDate>{format_datetime(at) if isinstance(at, datetime) else at}</pubDate>" if at else ""
    link = f"<link>{link}</link>" if link else ""
    return f"<item><title>{title}</title>{link}<description>{desc}</description>{date}</item>"


def channel(*items):
    return f'<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>{"".join(items)}</channel></rss>'


def test_rss_window_and_cleaning(spark):
    body = channel(
        item("one", "https://x/1", NOW - timedelta(hours=2), "&lt;p&gt;a &lt;b&gt;bold&lt;/b&gt;&lt;/p&gt;"),
        item("two", "https://x/2", NOW - timedelta(hours=20)),
        item("old", "https://x/3", NOW - timedelta(days=3)),
        item("undated", "https://x/4", None), item("nolink", "", NOW),
        item("zone", "https://x/5", "Mon, 06 Jul 2026 14:30:00 +0200"),
        item("named", "https://x/6", "Mon, 06 Jul 2026 08:30 EST"))
    df = rss.rss_articles(raw(spark, ("s", 0, body)), SINCE, NOW)
    rows = {r["title"]: r for r in df.collect()}
    assert set(rows) == {"one", "two", "undated", "zone", "named"}
    assert rows["one"]["summary"] == "a bold"
    assert [r["title"] for r in df.orderBy("entry_ord").collect()] == [
        "one", "two", "undated", "zone", "named"]
    stamp = {t: v for t, v in df.select("title", F.date_format("published", "MM-dd HH:mm")).collect()}
    assert stamp["undated"] == "07-07 12:00"
    assert stamp["zone"] == "07-06 12:30" and stamp["named"] == "07-06 13:30"


def test_atom_rdf_and_errors(spark):
    atom = ('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E</title>'
            '<link rel="self" href="https://self"/><link rel="alternate" href="https://alt"/>'
            '<updated>2026-07-07T10:00:00Z</updated><summary>s</summary></entry></feed>')
    rdf = ('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" '
           'xmlns:dc="http://purl.org/dc/elements/1.1/"><item><title>R</title><link>https://r</link>'
           '<dc:date>2026-07-07T09:00:00+02:00</dc:date></item></rdf:RDF>')
    guid = channel('<item><title>G</title><guid>https://g</guid></item>',
                   '<item><title>H</title><guid isPermaLink="false">id</guid></item>')
    data = raw(spark, ("a", 0, atom), ("r", 0, rdf), ("g", 0, guid), ("bad", 0, "not XML <<<"),
               ("none", 0, None))
    rows = {r["source"]: r for r in rss.rss_articles(data, SINCE, NOW).collect()}
    assert rows["a"]["url"] == "https://alt" and rows["r"]["url"] == "https://r"
    assert rows["g"]["url"] == "https://g" and set(rows) == {"a", "r", "g"}
    assert {r["source"] for r in rss.rss_errors(data).collect()} == {"bad", "none"}


def kev_doc(*entries):
    return json.dumps({"count": len(entries), "vulnerabilities": list(entries)})


def test_kev(spark):
    one = dict(cveID="CVE-2026-1111", vendorProject="Acme", product="Gate",
               vulnerabilityName="Acme Gate RCE", dateAdded="2026-07-07",
               shortDescription="bad flaw", requiredAction="patch it",
               knownRansomwareCampaignUse="Known")
    body = kev_doc(one, {**one, "cveID": "CVE-2000-1", "dateAdded": "2000-01-01"},
                   {"cveID": "CVE-2026-2222", "dateAdded": "2026-07-06", "shortDescription": None},
                   {**one, "cveID": ""}, {**one, "dateAdded": "soon"})
    data = raw(spark, ("k", 0, body), ("bad", 0, "{oops"))
    rows = {r["url"]: r for r in kev.kev_articles(data, SINCE).collect()}
    assert set(rows) == {kev.DETAIL_URL + "CVE-2026-1111", kev.DETAIL_URL + "CVE-2026-2222"}
    full = rows[kev.DETAIL_URL + "CVE-2026-1111"]
    assert full["title"] == "Acme Gate: Acme Gate RCE (CVE-2026-1111)"
    assert full["summary"] == (
        "CISA KEV — actively exploited. CVE-2026-1111. bad flaw | Required action: patch it"
        " | Known ransomware campaign use.")
    assert rows[kev.DETAIL_URL + "CVE-2026-2222"]["title"] == "(CVE-2026-2222)"
    assert {r["source"] for r in kev.kev_errors(data).collect()} == {"bad"}


def adv(hours, severity="critical", **more):
    at = (NOW - timedelta(hours=hours)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return {"ghsa_id": "GHSA-1", "cve_id": "CVE-2026-3333", "summary": "acme bug",
            "description": "text", "severity": severity, "html_url": f"https://a/{hours}",
            "published_at": at,
            "vulnerabilities": [{"package": {"ecosystem": "composer", "name": "acme/pkg"}}], **more}


def test_advisories(spark):
    page = json.dumps([adv(1), adv(2, "high"), adv(99 * 24)])
    rows = advisories.advisory_articles(raw(spark, ("g", 0, page)), SINCE).collect()
    assert [r["url"] for r in rows] == ["https://a/1"]
    assert rows[0]["title"] == "acme bug (CVE-2026-3333)"
    assert rows[0]["summary"] == ("GitHub Security Advisory. Severity: critical. CVE-2026-3333"
                                  " text Affected: composer/acme/pkg")
    pages = [json.dumps([adv(1)]), json.dumps([adv(2)]), '{"message": "limit"}',
             json.dumps([adv(3)])]
    data = raw(spark, *[("g", i, b) for i, b in enumerate(pages)])
    got = advisories.advisory_articles(data, SINCE, max_pages=10)
    assert {r["url"] for r in got.collect()} == {"https://a/1", "https://a/2"}
    capped = advisories.advisory_articles(data, SINCE, max_pages=1)
    assert {r["url"] for r in capped.collect()} == {"https://a/1"}
    assert [r["page_ord"] for r in advisories.advisory_errors(data).collect()] == [2]
    stopped = advisories.advisory_articles(
        raw(spark, ("g", 0, json.dumps([adv(1), adv(99), adv(2)]))), SINCE, early_stop=True)
    assert {r["url"] for r in stopped.collect()} == {"https://a/1"}


def test_advisory_packages(spark):
    names = [{"package": {"ecosystem": "npm", "name": f"p{i % 10}"}} for i in range(25)]
    names += [{"package": {"name": "bare"}}, {"package": None}, {"package": {"ecosystem": "x"}}]
    page = json.dumps([adv(1, vulnerabilities=names, severity="CRITICAL", description="x" * 600),
                       adv(2, severity=None)])
    rows = advisories.advisory_articles(raw(spark, ("g", 0, page)), SINCE).collect()
    assert len(rows) == 1
    expect = ", ".join(["bare"] + [f"npm/p{i}" for i in range(7)])
    assert rows[0]["summary"].endswith("x" * 500 + " Affected: " + expect)


def test_union_and_registry(spark):
    sources = [SourceConfig("b", "rss"), SourceConfig("a", "cisa_kev"),
               SourceConfig("g", "github_advisories", options={"severities": ["high"]}),
               SourceConfig("off", "rss", enabled=False), SourceConfig("odd", "gopher"),
               SourceConfig("silent", "rss")]
    data = raw(spark, ("b", 0, channel(item("t", "https://x/1", NOW))),
               ("a", 0, kev_doc({"cveID": "CVE-2026-1111", "dateAdded": "2026-07-07"})),
               ("g", 0, json.dumps([adv(1), adv(2, "high")])),
               ("off", 0, channel(item("t", "https://x/9", NOW))))
    entries, errors = registry.union_sources(data, sources, SINCE, NOW)
    rows = entries.where("in_window").orderBy("source_ord", "entry_ord").collect()
    assert [r["source"] for r in rows] == ["b", "a", "g"]
    assert rows[2]["url"] == "https://a/2"
    assert {(r["source"], r["error"]) for r in errors.collect()} == {
        ("odd", "unknown source type"), ("silent", "no payload")}


def test_landing_files(spark, tmp_path):
    for source, page, text in (("s", 0, channel(item("é", "https://x/1", NOW)).encode()),
                               ("l", 1, channel(item("ü", "https://x/2", NOW)).replace(
                                   '"1.0"', '"1.0" encoding="ISO-8859-1"').encode("latin-1"))):
        folder = tmp_path / f"source={source}" / f"page_ord={page}"
        folder.mkdir(parents=True)
        (folder / "body.xml").write_bytes(text)
    df = landing.read_landing(spark, str(tmp_path))
    rows = {r["source"]: r for r in rss.rss_articles(df, SINCE, NOW).collect()}
    assert rows["s"]["title"] == "é" and rows["l"]["title"] == "ü" and rows["l"]["page_ord"] == 1
