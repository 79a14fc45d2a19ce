import json

from pyspark.sql import functions as F

from feedtriage.operators import classify, filters, model


def classified(spark, *articles):
    df = spark.createDataFrame(list(articles), "title string, summary string")
    return {r["title"]: r for r in classify.heuristic_classify(df).collect()}


def test_heuristics(spark):
    rows = classified(
        spark, ("Beacon flaw", "windows cve-2024-12345"), ("RCE in WordPress plugin", ""),
        ("Quiet CVE-2024-99999", "0-day"), ("Company news", "new resource"), ("Gossip", "nothing"),
        ("***", "patch"))
    assert rows["Beacon flaw"]["category"] == "red_team"
    assert rows["Beacon flaw"]["relevance"] == 5
    assert rows["Beacon flaw"]["cve_ids"] == ["CVE-2024-12345"]
    assert rows["RCE in WordPress plugin"]["relevance"] == 2
    assert rows["RCE in WordPress plugin"]["canonical_key"] == "rce-in-wordpress-plugin"
    assert rows["Quiet CVE-2024-99999"]["category"] == "vulnerability"
    assert rows["Quiet CVE-2024-99999"]["is_zero_or_nday"]
    assert rows["Company news"]["category"] == "vulnerability"  # "resource" holds "rce"
    assert rows["Gossip"]["category"] == "other" and rows["Gossip"]["relevance"] == 3
    assert rows["***"]["canonical_key"] == "unknown"


FULL = {"category": " Red_Team ", "canonical_key": " A:B ", "one_line": "x" * 300,
        "is_zero_or_nday": True, "vendor": " V ", "product": "", "vuln_class": None,
        "cve_ids": ["cve-2024-11111", "junk", None, "CVE-2024-11111"], "severity": 9.8,
        "relevance": 4.7}
RESPONSES = {
    "plain": json.dumps(FULL),
    "fenced": "Sure:\n```json\n" + json.dumps({"category": "vulnerability", "relevance": "4"}) + "\n```",
    "prose": 'Here {"category": "vulnerability", "cve_ids": "CVE-2024-22222", "relevance": 9} ok',
    "broken": '{"category": "vulnerability"', "null": None, "list": '["vulnerability"]',
    "unknown": '{"category": "gossip", "relevance": "4.7", "vendor": "Acme Inc", "vuln_class": "RCE"}',
    "low": '{"category": "other", "relevance": -3, "is_zero_or_nday": "false"}',
    "odd": '{"category": "other", "relevance": "x"}',
    "flag": '{"category": "other", "relevance": true}',
}


def test_responses(spark):
    df = spark.createDataFrame([(k, "The Title", v) for k, v in RESPONSES.items()],
                               "name string, title string, response string")
    rows = {r["name"]: r for r in classify.parse_classification(df).collect()}
    full = rows["plain"]
    assert full["category"] == "red_team" and full["canonical_key"] == "a:b"
    assert full["one_line"] == "x" * 200 and full["is_zero_or_nday"]
    assert full["vendor"] == "V" and full["product"] is None and full["severity"] == "9.8"
    assert full["cve_ids"] == ["CVE-2024-11111", "CVE-2024-11111"] and full["relevance"] == 4
    assert rows["fenced"]["category"] == "vulnerability" and rows["fenced"]["relevance"] == 4
    assert rows["fenced"]["canonical_key"] == "the-title"
    assert rows["prose"]["cve_ids"] == ["CVE-2024-22222"] and rows["prose"]["relevance"] == 5
    for name in ("broken", "null", "list"):
        r = rows[name]
        assert (r["category"], r["canonical_key"], r["one_line"]) == ("other", "", "The Title")
        assert r["cve_ids"] == [] and r["relevance"] is None
    assert rows["unknown"]["category"] == "other" and rows["unknown"]["relevance"] is None
    assert rows["unknown"]["canonical_key"] == "acme-inc:rce"
    assert rows["low"]["relevance"] == 1 and not rows["low"]["is_zero_or_nday"]
    assert rows["odd"]["relevance"] is None and rows["flag"]["relevance"] == 1


def test_match_parse(spark):
    texts = ['{"match_id": 7}', '{"match_id": " 7 "}', '{"match_id": true}', '{"match_id": null}',
             '{"match_id": "x"}', '{"match_id": 8}', "no", '{"match_id": 7.5}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    df = df.withColumn("ids", F.array(F.lit(7).cast("long")))
    got = [r["match_id"] for r in classify.parse_match(df).orderBy("i").collect()]
    assert got == [7, 7, None, None, None, 8, None, None]
    checked = [r["match_id"] for r in classify.parse_match(df, candidates="ids").orderBy("i").collect()]
    assert checked == [7, 7, None, None, None, None, None, None]


def test_gates(spark):
    df = spark.createDataFrame(
        [("s", "vulnerability", 5), ("s", "vulnerability", 1), ("s", "red_team", None),
         ("s", "other", 5), ("s", None, 5)], "source string, category string, relevance int")
    assert filters.category_gate(df).count() == 3
    assert filters.category_gate(df, ["red_team"]).count() == 1
    assert filters.relevance_gate(df, 3).count() == 4


def test_prefilter_and_bypass(spark):
    df = spark.createDataFrame([("a", "Resource", ""), ("b", "x", "y"), ("c", "x", None)],
                               "source string, title string, summary string")
    src = spark.createDataFrame([("b", True), ("a", False)], "name string, bypass_prefilter boolean")
    names = lambda d: sorted(r["source"] for r in d.collect())
    assert names(filters.keyword_prefilter(df, {"g": ["RCE"]})) == ["a"]
    assert names(filters.keyword_prefilter(df, {})) == ["a", "b", "c"]
    assert names(filters.keyword_prefilter(df, {"g": ["rce"]}, src)) == ["a", "b"]


def test_model_calls(spark):
    def make():
        def fn(prompts):
            if any("boom" in p for p in prompts):
                raise RuntimeError("no")
            return [p.upper() for p in prompts]
        return fn

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", None, "boom", "b"])],
                               "i int, p string").coalesce(1)
    got = [r["out"] for r in model.with_model(df, "p", "out", make, 3).orderBy("i").collect()]
    assert got == ["A", None, None, "B"]


def test_candidate_blocks(spark):
    seen = spark.sql("""select id, concat('k', id) canonical_key, array('CVE-1') cve_ids, 't' title,
        'd' description, timestamp_seconds(id) first_seen_at from range(1, 51)""")
    links = spark.sql("select 1L seq, id from range(1, 51) union all select 2L, 3L")
    blocks = model.candidate_blocks(links, seen, page_lines=10).collect()
    one = [b for b in blocks if b["seq"] == 1]
    assert sorted(i for b in one for i in b["candidate_ids"]) == list(range(1, 51)) and len(one) > 1
    for b in one:
        assert b["candidate_ids"] == sorted(b["candidate_ids"], reverse=True)
    two = next(b for b in blocks if b["seq"] == 2)
    assert two["block"] == "[3] key=k3 cves=CVE-1 :: t — d"
    items = spark.createDataFrame([(2, "k", [], "T", "S")],
                                  "seq long, canonical_key string, cve_ids array<string>, title string, summary string")
    prompt = model.match_prompts(items, spark.createDataFrame(blocks)).first()["prompt"]
    assert prompt == ("NEW ITEM:\nkey=k cves=none\ntitle: T\nsummary: S\n\n"
                      "ALREADY-REPORTED ITEMS:\n[3] key=k3 cves=CVE-1 :: t — d")
