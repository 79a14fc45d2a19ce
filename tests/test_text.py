from datetime import datetime, timezone

from pyspark.sql import functions as F

from feedtriage.functions import dates as D, text as X


def values(spark, fn, *inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_strip_and_clean(spark):
    assert values(spark, X.strip, "  \n a b \t", "", None) == ["a b", "", None]
    assert values(spark, X.clean_html, "<p>a <b>b</b>\n c</p>", None, "1 < 2") == ["a b c", "", "1 < 2"]
    assert values(spark, X.opt_string, "  ", " x ", None) == [None, "x", None]


def test_slug(spark):
    assert values(spark, X.slug, "Ivanti Connect-Secure!", "***", None) == ["ivanti-connect-secure", "", ""]
    long = "a" * 79 + " b"
    assert values(spark, X.slug80, long) == ["a" * 79 + "-"]


def test_cves(spark):
    text = "x cve-2024-12345 CVE-2023-0001, CVE-2024-12345 CVE-99-1 CVE-2024-123"
    assert values(spark, X.cves_in_text, text, None) == [["CVE-2023-0001", "CVE-2024-12345"], []]
    assert values(spark, X.normalize_cve, "see cve-2024-12345!", "none") == ["CVE-2024-12345", ""]
    assert values(spark, X.normalize_cve_list, ["a cve-2024-1111", "no", "CVE-2024-1111", None],
                  kind="array<string>") == [["CVE-2024-1111", "CVE-2024-1111"]]
    assert values(spark, X.cves_from_json, '["b-2","A-1","B-2"]', "bad", None) == [["A-1", "B-2"], [], []]
    assert values(spark, lambda c: X.append_cve(c, F.lit("CVE-1")), "t", "t CVE-1") == [
        "t (CVE-1)", "t CVE-1"]


def test_header_safe(spark):
    got = values(spark, X.header_safe, "a — b…", "“q” ‘r’", "naïve", "Łódź 🛡", "x y 🛡", None)
    assert got == ["a - b...", "\"q\" 'r'", "naïve", "odz", "x y", None]
    for text in got[:-1]:
        text.encode("latin-1")


def test_link_header(spark):
    head = '<https://x/1>; rel="prev", <https://x/3>; rel="next"'
    assert values(spark, X.next_page_link, '<https://x/3>; rel="next"', "none") == ["https://x/3", None]
    assert values(spark, X.next_page_link, head)[0].endswith("https://x/3")


def test_dates(spark):
    utc = lambda *a: datetime(*a, tzinfo=timezone.utc)
    show = lambda fn: lambda c: F.date_format(fn(c), "yyyy-MM-dd HH:mm:ss")
    assert values(spark, show(D.iso_timestamp), "2026-07-07T13:01:01Z", "2026-07-07T13:01:01+02:00",
                  "2026-07-07", "soon", "2026", None) == [
        "2026-07-07 13:01:01", "2026-07-07 11:01:01", "2026-07-07 00:00:00", None, None, None]
    assert values(spark, show(D.day_timestamp), "2026-07-07", "07.07.2026", None) == [
        "2026-07-07 00:00:00", None, None]
    assert values(spark, show(D.rfc822_timestamp), "Tue, 07 Jul 2026 13:01:01 +0200",
                  "7 jul 26 13:01 GMT", "Tue, 7 Jul 2026 13:01:01 PDT", "never",
                  "Tuesday, 07 Jul 2026 13:01:01") == [
        "2026-07-07 11:01:01", "2026-07-07 13:01:00", "2026-07-07 20:01:01", None,
        "2026-07-07 13:01:01"]
    df = spark.sql("select timestamp'2026-07-07 13:01:01' a, timestamp'2026-07-07 13:01:01.5' b")
    assert list(df.select(D.rfc3339(F.col("a")), D.rfc3339(F.col("b"))).first()) == [
        "2026-07-07T13:01:01+00:00", "2026-07-07T13:01:01.500000+00:00"]


def test_matches_any_is_literal(spark):
    terms = ["c++", "a.b", "[x]", "0-day", "two words", "ünï", "back\\slash", "(|)"]
    texts = terms + ["cxx", "axb", "x", "0day", "twowords", "uni", "backslash", ""]
    got = values(spark, lambda c: X.matches_any(c, terms), *texts)
    assert got == [True] * len(terms) + [False] * 8
    assert got == values(spark, lambda c: X.any_term(c, terms), *texts)
