"""Plain SQL with the same results as the driver queries, for another engine."""

from __future__ import annotations

_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
_CVE = r"(?i)CVE-\p{Nd}{4}-\p{Nd}{4,}"
_CLOCK = "'%Y-%m-%d %H:%M:%S'"
_RUN = "TIMESTAMP '2024-02-01 00:00:00'"
_SINCE = "TIMESTAMP '2024-01-01 03:00:00'"


def _strip(x):
    return f"regexp_replace({x}, '^{_SPACE}|{_SPACE}$', '', 'g')"


def _clean(x):
    return (f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'),"
            f" '{_SPACE}', ' ', 'g'))")


def _slug(x):
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '-', 'g'), '-')"


def _clock(x):
    return f"strftime({x}, {_CLOCK})"


def _has(text, terms):
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def _cves_in(text):
    return f"list_sort(list_distinct([upper(x) for x in regexp_extract_all({text}, '{_CVE}')]))"


_DOCS = """docs AS (
  SELECT doc_id AS seq, source, split_part(text, chr(10), 1) AS title,
         'https://feed.example/' || lang || '/' || n_chars AS url, text AS summary,
         CASE WHEN lang <> 'es' THEN TIMESTAMP '2024-01-01' + to_minutes(doc_id) END AS published,
         lang, n_chars
  FROM documents)"""

_PAGES = f"""parts AS (
  SELECT page_id AS seq, regexp_extract(url, '^https?://([^/]+)', 1) AS source,
         {_clean("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title, url,
         {_clean("html")} AS summary
  FROM pages)"""

_ITEMS = _DOCS + """, items AS (
  SELECT d.*, quality, toxic, lang || ':' || length(title) AS canonical_key,
         CASE WHEN lang IN ('en', 'fr') THEN 'vulnerability' WHEN lang = 'de' THEN 'red_team'
              ELSE 'other' END AS category,
         substr(title, 1, 140) AS one_line, coalesce(toxic = 1, false) AS is_zero_or_nday,
         CASE WHEN lang = 'de' THEN source END AS vendor,
         CASE WHEN lang = 'fr' THEN 'p-' || source END AS product,
         CASE WHEN lang = 'en' THEN 'rce' END AS vuln_class,
         CASE WHEN lang IN ('en', 'de') THEN ['CVE-2024-' || (n_chars + 10000),
                                              'cve-2023-' || (length(title) + 10000)]
              WHEN lang = 'fr' THEN ['cve-2023-' || (length(title) + 10000)]
              ELSE []::VARCHAR[] END AS cve_ids,
         CASE WHEN quality = 1 THEN 'high' END AS severity,
         CAST(quality * 4 + 1 AS INTEGER) AS relevance,
         CASE WHEN lang = 'de' THEN [url, url || '?alt'] ELSE [url] END AS urls
  FROM docs d LEFT JOIN labels l ON l.doc_id = d.seq)"""

_SEEN = """paths AS (
  SELECT page_id, regexp_extract(url, '/([a-z]{2})/([0-9]+)', 1) AS lang,
         regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2) AS number,
         regexp_extract(url, '^https?://([^/]+)', 1) AS source,
         regexp_extract(html, '<title>(.*?)</title>', 1) AS title
  FROM pages), seen AS (
  SELECT page_id + 1 AS id, CASE WHEN lang = 'de' THEN 'red_team' ELSE 'vulnerability' END AS category,
         CASE WHEN lang = 'en' THEN 'rce' END AS vuln_class,
         lang || ':' || length(title) AS canonical_key,
         ['CVE-2024-' || (CAST(number AS BIGINT) + 10000)] AS cve_ids,
         title AS description, title, source, 'https://feed.example/' || lang || '/' || number AS url,
         TIMESTAMP '2024-01-01' + to_hours(page_id) AS first_seen_at
  FROM paths)"""

_EVENTS = """stored AS (
  SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'vulnerability' WHEN 'click' THEN 'red_team'
                              ELSE event_type END AS category,
         CASE WHEN value > 50 THEN 'big' END AS vuln_class, 'user:' || user_id AS canonical_key,
         CASE WHEN event_type = 'error' THEN ['CVE-2024-' || (event_id + 10000)]
              ELSE []::VARCHAR[] END AS cve_ids,
         props AS description, 'event ' || event_id AS title, event_type AS source,
         'https://events.example/?id=' || event_id || '&u=' || user_id AS url, ts AS first_seen_at
  FROM events)"""

_WITH = lambda *parts: "WITH " + ", ".join(parts) + "\n"


def _dedup(rows: str, store: bool, visible: bool = True, semantic: bool = False,
           pairs: bool = False, head: str = "", final: str | None = None) -> str:
    """The sequential rules, one item per step of a recursive query.

    The state is the list of claimed tokens (as hashes) and the list of CVE ids
    per record, which starts with the store's own.
    """
    seen = "seen" if store else "(SELECT * FROM seen WHERE false)"
    size = "split_part(url, '/', 5)"
    recent = f"first_seen_at >= {_RUN} - INTERVAL 25 DAYS"
    parts = [head] if head else [_ITEMS]
    parts += [_SEEN]
    parts.append(f"""batch AS (SELECT seq, url, canonical_key AS k,
       list_distinct_ordered AS cves, {size} AS size FROM (
       SELECT *, CASE WHEN len(cve_ids) = 0 THEN []::VARCHAR[] ELSE [upper(c) for c in cve_ids] END
              AS list_distinct_ordered FROM {rows}))""")
    parts.append(f"first_key AS (SELECT canonical_key AS k, min(id) AS id FROM {seen} s GROUP BY 1)")
    parts.append(f"first_url AS (SELECT DISTINCT url FROM {seen} s)")
    parts.append(f"""newest_size AS (SELECT {size} AS size, arg_max(id, (first_seen_at, id)) AS id
       FROM {seen} s WHERE {recent} GROUP BY 1)""")
    parts.append(f"""given AS (SELECT doc_id AS seq, CASE WHEN lang <> 'fr' THEN n_chars END AS cand,
       CASE WHEN lang = 'fr' THEN n_chars END AS record,
       1.0::DOUBLE / (1 + length(split_part(text, chr(10), 1))) AS score FROM documents)""")
    parts.append("""links AS (SELECT greatest(g.seq, cand) AS seq, least(g.seq, cand) AS cand, max(score) AS score
       FROM given g JOIN batch b ON b.seq = g.cand WHERE g.seq <> cand GROUP BY 1, 2)""")
    parts.append("link_lists AS (SELECT seq, list({'c': cand, 's': score}) AS links FROM links GROUP BY 1)")
    parts.append(f"""link_store AS (SELECT g.seq, arg_max(record, (score, -record)) AS id, max(score) AS score
       FROM given g JOIN {seen} s ON s.id = g.record WHERE {recent} GROUP BY 1)""")
    parts.append("""ordered AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY b.seq) AS rn, b.seq, hash('u' || b.url) AS u, hash('k' || b.k) AS kh,
         b.cves, [hash('c' || c) for c in b.cves] AS ch, hash('s' || b.size) AS sh,
         f.url IS NOT NULL AS s_url, fk.id AS s_key, ns.id AS s_size,
         ll.links, ls.id AS s_link, ls.score AS s_score
  FROM batch b LEFT JOIN first_url f ON f.url = b.url LEFT JOIN first_key fk ON fk.k = b.k
       LEFT JOIN newest_size ns ON ns.size = b.size
       LEFT JOIN link_lists ll ON ll.seq = b.seq LEFT JOIN link_store ls ON ls.seq = b.seq)""")
    start = (f"(SELECT list({{'c': c, 'r': id}}) FROM (SELECT unnest(cve_ids) AS c, id FROM {seen} s))"
             if store else "[]::STRUCT(c VARCHAR, r BIGINT)[]")
    sem_claim = ", hash('i' || seq)" + (", sh" if semantic else "")
    if semantic:
        layer3 = """WHEN s_size IS NOT NULL OR list_contains(claimed, sh) THEN 'layer3:semantic'"""
        rid3 = "s_size"
    elif pairs:
        layer3 = "WHEN s_link IS NOT NULL OR p_score IS NOT NULL THEN 'layer3:semantic'"
        rid3 = "CASE WHEN s_link IS NOT NULL AND (p_score IS NULL OR s_score >= p_score) THEN s_link END"
    else:
        layer3, rid3 = "", "NULL"
    add = ("CASE WHEN rid IS NOT NULL THEN list_concat(added, [{'c': c, 'r': rid} for c in cves]) ELSE added END"
           if visible else "added")
    parts.append(f"""steps AS (
  SELECT 0::BIGINT AS rn, NULL::BIGINT AS seq, []::UBIGINT[] AS claimed, {start} AS added,
         ''::VARCHAR AS reason, NULL::BIGINT AS rid
  UNION ALL
  SELECT rn, seq, CASE WHEN reason = '' THEN list_concat(claimed, list_concat([u, kh{sem_claim}], ch))
                       ELSE claimed END, {add}, reason, rid
  FROM (SELECT *, CASE reason WHEN 'layer1:cve' THEN c_rid WHEN 'layer2:canonical-key' THEN s_key
                       WHEN 'layer3:semantic' THEN {rid3} END AS rid
    FROM (SELECT *, CASE WHEN s_url THEN 'layer1:url-seen'
                 WHEN list_contains(claimed, u) THEN 'layer1:url-seen(pending)'
                 WHEN c_rid IS NOT NULL THEN 'layer1:cve'
                 WHEN list_has_any(claimed, ch) THEN 'layer1:cve(pending)'
                 WHEN s_key IS NOT NULL THEN 'layer2:canonical-key'
                 WHEN list_contains(claimed, kh) THEN 'layer2:canonical-key(pending)'
                 {layer3} ELSE '' END AS reason
      FROM (SELECT o.*, s.claimed, s.added,
              [r for r in [list_min([a.r for a in s.added if a.c = x]) for x in o.cves]
                 if r IS NOT NULL][1] AS c_rid,
              list_max([l.s for l in o.links if list_contains(s.claimed, hash('i' || l.c))]) AS p_score
            FROM steps s JOIN ordered o ON o.rn = s.rn + 1))))""")
    final = final or """SELECT seq, reason <> '' AS is_duplicate, reason,
       rid AS matched_record_id FROM steps WHERE rn > 0"""
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + final


_FIRST_CVE = """hits AS (
  SELECT seq, arg_min(id, (pos, id)) AS record_id FROM (
    SELECT i.seq, i.pos, s.id
    FROM (SELECT seq, upper(unnest(cve_ids)) AS c, generate_subscripts(cve_ids, 1) AS pos FROM items) i
    JOIN (SELECT id, unnest(cve_ids) AS c FROM seen) s ON s.c = i.c) GROUP BY seq)"""

_META = """concat_ws(' · ', CASE WHEN is_zero_or_nday THEN 'zero/n-day' END,
   CASE WHEN relevance <> 0 THEN 'relevance ' || relevance || '/5' END, severity, vuln_class,
   nullif(array_to_string(cve_ids, ', '), ''))"""


def _messages(source: str) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY
         CASE category WHEN 'vulnerability' THEN 0 WHEN 'red_team' THEN 1 ELSE 2 END,
         coalesce(relevance, 0) DESC, seq) AS BIGINT) AS position,
       coalesce(nullif(product, ''), nullif(vendor, ''), nullif(canonical_key, ''), title) AS title,
       concat_ws(chr(10) || chr(10), CASE WHEN {_META} <> '' THEN '_' || {_META} || '_' END,
         coalesce(nullif(summary, ''), one_line),
         CASE WHEN len(urls) = 1 THEN '[Read more](' || urls[1] || ')'
              ELSE 'Sources: [1](' || urls[1] || ') · [2](' || urls[2] || ')' END) AS body,
       CASE category WHEN 'vulnerability' THEN 'shield,rotating_light'
            WHEN 'red_team' THEN 'dart,crossed_swords' ELSE 'newspaper' END AS tags
FROM {source}"""


def _classified(source: str, cves: str) -> str:
    """CTEs with the keyword classification of a table of articles."""
    return f"""low AS (SELECT *, lower({_strip("title || chr(10) || chr(10) || summary")}) AS t,
           {cves} AS found FROM {source}),
     classed AS (SELECT *,
       CASE WHEN {_has("t", ["license", "mail"])} THEN 'red_team'
            WHEN len(found) > 0 OR {_has("t", ["ung", "ción", "ement"])} THEN 'vulnerability'
            ELSE 'other' END AS category,
       coalesce(nullif(substr({_slug("title")}, 1, 80), ''), 'unknown') AS canonical_key,
       substr(title, 1, 140) AS one_line, {_has("t", ["tion", "heit"])} AS is_zero_or_nday,
       CASE WHEN {_has("t", ["the ", "license"])} THEN 5
            WHEN {_has("t", ["sch", "que"])} THEN 2 ELSE 3 END AS relevance FROM low)"""


_PASSES = _has("lower(title || chr(10) || chr(10) || summary)", ["license", "@", "mail", "heit"])
_NUMBER = "CAST(substr(source, 4) AS INTEGER)"

# The whole job: sources in list order, one document per payload.
_TRIAGE_HEAD = (_DOCS + f""", entries AS (
  SELECT source, seq AS page_ord, {_clean("title")} AS title, url, {_clean("summary")} AS summary,
         published IS NULL OR published >= {_SINCE} AS in_window, published IS NULL AS undated
  FROM docs WHERE source NOT IN ('src5', 'src6')),
kept AS (SELECT * FROM entries WHERE in_window AND ({_NUMBER} >= 10 OR {_PASSES})),
""" + _classified("kept", _cves_in("title || chr(10) || chr(10) || summary")) + f""",
wanted AS (SELECT *, found AS cve_ids, row_number() OVER (ORDER BY {_NUMBER}, page_ord) - 1 AS seq
  FROM classed WHERE category IN ('vulnerability', 'red_team') AND relevance >= 3)""")

_STEP_ITEMS = "steps JOIN wanted w ON w.seq = steps.seq WHERE rn > 0"


def _triage(final: str) -> str:
    return _dedup("wanted", store=True, head=_TRIAGE_HEAD, final=final)


_COUNTED = f"""SELECT source, CAST(sum(f) AS BIGINT) AS fetched, CAST(sum(w) AS BIGINT) AS in_window,
  CAST(sum(u) AS BIGINT) AS undated, CAST(sum(p) AS BIGINT) AS prefiltered,
  CAST(sum(i) AS BIGINT) AS classified_interesting, CAST(sum(l) AS BIGINT) AS low_relevance,
  CAST(sum(n) AS BIGINT) AS new_items, CAST(sum(d) AS BIGINT) AS duplicates FROM (
  SELECT source, 1 AS f, CAST(in_window AS INT) AS w, CAST(in_window AND undated AS INT) AS u,
         0 AS p, 0 AS i, 0 AS l, 0 AS n, 0 AS d FROM entries
  UNION ALL SELECT source, 0, 0, 0, 1, CAST(category <> 'other' AS INT),
         CAST(category <> 'other' AND relevance < 3 AS INT), 0, 0 FROM classed
  UNION ALL SELECT source, 0, 0, 0, 0, 0, 0, CAST(reason = '' AS INT), CAST(reason <> '' AS INT)
         FROM {_STEP_ITEMS}) GROUP BY ROLLUP (source)"""

_XML = lambda x: (f"replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),"
                  " '\"', '&quot;')")

_LABEL = "CASE category WHEN 'red_team' THEN 'red-team' ELSE category END"

ORACLES = {
    "articles_clean_html": _WITH(_PAGES) + f"""SELECT seq, title,
        {_strip("title || chr(10) || chr(10) || summary")} AS text FROM parts""",
    "scalar_text": _WITH(_DOCS) + f"""SELECT seq, {_slug("title")} AS slug,
        substr({_slug("summary")}, 1, 80) AS slug80,
        'CVE-2024-' || (n_chars + 10000) AS cve, upper(regexp_extract(title, '{_CVE}')) AS no_cve,
        source || ' CVE-2024-' || (n_chars + 10000) AS named,
        source || ' (CVE-2024-' || (n_chars + 10000) || ')' AS appended, source AS bare,
        CASE WHEN lang = 'en' THEN source END AS optional,
        'CVE-2024-' || (n_chars + 10000) || ',CVE-2024-' || (n_chars + 10000) AS cves FROM docs""",
    "cve_extract": _WITH(_DOCS) + f"""SELECT seq, array_to_string({_cves_in(
        "summary || ' cve-2024-' || (n_chars + 10000) || ' CVE-2023-' || (length(title) + 10000)"
        " || ' Cve-2024-' || (n_chars + 10000) || ' CVE-2024-' || length(source)")}, ',') AS cves
        FROM docs""",
    "date_parsing": f"""SELECT event_id,
        {_clock("date_trunc('second', ts) + CASE event_type WHEN 'click' THEN INTERVAL '-2' HOUR WHEN 'view' THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END")} AS mail,
        {_clock("date_trunc('second', ts) + CASE event_type WHEN 'click' THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END")} AS iso,
        {_clock("CAST(date_trunc('day', ts) AS TIMESTAMP)")} AS day, true AS bad,
        CASE WHEN date_trunc('second', ts) = ts THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00')
             ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS rfc3339,
        strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS whole FROM events""",
    "next_page_links": """SELECT page_id, CASE WHEN starts_with(url, 'https') THEN url END AS next
        FROM pages""",
    "header_safe_titles": _WITH(_PAGES) + """SELECT seq,
        '"' || title || '" - ''ok''...' AS title FROM parts""",
    "rss_source": _WITH(_DOCS) + f"""SELECT CAST(seq AS INTEGER) AS seq, source, {_clean("title")} AS title,
        url, {_clean("summary")} AS summary, {_clock(f"coalesce(published, {_RUN})")} AS published
        FROM docs WHERE published IS NULL OR published >= {_SINCE}""",
    "catalogue_source": """SELECT p_brand AS source,
        trim(p_brand || ' ' || CASE WHEN p_type <> 'SMALL' THEN p_name ELSE '' END || ': : ' || p_type, ': ')
          || ' (CVE-2024-' || (p_partkey + 10000) || ')' AS title,
        'https://nvd.nist.gov/vuln/detail/CVE-2024-' || (p_partkey + 10000) AS url,
        'CISA KEV — actively exploited. CVE-2024-' || (p_partkey + 10000) || '. ' || concat_ws(' | ', p_name,
          CASE WHEN p_size > 25 THEN 'Required action: replace ' || p_name END,
          CASE WHEN p_type = 'ECONOMY' THEN 'Known ransomware campaign use.' END) AS summary,
        strftime(DATE '2024-01-01' + p_size, '%Y-%m-%d 00:00:00') AS published
        FROM part WHERE DATE '2024-01-01' + p_size >= DATE '2024-01-16'""",
    "advisory_source": f"""SELECT o_orderpriority AS source,
        CASE WHEN o_orderstatus <> 'F' THEN 'order ' || o_orderkey ELSE 'GHSA-' || o_orderkey END
          || CASE WHEN o_orderstatus <> 'P' THEN ' (CVE-2024-' || o_orderkey || ')' ELSE '' END AS title,
        'https://orders.example/' || o_orderkey AS url,
        concat_ws(' ', 'GitHub Security Advisory. Severity: ' || o_orderpriority || '.',
          CASE WHEN o_orderstatus <> 'P' THEN 'CVE-2024-' || o_orderkey END,
          'by customer ' || o_custkey, 'Affected: ' || o_orderstatus || ', z/' || o_custkey) AS summary,
        {_clock("o_orderdate")} AS published FROM orders
        WHERE lower(o_orderpriority) IN ('1-urgent', '2-high') AND o_orderdate >= TIMESTAMP '1997-01-01'""",
    "source_errors": """SELECT source, 'feed could not be parsed' AS error, count(*) AS payloads
        FROM documents GROUP BY 1, 2""",
    "source_dimension": f"""SELECT source AS name,
        CASE WHEN source = 'src6' THEN 'gopher' ELSE 'rss' END AS type, {_NUMBER} AS source_ord,
        {_NUMBER} >= 10 AS bypass_prefilter, count(*) AS documents
        FROM documents WHERE source <> 'src5' GROUP BY 1, 2, 3, 4""",
    "union_order": _WITH(_DOCS) + """SELECT source_ord, entry_ord, url,
        row_number() OVER (ORDER BY source_ord, entry_ord) - 1 AS seq FROM (
          SELECT 0 AS source_ord, page_id AS entry_ord, url FROM pages
          UNION ALL SELECT 1, seq, url FROM docs)""",
    "store_import": f"""SELECT event_id AS id, CASE WHEN event_type = 'view' THEN ''
        ELSE 'CVE-1999-0001,CVE-2024-' || (event_id + 10000) END AS cves,
        {_clock("ts")} AS first_seen_at FROM events""",
    "lookback_instant": _WITH(_DOCS) + f"""SELECT seq, source,
        {_clock(f"coalesce(published, {_RUN})")} AS published FROM docs
        WHERE published IS NULL OR published >= {_SINCE}""",
    "lookback_day": f"""SELECT l_returnflag, count(*) AS n, {_clock("min(l_shipdate)")} AS first
        FROM lineitem WHERE CAST(l_shipdate AS DATE) >= DATE '1999-06-17' GROUP BY 1""",
    "lookback_early_stop": """SELECT event_type, event_id FROM (
        SELECT *, max(coalesce(CAST(known < TIMESTAMP '2024-01-02' AS INT), 0)) OVER (PARTITION BY event_type
          ORDER BY user_id, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stopped
        FROM (SELECT *, CASE WHEN event_id % 50 <> 0 THEN ts END AS known FROM events))
        WHERE stopped = 0 AND known IS NOT NULL""",
    "enabled_category": _WITH(_ITEMS) + "SELECT seq, category FROM items WHERE category = 'red_team'",
    "rss_partly_broken": """SELECT CAST(doc_id AS INT) AS page_ord, CAST(e AS INT) AS entry_ord,
        'https://feeds.example/' || doc_id || ['/a', '/b', '/c'][e + 1] AS url,
        ['AT&T & co', 'fish © & chips < 3 < 4 €', 'three'][e + 1] AS title,
        CASE e WHEN 0 THEN 'an n &amp; more' ELSE '' END AS summary, NULL::VARCHAR AS error
        FROM documents, range(3) AS r(e) WHERE e < 2 OR doc_id % 3 <> 0
        UNION ALL SELECT CAST(doc_id AS INT), NULL, NULL, NULL, NULL, '1 entries could not be parsed' FROM documents WHERE doc_id % 3 = 0""",
    "advisory_two_fetches": """SELECT o_orderpriority AS source, CAST(o_orderkey AS INT) AS page_ord,
        'https://orders.example/' || o_orderkey AS url FROM (
          SELECT *, min(CASE WHEN o_orderkey % 2 = 1 AND o_orderkey > 3000 AND o_orderkey % 101 = 0 THEN o_orderkey END)
            OVER (PARTITION BY o_orderpriority, o_orderkey % 2) AS broken FROM orders)
        WHERE broken IS NULL OR o_orderkey < broken""",
    "advisory_many_pages": """SELECT o_orderpriority AS source, count(*) AS n,
        count(*) FILTER (o_orderkey >= 500) AS beyond_cap FROM orders GROUP BY 1""",
    "keyword_prefilter": _WITH(_DOCS) + f"SELECT seq FROM docs WHERE {_PASSES}",
    "prefilter_bypass": _WITH(_DOCS) + f"""SELECT seq, source FROM docs
        WHERE {_NUMBER} >= 10 OR {_PASSES}""",
    "relevance_fail_open": _WITH(_ITEMS) + """SELECT seq, category, relevance FROM items
        WHERE category IN ('vulnerability', 'red_team') AND (relevance IS NULL OR relevance >= 3)""",
    "severity_allow_list": """SELECT o_orderkey, o_orderpriority FROM orders
        WHERE lower(o_orderpriority) IN ('1-urgent', '5-low')""",
    "page_cap": "SELECT conv_id, turn, role FROM conversations WHERE turn < 3",
    "heuristic_classify": _WITH(_DOCS, """marked AS (SELECT * REPLACE (CASE WHEN lang = 'es'
        THEN summary || ' cve-2024-' || (n_chars + 10000) ELSE summary END AS summary) FROM docs)""",
        _classified("marked", _cves_in("title || chr(10) || chr(10) || summary"))) + """
        SELECT seq, category, canonical_key, one_line, is_zero_or_nday,
               array_to_string(found, ',') AS cves, relevance FROM classed""",
    "model_response_parse": """WITH e AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k,
          'Event ' || event_id AS title FROM events)
        SELECT event_id, CASE event_type WHEN 'click' THEN 'vulnerability' WHEN 'view' THEN 'red_team'
                              ELSE 'other' END AS category,
          CASE event_type WHEN 'click' THEN 'acme-' || k WHEN 'view' THEN 'u:' || user_id
               WHEN 'signup' THEN 'p-' || k ELSE '' END AS canonical_key,
          CASE event_type WHEN 'click' THEN 'line ' || event_id ELSE title END AS one_line,
          event_type = 'signup' AS is_zero_or_nday,
          CASE WHEN event_type = 'click' THEN 'Acme ' || k END AS vendor,
          CASE WHEN event_type = 'signup' THEN 'P ' || k END AS product,
          CAST(NULL AS VARCHAR) AS vuln_class,
          CASE event_type WHEN 'click' THEN 'CVE-2024-' || (event_id + 10000)
               WHEN 'signup' THEN 'CVE-2023-0001' ELSE '' END AS cves,
          CASE WHEN event_type IN ('click', 'view') THEN greatest(1, least(5, k))
               WHEN event_type = 'signup' THEN 4 END AS relevance FROM e""",
    "match_response_parse": """SELECT event_id,
        CASE WHEN event_type IN ('click', 'view') THEN user_id END AS match_id FROM events""",
    "model_answers": """SELECT conv_id, turn,
        're: Title: ' || role || chr(10) || chr(10) || 'Summary: ' || text AS answer
        FROM conversations""",
    "match_prompts": _WITH(_ITEMS, _SEEN, """links AS (SELECT DISTINCT i.seq, s.id FROM
          (SELECT seq, upper(unnest(cve_ids)) AS c FROM items) i
          JOIN (SELECT id, unnest(cve_ids) AS c FROM seen) s ON s.c = i.c),
        blocks AS (SELECT l.seq, string_agg('[' || s.id || '] key=' || canonical_key || ' cves='
            || array_to_string(cve_ids, ',') || ' :: ' || title || ' — ' || description, chr(10)
            ORDER BY first_seen_at DESC, s.id DESC) AS block
          FROM links l JOIN seen s ON s.id = l.id GROUP BY 1)""") + """
        SELECT seq, 0 AS page, 'NEW ITEM:' || chr(10) || 'key=' || canonical_key || ' cves='
          || CASE WHEN len(cve_ids) = 0 THEN 'none' ELSE array_to_string(cve_ids, ',') END || chr(10)
          || 'title: ' || title || chr(10) || 'summary: ' || summary || chr(10) || chr(10)
          || 'ALREADY-REPORTED ITEMS:' || chr(10) || block AS prompt
        FROM items JOIN blocks USING (seq)""",
    "summaries": _WITH(_ITEMS) + """SELECT seq, CASE WHEN category = 'other' OR summary = ''
        THEN one_line ELSE summary END AS summary FROM items""",
    "url_anti_join": _WITH(_ITEMS, _SEEN) + """SELECT seq, url FROM items
        WHERE url NOT IN (SELECT url FROM seen)""",
    "url_semi_join": _WITH(_ITEMS, _SEEN) + """SELECT seq, url FROM items
        WHERE url IN (SELECT url FROM seen)""",
    "cve_first_match": _WITH(_ITEMS, _SEEN, _FIRST_CVE) + "SELECT seq, record_id FROM hits",
    "key_first_match": _WITH(_ITEMS, _SEEN) + """SELECT i.seq, min(s.id) AS record_id FROM items i
        JOIN seen s ON s.canonical_key = i.canonical_key GROUP BY 1""",
    "recent_key_match": _WITH(_ITEMS, _SEEN) + f"""SELECT i.seq,
        arg_max(s.id, (s.first_seen_at, s.id)) AS record_id FROM items i
        JOIN seen s ON s.canonical_key = i.canonical_key
        WHERE s.first_seen_at >= {_RUN} - INTERVAL 25 DAYS GROUP BY 1""",
    "recent_candidates": f"""SELECT event_id AS id, {_clock("ts")} AS first_seen_at FROM events
        WHERE ts >= {_RUN} - INTERVAL 10 DAYS""",
    "candidate_union": _WITH(_ITEMS, _SEEN) + f"""SELECT id, canonical_key, title,
          array_to_string(cve_ids, ',') AS cves, url, {_clock("first_seen_at")} AS first_seen_at
        FROM seen WHERE first_seen_at >= {_RUN} - INTERVAL 25 DAYS
        UNION ALL SELECT NULL, canonical_key, title, array_to_string(cve_ids, ','), url,
          {_clock("published")} FROM items""",
    "record_by_id": _WITH(_SEEN) + "SELECT id, title, url FROM seen WHERE id = 42",
    "store_dedup": _WITH(_ITEMS, _SEEN, _FIRST_CVE, """keyed AS (
        SELECT canonical_key, min(id) AS id FROM seen GROUP BY 1)""") + """
        SELECT i.seq, reason <> '' AS is_duplicate, reason,
          CASE reason WHEN 'layer1:cve' THEN record_id WHEN 'layer2:canonical-key' THEN kid END
            AS matched_record_id
        FROM (SELECT i.seq, h.record_id, k.id AS kid, CASE
              WHEN i.url IN (SELECT url FROM seen) THEN 'layer1:url-seen'
              WHEN h.record_id IS NOT NULL THEN 'layer1:cve'
              WHEN k.id IS NOT NULL THEN 'layer2:canonical-key' ELSE '' END AS reason
            FROM items i LEFT JOIN hits h ON h.seq = i.seq
            LEFT JOIN keyed k ON k.canonical_key = i.canonical_key) i""",
    "greedy_dedup": _dedup("items", store=False),
    "dedup_reasons": _dedup("items", store=True, visible=False),
    "dedup_backfill_run": _dedup("items", store=True),
    "dedup_semantic_key": _dedup("items", store=True, semantic=True),
    "dedup_semantic_pairs": _dedup("items", store=True, pairs=True),
    "cve_backfill": _WITH(_ITEMS, _SEEN, _FIRST_CVE) + """SELECT id,
          string_agg(c, ',' ORDER BY c) AS cves FROM (
        SELECT id, unnest(cve_ids) AS c FROM seen
        UNION SELECT record_id, upper(unnest(cve_ids)) FROM hits JOIN items USING (seq)) GROUP BY 1""",
    "store_append_ids": _WITH(_ITEMS, _SEEN) + f"""SELECT id, category, canonical_key,
          array_to_string(cve_ids, ',') AS cves, description, title, url,
          {_clock("first_seen_at")} AS first_seen_at FROM seen
        UNION ALL SELECT (SELECT max(id) FROM seen) + row_number() OVER (ORDER BY seq), category,
          canonical_key, array_to_string(list_sort(list_distinct([upper(c) for c in cve_ids])), ','),
          coalesce(nullif(summary, ''), one_line), title, url, {_clock(_RUN)} FROM items""",
    "latest_n": f"""SELECT event_id AS id, 'event ' || event_id AS title, {_clock("ts")} AS first_seen_at
        FROM events ORDER BY ts DESC, event_id DESC LIMIT 100""",
    "report_rows": _WITH(_ITEMS) + _messages("items"),
    "report_empty": """SELECT CAST(0 AS BIGINT) AS position, 'Feed triage 2024-02-01 - 0 new' AS title,
        'No new vulnerabilities or red-team items in the last run.' AS body, 'shield' AS tags
        WHERE NOT EXISTS (SELECT 1 FROM labels WHERE quality * 4 + 1 > 5)""",
    "report_size": """SELECT count(*) AS "count", count(*) = 0 AS is_empty FROM documents""",
    "outbox": _WITH(_ITEMS, "messages AS (" + _messages("items") + ")") + """SELECT position,
        trim(title) AS title, tags, 'high' AS priority, false AS delivered FROM messages""",
    "primary_urls": _WITH(_ITEMS) + "SELECT seq, url AS primary_url FROM items",
    "feed_entries": _WITH(_EVENTS, """newest AS (
        SELECT * FROM stored ORDER BY first_seen_at DESC, id DESC LIMIT 100)""") + f"""
        SELECT 'urn:feedtriage:item:' || id AS entry_id, title, url,
          CASE WHEN date_trunc('second', first_seen_at) = first_seen_at
               THEN strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S+00:00')
               ELSE strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS published,
          published AS updated, {_LABEL} AS category,
          '<p><em>' || concat_ws(' · ', {_LABEL}, vuln_class, nullif(array_to_string(cve_ids, ', '), ''))
          || '</em></p><p>' || {_XML("description")} || '</p><p><a href="' || {_XML("url")}
          || '">Read more</a> · Source: ' || source || '</p>' AS content FROM newest""",
    "feed_updated": """SELECT CASE WHEN date_trunc('second', max(ts)) = max(ts)
        THEN strftime(max(ts), '%Y-%m-%dT%H:%M:%S+00:00')
        ELSE strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f+00:00') END AS updated FROM events""",
    "fetch_counts": _WITH(_DOCS) + f"""SELECT source, count(*) AS fetched,
        count(*) FILTER (published IS NULL OR published >= {_SINCE}) AS in_window,
        count(*) FILTER (published IS NULL) AS undated FROM docs GROUP BY 1""",
    "windowed_source_counts": f"""SELECT {_clock("time_bucket(INTERVAL 4 HOURS, ts)")} AS window_start,
        event_type AS source, count(*) AS items FROM events GROUP BY 1, 2""",
    "triage_run": _triage(f"""SELECT w.seq, w.source, w.title, w.url, w.category, w.canonical_key,
        w.relevance FROM {_STEP_ITEMS} AND reason = ''"""),
    "triage_report": _triage(_messages(f"""(SELECT w.*, '' AS product, '' AS vendor,
        NULL::VARCHAR AS severity, NULL::VARCHAR AS vuln_class, [w.url] AS urls
        FROM {_STEP_ITEMS} AND reason = '')""")),
    "funnel_by_source": _triage(_COUNTED),
}
ORACLES["windowed_source_counts_stream"] = ORACLES["windowed_source_counts"]
