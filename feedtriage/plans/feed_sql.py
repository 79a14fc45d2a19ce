"""Plain SQL with the same results as the queries of ``feed_queries``."""

from __future__ import annotations

from feedtriage.plans.driver_sql import _DOCS, _ITEMS, _RUN, _SEEN, _WITH, _clean, _clock
from feedtriage.plans.feed_queries import PAGE_LINES

_PLACES = f"""firsts AS (
  SELECT split_part(canonical_key, ':', 1) AS lang, min(seq) AS seq FROM items GROUP BY 1),
places AS (
  SELECT f.seq, s.*, (row_number() OVER (PARTITION BY f.seq ORDER BY first_seen_at DESC, id DESC) - 1) // {PAGE_LINES} AS page
  FROM firsts f JOIN seen s ON split_part(s.canonical_key, ':', 1) = f.lang)"""

ORACLES = {
    "plugin_source": _WITH(_DOCS) + f"""SELECT 'documents' AS source, {_clean("title")} AS title, url, {_clean("summary")} AS summary,
        {_clock(f"coalesce(published, {_RUN})")} AS published, published IS NULL AS undated
        FROM docs WHERE published IS NULL OR published >= TIMESTAMP '2024-01-01 03:00:00'""",
    "windowed_counts_upsert": _WITH(_DOCS) + f"""SELECT {_clock(f"time_bucket(INTERVAL 4 HOURS, coalesce(published, {_RUN}))")} AS window_start,
        source, published IS NULL AS undated, count(*) AS items FROM docs GROUP BY ALL""",
    "candidate_pages": _WITH(_ITEMS, _SEEN, _PLACES) + """SELECT seq, CAST(page AS INTEGER) AS page,
        string_agg('[' || id || '] key=' || canonical_key || ' cves=' || array_to_string(cve_ids, ',') || ' :: ' || title || ' — ' || description,
                   chr(10) ORDER BY first_seen_at DESC, id DESC) AS block,
        string_agg(CAST(id AS VARCHAR), ',' ORDER BY first_seen_at DESC, id DESC) AS ids FROM places GROUP BY seq, page""",
    "candidate_answer": _WITH(_ITEMS, _SEEN, _PLACES) + """SELECT seq,
        arg_max(id, (first_seen_at, id)) FILTER (id % 7 = 0) AS record_id FROM places GROUP BY seq""",
}
