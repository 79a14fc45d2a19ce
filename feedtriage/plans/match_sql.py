"""Plain SQL with the same results as the queries of the semantic layer: all pairs, exactly."""

from __future__ import annotations

from feedtriage.plans.driver_sql import _ITEMS, _SEEN, _WITH, _clock, _dedup

_SETS = r"""words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
alike AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (x.n + y.n - count(*)) AS score
  FROM grams a JOIN grams b USING (gram) JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  WHERE a.doc_id > b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING count(*) >= 0.8 * (x.n + y.n - count(*)))"""

_REACH = """linked AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
reach(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)"""

_VECTORS = """v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
alike AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id > b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93)"""

_BLOCKS = """i_blocks AS (
  SELECT DISTINCT seq, published AS at, unnest(list_concat(list_transform(cve_ids, lambda c: 'c:' || upper(c)),
         ['k:' || canonical_key, 'l:' || lang])) AS block FROM items WHERE published IS NOT NULL),
r_blocks AS (
  SELECT DISTINCT id, first_seen_at AS at, unnest(list_concat(list_transform(cve_ids, lambda c: 'c:' || upper(c)),
         ['k:' || canonical_key, 'l:' || split_part(canonical_key, ':', 1)])) AS block FROM seen),
near AS (
  SELECT i.seq, i.block, arg_max(r.id, (r.at, r.id)) AS id, max(r.at) AS record_at
  FROM i_blocks i JOIN r_blocks r ON r.block = i.block AND r.at <= i.at AND r.at >= i.at - INTERVAL 6 HOUR
  GROUP BY i.seq, i.block)"""


# Each record has the number of the next one as a further CVE id.
_SEEN_ADDED = _SEEN.replace(
    "['CVE-2024-' || (CAST(number AS BIGINT) + 10000)] AS cve_ids",
    """list_sort(list_distinct(list_concat(['CVE-2024-' || (CAST(number AS BIGINT) + 10000)],
         CASE WHEN page_id + 1 < (SELECT count(*) FROM pages) THEN ['CVE-2023-' || (page_id + 10002)] ELSE [] END))) AS cve_ids""")


def _index_dedup() -> str:
    sql = _dedup("items", store=True, visible=False)
    assert _SEEN in sql
    sql = sql.replace(_SEEN, _SEEN_ADDED)
    # decisions from the store alone: no item of the batch claims a token
    return sql.replace("CASE WHEN reason = '' THEN list_concat(claimed", "CASE WHEN false THEN list_concat(claimed")


def _dedup_alike() -> str:
    """The sequential rules with all similar earlier texts as links, and no store."""
    sql = _dedup("items", store=False, visible=False, pairs=True, final="SELECT seq, reason <> '' AS is_duplicate, reason FROM steps WHERE rn > 0")
    start, end = sql.index("links AS (SELECT greatest"), sql.index("link_lists AS")
    return (sql[:start] + _SETS + ",\nlinks AS (SELECT a AS seq, b AS cand, score FROM alike),\n" + sql[end:])


ORACLES = {
    "jaccard_pairs": "WITH RECURSIVE " + _SETS + ",\n" + _REACH + """
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM alike WHERE a = doc_id AND score = 1), doc_id)) AS class_id,
       least(doc_id, coalesce(b, doc_id)) AS group_id FROM documents LEFT JOIN lowest ON a = doc_id""",
    "cosine_pairs": "WITH RECURSIVE " + _VECTORS + ",\n" + _REACH + """
SELECT vec_id, least(vec_id, coalesce(b, vec_id)) AS group_id FROM embeddings LEFT JOIN lowest ON a = vec_id""",
    "dedup_similar_texts": _dedup_alike(),
    "window_candidates": _WITH(_ITEMS, _SEEN, _BLOCKS) + f"SELECT seq, block, id, {_clock('record_at')} AS record_at FROM near",
    "store_levels": _WITH(_SEEN_ADDED) + f"""SELECT id, canonical_key, array_to_string(cve_ids, ',') AS cves, url,
        {_clock('first_seen_at')} AS first_seen_at FROM seen""",
    "store_index_dedup": _index_dedup(),
    "model_pairs": _WITH(_ITEMS, _SEEN, _BLOCKS) + """SELECT DISTINCT n.seq, n.id AS record_id
        FROM near n JOIN items i USING (seq) JOIN seen s ON s.id = n.id
        WHERE split_part(i.title, ' ', 1) = split_part(s.title, ' ', 1)""",
}
