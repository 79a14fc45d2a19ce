"""The queries of this package as SQL for another engine, where SQL can express them."""

from __future__ import annotations

import string

from feedtriage.llm import secret_scan
from feedtriage.llm.queries import MIX

OP1 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
           FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n
"""

OP9 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role
              AS goes_on,
         len(text) + len(text) - len(replace(text, '\', ''))
           + len(regexp_extract_all(text, '<\|[a-z_]+\|>|</?s>|<</?SYS>>|\[/?INST\]')) AS chars
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), ''))
         AS loss_sha256,
       CAST(sum(chars + CASE WHEN goes_on THEN len('<|next|>')
                        ELSE len('<|start|>') + len(role) + 1 + len('<|end|>') + 1 END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


OP2 = r"""
WITH RECURSIVE goals(facet, value, weight) AS (VALUES
  {goals}),
rows AS (
  SELECT doc_id, tokens, CASE WHEN source IN ({source}) THEN source ELSE '(other)' END AS source,
         CASE WHEN lang IN ({lang}) THEN lang ELSE '(other)' END AS lang,
         CASE WHEN contains(text, 'License') THEN 'legal' WHEN contains(text, ' | ') THEN 'table'
              WHEN tokens < 100 THEN 'brief' WHEN tokens > 1000 THEN 'long' ELSE 'prose' END AS topic
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens FROM documents)),
cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS have FROM rows GROUP BY ALL),
margins AS (
  SELECT facet, value, sum(have) AS have FROM (
    SELECT unnest(['source', 'lang', 'topic']) AS facet, unnest([source, lang, topic]) AS value, have FROM cells)
  GROUP BY ALL),
wanted AS (
  SELECT facet, value, have, CASE WHEN have > 0 THEN coalesce(weight, 0) ELSE 0 END AS weight,
         sum(have) OVER (PARTITION BY facet) AS total,
         coalesce(sum(have) FILTER (value = '(other)') OVER (PARTITION BY facet), 0) AS other
  FROM margins LEFT JOIN goals USING (facet, value)),
shares AS (
  SELECT facet, value, total * {rate} * CASE WHEN value = '(other)' THEN have / total
         ELSE weight * (1 - other / total) / sum(weight) OVER (PARTITION BY facet) END AS goal FROM wanted),
raked(step, source, lang, topic, have, drawn, s, l, t) AS (
  SELECT 0, source, lang, topic, have, have * {rate}, s.goal, l.goal, t.goal FROM cells
  JOIN shares s ON s.facet = 'source' AND s.value = source JOIN shares l ON l.facet = 'lang' AND l.value = lang
  JOIN shares t ON t.facet = 'topic' AND t.value = topic
  UNION ALL
  SELECT step + 1, source, lang, topic, have, CASE step % 3
    WHEN 0 THEN drawn * s / nullif(sum(drawn) OVER (PARTITION BY source), 0)
    WHEN 1 THEN drawn * l / nullif(sum(drawn) OVER (PARTITION BY lang), 0)
    ELSE least(have, drawn * t / nullif(sum(drawn) OVER (PARTITION BY topic), 0)) END, s, l, t
  FROM raked WHERE step < 180),
final AS (SELECT source, lang, topic, CASE WHEN have > 0 THEN coalesce(drawn, 0) / have ELSE 0 END AS p,
    round(sum(coalesce(drawn, 0)) OVER (PARTITION BY source) / nullif(s, 0), 6) AS source_reached,
    round(sum(coalesce(drawn, 0)) OVER (PARTITION BY lang) / nullif(l, 0), 6) AS lang_reached,
    round(sum(coalesce(drawn, 0)) OVER (PARTITION BY topic) / nullif(t, 0), 6) AS topic_reached FROM raked WHERE step = 180)
SELECT doc_id, source, lang, topic, tokens, round(p, 6) AS probability, source_reached, lang_reached, topic_reached,
       CAST('0x' || substr(md5('mix:' || doc_id), 1, 12) AS BIGINT) / 281474976710656.0 < p AS selected
FROM rows JOIN final USING (source, lang, topic)
"""

OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(
        CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b USING (gram) JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(doc_id, coalesce(min(r.b), doc_id)) AS component_id
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN reach r ON r.a = doc_id GROUP BY doc_id
"""

OP5 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
c AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id,
       least(vec_id, coalesce(c.b, vec_id)) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
"""

_ASSIGN = (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"""
           r"""|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)""")


def _found(kind: int, pattern: str, group: int, least: int) -> str:
    """Matches of a pattern with their places, from the pieces between them."""
    return f"""
  SELECT doc_id, {kind} AS kind, t, start, start + len(hit) AS stop FROM (
    SELECT doc_id, t, m.hit AS hit, m.value AS value,
           sum(len(m.before) + len(m.hit)) OVER (PARTITION BY doc_id ORDER BY m.k) - len(m.hit) AS start
    FROM (SELECT doc_id, t, unnest(list_transform(range(1, len(hits) + 1), lambda k:
            {{'k': k, 'hit': hits[k], 'value': vals[k], 'before': gaps[k]}})) AS m
          FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}', 0) AS hits, regexp_extract_all(t, '{pattern}', {group}) AS vals,
                       string_split_regex(t, '{pattern}') AS gaps
                FROM d WHERE regexp_matches(t, '{pattern}'))))
  WHERE len(value) >= {least}"""


def _fits(cls) -> str:
    return " AND ".join([f"len(run) >= {cls.width}", *[f"regexp_matches(run, '{p}')" for p in cls.patterns]])


def _of_class(value: str) -> str:
    return "CASE " + " ".join(f"WHEN {_fits(c)} THEN {getattr(c, value)}" for c in secret_scan.CLASSES) + " END"


OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
base AS (""" + "\nUNION ALL".join([_found(0, _ASSIGN, 1, 8), _found(1, "AKIA[A-Z0-9]+", 0, 16), _found(2, "[0-9a-f]{32,}", 0, 32)]) + r"""),
runs AS (""" + _found(3, secret_scan.CANDIDATE, 0, secret_scan.SHORT) + r"""),
repeats AS (SELECT doc_id, start + i - 1 AS start, start + i - 1 + {rep} AS stop FROM (
    SELECT doc_id, start, t, stop, unnest(range(1, CAST(stop - start AS BIGINT) - {rep} + 2)) AS i FROM runs)
  WHERE len(replace(substr(t, CAST(start + i AS BIGINT), {rep}), substr(t, CAST(start + i AS BIGINT), 1), '')) = 0),
cuts AS (SELECT doc_id, start, stop FROM base UNION ALL SELECT doc_id, start, stop FROM repeats
  UNION ALL SELECT doc_id, start, stop FROM (""".replace("{rep}", str(secret_scan.REPEATED)) + "\nUNION ALL".join([_found(4, secret_scan.ALLOW_WORDS, 0, 1), _found(4, secret_scan.ALLOW_UUID, 0, 1)]) + r""")),
ends AS (SELECT r.doc_id, r.t, r.start AS run, r.stop, c.start AS a, c.stop AS b FROM runs r JOIN cuts c
    ON c.doc_id = r.doc_id AND c.start < r.stop AND r.start < c.stop
  UNION ALL SELECT doc_id, t, start, stop, stop, stop FROM runs),
gaps AS (SELECT doc_id, t, CAST(greatest(run, coalesce(max(b) OVER (PARTITION BY doc_id, run ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), run)) AS BIGINT) AS start,
    CAST(a AS BIGINT) AS stop FROM ends),
pieces AS (SELECT doc_id, start, substr(t, start + 1, stop - start) AS run FROM gaps WHERE stop - start >= """ + str(secret_scan.SHORT) + r"""),
classed AS (SELECT *, """ + _of_class("bits") + " AS bits, " + _of_class("width") + r""" AS w FROM pieces),
hits AS (SELECT doc_id, start, w, list_filter(range(1, len(run) - w + 2), lambda i: log2(w) - list_sum(list_transform(
      list_distinct(string_split(substr(run, i, w), '')), lambda c: (w - len(replace(substr(run, i, w), c, '')))
        * log2(w - len(replace(substr(run, i, w), c, ''))))) / w >= bits) AS places FROM classed),
found AS (SELECT doc_id, kind, start, stop FROM base
  UNION ALL SELECT doc_id, 3, start + list_first(places) - 1, start + list_last(places) + w - 1 FROM hits WHERE len(places) > 0),
named AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM found)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id
"""


def _mixing_sql(targets) -> str:
    goals = [(f, v, w) for f in ("source", "lang", "topic") for v, w in sorted(getattr(targets, f).items())]
    names = {f: ", ".join(f"'{v}'" for v in sorted(getattr(targets, f))) for f in ("source", "lang")}
    return (OP2.replace("{goals}", ",\n  ".join(f"('{f}', '{v}', {w})" for f, v, w in goals)).replace("{rate}", str(targets.rate))
            .replace("{source}", names["source"]).replace("{lang}", names["lang"]))


def _merkle_level(name: str, source: str, keys: str) -> str:
    """Siblings before and after each node of one level, and the level above it."""
    run = f"OVER (PARTITION BY {keys}, p // 8 ORDER BY p ROWS BETWEEN"
    return f"""
{name}s AS (
  SELECT *, coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {source}),
{name}n AS (
  SELECT {keys}, p // 8 AS p, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY p)) END AS h
  FROM {source} GROUP BY {keys}, p // 8, n)"""


def _merkle(levels: int = 8, top: int = 4) -> str:
    """Levels written out, enough for 8 ** levels rows of a language and 8 ** top languages."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    bits = "[(ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1]) >> (i % 8)) & 1 for i in range(8 * len(CAST(doc_id AS VARCHAR)))]"
    crc = f"xor(list_reduce({bits}, lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295), 4294967295)"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    parts = [f"""
d AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lower)} END AS claimed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n
  FROM documents),
a0n AS (SELECT lang, p, n, leaf AS h FROM d)"""]
    parts += [_merkle_level(f"a{k + 1}", f"a{k}n", "lang") for k in range(levels)]
    parts.append(f"""
b0n AS (SELECT 0 AS tree, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, count(*) OVER () AS n, h FROM a{levels}n),
c0 AS (SELECT d.doc_id, d.lang, d.leaf, d.p, b.p AS q, b.h AS subroot, coalesce(d.claimed, d.leaf) AS x, '' AS proof
       FROM d JOIN b0n b ON d.lang IS NOT DISTINCT FROM b.lang)""")
    parts += [_merkle_level(f"b{k + 1}", f"b{k}n", "tree") for k in range(top)]
    for k in range(levels + top):
        below, on = (f"a{k + 1}s", f"s.lang IS NOT DISTINCT FROM c.lang AND s.p = c.p // {8 ** k}") if k < levels else (f"b{k - levels + 1}s", f"s.p = c.q // {8 ** (k - levels)}")
        parts.append(f"""
c{k + 1} AS (
  SELECT c.* REPLACE (CASE WHEN s.n = 1 THEN x ELSE sha256(s.l || x || s.r) END AS x, proof || s.l || s.r AS proof)
  FROM c{k} c JOIN {below} s ON {on})""")
    return "WITH " + ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = h AS verified
FROM c{levels + top}, b{top}n"""


ORACLES = {"op1_exact_dedup": OP1, "op2_mixing": _mixing_sql(MIX), "op3_ngram_join": OP3, "op5_embedding_dedup": OP5,
           "op9_chat_formatting": OP9, "op10_secret_scan": OP10, "op13_merkle_manifest": _merkle()}
