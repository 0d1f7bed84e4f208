"""DuckDB SQL for the opN_ queries that SQL can express."""

from __future__ import annotations

from . import decontaminate, licenses, mixing, secrets


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secrets() -> str:
    kinds = " UNION ALL ".join(
        f"SELECT {i} AS rule, {_text(r.kind)} AS kind, {r.base} AS base, doc_id, "
        f"string_split(regexp_replace(t, {_text('(' + r.pattern + ')')}, chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS segs, "
        f"{r.least} AS least FROM d"
        for i, r in enumerate(secrets.RULES)
    )
    groups = " ".join(
        f"WHEN {i} THEN length(regexp_extract(hit, {_text(r.pattern)}, {r.group}))" for i, r in enumerate(secrets.RULES)
    )
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), '??') AS t FROM documents),
parts AS ({kinds}),
hits AS (SELECT *, unnest(range(2, len(segs) + 1)) AS k FROM parts WHERE len(segs) > 1),
placed AS (SELECT rule, kind, base, doc_id, least, split_part(segs[k], chr(2), 1) AS hit,
  list_sum(list_transform(segs[1:k-1], lambda x: length(x))) - (k - 2) AS s FROM hits),
spans AS (SELECT *, kind || ':' || s::BIGINT || ':' || (s + length(hit))::BIGINT AS span FROM placed
  WHERE CASE rule {groups} END >= least),
agg AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY s, rule) FILTER (base) AS b,
  string_agg(span, ',' ORDER BY s, rule) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN agg USING (doc_id)"""


def _mix() -> str:
    w = ", ".join(f"{x}.0" for x in mixing.WEIGHTS)
    n = len(mixing.WEIGHTS)
    most = mixing.MOST_COPIES
    return f"""
WITH sized AS (SELECT doc_id, source, text,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
classed AS (SELECT *, length(bin(size)) * 8 + ((size >> greatest(length(bin(size)) - 4, 0)) & 7) AS class,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 2))::BIGINT AS id_hash FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, list_extract([{w}]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {n} + 1)::INT) AS weight FROM sources),
stops AS (SELECT *, ({most} * source_size)::DOUBLE / weight AS stop FROM ranked),
levels AS (SELECT *, ((sum(source_size) OVER ()) - {most} * coalesce(sum(source_size) OVER w, 0))::DOUBLE
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0.0)) AS level_here FROM stops
    WINDOW w AS (ORDER BY stop, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size,
    least(coalesce(weight * max(level_here) OVER (), {most} * source_size::DOUBLE), {most} * source_size::DOUBLE) AS target,
    ('0x' || substr(sha256('{mixing.SEED}|' || coalesce('s' || source, '')), 1, 5))::BIGINT::DOUBLE / {float(1 << 20)} AS off FROM levels),
placed AS (SELECT c.*, row_number() OVER (PARTITION BY source ORDER BY class, id_hash, size, doc_id NULLS FIRST) AS r FROM classed c),
taken AS (SELECT p.doc_id, p.size, t.source_size, t.target, p.source,
    CASE WHEN p.size > 0 THEN least(floor(t.target / t.source_size * r + off) - floor(t.target / t.source_size * (r - 1) + off), {most})
      ELSE 0 END::BIGINT AS copies
    FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM taken"""


def _licenses() -> str:
    rows = ", ".join(f"({_text(n)}, {_text(t)})" for n, t in licenses.TEMPLATES)
    words = "string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    ascii_lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = words.replace("lower({0})", ascii_lower)
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH tw AS (SELECT name, {words.format("t")} AS w FROM (VALUES {rows}) AS v(name, t)),
templates AS (SELECT name, {grams} AS g FROM tw),
d AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS text FROM documents),
parts AS (
  SELECT doc_id, coalesce(text, '') AS s FROM documents
  UNION ALL SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) FROM d WHERE contains(text, chr(10) || chr(10))
  UNION ALL SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: x <> '')) FROM d WHERE contains(text, chr(10))),
pw AS (SELECT doc_id, {words.format("s")} AS w FROM parts),
pg AS (SELECT doc_id, {grams} AS g FROM pw WHERE len(w) > 1),
scores AS (SELECT doc_id, name, 2 * len(list_intersect(pg.g, t.g)) / (len(pg.g) + len(t.g)) AS score
  FROM pg JOIN templates t ON len(pg.g) <= 2 * len(t.g) AND len(t.g) <= 2 * len(pg.g)),
hits AS (SELECT doc_id, name, max(score) AS score, count(*) AS k FROM scores WHERE score >= {licenses.THRESHOLD} GROUP BY ALL),
best AS (SELECT doc_id, first(name ORDER BY score DESC, name) AS license, max(score) AS dice,
  string_agg(name, ',' ORDER BY name) AS licenses, sum(k)::BIGINT AS n_segments FROM hits GROUP BY doc_id)
SELECT d.doc_id, license, coalesce(dice, 0.0) AS dice, coalesce(licenses, '') AS licenses, coalesce(n_segments, 0) AS n_segments
FROM documents d LEFT JOIN best USING (doc_id)"""


def _decontaminate() -> str:
    size, share = decontaminate.WINDOW, decontaminate.SHARE
    words = (
        "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    )
    return f"""
WITH dw AS (SELECT doc_id, {words} AS w FROM documents),
iw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words} AS w FROM benchmark),
il AS (SELECT item, w, least(len(w), {size}) AS n FROM iw WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM il)),
spots AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item, i, spots.n FROM spots JOIN windows USING (n, win)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND {share} * n_hit >= len(w), false) AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""


_DEDUP = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""

ORACLES = {
    "op1_secrets": _secrets(),
    "op2_mix": _mix(),
    "op3_licenses": _licenses(),
    "op4_decontaminate": _decontaminate(),
    "op6_exact_dedup": _DEDUP,
}
