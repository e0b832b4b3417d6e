"""The same results in SQL for DuckDB, where SQL can express an operator."""

from __future__ import annotations

LLM_SQL: dict[str, str] = {}

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_letters = " || ".join(
    f"substr('{BASE32}', (('0x' || substr(hex40, {5 * g + 1}, 5))::INTEGER >> {shift} & 31) + 1, 1)"
    for g in range(8)
    for shift in (15, 10, 5, 0)
)
LLM_SQL["op1_warc_revisits"] = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes,
    sha1(coalesce(html, '')) AS hex40 FROM pages),
d AS (SELECT page_id, payload_bytes, {_letters} AS payload_digest,
    min(page_id) OVER (PARTITION BY hex40) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""

LLM_SQL["op4_mix_sources"] = r"""
WITH d AS (SELECT doc_id, text, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER) AS weight,
    2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) AS nth FROM w),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)
      - coalesce(sum(cap) OVER (ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
v AS (SELECT level FROM l WHERE level <= cap / weight ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM v) * weight, cap)) AS target FROM w),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, '') || ':' || coalesce(d.text, '')), 1, 13))::BIGINT
      / 4503599627370496.0::DOUBLE AS coin
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    r" 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
LLM_SQL["op5_benchmark_windows"] = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS m,
    array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS run
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM win),
runs AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS run
  FROM d, sizes, unnest(generate_series(1, len(w) - m + 1)) u(i)),
hit AS (SELECT r, i, runs.m, item_id FROM runs JOIN win USING (run)),
words AS (SELECT r, count(DISTINCT j) AS n FROM hit, unnest(generate_series(i, i + m - 1)) u(j) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n,
    string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit,
  coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

_COUNTED = "eainorstlud"
_counts = ", ".join(f"strlen(line) - strlen(replace(line, '{c}', '')) AS c_{c}" for c in _COUNTED)
_apart = " + ".join(f"abs(a.c_{c} - b.c_{c})" for c in _COUNTED)
LLM_SQL["op6_line_dedup"] = rf"""
WITH parts AS (SELECT doc_id, row_number() OVER () AS r, string_split(text, chr(10)) AS parts FROM documents),
occ AS (SELECT r, doc_id, i - 1 AS pos, trim(parts[i], ' ') AS line
  FROM parts, unnest(generate_series(1, len(parts))) u(i) WHERE length(trim(parts[i], ' ')) >= 20),
lines AS (SELECT line, min((doc_id::HUGEINT * 1000000000 + pos)) AS place, length(line) AS n, {_counts}
  FROM occ GROUP BY line),
close AS (SELECT a.line AS x, b.line AS y, a.place AS px, b.place AS py
  FROM (SELECT *, unnest([n, n + 1, n + 2]) AS other FROM lines) a JOIN lines b ON a.other = b.n
  WHERE {_apart} <= 4 AND (a.n < b.n OR a.line < b.line)),
links AS (SELECT * FROM close WHERE levenshtein(x, y) <= 2),
ends AS (SELECT CASE WHEN px < py OR px = py AND x < y THEN y ELSE x END AS line, 1 AS near FROM links UNION ALL
  SELECT CASE WHEN px < py OR px = py AND x < y THEN x ELSE y END, 0 FROM links),
deg AS (SELECT line, max(near) AS near, count(*) AS links FROM ends GROUP BY line),
marks AS (SELECT r, pos, coalesce(links, 0) AS links,
    CASE WHEN doc_id::HUGEINT * 1000000000 + pos <> place THEN 0 WHEN near = 1 THEN 1 END AS why
  FROM occ JOIN lines USING (line) LEFT JOIN deg USING (line)),
tot AS (SELECT r, count(*) AS n, count(*) FILTER (why = 0) AS eq, count(*) FILTER (why = 1) AS nr, sum(links) AS lk,
    string_agg(CASE WHEN why IS NOT NULL THEN pos::VARCHAR END, ',' ORDER BY pos) AS dropped FROM marks GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(eq, 0)::BIGINT AS n_equal,
  coalesce(nr, 0)::BIGINT AS n_near, coalesce(lk, 0)::BIGINT AS n_links, coalesce(dropped, '') AS dropped
FROM parts LEFT JOIN tot USING (r)"""
