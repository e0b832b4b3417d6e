"""The same results in SQL, written for DuckDB over the same tables."""

from __future__ import annotations

from themeloom import fixed
from themeloom.functions import prompts as P
from themeloom.settings import Settings
from themeloom.stop_words import ENGLISH

S = Settings()
LOOSE = 0.3
QUESTION = ["thing", "tion", "eau", "schst", "que"]
CHUNK, OVERLAP = 120, 20
K = 20
ORACLES: dict[str, str] = {}

STRIP = rf"^[{fixed.WHITE}]+|[{fixed.WHITE}]+\z"


def text(value: str) -> str:
    """A SQL string; control characters are written out."""
    return "'" + value.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {text(STRIP)}, '', 'g')"


def clean(x: str) -> str:
    blank = f"regexp_replace({x}, {text(chr(10) + '[' + fixed.WHITE + ']*' + chr(10))}, {text(chr(10) * 2)}, 'g')"
    return strip(f"regexp_replace({blank}, ' +', ' ', 'g')")


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {text('[^' + fixed.WHITE + ']+')})"


def toks(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {text(fixed.TERM_PATTERN)})"


def joined(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda j: coalesce(j, '-')), '|')"


SENTENCE = "regexp_extract({}, '^[^.!?]*[.!?]?')"
STOP = f"stop AS (SELECT unnest([{', '.join(text(w) for w in ENGLISH)}]) AS w)"


# --- text and markdown -------------------------------------------------------

ORACLES["clean_text"] = f"SELECT doc_id, {clean('text')} AS cleaned FROM documents"
ORACLES["word_count"] = (
    f"SELECT doc_id, len({words('text')})::BIGINT AS word_count FROM documents"
)
ORACLES["content_cap"] = (
    f"SELECT doc_id, substring(text, 1, {S.content_cap}) AS shown FROM documents"
)
ORACLES["metadata_envelope"] = f"""
SELECT doc_id, chr(10) || 'Document: ' || source || '_' || doc_id || '.md' || chr(10)
  || 'Word Count: ' || len({words('text')}) || chr(10) || chr(10) || text || chr(10) AS envelope
FROM documents"""

TITLE = (
    "array_to_string(list_transform(regexp_extract_all({}, "
    r"'[\p{{Lu}}\p{{Ll}}\p{{Lt}}]+|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}]+'), "
    "lambda w: upper(w[1]) || lower(w[2:])), '')"
)
ORACLES["title_case"] = f"""
WITH n AS (SELECT doc_id, source || '-' || lang || '_it''s o''neil ' || doc_id || 'rd.été' AS stem
           FROM documents)
SELECT doc_id, {TITLE.format("translate(stem, '_-', '  ')")} AS title,
  stem || '.md' AS output_name FROM n"""

ORACLES["heading_level"] = r"""
WITH s AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'heading ' || n_chars % 23 WHEN 1 THEN 'Heading'
    WHEN 2 THEN source ELSE 'Heading ' || n_chars % 23 END AS style
  FROM documents)
SELECT doc_id, style,
  CASE WHEN NOT contains(style, 'Heading') THEN NULL
    WHEN contains(style, 'Heading 1') THEN 1 WHEN contains(style, 'Heading 2') THEN 2
    WHEN contains(style, 'Heading 3') THEN 3 WHEN contains(style, 'Heading 4') THEN 4
    WHEN NOT regexp_matches(style, '[0-9]') THEN 1
    ELSE least(CAST(regexp_extract(style, '[0-9]+') AS INT), 6) END AS level,
  CASE WHEN regexp_matches(lower(style), 'heading [1-6]')
    THEN CAST(regexp_extract(lower(style), 'heading ([1-6])', 1) AS INT) END AS plain_level
FROM s"""

ORACLES["emphasis"] = """
WITH a AS (SELECT doc_id, lang, text, split_part(text, ' ', 1) AS w FROM documents),
b AS (SELECT doc_id, lang,
  CASE WHEN w = '' THEN text ELSE replace(text, w, '**' || w || '**') END AS t FROM a)
SELECT doc_id, replace(t, lang, '*' || lang || '*') AS marked FROM b"""

LINE = "'| ' || array_to_string({}, ' | ') || ' |'"
ORACLES["table_markdown"] = rf"""
WITH r AS (SELECT doc_id, list_transform(string_split(text, chr(10)),
             lambda l: regexp_split_to_array(l, '[.] *')) AS rows FROM documents),
t AS (SELECT doc_id, list_transform(rows, lambda r: list_transform(r, lambda c: {strip('c')})) AS rows
      FROM r),
w AS (SELECT doc_id, list_transform(rows, lambda r: {LINE.format("list_append(r, 'a|b')")}) AS body,
        rows[1] AS head, rows[2:] AS rest
      FROM t)
SELECT doc_id, '| x |' || chr(10) || '| --- |' || chr(10) || array_to_string(body, chr(10)) AS lines,
  CASE WHEN len(list_filter(head, lambda c: c <> '')) = 0 THEN '' ELSE
    chr(10) || {LINE.format('head')} || chr(10)
    || {LINE.format("list_transform(head, lambda c: '---')")}
    || array_to_string(list_transform(rest, lambda r: chr(10) || {LINE.format('r')}), '') END
    AS plain_lines
FROM w"""

TAGS = "list_transform(regexp_extract_all(html, '(?s)<{0}>(.*?)</{0}>', 1), lambda x: {1})"
NO_TAGS = "regexp_replace(x, '<[^>]*>', ' ', 'g')"
ORACLES["block_markdown"] = f"""
WITH b AS (
  SELECT page_id, {TAGS.format('h1', NO_TAGS)} AS h, {TAGS.format('p', NO_TAGS)} AS p,
    list_zip(regexp_extract_all(html, '<a href="([^"]*)">', 1),
             regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS links
  FROM pages),
c AS (
  SELECT page_id,
    list_transform(h, lambda x: '# ' || {strip('x')}) AS heads,
    list_transform(h, lambda x: '# ' || {strip('x')}) AS plain_heads,
    list_filter(list_transform(p, lambda x: {strip('x')}), lambda x: x <> '') AS body,
    list_transform(p, lambda x: CASE WHEN {strip('x')} = '' THEN ''
      WHEN split_part(x, ' ', 1) = '' THEN {strip('x')}
      ELSE replace({strip('x')}, split_part(x, ' ', 1), '**' || split_part(x, ' ', 1) || '**') END)
      AS plain_body,
    list_transform(links, lambda l: '| ' || {strip('l[1]')} || ' | ' || {strip('l[2]')} || ' |') AS rows
  FROM b),
d AS (SELECT *, list_concat([rows[1], '| --- | --- |'], rows[2:]) AS tab FROM c)
SELECT page_id,
  {clean("array_to_string(list_concat(list_concat(heads, body), "
         "[chr(10) || array_to_string(tab, chr(10)) || chr(10)]), chr(10) || chr(10))")} AS markdown,
  array_to_string(list_concat(list_concat(list_concat(plain_heads, plain_body), ['']), tab), chr(10))
    AS plain_markdown
FROM d"""

WORD_BASE = f"""
WITH f AS (SELECT doc_id, lang, source, TRUE AS ok,
    source || '-' || lang || '_' || doc_id AS stem, string_split(text, chr(10)) AS lines
  FROM documents)"""
ORACLES["word_to_markdown"] = f"""{WORD_BASE},
g AS (SELECT *, {clean(
    "array_to_string(list_concat(list_filter(list_transform(lines, lambda l, i: CASE "
    f"WHEN {strip('l')} = '' THEN '' WHEN i = 1 THEN '## ' || {strip('l')} ELSE {strip('l')} END), "
    "lambda l: l <> ''), [chr(10) || '| ' || lang || ' | ' || source || ' |' || chr(10) "
    "|| '| --- | --- |' || chr(10)]), chr(10) || chr(10))")} AS body FROM f),
t AS (SELECT *, {TITLE.format("translate(stem, '_-', '  ')")} AS title FROM g)
SELECT doc_id, title, stem || '.md' AS output_name,
  '# ' || title || chr(10) || chr(10) || body AS content,
  len({words("'# ' || title || chr(10) || chr(10) || body")})::BIGINT AS word_count, ok FROM t"""
BOLD = "CASE WHEN i % 2 = 0 THEN '**' ELSE '*' END"
ORACLES["word_to_plain_markdown"] = f"""{WORD_BASE}
SELECT doc_id, ok, array_to_string(list_concat(
  list_transform(lines, lambda l, i: CASE WHEN {strip('l')} = '' THEN ''
    WHEN i = 1 THEN '## ' || {strip('l')} WHEN split_part(l, ' ', 1) = '' THEN {strip('l')}
    ELSE replace({strip('l')}, split_part(l, ' ', 1), {BOLD} || split_part(l, ' ', 1) || {BOLD}) END),
  ['', '| ' || lang || ' | ' || source || ' |', '| --- | --- |']), chr(10)) AS content
FROM f"""
ORACLES["conversion_outcome"] = """
SELECT CASE WHEN doc_id % 17 = 16 THEN 'BadZipFile: File is not a zip file' END AS error,
  count(*) AS rows FROM documents GROUP BY 1"""


# --- shared derivations --------------------------------------------------------

TOPICS = f"""topics AS (
  SELECT conv_id, turn, role, text, t,
    array_to_string(t[1:3], ' ') AS name, text AS description,
    list_transform(list_filter(list_transform(t, lambda x, i: struct_pack(b := x || ' ' || t[i + 1], i := i)),
      lambda s: s.b IS NOT NULL), lambda s: s.b) AS pairs,
    CASE WHEN turn % 5 <> 4 THEN (1 + (conv_id * 3 + turn * 7) % 10)::DOUBLE END AS importance,
    [role, {SENTENCE.format('text')}] AS quotes
  FROM (SELECT *, {toks('text')} AS t FROM conversations)),
topics2 AS (SELECT * EXCLUDE (pairs),
    list_filter(pairs, lambda p, i: list_position(pairs, p) = i)[1:3] AS phrases FROM topics)"""


def tfidf(
    source: str, keys: str, within: str, limit: int, pairs: bool, body: str, p: str = ""
) -> str:
    """CTEs ``tf``, ``vocab``, ``vec(keys, term, slot, w)`` over rows of ``source``.

    ``p`` is put before the names, for a second fit in one statement.
    """
    on = f"{within}, " if within else ""
    part = f"PARTITION BY {within}" if within else ""
    grams = (
        f"""SELECT {keys}, term FROM {p}uni UNION ALL
        SELECT {keys}, term || ' ' || nxt FROM (SELECT {keys}, term,
          lead(term) OVER (PARTITION BY {keys} ORDER BY pos) AS nxt FROM {p}uni) WHERE nxt IS NOT NULL"""
        if pairs
        else f"SELECT {keys}, term FROM {p}uni"
    )
    sizes = (
        f"(SELECT {within}, count(*) AS n FROM {source} GROUP BY {within})"
        if within
        else f"(SELECT count(*) AS n FROM {source})"
    )
    join_sizes = f"JOIN {sizes} z USING ({within})" if within else f", {sizes} z"
    return f"""{p}tok AS (SELECT {keys}, unnest({toks(body)}) AS term,
    generate_subscripts({toks(body)}, 1) AS pos FROM {source}),
{p}uni AS (SELECT * FROM {p}tok WHERE term NOT IN (SELECT w FROM stop)),
{p}grams AS ({grams}),
{p}tf AS (SELECT {keys}, term, count(*) AS tf FROM {p}grams GROUP BY ALL),
{p}stat AS (SELECT {on} term, sum(tf)::BIGINT AS cf, count(*) AS df FROM {p}tf GROUP BY ALL),
{p}vocab AS (SELECT *, row_number() OVER ({part} ORDER BY cf DESC, term) AS slot FROM {p}stat
  QUALIFY slot <= {limit}),
{p}raw AS (SELECT {keys}, term, slot, tf * (ln((1 + n) / (1 + df)) + 1) AS raw
  FROM {p}tf JOIN {p}vocab USING ({on} term) {join_sizes}),
{p}vec AS (SELECT {keys}, term, slot,
  raw / sqrt(sum(raw * raw) OVER (PARTITION BY {keys})) AS w FROM {p}raw)"""


TOPIC_TEXT = "name || ' ' || description || ' ' || array_to_string(phrases, ' ')"
WITHIN = tfidf("topics2", "conv_id, turn", "conv_id", S.topic_terms, False, TOPIC_TEXT)
SIMS = """sims AS (
  SELECT a.conv_id, a.turn AS i, b.turn AS j, round(sum(a.w * b.w), 9) AS sim
  FROM vec a JOIN vec b ON a.conv_id = b.conv_id AND a.term = b.term AND a.turn < b.turn
  GROUP BY ALL)"""
VECTORS = f"{STOP}, {TOPICS}, {WITHIN}, {SIMS}"


def leaders(threshold: float, vectors: str = VECTORS) -> str:
    return f"""{vectors},
adj AS (SELECT conv_id, j AS turn, list(i) AS nb FROM sims WHERE sim > {threshold} GROUP BY ALL),
ordered AS (SELECT conv_id, turn, coalesce(nb, []) AS nb,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM topics2 LEFT JOIN adj USING (conv_id, turn)),
walk AS (
  SELECT conv_id, rn, turn, [turn] AS found, turn AS leader FROM ordered WHERE rn = 1
  UNION ALL
  SELECT h.conv_id, h.rn, h.turn,
    CASE WHEN hit IS NULL THEN list_append(found, turn) ELSE found END, coalesce(hit, turn)
  FROM (SELECT o.*, w.found, CASE WHEN o.n > 2 THEN
          list_min(list_filter(w.found, lambda l: list_contains(o.nb, l))) END AS hit
        FROM walk w JOIN ordered o ON o.conv_id = w.conv_id AND o.rn = w.rn + 1) h),
led AS (SELECT conv_id, turn, leader FROM walk)"""


def merged(threshold: float) -> str:
    return f"""{leaders(threshold)},
members AS (SELECT conv_id, leader, count(*) AS size,
    array_to_string(list(name ORDER BY turn)[1:2], ' / ') AS name,
    array_to_string(list(description ORDER BY turn), ' | ') AS description,
    list(name ORDER BY turn) AS names,
    list_sort(list_distinct(flatten(list(phrases)))) AS all_phrases,
    any_value(phrases) AS own_phrases, any_value(importance) AS own_importance,
    round_even(avg(coalesce(importance, 5)), 0)::DOUBLE AS mean_importance,
    any_value(quotes) AS own_quotes,
    list_sort(list_distinct(flatten(list(quotes))))[1:3] AS all_quotes
  FROM topics2 JOIN led USING (conv_id, turn) GROUP BY ALL),
merged AS (SELECT conv_id, leader AS leader_no, name, description, size,
    CASE WHEN size = 1 THEN own_phrases ELSE all_phrases END AS phrases,
    CASE WHEN size = 1 THEN own_importance ELSE mean_importance END AS importance,
    CASE WHEN size = 1 THEN own_quotes ELSE all_quotes END AS quotes,
    CASE WHEN size > 1 THEN names END AS merged_from
  FROM members)"""


def records() -> str:
    """Conversations as stage 1 records; one in ten failed and has no topics."""
    return f"""{merged(LOOSE)},
rec AS (SELECT a.conv_id, word_count, CASE WHEN a.conv_id % 10 = 9 THEN 'unreadable' END AS error,
    CASE WHEN a.conv_id % 10 <> 9 THEN n END AS topics_count,
    CASE WHEN a.conv_id % 10 <> 9 THEN m END AS clustered_count, originals, clustered
  FROM (SELECT conv_id, sum(len({words('text')}))::BIGINT AS word_count FROM conversations
        GROUP BY 1) a
  JOIN (SELECT conv_id, count(*) AS n, list(name ORDER BY turn) AS originals FROM topics2
        GROUP BY 1) b USING (conv_id)
  JOIN (SELECT conv_id, count(*) AS m,
          list(struct_pack(name := name, description := description, importance := importance)
               ORDER BY leader_no) AS clustered
        FROM merged GROUP BY 1) c USING (conv_id))"""


THEMES = f"""themes AS (
  SELECT doc_id, ascii(lang) AS cluster_number,
    unnest([0, 1]) AS theme_no,
    unnest([array_to_string(t[1:3], ' '), source]) AS name,
    unnest([text, {SENTENCE.format('text')}]) AS description,
    unnest([CASE WHEN doc_id % 11 <> 10 THEN (doc_id % 11)::DOUBLE END, 9.0::DOUBLE]) AS strength,
    unnest([NULL, 'all of ' || lang]) AS coverage
  FROM (SELECT *, {toks('text')} AS t FROM documents))"""


# --- prompts and answers -------------------------------------------------------

ORACLES["topic_prompts"] = f"""
SELECT doc_id, window_no, {text(P.TOPIC_REQUEST.format(max_topics=S.max_topics) + chr(10) + 'Interview:' + chr(10))}
  || substring(text, window_no * {S.content_cap} + 1, {S.content_cap})
  || {text(P.ANSWER_WITH + P.TOPIC_ANSWER_SHAPE)} AS prompt
FROM (SELECT doc_id, text,
    unnest(range(greatest(1, ceil(length(text) / {S.content_cap})::BIGINT))) AS window_no FROM documents)"""

ORACLES["theme_prompts"] = f"""
WITH RECURSIVE {records()}
SELECT conv_id, {text(P.THEME_REQUEST + chr(10) + 'Topics:' + chr(10))}
  || array_to_string(list_transform(clustered, lambda t: '- ' || t.name || ': ' || t.description
     || ' (Importance: ' || coalesce(t.importance::BIGINT::VARCHAR, 'N/A') || ')'), chr(10))
  || {text(P.ANSWER_WITH + P.THEME_ANSWER_SHAPE)} AS prompt
FROM rec WHERE error IS NULL"""

SHOWN = f"""shown AS (SELECT *, row_number() OVER (PARTITION BY cluster_number
    ORDER BY doc_id, theme_no) AS shown_no FROM themes QUALIFY shown_no <= {S.shown_themes})"""
ORACLES["cluster_prompts"] = f"""
WITH {THEMES}, {SHOWN},
sizes AS (SELECT cluster_number, count(DISTINCT doc_id) AS size FROM themes GROUP BY 1)
SELECT cluster_number, any_value(size) || {text(P.CLUSTER_REQUEST + chr(10) + 'Themes:' + chr(10))}
  || string_agg('- ' || doc_id || ': ' || name || ' (' || description || ')', chr(10)
                ORDER BY shown_no)
  || {text(P.ANSWER_WITH + P.CLUSTER_ANSWER_SHAPE)} AS prompt
FROM shown JOIN sizes USING (cluster_number) GROUP BY cluster_number"""

ORACLES["search_sentences"] = f"""
WITH {THEMES}
SELECT doc_id, theme_no, 'Find articles and content related to ' || name || '. Focus on: '
  || description AS question FROM themes"""

ANSWERS = """answers AS (
  SELECT conv_id, turn, role, text, (conv_id + turn) % 8 AS form,
    '{"topics":[{' || CASE WHEN (conv_id + turn) % 8 = 6 THEN '' ELSE '"name":' || to_json(role) || ',' END
    || '"description":' || to_json(text) || ',"importance":' || turn || '}]}' AS body
  FROM conversations)"""
ORACLES["fence_strip"] = f"""
WITH {ANSWERS}
SELECT conv_id, turn, CASE form WHEN 0 THEN chr(10) || body || chr(10)
  WHEN 1 THEN chr(10) || body || chr(10) WHEN 2 THEN body WHEN 3 THEN body[:-3]
  WHEN 4 THEN '[' || body || ']' WHEN 5 THEN body || ' and so on' WHEN 6 THEN body END AS body
FROM answers"""
PARSED = f"""{ANSWERS},
parsed AS (SELECT *, CASE form WHEN 3 THEN 'json_parse_failed' WHEN 4 THEN 'not_an_object'
    WHEN 5 THEN 'json_parse_failed' WHEN 6 THEN 'bad_topic' WHEN 7 THEN 'no answer for ' || role END
    AS error FROM answers)"""
ORACLES["response_parse"] = f"""
WITH {PARSED}
SELECT conv_id, turn, error, CASE WHEN error IS NULL THEN 1 ELSE 0 END AS topics_count,
  CASE WHEN error IS NULL THEN role END AS name, CASE WHEN error IS NULL THEN text END AS description,
  CASE WHEN error IS NULL THEN turn::DOUBLE END AS importance FROM parsed"""
ORACLES["response_errors"] = (
    f"WITH {PARSED} SELECT error, count(*) AS rows FROM parsed GROUP BY error"
)
ORACLES["completion_calls"] = """
SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0 THEN 'refused' END AS error,
  CASE WHEN length(text) % 7 <> 0 THEN length(text)::VARCHAR END AS description FROM conversations"""


# --- terms -----------------------------------------------------------------------

CORPUS = f"WITH {STOP}, " + tfidf("documents", "doc_id", "", S.article_terms, False, "text")
ORACLES["term_counts"] = f"{CORPUS} SELECT doc_id, term, tf FROM tf"
ORACLES["bigrams"] = f"""{CORPUS},
pairs AS (SELECT doc_id, term || ' ' || lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS term FROM uni)
SELECT term, count(*) AS cf, count(DISTINCT doc_id) AS df FROM pairs WHERE term IS NOT NULL GROUP BY term"""
ORACLES["vocabulary_topn"] = f"{CORPUS} SELECT term, cf, df, slot FROM vocab"
ORACLES["tfidf_within_article"] = f"""
WITH {STOP}, {TOPICS}, {WITHIN}
SELECT conv_id, turn AS topic_no, term, round(w, 6) AS w FROM vec"""
ORACLES["tfidf_corpus"] = (
    f"WITH {STOP}, "
    + tfidf("documents", "doc_id", "", S.article_terms, True, "text")
    + " SELECT doc_id, term, round(w, 6) AS w FROM vec"
)


# --- topics inside an article ------------------------------------------------------


def similar(threshold: float) -> str:
    """Pairs of distinct vectors; equal vectors are one point with its copies."""
    return f"""WITH {VECTORS},
points AS (SELECT conv_id, turn, list(struct_pack(s := slot, w := round(w, 12)) ORDER BY slot) AS v
  FROM vec GROUP BY ALL),
firsts AS (SELECT conv_id, v, min(turn) AS turn, count(*) AS copies FROM points GROUP BY ALL)
SELECT s.conv_id, i, j, round(sim, 6) AS sim, a.copies AS copies_i, b.copies AS copies_j
FROM sims s JOIN firsts a ON a.conv_id = s.conv_id AND a.turn = s.i
JOIN firsts b ON b.conv_id = s.conv_id AND b.turn = s.j WHERE sim > {threshold}"""


ORACLES["topic_similarity_pairs"] = similar(S.similarity_threshold)
ORACLES["topic_copies"] = f"""WITH {VECTORS},
points AS (SELECT conv_id, turn, list(struct_pack(s := slot, w := round(w, 12)) ORDER BY slot) AS v
  FROM vec GROUP BY ALL)
SELECT conv_id, turn AS topic_no, min(turn) OVER (PARTITION BY conv_id, v) AS representative,
  count(*) OVER (PARTITION BY conv_id, v) AS copies FROM points"""
ORACLES["topic_similarity_pairs_loose"] = similar(LOOSE)
for name, threshold in (("", S.similarity_threshold), ("_loose", LOOSE)):
    ORACLES[f"topic_leaders{name}"] = f"""
WITH RECURSIVE {leaders(threshold)}
SELECT l.conv_id, l.turn AS topic_no, leader AS leader_no,
  CASE WHEN l.turn = leader THEN 1.0 ELSE round(sim, 6) END AS sim
FROM led l LEFT JOIN sims s ON s.conv_id = l.conv_id AND s.i = leader AND s.j = l.turn"""
    ORACLES[f"merged_topics{name}"] = f"""
WITH RECURSIVE {merged(threshold)}
SELECT conv_id, leader_no, 0 AS part_no, name, description, {joined('phrases')} AS key_phrases,
  importance, {joined('quotes')} AS supporting_quotes, {joined('merged_from')} AS merged_from,
  CASE WHEN size > 1 THEN size END AS cluster_size FROM merged"""
ORACLES["stage1_records"] = f"""
WITH RECURSIVE {records()}
SELECT conv_id, word_count, error, 0 AS part_no,
  CASE WHEN error IS NULL THEN {joined('originals')} END AS original_names,
  CASE WHEN error IS NULL THEN {joined('list_transform(clustered, lambda c: c.name)')} END
    AS clustered_names, topics_count, clustered_count,
  round_even((topics_count - clustered_count) / topics_count, 2)::DOUBLE AS reduction_ratio
FROM rec"""
SUMMARY1 = """SELECT 1 AS stage, 'Within-article topic clustering' AS description,
  count(*) AS total_articles, count(*) FILTER (error IS NULL) AS successful_articles,
  count(*) FILTER (error IS NOT NULL) AS failed_articles,
  sum(topics_count)::BIGINT AS total_original_topics,
  sum(clustered_count)::BIGINT AS total_clustered_topics FROM rec"""
ORACLES["stage1_summary"] = f"WITH RECURSIVE {records()} {SUMMARY1}"
ORACLES["successful_articles"] = f"""
WITH RECURSIVE {records()}
SELECT conv_id, clustered_count FROM rec WHERE error IS NULL AND clustered_count > 0"""


def segments(source: str, keys: str, key: str, number: str) -> str:
    """The built-in topics of the segments in ``source``."""
    base = tfidf(source, keys, key, 1_000_000_000, False, "text", "seg_")
    return f"""{STOP}, {base},
rated AS (SELECT {keys}, term, round(raw, 6) AS w FROM seg_raw),
heads AS (SELECT {keys}, round(sum(w), 4) AS mass,
    array_to_string(list(term ORDER BY w DESC, term)[1:3], ' ') AS name FROM rated GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY mass DESC, {number}) AS rank
  FROM heads QUALIFY rank <= {S.max_topics}),
firsts AS (SELECT {keys}, pair, min(pos) AS pos FROM (SELECT {keys}, pos, term || ' '
    || lead(term) OVER (PARTITION BY {keys} ORDER BY pos) AS pair FROM seg_uni)
  WHERE pair IS NOT NULL GROUP BY ALL),
phrases AS (SELECT {keys}, list(pair ORDER BY pos)[1:3] AS phrases FROM firsts GROUP BY ALL),
found AS (SELECT {keys}, rank - 1 AS topic_no, name, {SENTENCE.format('text')} AS description,
    coalesce(phrases, []) AS phrases, greatest(1, 11 - rank)::DOUBLE AS importance, text
  FROM best JOIN {source} USING ({keys}) LEFT JOIN phrases USING ({keys}))"""


ORACLES["builtin_topics"] = f"""
WITH {segments('conversations', 'conv_id, turn', 'conv_id', 'turn')}
SELECT conv_id, topic_no, name, description, {joined('phrases')} AS key_phrases, importance,
  text AS supporting_quotes FROM found"""


DOCUMENT_TOPICS = f"""segs AS (
  SELECT doc_id AS conv_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS turn, line AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
          generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
  WHERE trim(line) <> ''),
{segments('segs', 'conv_id, turn', 'conv_id', 'turn')},
topics2 AS (SELECT conv_id, topic_no AS turn, name, description, phrases, importance FROM found),
{WITHIN}, {SIMS}"""
ORACLES["stage1_documents"] = f"""
WITH RECURSIVE {leaders(S.similarity_threshold, DOCUMENT_TOPICS)},
counts AS (SELECT conv_id, count(*) AS n, count(DISTINCT leader) AS m FROM led GROUP BY 1)
SELECT doc_id, source || '_' || doc_id || '.md' AS filename, len({words('text')})::BIGINT AS word_count,
  coalesce(n, 0) AS topics_count, coalesce(m, 0) AS clustered_count,
  coalesce(round_even((n - m) / n, 2)::DOUBLE, 0) AS reduction_ratio, NULL::VARCHAR AS error
FROM documents LEFT JOIN counts ON conv_id = doc_id"""


# --- themes and clusters -------------------------------------------------------------

ORACLES["builtin_themes"] = f"""
WITH RECURSIVE {records()},
t AS (SELECT conv_id, len(clustered) AS n, unnest(clustered) AS c,
    generate_subscripts(clustered, 1) AS pos FROM rec WHERE error IS NULL),
g AS (SELECT conv_id, n, split_part(c.name, ' ', 1) AS word, count(*) AS uses,
    round(avg(coalesce(c.importance, 5)), 6) AS mean,
    round_even(avg(coalesce(c.importance, 5)), 0)::DOUBLE AS strength,
    list(c.description ORDER BY pos)[1] AS description, list(c.name ORDER BY pos) AS names
  FROM t GROUP BY ALL)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY uses DESC, mean DESC, word) - 1
    AS theme_no, word AS name, description, {joined('names')} AS related_topics, strength,
  uses || ' of ' || n || ' topics' AS coverage
FROM g QUALIFY theme_no < 4"""

WEIGHTED = f"""weighted AS (SELECT doc_id, string_agg(array_to_string(list_transform(
      range(greatest(1, floor(coalesce(strength, 5) / 3))::BIGINT),
      lambda i: name || ' ' || description || ' ' || coalesce(coverage, '')), ' '), ' '
    ORDER BY theme_no) AS text FROM themes GROUP BY doc_id)"""
ORACLES["theme_weighting"] = f"WITH {THEMES}, {WEIGHTED} SELECT doc_id, text FROM weighted"
ORACLES["cluster_count"] = """
SELECT source, lang, count(*) AS articles,
  least(least(greatest(2, count(*) // 8), 10), count(*))::INT AS k FROM documents GROUP BY ALL"""

POINTS = """pts AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
dims AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM pts),
centres AS (SELECT label, dim, avg(x) AS value FROM dims GROUP BY ALL)"""
NEAREST = f"""{POINTS},
centre_rows AS (SELECT label, list(value ORDER BY dim) AS c FROM centres GROUP BY label),
gaps AS (SELECT vec_id, b.label AS cluster_number, list_distance(a.v, b.c) ^ 2 AS d
  FROM pts a, centre_rows b),
nearest AS (SELECT vec_id, arg_min(cluster_number, struct_pack(d := round(d, 9), l := cluster_number))
    AS cluster_number, min(d) AS d FROM gaps GROUP BY vec_id)"""
ORACLES["centroids"] = f"WITH {POINTS} SELECT label, dim::INT AS dim, round(value, 6) AS value FROM centres"
ORACLES["nearest_centroid"] = f"""
WITH {NEAREST} SELECT vec_id, cluster_number, round(d, 6) AS squared_distance FROM nearest"""
ORACLES["inertia"] = (
    f"WITH {NEAREST} SELECT count(*) AS points, round(sum(d), 6) AS inertia FROM nearest"
)
SILHOUETTE = f"""{POINTS},
near AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS total,
    count(*) AS n FROM pts a, pts b GROUP BY ALL),
ab AS (SELECT vec_id, label, max(CASE WHEN other = label THEN n END) AS size,
    max(CASE WHEN other = label AND n > 1 THEN total / (n - 1) END) AS a,
    min(CASE WHEN other <> label THEN total / n END) AS b FROM near GROUP BY ALL),
scores AS (SELECT vec_id, label, CASE WHEN b IS NULL THEN NULL WHEN size = 1 THEN 0.0
    ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS score FROM ab)"""
ORACLES["silhouette_by_point"] = f"""
WITH {SILHOUETTE}
SELECT min(vec_id) AS vec_id, label, count(*) AS copies, round(any_value(score), 6) AS score
FROM scores JOIN pts USING (vec_id, label) GROUP BY label, v"""
SCORE = """SELECT count(*) AS points, count(DISTINCT label) AS clusters,
  CASE WHEN count(DISTINCT label) = 1 THEN 0.0 WHEN count(DISTINCT label) < count(*)
    THEN round(avg(score), 3) END AS silhouette_score FROM scores"""
ORACLES["silhouette_score"] = f"WITH {SILHOUETTE} {SCORE}"
ORACLES["cluster_members"] = """
SELECT 'cluster_' || label AS cluster_id, label AS cluster_number, vec_id,
  count(*) OVER (PARTITION BY label) AS size FROM embeddings"""
ORACLES["cluster_themes_top20"] = f"""
WITH {THEMES}, {SHOWN}
SELECT cluster_number, shown_no, doc_id, theme_no, name, description FROM shown"""
ORACLES["cluster_theme_counts"] = f"""
WITH {THEMES}
SELECT cluster_number, count(*) AS themes_analyzed,
  round(avg(coalesce(strength, 5)), 6) AS mean_strength FROM themes GROUP BY 1"""
ANALYSIS = f"""{THEMES},
sizes AS (SELECT cluster_number, count(DISTINCT doc_id) AS size, count(*) AS n FROM themes GROUP BY 1),
by_name AS (SELECT cluster_number, name, sum(coalesce(strength, 5)) AS weight, count(*) AS uses
  FROM themes GROUP BY ALL),
top AS (SELECT cluster_number, list(name ORDER BY weight DESC, uses DESC, name)[1:6] AS names
  FROM by_name GROUP BY 1)"""
ORACLES["builtin_cluster_analysis"] = f"""
WITH {ANALYSIS}
SELECT 'cluster_' || cluster_number AS cluster_id, cluster_number, size,
  array_to_string(names[1:3], ' ') AS cluster_name, names[1] AS main_theme,
  {joined('names[1:3]')} AS common_patterns, {joined('names[4:6]')} AS distinguishing_features,
  'Themes: ' || array_to_string(names, ', ') AS cluster_summary, size AS articles_count,
  n AS themes_analyzed, array_to_string(names[1:3], ' ') AS display_name, names[1] AS display_theme,
  NULL::VARCHAR AS error
FROM sizes JOIN top USING (cluster_number)"""
ORACLES["cluster_fallback_names"] = f"""
WITH {ANALYSIS}
SELECT cluster_number, size, CASE WHEN cluster_number % 2 = 0 THEN array_to_string(names[1:3], ' ')
    ELSE 'Cluster ' || cluster_number END AS display_name,
  CASE WHEN cluster_number % 2 = 0 THEN names[1] ELSE 'Unknown theme' END AS display_theme
FROM sizes JOIN top USING (cluster_number)"""
ORACLES["first_match_lookup"] = """
WITH f AS (SELECT source, min(doc_id) AS first_id, arg_min(lang, doc_id) AS first_lang
  FROM documents GROUP BY source)
SELECT doc_id, source, first_id, first_lang FROM documents JOIN f USING (source)"""
ORACLES["stage2_summary"] = f"""
WITH {SILHOUETTE}, score AS ({SCORE}),
articles AS (SELECT count(DISTINCT conv_id) AS total_articles FROM conversations),
rows AS (SELECT count(*) FILTER (doc_id % 13 <> 12) AS articles_with_themes,
    count(*) FILTER (doc_id % 13 = 12) AS failed_articles FROM documents)
SELECT 2 AS stage, 'Cross-article theme clustering' AS description, total_articles,
  articles_with_themes, failed_articles, 'k-means' AS clustering_method,
  clusters AS n_clusters, silhouette_score FROM score, articles, rows"""


# --- retrieval -------------------------------------------------------------------------

CHUNKS = f"""ws AS (SELECT doc_id, {words('text')} AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(0, len(ws), {CHUNK - OVERLAP})) AS s FROM ws),
chunks AS (SELECT doc_id, (s // {CHUNK - OVERLAP})::INT AS chunk_no,
    array_to_string(ws[s + 1 : s + {CHUNK}], ' ') AS text FROM starts)"""
ORACLES["chunks"] = f"WITH {CHUNKS} SELECT doc_id, chunk_no, text FROM chunks"
# CRC-32 of a term's bytes, bit by bit, for the distinct terms only
CRC = """crc AS (SELECT term, xor(list_reduce(
    list_transform(range(octet_length(encode(term))),
      lambda i: ('0x' || substr(hex(encode(term)), (2 * i + 1)::INT, 2))::BIGINT),
    lambda acc, b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(acc, b)),
    4294967295::BIGINT), 4294967295) AS crc FROM (SELECT DISTINCT term FROM uni))"""
ORACLES["chunk_vectors"] = f"""
WITH {STOP}, {CHUNKS}, tok AS (SELECT doc_id, chunk_no, unnest({toks('text')}) AS term FROM chunks),
uni AS (SELECT * FROM tok WHERE term NOT IN (SELECT w FROM stop)), {CRC},
slots AS (SELECT doc_id, chunk_no, crc % {S.embedding_dim} AS slot, count(*) AS n
  FROM uni JOIN crc USING (term) GROUP BY ALL),
grid AS (SELECT doc_id, chunk_no, unnest(range({S.embedding_dim})) AS slot FROM chunks)
SELECT doc_id, chunk_no, string_agg(coalesce(n, 0), '|' ORDER BY slot) AS v
FROM grid LEFT JOIN slots USING (doc_id, chunk_no, slot) GROUP BY ALL"""
ORACLES["vector_topk"] = f"""
WITH {POINTS},
centre_rows AS (SELECT label, list(value ORDER BY dim) AS c FROM centres GROUP BY label),
scored AS (SELECT b.label::VARCHAR AS query_id, vec_id,
    round(list_cosine_similarity(a.v, b.c), 9) AS score FROM pts a, centre_rows b)
SELECT query_id, vec_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM scored QUALIFY rank <= {K}"""
ORACLES["vector_index_topk"] = f"""
WITH pts AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
asked AS (SELECT vec_id AS asker, v AS q FROM pts WHERE vec_id % 50 = 0),
scored AS (SELECT asker::VARCHAR AS query_id, vec_id, round(list_cosine_similarity(q, v), 9) AS score
  FROM asked, pts)
SELECT query_id, vec_id, round(score, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
FROM scored QUALIFY rank <= {K}"""
KEYED = f"""{STOP}, {CHUNKS},
{tfidf('chunks', 'doc_id, chunk_no', '', 1_000_000_000, False, 'text')},
picked AS (SELECT doc_id, chunk_no, term, row_number() OVER (PARTITION BY doc_id, chunk_no
    ORDER BY round(raw, 6) DESC, term) AS r FROM raw QUALIFY r <= {S.chunk_key_terms}),
edges AS (SELECT a.term AS a, b.term AS b, count(*) AS weight FROM picked a JOIN picked b
  ON a.doc_id = b.doc_id AND a.chunk_no = b.chunk_no AND a.term < b.term GROUP BY ALL)"""
ORACLES["chunk_key_terms"] = f"""
WITH {KEYED}
SELECT doc_id, chunk_no, string_agg(term, '|' ORDER BY term) AS terms FROM picked GROUP BY ALL"""
ORACLES["term_graph_nodes"] = (
    f"WITH {KEYED} SELECT term, count(*) AS chunks FROM picked GROUP BY term"
)
ORACLES["term_graph"] = f"WITH {KEYED} SELECT a, b, weight FROM edges"
ASKED = "(" + ", ".join(text(q) for q in QUESTION) + ")"
LOCAL = f"""ends AS (
  SELECT b AS term, weight FROM edges WHERE a IN {ASKED} UNION ALL
  SELECT a, weight FROM edges WHERE b IN {ASKED}),
near AS (SELECT term, max(weight) AS weight FROM ends WHERE term NOT IN {ASKED} GROUP BY term
  ORDER BY weight DESC, term LIMIT {S.neighbours}),
wanted AS (SELECT term, weight / max(weight) OVER () AS relevance FROM near UNION ALL
  SELECT unnest([{', '.join(text(q) for q in QUESTION)}]), 1.0),
local AS (SELECT doc_id, chunk_no, round(sum(relevance), 6) AS score,
    row_number() OVER (ORDER BY round(sum(relevance), 6) DESC, doc_id, chunk_no) AS rank
  FROM picked JOIN wanted USING (term) GROUP BY doc_id, chunk_no QUALIFY rank <= {K})"""
GLOBAL = f"""globally AS (SELECT a.doc_id, a.chunk_no, sum(weight)::DOUBLE AS score,
    row_number() OVER (ORDER BY sum(weight) DESC, a.doc_id, a.chunk_no) AS rank
  FROM picked a JOIN picked b ON a.doc_id = b.doc_id AND a.chunk_no = b.chunk_no
  JOIN edges e ON e.a = a.term AND e.b = b.term
  WHERE e.a IN {ASKED} OR e.b IN {ASKED} GROUP BY a.doc_id, a.chunk_no QUALIFY rank <= {K})"""
ORACLES["retrieve_local"] = f"WITH {KEYED}, {LOCAL} SELECT doc_id, chunk_no, score, rank FROM local"
ORACLES["retrieve_global"] = (
    f"WITH {KEYED}, {GLOBAL} SELECT doc_id, chunk_no, score, rank FROM globally"
)
# the growing store picks key terms inside each chunk: by count, ties by term
STORED = f"""{STOP}, {CHUNKS},
{tfidf('chunks', 'doc_id, chunk_no', '', 1_000_000_000, False, 'text')},
picked AS (SELECT doc_id, chunk_no, term, row_number() OVER (PARTITION BY doc_id, chunk_no
    ORDER BY tf DESC, term) AS r FROM tf QUALIFY r <= {S.chunk_key_terms}),
edges AS (SELECT a.term AS a, b.term AS b, count(*) AS weight FROM picked a JOIN picked b
  ON a.doc_id = b.doc_id AND a.chunk_no = b.chunk_no AND a.term < b.term GROUP BY ALL)"""
ORACLES["term_store_local"] = f"WITH {STORED}, {LOCAL} SELECT doc_id, chunk_no, score, rank FROM local"
ORACLES["term_store_global"] = f"WITH {STORED}, {GLOBAL} SELECT doc_id, chunk_no, score, rank FROM globally"
ORACLES["retrieve_hybrid"] = f"""
WITH {KEYED}, {LOCAL}, {GLOBAL},
best AS (SELECT doc_id, chunk_no, min(rank) AS best_rank, count(*) AS found_by FROM (
    SELECT doc_id, chunk_no, rank FROM local UNION ALL
    SELECT doc_id, chunk_no, rank FROM globally) GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY best_rank, doc_id, chunk_no) AS rank FROM best
QUALIFY rank <= {K}"""


# --- totals ------------------------------------------------------------------------------

FAILED = "doc_id % 19 = 18"
ORACLES["corpus_totals"] = f"""
SELECT count(*) AS documents, count(*) FILTER (NOT {FAILED}) AS inserted,
  count(*) FILTER ({FAILED}) AS failed,
  (sum(len({words('text')})) FILTER (NOT {FAILED}))::BIGINT AS words FROM documents"""
ORACLES["failure_counts"] = f"""
SELECT CASE WHEN {FAILED} THEN 'cannot read ' || lang END AS error, count(*) AS rows
FROM documents GROUP BY 1"""


def oracles() -> dict[str, str]:
    return dict(ORACLES)
