"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from ..functions.constants import BLOCK_TAGS, CHAT_ROLES, CONCEPT_LIMITS, DISCOURAGED_LABELS, GLYPHS, SKIPPED_TAGS, STOP_WORDS
from ..operators.symbols import BONUS
from ..sources.normalize import _ENTITIES, _REST


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _among(words) -> str:
    return "(" + ", ".join(map(_lit, words)) + ")"


def _chain(start: str, steps: list[tuple[str, str]]) -> str:
    for pattern, value in steps:
        start = f"regexp_replace({start}, {_lit(pattern)}, {value}, 'g')"
    return start


_LINES = [("\\r\\n?", "chr(10)"), ("[ \\t]+", "' '"), (" ?\\n ?", "chr(10)"), ("\\n{3,}", "chr(10) || chr(10)"), ("^\\s+|\\s+$", "''")]


def _normal(column: str) -> str:
    return _chain(f"coalesce({column}, '')", _LINES)


def _html(column: str) -> str:
    steps = [("(?s)<!--.*?(?:-->|\\z)", "' '")]
    steps += [(f"(?is)<\\s*{t}{_REST}>.*?(?:</\\s*{t}{_REST}>|\\z)", "''") for t in SKIPPED_TAGS]
    steps += [("(?i)<\\s*(?:!doctype|\\?xml)[^>]*>", "''"), (f"(?i)<\\s*/?\\s*(?:{'|'.join(BLOCK_TAGS)}){_REST}>", "chr(10)"), ("<[^>]*>", "' '"), ("<[^>]*\\z", "' '"), ("&amp;", "chr(1)")]
    steps += [(f"&{n};", _lit(v)) for n, v in _ENTITIES] + [("&[A-Za-z]+;", "' '"), ("\\x01", "'&'")]
    return _chain(_chain(f"coalesce({column}, '')", steps), _LINES)


def _space(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9_\\-'']*'), lambda t: length(t) > 1)"


def _content(x: str) -> str:
    return f"list_filter({_tokens(x)}, lambda t: t NOT IN {_among(STOP_WORDS)})"


def _round(x: str, digits: int) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def _jaccard(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0 WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE {n} / CAST(len({a}) + len({b}) - {n} AS DOUBLE) END"


_ROLE = "CASE WHEN r = '' THEN 'unknown' " + " ".join(f"WHEN regexp_matches(r, '(?:^| )(?:{'|'.join(a)})(?: |$)') THEN '{n}'" for n, a in CHAT_ROLES.items()) + " ELSE r END"
_LABEL = "CASE c WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System' WHEN 'tool' THEN 'Tool' ELSE 'Speaker' END"

DOCS = f"docs AS (SELECT printf('doc:%06d', doc_id) AS source_id, {_normal('text')} AS text FROM documents)"

_TABLE = "(len(regexp_extract_all(t, '\\|')) >= 2 OR len(regexp_extract_all(t, '\\t')) >= 2 OR regexp_matches(t, '^[^,]{1,80}(?:,[^,]{1,80}){2,}$'))"
_JSON = "(regexp_matches(t, '^[\\[{]') OR regexp_matches(t, '^\"[^\"\\n]{1,120}\"\\s*:') OR regexp_matches(t, '^(?:true|false|null|-?[0-9]+(?:\\.[0-9]+)?)\\s*[,}\\]]?$'))"
_HEAD = "(length(t) <= 120 AND (regexp_matches(t, '^#{1,6}\\s+') OR regexp_matches(t, '(?i)^(?:chapter|section|part|appendix)\\b') OR regexp_matches(t, '^[A-Z0-9][A-Z0-9\\s:._\\-/]{4,90}$')))"
_STAMP = "regexp_matches({x}, '(?i)\\b(?:[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?\\s?(?:AM|PM)?|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}})\\b')"

#: Lines with type (code fences included), then blocks, over a table s(source_id, text).
LINES = f"""
raw AS (SELECT source_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM s WHERE length(text) > 0),
l0 AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS t FROM raw),
l1 AS (SELECT *, starts_with(t, '```') AS fence,
              coalesce(sum(length(line) + 1) OVER w, 0) AS start, coalesce(sum(CAST(starts_with(t, '```') AS INT)) OVER w, 0) % 2 = 1 AS inside
       FROM l0 WINDOW w AS (PARTITION BY source_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lines AS (SELECT *, CASE WHEN fence OR inside THEN 'code' WHEN t = '' THEN NULL WHEN {_TABLE} THEN 'table' WHEN {_JSON} THEN 'json' WHEN {_HEAD} THEN 'section' WHEN starts_with(t, '>') THEN 'quote' ELSE 'paragraph' END AS type FROM l1)"""

BLOCKS = LINES + f""",
b0 AS (SELECT *, lag(type) OVER w AS ptype, coalesce(lag(fence AND inside) OVER w, false) AS closed,
              max(CASE WHEN type IS NOT NULL THEN line_no END) OVER (PARTITION BY source_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_text
       FROM lines WINDOW w AS (PARTITION BY source_id ORDER BY line_no)),
b1 AS (SELECT *, sum(CAST(type IS NOT NULL AND (ptype IS NULL OR ptype <> type OR (fence AND NOT inside) OR closed) AS INT)) OVER (PARTITION BY source_id ORDER BY line_no) AS block_no FROM b0),
b2 AS (SELECT source_id, block_no, min_by(type, line_no) AS type, min_by(line_no - coalesce(last_text, -1) - 1, line_no) AS leading_blank_lines, min_by(start, line_no) AS begin_at,
              string_agg(line, chr(10) ORDER BY line_no) AS raw FROM b1 WHERE type IS NOT NULL GROUP BY ALL),
blocks AS (SELECT source_id, CAST(block_no AS BIGINT) AS block_no, type, CAST(leading_blank_lines AS INT) AS leading_blank_lines, CAST(begin_at AS BIGINT) AS start_offset, CAST(begin_at + length(raw) AS BIGINT) AS end_offset, raw AS text, {_STAMP.format(x='raw')} AS has_timestamp FROM b2)"""

MESSAGES = f"""
m0 AS (SELECT printf('c%06d', conv_id) AS session_id, printf('c%06d/%04d', conv_id, turn) AS chunk_id, conv_id, turn AS seq_in_session, role, {_space('text')} AS text FROM conversations),
messages AS (SELECT * FROM m0 WHERE text <> '')"""

_KIND = """CASE WHEN regexp_matches(lower(text), '\\b(?:error|failed|failure|exception|traceback|bug)\\b') THEN 'error'
 WHEN regexp_matches(lower(text), '\\b(?:decision|decide|decided|approved|final|resolved|ship(?:ped)?)\\b') THEN 'decision'
 WHEN regexp_matches(lower(text), '\\b(?:please|could you|can you|would you|need to|request|ask)\\b') THEN 'request'
 WHEN regexp_matches(lower(text), '\\b(?:todo|next step|action item|follow up)\\b') THEN 'task'
 WHEN regexp_matches(text, '"[^"]+"|''[^'']+''') THEN 'quote'
 WHEN regexp_matches(lower(text), '\\b(?:is|means|defined as|consists of)\\b') THEN 'fact' ELSE 'statement' END"""
_SHAPE = """CASE WHEN contains(text, '|') OR regexp_matches(text, '(?i)\\b[a-z0-9_]+\\s*,\\s*[a-z0-9_]+\\s*,\\s*[a-z0-9_]+') THEN 'table'
 WHEN regexp_matches(trim(text), '^[\\[{]') OR regexp_matches(text, '"[^"\\\\]{1,40}"\\s*:') THEN 'json_object'
 WHEN regexp_matches(text, '(?i)^(?:#{1,6}\\s+)?(?:chapter|section|part|appendix)\\b') OR regexp_matches(trim(text), '^[A-Z0-9][A-Z0-9\\s:._\\-/]{6,90}$') THEN 'document_section' END"""

_MIN_CHUNKS, _MIN_TOTAL, _FACTOR = CONCEPT_LIMITS["medium"]


def _grams(n: int, weight: int) -> str:
    return f"SELECT session_id, chunk_id, array_to_string(g, ' ') AS surface, {weight} AS weight FROM (SELECT session_id, chunk_id, unnest(list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: list_slice(w, i, i + {n - 1}))) AS g FROM words) WHERE len(list_filter(g, lambda t: length(t) < 3)) = 0"


CONCEPTS = MESSAGES + f""",
words AS (SELECT session_id, chunk_id, text, {_content('text')} AS w FROM messages),
found AS ({_grams(2, 120)} UNION ALL {_grams(3, 100)} UNION ALL {_grams(4, 85)}
  UNION ALL SELECT session_id, chunk_id, {_space("substr(q, 2, length(q) - 2)")}, 200 FROM (SELECT session_id, chunk_id, unnest(regexp_extract_all(text, '"[^"\\n]{{3,80}}"|''[^''\\n]{{3,80}}''')) AS q FROM words)
  UNION ALL SELECT session_id, chunk_id, {_space('q')}, 150 FROM (SELECT session_id, chunk_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z0-9]+(?:\\s+[A-Z][a-z0-9]+){{1,4}}\\b')) AS q FROM words)),
summed AS (SELECT session_id, chunk_id, surface, CAST(sum(weight) AS BIGINT) AS weight FROM found WHERE length(surface) >= 3 GROUP BY ALL HAVING sum(weight) >= 100),
cand AS (SELECT *, trim(regexp_replace(lower(surface), '[^a-z0-9\\s]', '', 'g')) AS key FROM summed),
candidates AS (SELECT * FROM cand WHERE length(key) >= 3 AND len(string_split(key, ' ')) <= 6),
labels AS (SELECT key, arg_min(surface, (-weight, surface)) AS label FROM (SELECT key, surface, sum(weight) AS weight FROM candidates GROUP BY ALL) GROUP BY key),
totals AS (SELECT key, CAST(sum(weight) AS BIGINT) AS total, count(DISTINCT session_id) AS sessions, count(DISTINCT chunk_id) AS chunk_mentions FROM candidates GROUP BY key
           HAVING count(DISTINCT chunk_id) >= {_MIN_CHUNKS} AND sum(weight) >= {100 * _MIN_TOTAL}),
size AS (SELECT count(*) AS n FROM messages),
scored AS (SELECT t.*, label, n, least(1.0, 0.46::DOUBLE * (total / greatest(max(total) OVER (), 100)::DOUBLE) + 0.32::DOUBLE * (sessions / greatest(max(sessions) OVER (), 1)::DOUBLE) + 0.22::DOUBLE * (chunk_mentions / greatest(n, 1)::DOUBLE)) AS raw
           FROM totals t JOIN labels USING (key) CROSS JOIN size),
ranked AS (SELECT *, row_number() OVER (ORDER BY raw DESC, total DESC, label, key) AS rank FROM scored),
concepts AS (SELECT printf('concept_%06d', rank) AS concept_id, rank, key, label, {_round('raw', 4)} AS importance, raw, chunk_mentions AS recurrence_count, total, sessions
             FROM ranked WHERE rank <= greatest(10, least(800, CAST(floor(n * {_FACTOR}::DOUBLE + 0.5) AS BIGINT)))),
mentions AS (SELECT key, session_id, chunk_id, sum(weight) AS weight FROM candidates GROUP BY ALL),
links AS (SELECT session_id, chunk_id, concept_id, weight / 100.0::DOUBLE + raw AS score, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY weight / 100.0::DOUBLE + raw DESC, concept_id) AS INT) AS link_rank FROM mentions JOIN concepts USING (key)),
cooccur AS (SELECT a.concept_id AS src, b.concept_id AS dst, 'often_cooccurs_with' AS type, {_round("least(1.0, 0.35::DOUBLE + 0.08::DOUBLE * count(*))", 4)} AS weight FROM links a JOIN links b ON a.chunk_id = b.chunk_id AND a.concept_id < b.concept_id GROUP BY ALL HAVING count(*) >= 3),
ct AS (SELECT concept_id, label, rank, list_distinct({_content('label')}) AS tokens FROM concepts WHERE rank <= 2000),
pairs AS (SELECT a.concept_id AS a, b.concept_id AS b, lower(a.label) AS la, lower(b.label) AS lb, {_jaccard('a.tokens', 'b.tokens')} AS s FROM ct a JOIN ct b ON a.rank < b.rank),
label_edges AS (SELECT a AS src, b AS dst, 'related_to' AS type, {_round("least(1.0, 0.30::DOUBLE + s)", 4)} AS weight FROM pairs WHERE s >= 0.45
  UNION ALL SELECT CASE WHEN length(la) > length(lb) THEN a ELSE b END, CASE WHEN length(la) > length(lb) THEN b ELSE a END, 'subconcept_of', 0.65 FROM pairs WHERE la <> lb AND (contains(la, lb) OR contains(lb, la)))"""

_TOPIC = f"SELECT concept_id AS src, chunk_id AS dst, CASE WHEN link_rank = 1 THEN 'primary_topic_of' ELSE 'mentioned_in' END AS type, {_round('least(1.0, CASE WHEN link_rank = 1 THEN 0.65::DOUBLE + 0.05::DOUBLE * score ELSE 0.40::DOUBLE + 0.04::DOUBLE * score END)', 4)} AS weight FROM links WHERE link_rank <= 6"


def _glyphs() -> str:
    scores = []
    for name, (_, words) in GLYPHS.items():
        parts = [f"CASE WHEN contains(lower(text), {_lit(w)}) THEN 10 ELSE 0 END" for w in words]
        parts += ["CASE WHEN artifact_type IS NOT NULL THEN 32 ELSE 0 END"] if name == "artifact" else []
        parts += [f"CASE WHEN kind = '{k}' THEN {b} ELSE 0 END" for k, (f, b) in BONUS.items() if f == name]
        scores.append(" + ".join(parts))
    signs = ", ".join(_lit(g) for g, _ in GLYPHS.values())
    return f"""WITH {MESSAGES}, k AS (SELECT *, {_KIND} AS kind, {_SHAPE} AS artifact_type FROM messages), v AS (SELECT chunk_id, [{', '.join(scores)}] AS v FROM k)
SELECT chunk_id, [{signs}][list_position(v, list_max(v))] AS glyph, {_round('CASE WHEN list_sum(v) > 0 THEN greatest(0.08::DOUBLE, least(0.99::DOUBLE, list_max(v) / CAST(list_sum(v) AS DOUBLE))) ELSE 0.1::DOUBLE END', 2)} AS probability FROM v"""


_TRANSCRIPT = f"""
r AS (SELECT conv_id, turn, text, lower({_space('role')}) AS r FROM conversations),
c AS (SELECT *, {_ROLE} AS c FROM r),
b AS (SELECT conv_id, turn, {_LABEL} AS label, list_filter(list_transform(string_split({_chain("coalesce(text, '')", [("\\r\\n?", "chr(10)")])}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM c),
transcripts AS (SELECT printf('conv:%06d', conv_id) AS source_id, CASE WHEN count(*) FILTER (len(lines) > 0) = 0 THEN '' ELSE '# Conversation: Conversation ' || conv_id || string_agg(chr(10) || chr(10) || label || ': ' || array_to_string(lines, chr(10)), '' ORDER BY turn) FILTER (len(lines) > 0) END AS text FROM b GROUP BY conv_id)"""

_SENTENCES = f"""WITH {DOCS}, f AS (SELECT source_id, text, regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]+|$)') AS parts FROM docs),
e AS (SELECT source_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS i FROM f),
g AS (SELECT source_id, i, {_space('raw')} AS text FROM e)
SELECT source_id, text FROM g WHERE text <> '' UNION ALL SELECT source_id, {_space('text')} FROM f WHERE len(list_filter(parts, lambda p: {_space('p')} <> '')) = 0 AND {_space('text')} <> ''"""

ORACLE_SQL = {
    "q_line_normalize": f"WITH {DOCS} SELECT source_id, text, CAST(length(text) AS BIGINT) AS n_chars FROM docs",
    "q_html_to_text": f"SELECT printf('page:%06d', page_id) AS source_id, {_html('html')} AS text FROM pages",
    "q_transcript_render": f"WITH {_TRANSCRIPT} SELECT source_id, text FROM transcripts",
    "q_role_normalize": f"WITH r AS (SELECT lower({_space('role')}) AS r FROM conversations), c AS (SELECT {_ROLE} AS c FROM r) SELECT c AS chat_role, {_LABEL} AS label, count(*) AS n FROM c GROUP BY ALL",
    "q_json_flatten_props": "SELECT event_id, CAST(0 AS BIGINT) AS line_no, regexp_extract(props, '\"([^\"]+)\"', 1) AS path, regexp_extract(props, ':\\s*([^}]*[^}\\s])\\s*}', 1) AS value FROM events",
    "q_line_types": f"WITH {DOCS}, s AS (SELECT * FROM docs), {LINES} SELECT type, count(*) AS n, count(*) FILTER ({_STAMP.format(x='t')}) AS n_timestamp FROM lines GROUP BY type",
    "q_blocks_of_documents": f"WITH {DOCS}, s AS (SELECT * FROM docs), {BLOCKS} SELECT * FROM blocks",
    "q_block_speaker": f"""WITH {_TRANSCRIPT}, s AS (SELECT * FROM transcripts), {BLOCKS},
x AS (SELECT *, trim(regexp_extract(string_split(text, chr(10))[1], '^([A-Za-z][A-Za-z0-9_ .\\-()]{{0,60}})\\s*:\\s+\\S', 1)) AS label FROM blocks),
y AS (SELECT *, CASE label WHEN 'User' THEN 'human' WHEN 'Assistant' THEN 'ai' WHEN 'System' THEN 'system' WHEN 'Tool' THEN 'tool' END AS role FROM x)
SELECT source_id, block_no, type, leading_blank_lines, CASE WHEN role IS NOT NULL THEN label END AS label, coalesce(role, 'unknown') AS role, CASE WHEN role IS NULL THEN 'unknown' ELSE 'explicit_label' END AS source, CASE WHEN role IS NULL THEN 0.0::DOUBLE ELSE 0.98::DOUBLE END AS confidence FROM y""",
    "q_chunk_kind": f"WITH u AS ({_SENTENCES}) SELECT kind, artifact_type, count(*) AS n FROM (SELECT {_KIND} AS kind, coalesce({_SHAPE}, 'none') AS artifact_type FROM u) GROUP BY ALL",
    "q_boundary_scores": f"""WITH {DOCS}, s AS (SELECT * FROM docs), {BLOCKS}, t AS (SELECT *, list_distinct({_content('text')}) AS ts FROM blocks),
p AS (SELECT *, lag(ts) OVER w AS pts, lag(type) OVER w AS pt, lag(has_timestamp) OVER w AS ph FROM t WINDOW w AS (PARTITION BY source_id ORDER BY block_no)),
q AS (SELECT *, {_jaccard('pts', 'ts')} AS j FROM p)
SELECT source_id, block_no, CASE WHEN block_no > 1 THEN CAST((CASE WHEN leading_blank_lines >= 2 THEN 20 ELSE 0 END) + (CASE WHEN ph OR has_timestamp THEN 16 ELSE 0 END) + (CASE WHEN pt <> type THEN 14 ELSE 0 END) + (CASE WHEN j < 0.06 THEN 35 WHEN j < 0.14 THEN 20 WHEN j < 0.2 THEN 10 ELSE 0 END) AS INT) END AS score FROM q""",
    "q_artifact_labels": f"WITH {MESSAGES}, k AS (SELECT chunk_id, text, {_SHAPE} AS artifact_type FROM messages) SELECT chunk_id, artifact_type, array_to_string(list_slice({_content('text')}, 1, CASE WHEN artifact_type = 'table' THEN 10 ELSE 12 END), ' ') AS artifact_label FROM k WHERE artifact_type IS NOT NULL",
    "q_concept_candidates": f"WITH {CONCEPTS} SELECT chunk_id, surface, key, weight FROM candidates",
    "q_concepts_topk": f"WITH {CONCEPTS} SELECT concept_id, key, label, importance, recurrence_count, total, sessions FROM concepts",
    "q_chunk_concepts": f"WITH {CONCEPTS} SELECT chunk_id, concept_id, {_round('score', 6)} AS score, link_rank FROM links",
    "q_templates": f"WITH {DOCS} SELECT substr(text, 1, 24) AS prefix, right(text, 24) AS suffix, count(*) AS recurrence_count FROM docs WHERE length(text) >= 72 GROUP BY ALL HAVING count(*) >= 3 ORDER BY recurrence_count DESC, prefix, suffix LIMIT 64",
    "q_dedupe_records": f"WITH {DOCS} SELECT min(source_id) AS chunk_id, count(*) AS n_chunks, sha256(text) AS text_hash FROM docs GROUP BY text",
    "q_lexicon": f"""WITH {MESSAGES}, w AS (SELECT chunk_id, {_tokens('text')} AS w FROM messages),
p AS ({' UNION ALL '.join(f"SELECT chunk_id, array_to_string(unnest(list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: list_slice(w, i, i + {n - 1}))), ' ') AS phrase FROM w" for n in (3, 4, 5, 6))}),
c AS (SELECT phrase, count(DISTINCT chunk_id) AS recurrence_count FROM p WHERE length(phrase) >= 12 GROUP BY phrase HAVING count(DISTINCT chunk_id) >= 3),
r AS (SELECT *, row_number() OVER (ORDER BY recurrence_count DESC, length(phrase) DESC, phrase) AS n FROM c)
SELECT printf('phrase_%06d', n) AS phrase_id, phrase, recurrence_count FROM r WHERE n <= 256""",
    "q_edges_topic": f"WITH {CONCEPTS} {_TOPIC}",
    "q_edges_cooccur": f"WITH {CONCEPTS} SELECT * FROM cooccur",
    "q_edges_labels": f"WITH {CONCEPTS} SELECT * FROM label_edges",
    "q_edges_sequence": f"""WITH {MESSAGES}, t AS (SELECT session_id, seq_in_session, chunk_id, text, list_distinct({_content('text')}) AS ts FROM messages),
p AS (SELECT *, lag(chunk_id) OVER w AS prev_id, lag(ts) OVER w AS pts FROM t WINDOW w AS (PARTITION BY session_id ORDER BY seq_in_session)),
j AS (SELECT *, {_jaccard('pts', 'ts')} AS s FROM p WHERE prev_id IS NOT NULL)
SELECT prev_id AS src, chunk_id AS dst, 'adjacent_to' AS type, 1.0::DOUBLE AS weight FROM j
UNION ALL SELECT chunk_id, prev_id, 'follows_from', {_round('least(1.0::DOUBLE, 0.35::DOUBLE + s)', 4)} FROM j WHERE s >= 0.25
UNION ALL SELECT chunk_id, prev_id, 'references', 0.62::DOUBLE FROM j WHERE regexp_matches(lower(text), '\\b(?:above|earlier|previous|reference|as discussed)\\b')""",
    "q_glyph_profile": _glyphs(),
    "q_keyword_index": f"WITH {CONCEPTS} SELECT DISTINCT unnest({_content('label')}) AS keyword, concept_id FROM concepts",
    "q_concept_index": f"WITH {CONCEPTS} SELECT label, max(concept_id) AS concept_id FROM concepts GROUP BY label",
    "q_concept_sessions": f"WITH {CONCEPTS} SELECT DISTINCT concept_id, session_id FROM links",
    "q_concept_adjacency": f"WITH {CONCEPTS}, e AS (SELECT * FROM cooccur UNION ALL SELECT * FROM label_edges) SELECT concept_id, dst AS neighbour, type, weight FROM concepts LEFT JOIN e ON concept_id = src",
    "q_concept_degrees": f"""WITH {CONCEPTS}, e AS (SELECT src, 'chunk_' || dst AS dst FROM ({_TOPIC}) UNION ALL SELECT src, dst FROM cooccur UNION ALL SELECT src, dst FROM label_edges),
d AS (SELECT src AS me, dst AS other FROM e UNION ALL SELECT dst, src FROM e)
SELECT concept_id, any_value(label) AS label, count(other) AS degree_total, count(*) FILTER (starts_with(other, 'chunk_')) AS chunk_degree, count(*) FILTER (starts_with(other, 'concept_')) AS concept_degree, CAST(0 AS BIGINT) AS artifact_degree FROM concepts LEFT JOIN d ON me = concept_id GROUP BY concept_id""",
    "q_concept_meta": f"""WITH {CONCEPTS}, n AS (SELECT concept_id, count(DISTINCT session_id) AS session_count FROM links GROUP BY concept_id),
c AS (SELECT k.*, coalesce(n.session_count, 0) AS session_count, len({_content('label')}) AS nw FROM concepts k LEFT JOIN n USING (concept_id)),
p AS (SELECT *, greatest(max(recurrence_count) OVER (), 1)::DOUBLE AS mr, greatest(max(session_count) OVER (), 1)::DOUBLE AS ms FROM c)
SELECT concept_id, label, session_count, {_round("least(1.0::DOUBLE, importance * 0.56::DOUBLE + recurrence_count / mr * 0.24::DOUBLE + session_count / ms * 0.2::DOUBLE + CASE WHEN nw >= 2 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END)", 4)} AS score
FROM p WHERE length(key) >= 3 AND key NOT IN {_among(DISCOURAGED_LABELS)} AND NOT regexp_matches(key, '^[0-9]+$') AND nw BETWEEN 1 AND 6""",
    "q_session_raw_text": f"WITH {MESSAGES} SELECT session_id, string_agg(upper(coalesce(role, 'unknown')) || ': ' || text, chr(10) || chr(10) ORDER BY seq_in_session) AS text FROM messages GROUP BY session_id",
    "q_retrieve_term": f"""WITH {CONCEPTS}, term AS (SELECT {_content('label')}[1] AS t FROM concepts WHERE rank = 1),
hits AS (SELECT concept_id FROM concepts CROSS JOIN term WHERE list_contains({_content('label')}, t)),
e AS (SELECT src, dst, weight FROM cooccur UNION ALL SELECT src, dst, weight FROM label_edges),
two AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
reached AS (SELECT concept_id, max(strength) AS strength FROM (SELECT concept_id, 1.0::DOUBLE AS strength FROM hits UNION ALL SELECT dst, weight FROM hits JOIN two ON src = concept_id) GROUP BY concept_id)
SELECT chunk_id, {_round('max(score * strength)', 6)} AS score FROM links JOIN reached USING (concept_id) GROUP BY chunk_id""",
    "q_artifact_version_list": f"""WITH {MESSAGES}, k AS (SELECT *, {_SHAPE} AS artifact_type, {_KIND} AS kind, {_content('text')} AS w FROM messages),
l AS (SELECT *, CASE WHEN len(w) > 0 THEN array_to_string(list_slice(w, 1, CASE WHEN artifact_type = 'table' THEN 10 ELSE 12 END), ' ') ELSE substr(text, 1, 80) END AS raw FROM k WHERE artifact_type IS NOT NULL),
v AS (SELECT *, artifact_type || ':' || trim(regexp_replace(lower(raw), '[^a-z0-9\\s:_\\-]', '', 'g')) AS artifact_key FROM l)
SELECT artifact_key, artifact_type, first_value(raw) OVER o AS label, CAST(row_number() OVER o AS INT) AS version_index, chunk_id, lag(chunk_id) OVER o AS previous_chunk_id
FROM v WINDOW o AS (PARTITION BY artifact_key ORDER BY session_id, chunk_id)""",
}

ORACLE_SQL["q_sentences"] = f"""WITH {DOCS}, f AS (SELECT source_id, text, regexp_extract_all(text, '[^.!?\\n]+(?:[.!?]+|$)') AS parts, regexp_split_to_array(text, '[^.!?\\n]+(?:[.!?]+|$)') AS gaps FROM docs),
e AS (SELECT source_id, unnest(parts) AS raw, unnest(gaps[1:len(parts)]) AS gap, generate_subscripts(parts, 1) AS i FROM f),
g AS (SELECT *, {_space('raw')} AS text, sum(length(gap)) OVER w + sum(length(raw)) OVER w - length(raw) + length(raw) - length(regexp_replace(raw, '^\\s+', '')) AS start FROM e WINDOW w AS (PARTITION BY source_id ORDER BY i))
SELECT source_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY i) - 1 AS INT) AS k, text, CAST(start AS BIGINT) AS start FROM g WHERE text <> ''
UNION ALL SELECT source_id, 0, {_space('text')}, 0 FROM f WHERE len(list_filter(parts, lambda p: {_space('p')} <> '')) = 0 AND {_space('text')} <> ''"""
ORACLE_SQL["q_textpack_roundtrip"] = f"WITH {MESSAGES} SELECT count(*) AS chunks, CAST(0 AS BIGINT) AS failures FROM messages"
ORACLE_SQL["q_reconstruct_session"] = f"WITH {MESSAGES} SELECT session_id, string_agg(upper(coalesce(role, 'unknown')) || ': ' || text, chr(10) || chr(10) ORDER BY seq_in_session) AS text FROM messages GROUP BY session_id"
ORACLE_SQL["q_mapping_order"] = f"WITH {_TRANSCRIPT} SELECT source_id, text FROM transcripts WHERE text <> ''"
ORACLE_SQL["q_json_fragment_udtf"] = ORACLE_SQL["q_json_flatten_props"].replace("CAST(0 AS BIGINT) AS line_no, ", "")
ORACLE_SQL["q_json_path_filter"] = """WITH n AS (SELECT conv_id, count(*) AS n, count(role) AS roles, count(text) AS texts FROM conversations GROUP BY conv_id)
SELECT 'title' AS path, count(*) AS n FROM n
UNION ALL SELECT 'message.author.role', CAST(sum(roles + CAST(n > 1 AS INT)) AS BIGINT) FROM n
UNION ALL SELECT 'message.content', CAST(sum(n + CAST(n > 1 AS INT)) AS BIGINT) FROM n"""
ORACLE_SQL["q_corpus_totals"] = f"""WITH {CONCEPTS}, s AS (SELECT session_id, sum(strlen(text)) + count(*) - 1 AS b FROM messages GROUP BY session_id),
t AS (SELECT count(*) AS sources, CAST(coalesce(sum(b), 0) AS BIGINT) AS text_bytes FROM s),
c AS (SELECT count(*) AS chunks, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chunk_chars FROM messages)
SELECT sources, text_bytes, sources AS sessions, chunks, chunk_chars, (SELECT count(*) FROM concepts) AS concepts, CAST(floor(350 + text_bytes / 17000::DOUBLE + sources * 90 + chunks * 24 + 0.5) AS BIGINT) AS estimated_processing_duration_ms FROM t CROSS JOIN c"""

_CONTINUES = f"""
ids AS (SELECT DISTINCT conv_id, session_id FROM messages),
held AS (SELECT ids.*, coalesce(c, []) AS c FROM ids LEFT JOIN (SELECT session_id, list(DISTINCT concept_id) AS c FROM links GROUP BY session_id) USING (session_id)),
turn AS (SELECT session_id, c, lag(session_id) OVER o AS prev_id, lag(c) OVER o AS p FROM held WINDOW o AS (ORDER BY conv_id)),
lap AS (SELECT *, len(list_intersect(c, p)) / CAST(greatest(len(c), len(p)) AS DOUBLE) AS overlap FROM turn WHERE prev_id IS NOT NULL AND len(c) > 0 AND len(p) > 0),
session_edges AS (SELECT prev_id AS src, session_id AS dst, 'continues' AS type, {_round('least(1.0::DOUBLE, 0.36::DOUBLE + overlap)', 4)} AS weight FROM lap WHERE overlap > 0
  UNION ALL SELECT prev_id, session_id, 'same_theme_as', {_round('least(1.0::DOUBLE, 0.42::DOUBLE + overlap)', 4)} FROM lap WHERE overlap >= 0.2::DOUBLE)"""
ORACLE_SQL["q_edges_continues"] = f"WITH {CONCEPTS}, {_CONTINUES} SELECT src, dst, type, weight FROM session_edges"

_VERSIONS = ORACLE_SQL["q_artifact_version_list"].removeprefix(f"WITH {MESSAGES}, ").partition("SELECT artifact_key, artifact_type, first_value")[0].rstrip() + f""",
vs AS (SELECT artifact_key, session_id, chunk_id, text, row_number() OVER o AS version_index, lag(text) OVER o AS previous_text FROM v WINDOW o AS (PARTITION BY artifact_key ORDER BY session_id, chunk_id)),
firsts AS (SELECT artifact_key, printf('artifact_%06d', row_number() OVER (ORDER BY session_id, chunk_id)) AS artifact_id FROM vs WHERE version_index = 1),
named AS (SELECT vs.*, artifact_id, artifact_id || '/' || printf('version_%06d', version_index) AS version_id, CASE WHEN version_index > 1 THEN artifact_id || '/' || printf('version_%06d', version_index - 1) END AS previous_version_id,
  list_distinct({_content('text')}) AS ta, list_distinct({_content("coalesce(previous_text, '')")}) AS tb FROM vs JOIN firsts USING (artifact_key)),
artifact_edges AS (SELECT artifact_id AS src, version_id AS dst, 'contains' AS type, 0.97::DOUBLE AS weight FROM named
  UNION ALL SELECT version_id, artifact_id, 'revision_of', 0.94::DOUBLE FROM named
  UNION ALL SELECT version_id, chunk_id, 'materialized_as', 0.99::DOUBLE FROM named
  UNION ALL SELECT DISTINCT session_id, artifact_id, 'contains', 0.76::DOUBLE FROM named
  UNION ALL SELECT version_id, previous_version_id, 'derived_from', {_round("least(1.0::DOUBLE, 0.48::DOUBLE + 0.45::DOUBLE * " + _jaccard('ta', 'tb') + ")", 4)} FROM named WHERE previous_version_id IS NOT NULL)"""
ORACLE_SQL["q_edges_artifacts"] = f"WITH {MESSAGES}, {_VERSIONS} SELECT src, dst, type, weight FROM artifact_edges"
_SEQUENCE = ORACLE_SQL["q_edges_sequence"].removeprefix(f"WITH {MESSAGES}, ")
ORACLE_SQL["q_graph_build"] = f"""WITH {CONCEPTS}, {_CONTINUES}, {_VERSIONS},
every AS (SELECT src, dst, type, weight, 0 AS ord FROM ({_TOPIC})
  UNION ALL SELECT concept_id, version_id, 'mentioned_in_artifact', {_round('least(1.0::DOUBLE, 0.42::DOUBLE + 0.04::DOUBLE * score)', 4)}, 1 FROM links JOIN named USING (chunk_id) WHERE link_rank <= 6
  UNION ALL SELECT src, dst, type, weight, 2 FROM (WITH {_SEQUENCE})
  UNION ALL SELECT src, dst, type, weight, 5 FROM session_edges
  UNION ALL SELECT src, dst, type, weight, 7 FROM artifact_edges
  UNION ALL SELECT src, dst, type, weight, 12 FROM cooccur
  UNION ALL SELECT src, dst, type, weight, 13 FROM label_edges),
one AS (SELECT type, arg_min(weight, ord) AS weight FROM every GROUP BY src, dst, type)
SELECT type, count(*) AS n, {_round('max(weight)', 4)} AS max_weight FROM one GROUP BY type"""

_SCORED = ORACLE_SQL["q_boundary_scores"].rpartition("SELECT source_id, block_no,")
ORACLE_SQL["q_sessions_of_documents"] = (
    "WITH RECURSIVE " + _SCORED[0].removeprefix("WITH ").rstrip() + f""",
y AS (SELECT source_id, block_no, text, start_offset, end_offset, length(text) AS n, score FROM q JOIN (SELECT source_id AS i, block_no AS k, score FROM ({_SCORED[1]}{_SCORED[2]})) ON i = source_id AND k = block_no),
f AS (SELECT source_id, block_no, n AS run, 1 AS session_no FROM y WHERE block_no = 1
  UNION ALL SELECT y.source_id, y.block_no, CASE WHEN {{split}} THEN y.n ELSE f.run + y.n END, f.session_no + CAST({{split}} AS INT)
  FROM f JOIN y ON y.source_id = f.source_id AND y.block_no = f.block_no + 1),
g AS (SELECT f.source_id, session_no, y.* EXCLUDE (source_id), {_space("regexp_extract(text, '[^\n]*')")} AS line FROM f JOIN y ON y.source_id = f.source_id AND y.block_no = f.block_no)
SELECT source_id, session_no, min_by(CASE WHEN length(line) > 90 THEN substr(line, 1, 87) || '...' ELSE line END, block_no) AS title, min(start_offset) AS start_offset, max(end_offset) AS end_offset, count(*) AS block_count FROM g GROUP BY source_id, session_no"""
).replace("{split}", "(f.run >= 7600 * 1.6 OR (y.score + CASE WHEN f.run > 7600 * 1.05 THEN 24 ELSE 0 END + CASE WHEN f.run > 7600 * 1.3 THEN 36 ELSE 0 END >= 62 AND f.run >= 7600 * 0.42))")
