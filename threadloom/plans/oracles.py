"""Independent SQL for the registered queries, in the dialect of the checking engine."""

from __future__ import annotations

# One agent thread per user of events, written from its description.
CONTEXT = r"""
logs AS (
  SELECT user_id, string_agg(replace(substr(CAST(ts AS VARCHAR), 1, 19), ' ', 'T') || CASE WHEN event_type = 'error' THEN 'Z ERROR worker-' ELSE 'Z INFO worker-' END || user_id
    || CASE WHEN event_type = 'error' THEN ' failed request_id=req-' ELSE ' handled batch ' END || event_id || chr(10), '' ORDER BY event_id) AS log
  FROM events GROUP BY user_id),
keys AS (SELECT o_custkey, min(o_orderkey) AS k1, max(o_orderkey) AS k2 FROM orders GROUP BY o_custkey),
h AS (SELECT user_id AS t, log, k1, a.o_orderstatus AS s1, b.o_orderstatus AS s2 FROM logs JOIN keys ON o_custkey = user_id JOIN orders a ON a.o_orderkey = k1 JOIN orders b ON b.o_orderkey = k2),
ctx AS (
  SELECT t AS thread_id, 0 AS msg_idx, 'system' AS role, 'You are a support agent. Always cite the order key.' AS content, NULL AS call_id, NULL AS tool_call_id FROM h
  UNION ALL SELECT t, 1, 'user', 'Check order ORD-' || lpad(CAST(k1 AS VARCHAR), 6, '0') || ' for customer ' || t || '.', NULL, NULL FROM h
  UNION ALL SELECT t, 2, 'assistant', '', 'c-' || t, NULL FROM h
  UNION ALL SELECT t, 3, 'tool', 'status=' || s1 || chr(10) || log, NULL, 'c-' || t FROM h
  UNION ALL SELECT t, 4, 'assistant', 'The carrier reports status: ' || s2 || ', and I recommend a retry.', NULL, NULL FROM h
  UNION ALL SELECT t, 5, 'user', CASE WHEN t % 3 = 0 THEN 'No, use customer ' || (t + 1) || ' instead of customer ' || t || '.' ELSE 'You must never refund twice.' END, NULL, NULL FROM h
  UNION ALL SELECT t, 6, 'tool', 'late result', NULL, 'gone-' || t FROM h WHERE t % 7 = 0
  UNION ALL SELECT t, 7, 'user', 'What should we do next?', NULL, NULL FROM h)"""

_IDS = r"""list_concat(list_concat(regexp_extract_all(text, '\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b'), regexp_extract_all(text, '\b[A-Z]{2,6}-\d{3,}\b')),
  list_concat(regexp_extract_all(text, '(?i)\b(?:req|request|trace|span|correlation|txn|transaction|order|session)[_-]?id\s*[:=]\s*["'']?[\w-]+'), regexp_extract_all(text, '(?i)\b(?:customer|order|account|invoice|ticket|incident)\s+#?\d+\b')))"""
_MASK = r"""regexp_replace(regexp_replace(regexp_replace(X, '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:Z|[+-]\d{2}:?\d{2})?|\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b', '<ts>', 'g'), '\d+(?:\.\d+)?', '<n>', 'g'), '\s+', ' ', 'g')"""
_FAIL = r"(?:fail(?:s|ed|ing|ure|ures)?|errors?|exceptions?|crash(?:es|ed)?|timed out|timeouts?|outages?|incidents?|root cause|panic(?:ked)?|denied|refused|unavailable|aborted)"
_FAILURE = rf"regexp_matches(regexp_replace(text, '(?i)\b(?:no|zero|without|not) {_FAIL}\b', '', 'g'), '(?i)\b{_FAIL}\b')"
_CORRECTION = r"""regexp_matches(text, '(?im)\binstead\s+of\b|\buse\s+[^.,;!?\n]{1,60}?\s+instead\b|\bdo(?:n''?t|\s+not)\s+use\b|\bi\s+meant\b|\bcorrection:|\bswitch\s+to\b|(?:^|[.!?]\s)no,\s+(?:use|it''?s|that''?s|make|i\b)')"""
_CONSTRAINT = r"""regexp_matches(text, '(?i)\b(?:must(?:\s+not)?|never|always|required|mandatory|forbidden|prohibited|do\s+not|don''?t|only\s+use|make\s+sure|ensure)\b')"""
_DECISION = r"regexp_matches(text, '(?i)\b(?:decision|decided|recommend(?:ed|ation)?|conclu(?:de|ded|sion)|approved|rejected|denied|agreed)\b')"

# Lines, units by gaps and islands, scores. The context has prose and timestamped logs only.
UNITS = rf"""
lines AS (SELECT thread_id, msg_idx, role, unnest(regexp_extract_all(content, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(content, '[^\n]*\n|[^\n]+'), 1) - 1 AS line_no FROM ctx),
kinds AS (SELECT *, CASE WHEN regexp_matches(line, '^\d{{4}}-\d{{2}}-\d{{2}}T') THEN 'log' ELSE 'text' END AS kind, CASE WHEN regexp_matches(line, '^\d{{4}}-\d{{2}}-\d{{2}}T') THEN regexp_extract(line, '\b(INFO|ERROR)\b', 1) END AS severity FROM lines),
opened AS (SELECT *, CASE WHEN lag(kind || (coalesce(severity, '') = 'ERROR')) OVER w IS DISTINCT FROM kind || (coalesce(severity, '') = 'ERROR') THEN 1 ELSE 0 END AS o FROM kinds WINDOW w AS (PARTITION BY thread_id, msg_idx ORDER BY line_no)),
placed AS (SELECT *, sum(o) OVER (PARTITION BY thread_id, msg_idx ORDER BY line_no) - 1 AS unit_pos FROM opened),
raw AS (
  SELECT thread_id, msg_idx, CAST(unit_pos AS INT) AS unit_pos, min(role) AS role, min(kind) AS kind, string_agg(line, '' ORDER BY line_no) AS text, CAST(min(line_no) + 1 AS INT) AS first_line, count(*) AS n_lines, max(severity) AS severity
  FROM placed GROUP BY 1, 2, placed.unit_pos),
units AS (SELECT *, coalesce(severity = 'ERROR', false) AS has_error, list_distinct({_IDS}) AS ids FROM raw)"""

SCORED = rf"""
grouped AS (SELECT *, list_sort(ids) AS idkey, trim({_MASK.replace("X", "text")}) AS norm, kind <> 'log' AND {_FAILURE} AS reports FROM units),
ranked AS (SELECT *, count(*) OVER g AS size, row_number() OVER (PARTITION BY thread_id, kind, idkey, norm ORDER BY msg_idx, unit_pos) AS nth, bool_or(has_error OR reports) OVER (PARTITION BY thread_id, msg_idx) AS failing,
  msg_idx / CAST(max(msg_idx) OVER (PARTITION BY thread_id) AS DOUBLE) AS recency FROM grouped WINDOW g AS (PARTITION BY thread_id, kind, idkey, norm)),
flags AS (SELECT *, role = 'user' AND {_CORRECTION} AS corr, role IN ('user', 'system') AND {_CONSTRAINT} AS cons, {_DECISION} AS deci, len(ids) > 0 AS named,
  len(ids) > 0 AND (has_error OR reports OR (kind = 'text' AND failing)) AS infail, size >= 3 AND nth > 1 AND nth < size AS rep FROM ranked),
summed AS (SELECT *, recency * 0.25::DOUBLE + CASE WHEN corr THEN 0.9::DOUBLE ELSE 0 END + CASE WHEN cons THEN 0.75::DOUBLE ELSE 0 END + CASE WHEN has_error THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN deci THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN named THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN infail THEN 0.35::DOUBLE ELSE 0 END AS v FROM flags),
scored AS (SELECT *, least(CASE WHEN rep AND NOT corr THEN greatest(0.05::DOUBLE, v * 0.2::DOUBLE) ELSE v END, 1.0::DOUBLE) AS score, rep AND NOT corr AS lowered FROM summed)"""

CLAIMS = r"""
said AS (SELECT thread_id, msg_idx, unit_pos, regexp_extract(text, '\bstatus\s*[:=]\s*([A-Za-z0-9]+)', 1) AS value FROM units WHERE kind = 'text' AND regexp_matches(text, '\bstatus\s*[:=]\s*[A-Za-z0-9]')),
firsts AS (SELECT thread_id, lower(value) AS folded, min(msg_idx) AS msg_idx, min(value) AS value FROM said GROUP BY 1, 2),
conflicts AS (SELECT a.thread_id, 'status' AS key, a.msg_idx AS msg_a, a.value AS value_a, b.msg_idx AS msg_b, b.value AS value_b FROM firsts a JOIN firsts b ON a.thread_id = b.thread_id AND a.msg_idx < b.msg_idx)"""


def levels(must: float, should: float, error_must: float) -> str:
    return rf"""
classified AS (SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM conflicts c WHERE c.thread_id = s.thread_id AND s.unit_pos = 0 AND s.msg_idx IN (c.msg_a, c.msg_b)) OR corr OR (named AND role = 'user') OR infail THEN 'must_preserve'
  WHEN lowered THEN 'compressible' WHEN score >= {must} OR (has_error AND score >= {error_must}) THEN 'must_preserve' WHEN score >= {should} THEN 'should_preserve' ELSE 'compressible' END AS level FROM scored s)"""


FACTS = r"""
must AS (SELECT * FROM classified WHERE level = 'must_preserve'),
old AS (SELECT thread_id, lower(regexp_extract(text, '(?i)\binstead\s+of\s+([^.,;!?\n]{1,60})', 1)) AS old FROM classified WHERE corr),
listed AS (
  SELECT thread_id, unnest(ids) AS statement FROM must
  UNION SELECT thread_id, 'User correction: "' || text || '"' FROM must WHERE corr
  UNION SELECT thread_id, 'User instruction: "' || CASE role WHEN 'system' THEN 'Always cite the order key.' ELSE text END || '"' FROM must WHERE cons
  UNION SELECT thread_id, 'Conflicting values reported for status: ' || value_a || ' (earlier) vs ' || value_b || ' (later)' FROM conflicts),
facts AS (SELECT l.* FROM listed l LEFT JOIN old ON old.thread_id = l.thread_id AND old.old = lower(l.statement) WHERE old.old IS NULL)"""

COLLAPSED = rf"""
planned AS (SELECT thread_id, msg_idx, unit_pos, first_line, text FROM classified WHERE kind = 'log' AND level = 'compressible' AND role <> 'system'),
parted AS (SELECT *, unnest(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS line, generate_subscripts(regexp_extract_all(text, '[^\n]*\n|[^\n]+'), 1) - 1 AS line_at FROM planned),
keyed AS (SELECT *, CASE WHEN line LIKE '%request_id=%' THEN NULL ELSE {_MASK.replace("X", "line")} END AS key FROM parted),
starts AS (SELECT *, sum(CASE WHEN key IS NULL OR p IS DISTINCT FROM key THEN 1 ELSE 0 END) OVER (PARTITION BY thread_id, msg_idx, unit_pos ORDER BY line_at) AS run
  FROM (SELECT *, lag(key) OVER (PARTITION BY thread_id, msg_idx, unit_pos ORDER BY line_at) AS p FROM keyed)),
sized AS (SELECT *, count(*) OVER r AS n, row_number() OVER (r ORDER BY line_at) AS nth, min(line_at) OVER r AS a, sum(length(line)) OVER r AS chars,
  first_value(length(line)) OVER (r ORDER BY line_at) AS c1, last_value(length(line)) OVER (r ORDER BY line_at ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS c2 FROM starts WINDOW r AS (PARTITION BY thread_id, msg_idx, unit_pos, run)),
marked AS (SELECT *, '... ' || (n - 2) || ' similar lines omitted (lines ' || (first_line + a + 1) || '-' || (first_line + a + n - 2) || ') ...' || chr(10) AS marker FROM sized),
pieces AS (SELECT *, key IS NOT NULL AND n >= 3 AND chars - c1 - c2 > length(marker) AS short FROM marked),
joined AS (SELECT thread_id, msg_idx, unit_pos, min(text) AS text, string_agg(CASE WHEN NOT short THEN line WHEN nth = 1 THEN line || marker WHEN nth = n THEN line ELSE '' END, '' ORDER BY line_at) AS new_text FROM pieces GROUP BY 1, 2, 3),
changed AS (SELECT * FROM joined WHERE length(new_text) < length(text))"""

# Facts with what must be stated of each.
NEEDED = r"""
needed AS (SELECT f.thread_id, statement, CASE
  WHEN starts_with(statement, 'User correction: ') THEN [lower(regexp_extract(statement, '(?i)\buse\s+([^.,;!?\n]{1,60}?)\s+instead\b', 1))]
  WHEN starts_with(statement, 'User instruction: ') THEN [lower(statement[20:-2])]
  WHEN starts_with(statement, 'Conflicting values ') THEN [lower(c.value_a), lower(c.value_b)]
  ELSE [lower(statement)] END AS required FROM facts f LEFT JOIN conflicts c ON c.thread_id = f.thread_id)"""
STATED = r"""regexp_matches(s.text, (CASE WHEN regexp_matches(r, '^\w') THEN '(?:^|\W)' ELSE '' END) || regexp_escape(r) || (CASE WHEN regexp_matches(r, '\w$') THEN '(?:\W|$)' ELSE '' END))"""

# Rewritten threads: the last three messages stay, the rest becomes one summary that states what facts are lacking.
_COST = "(ceil(octet_length(encode(text)) / 4.0)::BIGINT + 3)"
_FOLDED = r"lower(trim(regexp_replace(content, '\s+', ' ', 'g')))"
REWRITTEN = rf"""
rebuilt AS (SELECT u.thread_id, u.msg_idx, count(k.new_text) AS changed, string_agg(coalesce(k.new_text, u.text), '' ORDER BY u.unit_pos) AS content
  FROM units u LEFT JOIN changed k ON k.thread_id = u.thread_id AND k.msg_idx = u.msg_idx AND k.unit_pos = u.unit_pos GROUP BY 1, 2),
paid AS (SELECT c.thread_id, c.msg_idx, c.role, coalesce(r.changed, 0) AS changed, c.content || CASE WHEN call_id IS NULL THEN '' ELSE chr(10) || 'order_status {{}}' END AS before, coalesce(r.content, c.content) || CASE WHEN call_id IS NULL THEN '' ELSE chr(10) || 'order_status {{}}' END AS after,
  row_number() OVER (PARTITION BY c.thread_id ORDER BY c.msg_idx DESC) AS back FROM ctx c LEFT JOIN rebuilt r ON r.thread_id = c.thread_id AND r.msg_idx = c.msg_idx),
draft AS (SELECT thread_id, string_agg({_FOLDED}, chr(1) ORDER BY msg_idx) || chr(1) || 'summary of the conversation so far: the user asked about an order; the carrier answered.' AS text
  FROM (SELECT *, after AS content FROM paid) WHERE back <= 3 OR role = 'system' GROUP BY thread_id),
lacking AS (SELECT f.* FROM needed f JOIN draft s ON s.thread_id = f.thread_id WHERE NOT list_bool_and(list_transform(f.required, lambda r: {STATED}))),
told AS (SELECT l.thread_id, l.statement FROM lacking l LEFT JOIN (SELECT a.thread_id, a.statement, string_agg(lower(b.statement), chr(1)) AS text FROM lacking a JOIN lacking b ON a.thread_id = b.thread_id AND length(b.statement) > length(a.statement) GROUP BY 1, 2) s
  ON s.thread_id = l.thread_id AND s.statement = l.statement WHERE s.text IS NULL OR NOT list_bool_and(list_transform(l.required, lambda r: {STATED}))),
summaries AS (SELECT p.thread_id, 'Summary of the conversation so far:' || chr(10) || chr(10) || 'The user asked about an order; the carrier answered.'
  || coalesce(chr(10) || chr(10) || 'Facts preserved verbatim from the earlier conversation:' || chr(10) || t.bullets, '') AS text, t.bullets IS NOT NULL AS lacks
  FROM (SELECT DISTINCT thread_id FROM paid) p LEFT JOIN (SELECT thread_id, string_agg('- ' || statement, chr(10)) AS bullets FROM told GROUP BY 1) t ON t.thread_id = p.thread_id),
stray AS (SELECT thread_id, bool_or(back <= 3 AND role = 'tool' AND msg_idx = (SELECT max(x.msg_idx) FROM ctx x WHERE x.thread_id = p.thread_id AND x.role = 'tool' AND NOT EXISTS (SELECT 1 FROM ctx c WHERE c.thread_id = x.thread_id AND c.call_id = x.tool_call_id))) AS stray FROM paid p GROUP BY 1),
sums AS (SELECT thread_id, count(*) AS n, sum({_COST.replace("text", "before")})::BIGINT AS tokens, sum({_COST.replace("text", "after")})::BIGINT AS prepared, sum({_COST.replace("text", "after")}) FILTER (back <= 3 OR role = 'system')::BIGINT AS stays, sum(changed)::BIGINT AS compacted,
  'threadloom-summary-' || substr(sha256(thread_id || chr(0) || '1' || chr(0) || string_agg('m-' || thread_id || '-' || msg_idx, ',' ORDER BY msg_idx) FILTER (back > 3 AND role <> 'system')), 1, 32) AS summary_id FROM paid GROUP BY 1),
results AS (SELECT a.thread_id, summary_id, 1 AS generation, n || ' messages >= 7' AS trigger_reason, n::BIGINT AS input_messages, tokens AS input_tokens, 830::BIGINT AS available_tokens, greatest(tokens - 830, 0)::BIGINT AS overflow_tokens,
  CASE WHEN compacted > 0 THEN prepared ELSE tokens END AS prepared_tokens, 5::BIGINT AS output_messages, stays + {_COST} AS output_tokens, (stays + {_COST}) / tokens::DOUBLE AS compression_ratio, compacted AS compacted_units,
  (SELECT count(*) FROM must m WHERE m.thread_id = a.thread_id)::BIGINT AS must_preserve_units, (SELECT count(*) FROM facts f WHERE f.thread_id = a.thread_id)::BIGINT AS must_preserve_facts,
  (SELECT '{{' || string_agg('"' || kind || '":' || k, ',' ORDER BY kind) || '}}' FROM (SELECT kind, count(*) AS k FROM units u WHERE u.thread_id = a.thread_id GROUP BY kind)) AS content_kinds,
  CASE WHEN stray THEN 'failed_unrecovered' WHEN lacks THEN 'failed_recovered' ELSE 'passed' END AS validation_status, CASE WHEN lacks THEN 'restated_facts' WHEN stray THEN 'none_applicable' ELSE 'none_needed' END AS recovery_status, 'balanced' AS policy
  FROM sums a JOIN summaries b ON b.thread_id = a.thread_id JOIN stray c ON c.thread_id = a.thread_id)"""

# The JSON list of a user's events, and equal items of a group as one counted marker where that is shorter.
JSON_ITEMS = """items AS (SELECT user_id AS thread_id, event_id AS nth, replace(props, '": ', '":') AS item FROM events)"""
JSON_COUNTED = """sized AS (SELECT *, count(*) OVER g AS n, row_number() OVER (g ORDER BY nth) AS k FROM runs WINDOW g AS (PARTITION BY thread_id, grp)),
marked AS (SELECT *, '{"__repeated__":' || n || ',"value":' || item || '}' AS marker FROM sized),
counted AS (SELECT thread_id, nth, CASE WHEN n > 1 AND length(marker) < n * length(item) + n - 1 THEN marker ELSE item END AS text FROM marked WHERE k = 1 OR NOT (n > 1 AND length(marker) < n * length(item) + n - 1))"""

# One message for each customer from parts whose kind and severity are known, in two orders.
MIXED = r"""WITH base AS (SELECT c_custkey, c_mktsegment AS seg, [
  {'kind': 'text', 'severity': NULL, 'text': 'Report for ' || c_name || '.' || chr(10) || chr(10)},
  {'kind': 'json', 'severity': CASE WHEN c_acctbal < 0 THEN 'ERROR' ELSE 'INFO' END, 'text': '{"segment": "' || c_mktsegment || '", "level": "' || CASE WHEN c_acctbal < 0 THEN 'err' ELSE 'info' END || '"}' || chr(10)},
  {'kind': 'json', 'severity': NULL, 'text': '{' || chr(10) || '  "key": ' || c_custkey || chr(10) || '}' || chr(10)},
  {'kind': 'log', 'severity': 'INFO', 'text': '2024-01-01T00:00:00Z INFO a ' || c_custkey || chr(10) || '[10:00:00] started' || chr(10)},
  {'kind': 'log', 'severity': 'WARNING', 'text': 'WARN slow' || chr(10) || 'level=warning msg="x"' || chr(10)},
  {'kind': 'error', 'severity': 'ERROR', 'text': 'Traceback (most recent call last):' || chr(10) || '  File "a.py", line ' || c_custkey || ', in main' || chr(10) || '    total = compute(order)' || chr(10) || 'ValueError: bad' || chr(10)},
  {'kind': 'table', 'severity': NULL, 'text': '| a | b |' || chr(10) || '|---|---|' || chr(10)},
  {'kind': 'code', 'severity': NULL, 'text': '```python' || chr(10) || 'x = ' || c_custkey || chr(10) || chr(10) || 'print(x)' || chr(10) || '```' || chr(10)},
  {'kind': 'log', 'severity': 'CRITICAL', 'text': '~~~' || chr(10) || 'plain' || chr(10) || 'FATAL b' || chr(10) || '~~~' || chr(10)},
  {'kind': 'text', 'severity': NULL, 'text': 'Closing prose.' || chr(10)}] AS up FROM customer),
parts AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN up ELSE list_reverse(up) END AS list FROM base)
"""

_TOKENS = "(ceil(octet_length(encode(text)) / 4.0)::BIGINT + 3)"


def context(*parts: str, select: str) -> str:
    return "WITH " + ",".join([CONTEXT, *parts]) + "\n" + select


_BALANCED = levels(0.75, 0.45, 0.60)
_ANALYSIS = (UNITS, SCORED, CLAIMS)

ORACLES = {
    "thread_tokens": f"SELECT conv_id AS thread_id, count(*)::BIGINT AS messages, sum({_TOKENS})::BIGINT AS tokens FROM conversations GROUP BY conv_id",
    "trigger_decision": f"SELECT conv_id AS thread_id, count(*)::BIGINT AS messages, sum({_TOKENS})::BIGINT AS tokens, sum({_TOKENS})::BIGINT || ' tokens >= 700' AS reason, (sum({_TOKENS}) - 700)::BIGINT AS overflow FROM conversations GROUP BY conv_id HAVING sum({_TOKENS}) >= 700",
    "trigger_budget": f"SELECT conv_id AS thread_id, count(*)::BIGINT AS messages, sum({_TOKENS})::BIGINT AS tokens, sum({_TOKENS})::BIGINT || ' tokens exceed the 830-token input budget' AS reason, (sum({_TOKENS}) - 830)::BIGINT AS overflow FROM conversations GROUP BY conv_id HAVING sum({_TOKENS}) > 830",
    "trigger_or_and": f"""WITH t AS (SELECT conv_id AS thread_id, count(*)::BIGINT AS messages, sum({_TOKENS})::BIGINT AS tokens FROM conversations GROUP BY conv_id)
SELECT *, CASE WHEN tokens >= 500 AND messages >= 5 THEN tokens || ' tokens >= 500 and ' || messages || ' messages >= 5' ELSE messages || ' messages >= 7' END AS reason,
  CASE WHEN tokens >= 500 AND messages >= 5 THEN tokens - 500 ELSE 0 END::BIGINT AS overflow FROM t WHERE (tokens >= 500 AND messages >= 5) OR messages >= 7""",
    "keep_messages": context(
        select="""SELECT p.thread_id, least(min(p.n) - 5, min(c.at))::INT AS cut FROM (SELECT *, row_number() OVER w - 1 AS at, count(*) OVER (PARTITION BY thread_id) AS n FROM ctx WINDOW w AS (PARTITION BY thread_id ORDER BY msg_idx)) p
  LEFT JOIN (SELECT thread_id, call_id, row_number() OVER (PARTITION BY thread_id ORDER BY msg_idx) - 1 AS at FROM ctx) c ON c.thread_id = p.thread_id AND c.call_id = p.tool_call_id AND p.at >= p.n - 5 AND c.at < p.n - 5
GROUP BY p.thread_id"""
    ),
    "keep_tokens": f"""WITH t AS (SELECT conv_id, turn, {_TOKENS} AS k FROM conversations),
s AS (SELECT *, sum(k) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, sum(k) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM t)
SELECT conv_id AS thread_id, (CASE WHEN max(total) <= 400 THEN 0 ELSE least(coalesce(min(pos) FILTER (back <= 400), max(n)), max(n) - 1) END)::INT AS cut FROM s GROUP BY conv_id""",
    "trailing_window": """WITH s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id AS thread_id, count(*)::INT AS kept, min(turn) FILTER (role <> 'system')::INT AS first_turn FROM s WHERE role = 'system' OR back <= 3 GROUP BY conv_id""",
    "context_messages": context(select="SELECT thread_id, msg_idx, role, content, call_id, tool_call_id FROM ctx"),
    "identifiers": context(select=f"SELECT DISTINCT thread_id, msg_idx, unnest({_IDS}) AS identifier FROM (SELECT *, content AS text FROM ctx)"),
    "masked_text": context(select=f"SELECT thread_id, msg_idx, sha256(trim({_MASK.replace('X', 'content')})) AS masked_sha256 FROM ctx"),
    "signal_flags": context(select=f"SELECT thread_id, msg_idx, {_FAILURE} AS failure, {_CORRECTION} AS correction, {_CONSTRAINT} AS \"constraint\", {_DECISION} AS decision FROM (SELECT *, content AS text FROM ctx)"),
    "units": context(UNITS, select="SELECT thread_id, msg_idx, unit_pos, role, kind, sha256(text) AS text_sha256, first_line, n_lines, severity, has_error FROM units"),
    "kind_counts": context(UNITS, select="SELECT thread_id, kind, count(*)::BIGINT AS units FROM units GROUP BY ALL"),
    "severity_counts": context(UNITS, select="SELECT coalesce(severity, 'none') AS severity, count(*)::BIGINT AS units, sum(n_lines)::BIGINT AS lines FROM units GROUP BY 1"),
    "repetition": context(UNITS, SCORED, select="SELECT thread_id, msg_idx, unit_pos FROM scored WHERE rep"),
    "importance": context(UNITS, SCORED, select="SELECT thread_id, msg_idx, unit_pos, score FROM scored"),
    "contradictions": context(UNITS, CLAIMS, select="SELECT thread_id, key, msg_a, value_a, msg_b, value_b FROM conflicts"),
    "claims": context(UNITS, CLAIMS, select="SELECT thread_id, msg_idx, unit_pos, 'status' AS key, value FROM said"),
    "preservation_balanced": context(*_ANALYSIS, _BALANCED, select="SELECT thread_id, msg_idx, unit_pos, level FROM classified"),
    "preservation_maximum_preservation": context(*_ANALYSIS, levels(0.60, 0.30, 0.45), select="SELECT thread_id, msg_idx, unit_pos, level FROM classified"),
    "preservation_maximum_compression": context(*_ANALYSIS, levels(0.90, 0.65, 0.80), select="SELECT thread_id, msg_idx, unit_pos, level FROM classified"),
    "facts": context(*_ANALYSIS, _BALANCED, FACTS, select="SELECT thread_id, statement FROM facts"),
    "orphan_tool_results": context(select="SELECT thread_id, msg_idx, tool_call_id FROM ctx t WHERE role = 'tool' AND NOT EXISTS (SELECT 1 FROM ctx c WHERE c.thread_id = t.thread_id AND c.call_id = t.tool_call_id AND c.msg_idx < t.msg_idx)"),
    "tool_exchange": context(select="SELECT a.thread_id, a.msg_idx AS call_idx, b.msg_idx AS result_idx FROM ctx a JOIN ctx b ON a.thread_id = b.thread_id AND a.call_id = b.tool_call_id AND a.msg_idx < b.msg_idx"),
    "log_collapse": context(*_ANALYSIS, _BALANCED, COLLAPSED, select="SELECT thread_id, msg_idx, unit_pos, sha256(new_text) AS new_sha256, length(text)::BIGINT AS chars, length(new_text)::BIGINT AS new_chars FROM changed"),
    "rebuild": context(
        *_ANALYSIS, _BALANCED, COLLAPSED,
        select="""SELECT c.thread_id, c.msg_idx, sha256(coalesce(r.content, c.content)) AS content_sha256 FROM ctx c LEFT JOIN (
  SELECT u.thread_id, u.msg_idx, string_agg(coalesce(k.new_text, u.text), '' ORDER BY u.unit_pos) AS content FROM units u LEFT JOIN changed k ON k.thread_id = u.thread_id AND k.msg_idx = u.msg_idx AND k.unit_pos = u.unit_pos GROUP BY 1, 2) r
  ON r.thread_id = c.thread_id AND r.msg_idx = c.msg_idx""",
    ),
    "lineage_walk": """WITH RECURSIVE e AS (
  SELECT conv_id AS thread_id, 'm-' || conv_id || '-' || turn AS source_id, 's-' || conv_id || '-' || (turn // 2) AS target_id FROM conversations
  UNION SELECT conv_id, 's-' || conv_id || '-' || (turn // 2 - 1), 's-' || conv_id || '-' || (turn // 2) FROM conversations WHERE turn >= 2),
r AS (SELECT DISTINCT thread_id, target_id AS root_id FROM e),
w AS (SELECT r.thread_id, root_id, 1 AS depth, source_id, target_id FROM r JOIN e ON e.thread_id = r.thread_id AND e.target_id = root_id
  UNION SELECT w.thread_id, root_id, w.depth + 1, e.source_id, e.target_id FROM w JOIN e ON e.thread_id = w.thread_id AND e.target_id = w.source_id)
SELECT thread_id, root_id, min(depth)::INT AS depth, source_id, target_id FROM w GROUP BY thread_id, root_id, source_id, target_id""",
    "lineage_delete": "SELECT conv_id AS thread_id, (count(DISTINCT turn) + count(DISTINCT turn // 2) FILTER (turn >= 2))::BIGINT AS removed FROM conversations GROUP BY conv_id",
    "validation": context(
        *_ANALYSIS, _BALANCED, FACTS, NEEDED,
        select="""SELECT f.thread_id, count(*)::INT AS facts, count(*) FILTER (NOT list_bool_and(list_transform(f.required, lambda r: stated(r, s.text))))::INT AS missing
FROM needed f JOIN (SELECT thread_id, string_agg(lower(trim(regexp_replace(content, '\\s+', ' ', 'g'))), chr(1) ORDER BY msg_idx) AS text FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY msg_idx DESC) AS back FROM ctx) WHERE back <= 3 GROUP BY thread_id) s ON s.thread_id = f.thread_id GROUP BY f.thread_id""".replace("stated(r, s.text)", STATED),
    ),
    "events": context(*_ANALYSIS, _BALANCED, FACTS, NEEDED, COLLAPSED, REWRITTEN, select="SELECT * FROM results"),
    "event_metrics": context(
        *_ANALYSIS, _BALANCED, FACTS, NEEDED, COLLAPSED, REWRITTEN,
        select="""SELECT validation_status, recovery_status, policy, count(*)::BIGINT AS summarizations, sum(compacted_units)::BIGINT AS compacted_units, sum(input_tokens)::BIGINT AS input_tokens_sum, median(input_tokens)::DOUBLE AS input_tokens_median,
  sum(output_tokens)::BIGINT AS output_tokens_sum, median(output_tokens)::DOUBLE AS output_tokens_median, round(avg(compression_ratio), 9) AS compression_ratio_mean FROM results GROUP BY ALL""",
    ),
    "summary_links": context(
        select="""SELECT thread_id, source_id, 'threadloom-summary-' || substr(sha256(thread_id || chr(0) || '1' || chr(0) || string_agg(source_id, ',') OVER (PARTITION BY thread_id ORDER BY msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 1, 32) AS target_id, 'derived_from' AS relation
FROM (SELECT thread_id, msg_idx, 'm-' || thread_id || '-' || msg_idx AS source_id, row_number() OVER (PARTITION BY thread_id ORDER BY msg_idx DESC) AS back FROM ctx) WHERE back > 3 AND msg_idx > 0"""
    ),
    "json_minify": f"""WITH {JSON_ITEMS} SELECT thread_id, '[' || string_agg(item, ',' ORDER BY nth) || ']' AS compacted, length('[' || string_agg(item, ',' ORDER BY nth) || ']')::INT AS chars FROM items GROUP BY thread_id""",
    "json_collapse": f"""WITH {JSON_ITEMS},
runs AS (SELECT *, sum(o) OVER (PARTITION BY thread_id ORDER BY nth) AS grp FROM (SELECT *, CASE WHEN lag(item) OVER (PARTITION BY thread_id ORDER BY nth) IS DISTINCT FROM item THEN 1 ELSE 0 END AS o FROM items)),
{JSON_COUNTED} SELECT thread_id, '[' || string_agg(text, ',' ORDER BY nth) || ']' AS compacted, length('[' || string_agg(text, ',' ORDER BY nth) || ']')::INT AS chars FROM counted GROUP BY thread_id""",
    "json_sample": f"""WITH {JSON_ITEMS},
runs AS (SELECT *, item AS grp FROM items),
{JSON_COUNTED},
ended AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY nth) AS place, count(*) OVER (PARTITION BY thread_id) AS n FROM counted),
spans AS (SELECT thread_id, sum(length(text)) + count(*) - 1 AS chars, '{{"__omitted__":' || count(*) || '}}' AS marker FROM ended WHERE place > 5 AND place <= n - 5 GROUP BY thread_id),
kept AS (SELECT e.thread_id, nth, CASE WHEN s.marker IS NOT NULL AND length(s.marker) < s.chars AND place > 5 AND place <= n - 5 THEN CASE WHEN place = 6 THEN s.marker END ELSE text END AS text FROM ended e LEFT JOIN spans s ON s.thread_id = e.thread_id)
SELECT thread_id, '[' || string_agg(text, ',' ORDER BY nth) || ']' AS compacted, length('[' || string_agg(text, ',' ORDER BY nth) || ']')::INT AS chars FROM kept GROUP BY thread_id""",
    "mixed_units": MIXED + "SELECT c_custkey AS thread_id, p.place - 1 AS unit_pos, p.part.kind AS kind, sha256(p.part.text) AS text_sha256, p.part.severity AS severity, p.part.severity IN ('ERROR', 'CRITICAL') AND p.part.severity IS NOT NULL OR p.part.kind = 'error' AS has_error FROM parts, LATERAL (SELECT unnest(list) AS part, generate_subscripts(list, 1) AS place) p",
}
