"""DuckDB statements equivalent to the registered queries.

Each statement reads the benchmark views (``conversations``, ``events``,
``pages``) and states the same result as the Spark plan in plain SQL: the
adapters of :mod:`convsift.sources.driver_tables` are written out as
already-normalised CTEs (no JSON round trip), and each operator as window
functions, ``ORDER BY … LIMIT`` and ``ASOF`` joins — a formulation
independent from the Spark one.
"""

from __future__ import annotations

from ..sources.driver_tables import (CONV_BASE_MS, CONV_PROJECTS, CONV_SESSION_STRIDE_MS, DOC_BASE_MS,
                                     DOC_STRIDE_MS, EVENT_PROJECTS, PAGE_BASE_MS, PAGE_STRIDE_MS,
                                     TURN_STRIDE_MS)

PART_COLS = ("part_id, message_id, session_id, project_id, role, msg_created_ms, session_updated_ms, "
             "session_title, project_directory, created_ms, type, text, tool, has_state, input_json, "
             "output, state_title, files")
SESSION_COLS = "session_id, project_id, title, directory, created_ms, updated_ms"
MESSAGE_COLS = "message_id, session_id, project_id, role, agent, created_ms"

CONV = f"""
conv_s AS (
  SELECT conv_id, {CONV_BASE_MS} + conv_id * {CONV_SESSION_STRIDE_MS} AS created_ms,
         max(turn) AS max_turn, arg_min(text, turn) AS first_text
  FROM conversations GROUP BY conv_id),
conv_sessions AS (
  SELECT concat('ses_c', conv_id) AS session_id, concat('proj_', conv_id % {CONV_PROJECTS}) AS project_id,
         substring(first_text, 1, 60) AS title, concat('/data/proj_', conv_id % {CONV_PROJECTS}) AS directory,
         created_ms, created_ms + max_turn * {TURN_STRIDE_MS} AS updated_ms
  FROM conv_s),
conv_messages AS (
  SELECT concat('msg_c', c.conv_id, '_', c.turn) AS message_id, concat('ses_c', c.conv_id) AS session_id,
         concat('proj_', c.conv_id % {CONV_PROJECTS}) AS project_id, c.role AS role,
         coalesce(CASE WHEN c.role = 'assistant' THEN 'build' ELSE c.role END, '') AS agent,
         s.created_ms + c.turn * {TURN_STRIDE_MS} AS created_ms,
         s.created_ms + s.max_turn * {TURN_STRIDE_MS} AS session_updated_ms,
         substring(s.first_text, 1, 60) AS session_title,
         concat('/data/proj_', c.conv_id % {CONV_PROJECTS}) AS project_directory, c.conv_id, c.turn, c.text
  FROM conversations c JOIN conv_s s USING (conv_id)),
conv_parts AS (
  SELECT concat('prt_c', conv_id, '_', turn) AS part_id, message_id, session_id, project_id, role,
         created_ms AS msg_created_ms, session_updated_ms, session_title, project_directory,
         created_ms, 'text' AS type, text,
         NULL::VARCHAR AS tool, false AS has_state, NULL::VARCHAR AS input_json, NULL::VARCHAR AS output,
         NULL::VARCHAR AS state_title, NULL::VARCHAR[] AS files
  FROM conv_messages)"""

EVT = f"""
ev AS (
  SELECT event_id, user_id, event_type, props, epoch_us(ts) // 1000 AS ms,
         json_extract_string(props, '$.k') AS k
  FROM events),
evt_u AS (SELECT user_id, min(ms) AS first_ms, max(ms) AS last_ms FROM ev GROUP BY user_id),
evt_sessions AS (
  SELECT concat('ses_u', user_id) AS session_id, concat('proj_', user_id % {EVENT_PROJECTS}) AS project_id,
         concat('user ', user_id, ' activity') AS title, concat('/data/proj_', user_id % {EVENT_PROJECTS}) AS directory,
         first_ms AS created_ms, last_ms AS updated_ms
  FROM evt_u),
evt_base AS (
  SELECT concat('msg_e', e.event_id) AS message_id, concat('ses_u', e.user_id) AS session_id,
         concat('proj_', e.user_id % {EVENT_PROJECTS}) AS project_id,
         CASE WHEN e.event_type IN ('click', 'view') THEN 'user' ELSE 'assistant' END AS role,
         CASE WHEN e.event_type IN ('click', 'view') THEN 'user' ELSE 'build' END AS agent,
         e.ms AS created_ms, u.last_ms AS session_updated_ms,
         concat('user ', e.user_id, ' activity') AS session_title,
         concat('/data/proj_', e.user_id % {EVENT_PROJECTS}) AS project_directory,
         e.event_id, e.event_type, e.props, e.k,
         concat('src/f', e.k, '.ts') AS path
  FROM ev e JOIN evt_u u USING (user_id)),
evt_messages AS (SELECT {MESSAGE_COLS} FROM evt_base),
evt_parts AS (
  SELECT concat('prt_e', event_id, '_0') AS part_id, message_id, session_id, project_id, role,
         created_ms AS msg_created_ms, session_updated_ms, session_title, project_directory, created_ms,
         CASE WHEN event_type IN ('click', 'view') THEN 'text' ELSE 'tool' END AS type,
         CASE WHEN event_type IN ('click', 'view') THEN concat(event_type, ' ', props) END AS text,
         CASE WHEN event_type IN ('click', 'view') THEN NULL WHEN event_type = 'purchase' THEN 'write'
              WHEN event_type = 'signup' THEN 'edit' ELSE 'bash' END AS tool,
         event_type NOT IN ('click', 'view') AS has_state,
         CASE WHEN event_type IN ('click', 'view') THEN NULL
              WHEN event_type IN ('purchase', 'signup') THEN concat('{{"filePath":"', path, '"}}')
              ELSE concat('{{"command":"cat ', path, '"}}') END AS input_json,
         CASE WHEN event_type IN ('click', 'view') THEN NULL WHEN event_type = 'purchase' THEN concat('Wrote ', path)
              WHEN event_type = 'signup' THEN concat('Updated ', path) ELSE concat('exit code ', k) END AS output,
         CASE WHEN event_type IN ('click', 'view') THEN NULL WHEN event_type = 'purchase' THEN concat('Write ', path)
              WHEN event_type = 'signup' THEN concat('Edit ', path) ELSE 'Run command' END AS state_title,
         NULL::VARCHAR[] AS files
  FROM evt_base
  UNION ALL
  SELECT concat('prt_e', event_id, '_1'), message_id, session_id, project_id, role, created_ms,
         session_updated_ms, session_title, project_directory, created_ms + 1, 'patch', NULL, NULL, false, NULL, NULL, NULL,
         [path, 'src/shared.ts']
  FROM evt_base WHERE event_type = 'purchase')"""

PAGE = f"""
pg AS (
  SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host,
         regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS upath,
         {PAGE_BASE_MS} + page_id * {PAGE_STRIDE_MS} AS ms
  FROM pages),
pg_h AS (SELECT host, min(ms) AS first_ms, max(ms) AS last_ms FROM pg GROUP BY host),
page_sessions AS (
  SELECT concat('ses_h', host) AS session_id, 'proj_web' AS project_id, host AS title,
         concat('/web/', host) AS directory, first_ms - 500 AS created_ms, last_ms AS updated_ms
  FROM pg_h),
page_base AS (SELECT p.*, h.last_ms AS session_updated_ms, p.host AS session_title,
                     concat('/web/', p.host) AS project_directory FROM pg p JOIN pg_h h USING (host)),
page_messages AS (
  SELECT concat('msg_p', page_id, '_0') AS message_id, concat('ses_h', host) AS session_id,
         'proj_web' AS project_id, 'user' AS role, 'user' AS agent, ms - 500 AS created_ms FROM page_base
  UNION ALL
  SELECT concat('msg_p', page_id, '_1'), concat('ses_h', host), 'proj_web', 'assistant', 'build', ms
  FROM page_base),
page_parts AS (
  SELECT concat('prt_p', page_id, '_0') AS part_id, concat('msg_p', page_id, '_0') AS message_id,
         concat('ses_h', host) AS session_id, 'proj_web' AS project_id, 'user' AS role,
         ms - 500 AS msg_created_ms, session_updated_ms, session_title, project_directory,
         ms - 500 AS created_ms, 'text' AS type,
         concat('fetch ', url) AS text, NULL::VARCHAR AS tool, false AS has_state,
         NULL::VARCHAR AS input_json, NULL::VARCHAR AS output, NULL::VARCHAR AS state_title,
         NULL::VARCHAR[] AS files
  FROM page_base
  UNION ALL
  SELECT concat('prt_p', page_id, '_1'), concat('msg_p', page_id, '_1'), concat('ses_h', host),
         'proj_web', 'assistant', ms, session_updated_ms, session_title, project_directory,
         ms + 1, 'tool', NULL, 'webfetch', true,
         json_object('url', url)::VARCHAR, html, url, NULL
  FROM page_base
  UNION ALL
  SELECT concat('prt_p', page_id, '_2'), concat('msg_p', page_id, '_1'), concat('ses_h', host),
         'proj_web', 'assistant', ms, session_updated_ms, session_title, project_directory,
         ms + 2, 'patch', NULL, NULL, false,
         NULL, NULL, NULL, [upath]
  FROM page_base)"""

DOC = f"""
dc AS (SELECT doc_id, text, lang, source, {DOC_BASE_MS} + doc_id * {DOC_STRIDE_MS} AS ms FROM documents),
dc_s AS (SELECT source, lang, min(ms) AS first_ms, max(ms) AS last_ms FROM dc GROUP BY source, lang),
doc_sessions AS (
  SELECT concat('ses_d', source, '_', lang) AS session_id, concat('proj_', lang) AS project_id,
         concat(source, ' ', lang, ' archive') AS title, concat('/docs/', lang) AS directory,
         first_ms AS created_ms, last_ms AS updated_ms
  FROM dc_s),
doc_base AS (
  SELECT d.*, s.last_ms AS session_updated_ms, concat(d.source, ' ', d.lang, ' archive') AS session_title,
         concat('/docs/', d.lang) AS project_directory,
         CASE WHEN d.lang IN ('en', 'fr') THEN 'user' ELSE 'assistant' END AS role
  FROM dc d JOIN dc_s s USING (source, lang)),
doc_messages AS (
  SELECT concat('msg_d', doc_id) AS message_id, concat('ses_d', source, '_', lang) AS session_id,
         concat('proj_', lang) AS project_id, role, 'reader' AS agent, ms AS created_ms
  FROM doc_base),
doc_parts AS (
  SELECT concat('prt_d', doc_id) AS part_id, concat('msg_d', doc_id) AS message_id,
         concat('ses_d', source, '_', lang) AS session_id, concat('proj_', lang) AS project_id, role,
         ms AS msg_created_ms, session_updated_ms, session_title, project_directory, ms AS created_ms,
         'text' AS type, text, NULL::VARCHAR AS tool, false AS has_state, NULL::VARCHAR AS input_json,
         NULL::VARCHAR AS output, NULL::VARCHAR AS state_title, NULL::VARCHAR[] AS files
  FROM doc_base)"""

_SOURCES = {"conv": CONV, "evt": EVT, "page": PAGE, "doc": DOC}


def history_ctes(sources=("conv", "evt", "page")) -> str:
    """``WITH``-list defining ``sessions``, ``messages`` and ``parts``."""
    body = ",".join(_SOURCES[s] for s in sources)
    union = lambda kind, cols: " UNION ALL ".join(
        f"SELECT {cols} FROM {s}_{kind}" for s in sources)
    return (f"WITH {body},\nsessions AS ({union('sessions', SESSION_COLS)}),\n"
            f"messages AS ({union('messages', MESSAGE_COLS)}),\n"
            f"parts AS ({union('parts', PART_COLS)})")


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- keyword

class SqlMatcher:
    """SQL counterpart of :class:`convsift.functions.patterns.Matcher` (RE2)."""

    def __init__(self, query: str, regex: bool = False, case_sensitive: bool = False):
        self.query = query
        self.literal_cs = not regex and case_sensitive
        body = query if regex else "\\Q" + query + "\\E"
        self.pattern = body if case_sensitive else "(?i)" + body

    def test(self, c: str) -> str:
        if self.literal_cs:
            return f"contains({c}, {sql_str(self.query)})"
        return f"regexp_matches({c}, {sql_str(self.pattern)})"

    def first(self, c: str) -> str:
        if self.literal_cs:
            return sql_str(self.query)
        return f"regexp_extract({c}, {sql_str(self.pattern)}, 0)"


SCAN_ORDER_SQL = ("k_updated_ms DESC NULLS LAST, session_id, k_phase, k_msg_ms NULLS FIRST, "
                  "message_id NULLS FIRST, k_part_ms NULLS FIRST, part_id NULLS FIRST, k_slot, k_ord")


def _bounds(b: tuple[str, str]) -> str:
    return f"BETWEEN epoch_ms(TIMESTAMP {sql_str(b[0])}) AND epoch_ms(TIMESTAMP {sql_str(b[1])})"


def keyword_sql(m: SqlMatcher, limit: int, sources=("conv", "evt", "page"), role: str | None = None,
                project_id: str | None = None, date_range: tuple[str, str] | None = None,
                report: bool = False, corpus_range: tuple[str, str] | None = None) -> str:
    """Keyword search: first ``limit`` matches in walk order (then an
    optional date filter on the result, as the reference applies it)."""
    scope_s_l = [f"project_id = {sql_str(project_id)}"] if project_id else []
    scope_p = [f"project_id = {sql_str(project_id)}"] if project_id else []
    if role:
        scope_p.append(f"role = {sql_str(role)}")
    if corpus_range:
        scope_s_l.append(f"updated_ms {_bounds(corpus_range)}")
        scope_p.append(f"msg_created_ms {_bounds(corpus_range)}")
    scope_s = ("WHERE " + " AND ".join(scope_s_l)) if scope_s_l else ""
    where_p = ("WHERE " + " AND ".join(scope_p)) if scope_p else ""
    key = ("session_updated_ms AS k_updated_ms, session_id, 1 AS k_phase, msg_created_ms AS k_msg_ms, "
           "message_id, created_ms AS k_part_ms, part_id")
    date_filter = ""
    if date_range:
        date_filter = (f"WHERE r.timestamp BETWEEN epoch_ms(TIMESTAMP {sql_str(date_range[0])}) "
                       f"AND epoch_ms(TIMESTAMP {sql_str(date_range[1])})")
    select = ("r.session_id, r.session_title, r.timestamp, r.match_type, r.excerpt, r.context, "
              "r.message_id, r.part_id, r.project_directory")
    if report:
        select += (",\n  concat_ws(chr(10), concat('## ', r.session_title), concat('- Session ID: ', r.session_id),"
                   " concat('- Project: ', r.project_directory),"
                   " concat('- Date: ', strftime(make_timestamp(r.timestamp * 1000), '%Y-%m-%d %H:%M:%S')),"
                   " concat('- Match Type: ', r.match_type), concat('- Excerpt: \"', r.excerpt, '\"'),"
                   " CASE WHEN length(r.context) > 0 AND r.context <> r.excerpt"
                   " THEN concat('- Context: ...', r.context, '...') END) AS entry,\n"
                   "  concat('Found ', count(*) OVER (), ' matches in conversation history:') AS header")
    return f"""{history_ctes(sources)},
S AS (SELECT * FROM sessions {scope_s}),
P AS (SELECT *, coalesce(input_json, '{{}}') AS in_s, coalesce(nullif(output, ''), '') AS out_s FROM parts {where_p}),
cands AS (
  SELECT updated_ms AS k_updated_ms, session_id, 0 AS k_phase, NULL::BIGINT AS k_msg_ms, NULL::VARCHAR AS message_id,
         NULL::BIGINT AS k_part_ms, NULL::VARCHAR AS part_id, 0 AS k_slot, 0 AS k_ord, updated_ms AS timestamp,
         'title' AS match_type, NULL::VARCHAR AS src, title AS excerpt_fixed, title AS context_fixed
  FROM S WHERE title IS NOT NULL AND {m.test('title')}
  UNION ALL
  SELECT {key}, 0, 0, msg_created_ms, 'message', text, NULL, NULL
  FROM P WHERE type = 'text' AND length(text) > 0 AND {m.test('text')}
  UNION ALL
  SELECT {key}, 1, 0, msg_created_ms, 'tool', NULL, tool, coalesce(nullif(state_title, ''), tool)
  FROM P WHERE type = 'tool' AND length(tool) > 0 AND {m.test('tool')}
  UNION ALL
  SELECT {key}, 2, 0, msg_created_ms, 'filepath',
         CASE WHEN {m.test('in_s')} THEN in_s ELSE out_s END, NULL,
         coalesce(nullif(state_title, ''), nullif(tool, ''), '')
  FROM P WHERE type = 'tool' AND has_state AND ({m.test('in_s')} OR {m.test('out_s')})
  UNION ALL
  SELECT {key}, 3, i - 1, msg_created_ms, 'filepath', NULL, f, concat('Modified file: ', f)
  FROM (SELECT *, unnest(files) AS f, generate_subscripts(files, 1) AS i FROM P WHERE type = 'patch')
  WHERE f IS NOT NULL AND {m.test('f')}),
top AS (SELECT * FROM cands ORDER BY {SCAN_ORDER_SQL} LIMIT {limit}),
ex AS (SELECT t.*, coalesce(t.excerpt_fixed, {m.first('t.src')}) AS excerpt FROM top t),
r AS (
  SELECT e.session_id, s.title AS session_title, e.timestamp, e.match_type, e.excerpt,
         coalesce(e.context_fixed, CASE WHEN hi > lo THEN substring(e.src, lo + 1, hi - lo) ELSE '' END) AS context,
         e.message_id, e.part_id, s.directory AS project_directory
  FROM (SELECT *, greatest(strpos(src, excerpt) - 1 - 100, 0) AS lo,
               least(length(src), strpos(src, excerpt) - 1 + length(excerpt) + 100) AS hi FROM ex) e
  JOIN sessions s USING (session_id))
SELECT {select} FROM r {date_filter}"""


# ---------------------------------------------------------------- trace

def _path_match_sql(col: str, query: str) -> str:
    q = query.replace("\\", "/")
    if "/" in q:
        return f"{col} = {sql_str(q)}"
    return f"({col} = {sql_str(q)} OR suffix({col}, {sql_str('/' + q)}))"


TRACE_SELECT = ("r.session_id, s.title AS session_title, r.timestamp, r.first_touch, p.text AS user_prompt, "
                "r.tool_name, r.file_path")


def _prompts_cte() -> str:
    return ("prompts AS (SELECT session_id, msg_created_ms, text FROM parts "
            "WHERE role = 'user' AND type = 'text')")


def _trace_entry_sql(over: str) -> str:
    """Fixed texts of the trace report, as in ``operators/report.py``."""
    return (",\n  concat_ws(chr(10), concat('## ', s.title), concat('- Session ID: ', r.session_id),"
            " concat('- Date: ', strftime(make_timestamp(r.timestamp * 1000), '%Y-%m-%d %H:%M:%S')),"
            " concat('- Status: ', CASE WHEN r.first_touch THEN 'First seen' ELSE 'Later touch' END),"
            " concat('- File: ', r.file_path),"
            " CASE WHEN length(r.tool_name) > 0 THEN concat('- Tool: ', r.tool_name) END,"
            " CASE WHEN length(p.text) > 0 THEN concat('- Preceding User Prompt: \"', p.text, '\"') END) AS entry,\n"
            f"  concat('Found ', count(*) OVER ({over}), ' file trace matches in conversation history:') AS header")


def trace_sql(query: str, limit: int | None = 50, sources=("evt",), project_id: str | None = None,
              report: bool = False, date_range: tuple[str, str] | None = None, page_size: int | None = None) -> str:
    scope = f"AND project_id = {sql_str(project_id)}" if project_id else ""
    select = TRACE_SELECT
    if page_size:
        select += f", (1 + (r.place - 1) // {page_size})::INT AS page"
    if report:
        select += _trace_entry_sql("")
    return f"""{history_ctes(sources)},
{_prompts_cte()},
touch_rows AS (
  SELECT session_id, message_id, part_id, msg_created_ms AS timestamp, created_ms AS part_created_ms,
         0 AS source_priority, tool AS tool_name, json_extract_string(input_json, '$.filePath') AS file_path
  FROM parts WHERE role = 'assistant' AND type = 'tool' AND tool IN ('write', 'edit') {scope}
  UNION ALL
  SELECT session_id, message_id, part_id, msg_created_ms, created_ms, 1, NULL,
         list_filter(files, lambda f: {_path_match_sql('f', query)})[1]
  FROM parts WHERE role = 'assistant' AND type = 'patch' {scope}),
matched AS (SELECT * FROM touch_rows
            WHERE file_path IS NOT NULL AND length(file_path) > 0 AND {_path_match_sql('file_path', query)}),
dedup AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, message_id, file_path
                                              ORDER BY source_priority, part_created_ms, part_id) AS rn
                 FROM matched) WHERE rn = 1),
flagged AS (
  SELECT *, row_number() OVER (ORDER BY timestamp, source_priority, session_id, message_id, file_path) = 1 AS first_touch,
         row_number() OVER (ORDER BY timestamp DESC, source_priority, session_id, message_id, file_path) AS place
  FROM dedup),
r AS (SELECT * FROM flagged {f"WHERE place <= {limit}" if limit is not None else ""})
SELECT {select}
FROM r ASOF LEFT JOIN prompts p ON r.session_id = p.session_id AND r.timestamp > p.msg_created_ms
JOIN sessions s ON s.session_id = r.session_id
{f"WHERE r.timestamp {_bounds(date_range)}" if date_range else ""}"""


def trace_batch_sql(queries_sql: str, sources=("evt",), limit_per_query: int | None = None, report: bool = False) -> str:
    select = TRACE_SELECT + (_trace_entry_sql("PARTITION BY r.query") if report else "")
    lim = f"WHERE rk <= {limit_per_query}" if limit_per_query is not None else ""
    return f"""{history_ctes(sources)},
{_prompts_cte()},
queries AS ({queries_sql}),
qn AS (SELECT DISTINCT query, replace(query, '\\', '/') AS q FROM queries),
cands AS (
  SELECT session_id, message_id, part_id, msg_created_ms AS timestamp, created_ms AS part_created_ms,
         0 AS source_priority, tool AS tool_name, json_extract_string(input_json, '$.filePath') AS file_path, 1 AS pos
  FROM parts WHERE role = 'assistant' AND type = 'tool' AND tool IN ('write', 'edit')
  UNION ALL
  SELECT session_id, message_id, part_id, msg_created_ms, created_ms, 1, NULL, f, i
  FROM (SELECT *, unnest(files) AS f, generate_subscripts(files, 1) AS i FROM parts
        WHERE role = 'assistant' AND type = 'patch')),
matched AS (
  SELECT qn.query, c.* FROM cands c JOIN qn
    ON c.file_path IS NOT NULL AND length(c.file_path) > 0
   AND CASE WHEN contains(qn.q, '/') THEN c.file_path = qn.q
            ELSE c.file_path = qn.q OR suffix(c.file_path, concat('/', qn.q)) END),
per_part AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, part_id ORDER BY pos) AS rp FROM matched)
  WHERE rp = 1),
dedup AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, session_id, message_id, file_path
                                              ORDER BY source_priority, part_created_ms, part_id) AS rn
                 FROM per_part) WHERE rn = 1),
flagged AS (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY timestamp, source_priority, session_id,
                                                          message_id, file_path) = 1 AS first_touch,
         row_number() OVER (PARTITION BY query ORDER BY timestamp DESC, source_priority, session_id,
                                                       message_id, file_path) AS rk
  FROM dedup),
r AS (SELECT * FROM flagged {lim})
SELECT r.query, {select}
FROM r ASOF LEFT JOIN prompts p ON r.session_id = p.session_id AND r.timestamp > p.msg_created_ms
JOIN sessions s ON s.session_id = r.session_id"""


# ---------------------------------------------------------------- items / fuzzy

def items_cte(path_token: str) -> str:
    """``items``: the searchable strings of fuzzy search, with walk keys."""
    key = ("project_id, role, session_id, message_id, part_id, msg_created_ms AS timestamp")
    walk = "session_updated_ms AS k_updated_ms, 1 AS k_phase, msg_created_ms AS k_msg_ms, created_ms AS k_part_ms"
    tail = "session_title, project_directory"
    return f"""items AS (
  SELECT project_id, NULL::VARCHAR AS role, session_id, NULL::VARCHAR AS message_id, NULL::VARCHAR AS part_id,
         updated_ms AS timestamp, 'title' AS match_type, title AS content, updated_ms AS k_updated_ms,
         0 AS k_phase, NULL::BIGINT AS k_msg_ms, NULL::BIGINT AS k_part_ms, 0 AS k_slot, 0 AS k_ord,
         title AS session_title, directory AS project_directory
  FROM sessions
  UNION ALL
  SELECT {key}, 'message', text, {walk}, 0, 0, {tail} FROM parts WHERE type = 'text' AND length(text) > 0
  UNION ALL
  SELECT {key}, 'tool', concat(tool, ' ', coalesce(nullif(state_title, ''), '')), {walk}, 1, 0, {tail}
  FROM parts WHERE type = 'tool' AND length(tool) > 0
  UNION ALL
  SELECT {key}, 'filepath', tok, {walk}, 2, i - 1, {tail}
  FROM (SELECT *, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i
        FROM (SELECT *, regexp_extract_all(concat(coalesce(input_json, '{{}}'), ' ', coalesce(output, '')),
                                           {sql_str(path_token)}) AS toks
              FROM parts WHERE type = 'tool' AND has_state))
  UNION ALL
  SELECT {key}, 'filepath', f, {walk}, 3, i - 1, {tail}
  FROM (SELECT *, unnest(files) AS f, generate_subscripts(files, 1) AS i FROM parts WHERE type = 'patch')
  WHERE f IS NOT NULL)"""


N_WORDS_SQL = "len(list_filter(string_split(coalesce(content, ''), ' '), lambda w: w <> '')) AS n_words"


def items_sql(path_token: str, sources=("conv", "evt", "page")) -> str:
    return f"{history_ctes(sources)},\n{items_cte(path_token)}\nSELECT *, {N_WORDS_SQL} FROM items"


def fuzzy_sql(query: str, max_dist: int, limit: int, path_token: str, sources=("conv",),
              role: str | None = None, project_id: str | None = None,
              corpus_range: tuple[str, str] | None = None) -> str:
    """Brute force: Levenshtein of the query against every substring of
    length m-k … m+k of every item, block by block of start positions.  Non-ASCII characters of the lower-cased
    text become one placeholder byte (DuckDB's distance counts bytes), which
    keeps positions and distances for an ASCII query."""
    q = query.lower()
    m, k = len(q), max_dist
    filt = [f"content IS NOT NULL AND length(content) >= {m - k}"]
    if role:
        filt.append(f"(match_type = 'title' OR role = {sql_str(role)})")
    if project_id:
        filt.append(f"project_id = {sql_str(project_id)}")
    if corpus_range:
        filt.append(f"timestamp {_bounds(corpus_range)}")
    keys = "session_id, k_phase, pk, k_slot, k_ord"
    return f"""{history_ctes(sources)},
{items_cte(path_token)},
it AS (SELECT *, coalesce(part_id, '') AS pk,
              regexp_replace(lower(content), '[^\\x00-\\x7F]', chr(1), 'g') AS lc,
              len(list_filter(string_split(content, ' '), lambda w: w <> '')) AS n_words
       FROM items WHERE {' AND '.join(filt)}),
win AS (SELECT {keys}, o, substring(lc, o + 1, {255 + m + k}) AS wt
        FROM it, range(0, length(lc), 256) r(o)),
cand AS (SELECT * FROM (
           SELECT {keys}, o + s AS s, levenshtein({sql_str(q)}, substring(wt, s, L)) AS d
           FROM win, range(1, least(256, length(wt)) + 1) r(s), range({m - k}, {m + k + 1}) w(L)
           WHERE s + L - 1 <= length(wt)) WHERE d <= {k}),
dmin AS (SELECT {keys}, min(d) AS dist FROM cand GROUP BY ALL),
best AS (SELECT c.session_id, c.k_phase, c.pk, c.k_slot, c.k_ord, min(c.d) AS dist, min(c.s) - 1 AS start
         FROM cand c JOIN dmin USING ({keys}) WHERE c.d = dmin.dist GROUP BY ALL),
top AS (SELECT it.*, b.dist, b.start FROM it JOIN best b USING ({keys})
        WHERE b.dist <= {k} AND {m} - b.dist >= 2
        ORDER BY b.dist, it.n_words, {SCAN_ORDER_SQL} LIMIT {limit}),
cut AS (SELECT *,
          CASE WHEN least(length(content), start + 80) > greatest(start - 20, 0)
               THEN substring(content, greatest(start - 20, 0) + 1,
                              least(length(content), start + 80) - greatest(start - 20, 0)) ELSE '' END AS ex0,
          CASE WHEN least(length(content), start + 200) > greatest(start - 100, 0)
               THEN substring(content, greatest(start - 100, 0) + 1,
                              least(length(content), start + 200) - greatest(start - 100, 0)) ELSE '' END AS cx0
        FROM top),
fin AS (SELECT *, coalesce(nullif(ex0, ''), {sql_str(query)}) AS excerpt FROM cut)
SELECT f.session_id, s.title AS session_title, f.timestamp, f.match_type, f.excerpt,
       coalesce(nullif(f.cx0, ''), f.excerpt) AS context, f.message_id, f.part_id, s.directory AS project_directory
FROM fin f JOIN sessions s USING (session_id)"""
