"""DuckDB statements that compute the same answers as the registered queries.

They are written row by row (price every event, then sum), not the way the
Spark plans go about it, so that the two can disagree.
"""

NOW_MS = 1706659200000
DAY_MS = 86400000

_BASE = """
prices(provider, model, p_in, p_out, p_read, p_write) AS (VALUES
    ('prov-a', 'model-a', 3.0::DOUBLE, 15.0::DOUBLE, 0.3::DOUBLE, NULL::DOUBLE),
    ('prov-a', 'model-b', 15.0, 75.0, 1.5, 18.75),
    ('prov-b', 'model-a', 1.0, 5.0, 0.1, NULL)),
based AS (
    SELECT *, epoch_us(ts) // 1000 AS ms,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
        event_type <> 'signup' AS assistant
    FROM events),
raw AS (
    SELECT
        CAST(event_id AS VARCHAR) AS id, event_id AS seq, ms AS ts,
        CASE WHEN user_id % 7 = 0 THEN 'agent-b' ELSE 'agent-a' END AS agent,
        CASE WHEN user_id % 7 = 0 THEN 'prov-b' ELSE 'prov-a' END AS provider,
        CASE WHEN assistant AND event_id % 53 <> 0 THEN
            CASE event_type WHEN 'click' THEN 'model-a' WHEN 'view' THEN 'model-b'
                WHEN 'purchase' THEN 'model-c' WHEN 'error' THEN '<synthetic>' END END AS model,
        CASE WHEN user_id % 11 <> 0 THEN 'proj-' || (user_id % 12) END AS project,
        CASE WHEN event_id % 97 <> 0
            THEN 's-' || user_id || '-' || strftime(ts, '%Y-%m-%d') END AS session_id,
        CASE WHEN assistant THEN 'req-' || user_id || '-' || (ms // 21600000) END AS turn_id,
        CASE WHEN assistant THEN 'assistant' ELSE 'user' END AS role,
        CASE WHEN assistant AND event_id % 10 <> 9 THEN k * 10 END AS input_tok,
        CASE WHEN assistant AND event_id % 10 <> 9
            THEN CAST(floor(value * 10) AS BIGINT) END AS output_tok,
        CASE WHEN assistant AND event_id % 10 <> 9 THEN k * 100 END AS cache_read_tok,
        CASE WHEN assistant AND event_id % 10 <> 9 AND event_id % 3 <> 0 THEN k END
            AS cache_write_tok,
        CASE WHEN user_id % 7 = 0 THEN CAST(floor(value * 100) AS BIGINT) END AS duration_ms,
        CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN k * 0.01::DOUBLE END
            AS cost_est,
        CASE WHEN event_id % 5 = 0 THEN true WHEN event_id % 5 <> 1 THEN false END
            AS is_sidechain,
        strftime(ts, '%Y-%m-%d') AS day,
        strftime(ts, '%H') AS hour
    FROM based),
claims AS (
    SELECT *, coalesce(input_tok, output_tok, cache_read_tok, cache_write_tok) IS NOT NULL
        AND turn_id IS NOT NULL AS claims
    FROM raw),
owned AS (
    SELECT *, NOT claims OR row_number() OVER (
        PARTITION BY claims, agent, coalesce(session_id, ''), turn_id ORDER BY seq) = 1 AS owns
    FROM claims),
ue AS (
    SELECT * REPLACE (
        CASE WHEN owns THEN input_tok END AS input_tok,
        CASE WHEN owns THEN output_tok END AS output_tok,
        CASE WHEN owns THEN cache_read_tok END AS cache_read_tok,
        CASE WHEN owns THEN cache_write_tok END AS cache_write_tok)
    FROM owned),
"""

_PRICED = """
pe AS (
    SELECT e.*,
        coalesce(input_tok, 0) + coalesce(output_tok, 0)
            + coalesce(cache_read_tok, 0) + coalesce(cache_write_tok, 0) AS total_tok,
        coalesce(input_tok, output_tok, cache_read_tok, cache_write_tok) IS NOT NULL AS used,
        coalesce(input_tok, output_tok, cache_read_tok, cache_write_tok) IS NOT NULL
            AND e.model IS DISTINCT FROM '<synthetic>' AS billable,
        CASE WHEN e.model IS NULL THEN NULL WHEN p.p_in IS NULL THEN cost_est ELSE
            coalesce(input_tok, 0) * p_in / 1e6 + coalesce(output_tok, 0) * p_out / 1e6
            + coalesce(cache_read_tok, 0) * p_read / 1e6
            + coalesce(cache_write_tok, 0) * coalesce(p_write, p_in) / 1e6 END AS cost
    FROM ue e LEFT JOIN prices p ON e.provider = p.provider AND e.model = p.model),
"""

_CALLS = """
calls AS (
    SELECT r.id, r.seq, l_orderkey * 100 + l_linenumber AS place,
        CASE l_returnflag WHEN 'A' THEN 'Read' WHEN 'N' THEN 'Edit' ELSE 'Bash' END AS tool,
        CASE WHEN l_returnflag = 'R' THEN NULL
            WHEN l_suppkey % 10 = 0 THEN 'https://example.com/' || l_partkey
            ELSE 'src/f' || (l_partkey % 300) || '.rs' END AS target
    FROM lineitem JOIN raw r ON l_orderkey % (SELECT max(event_id) + 1 FROM events) = r.seq),
"""


def _with(body: str, *parts: str) -> str:
    ctes = "".join([_BASE, *parts]).rstrip().rstrip(",")
    if body.lstrip().startswith(","):
        return f"WITH {ctes}{body.lstrip()}"
    return f"WITH {ctes} {body}"


_TOTALS = """
    count(DISTINCT session_id) AS sessions,
    count(*) FILTER (used) AS requests,
    CAST(coalesce(sum(input_tok), 0) AS BIGINT) AS input_tok,
    CAST(coalesce(sum(output_tok), 0) AS BIGINT) AS output_tok,
    CAST(coalesce(sum(cache_read_tok), 0) AS BIGINT) AS cache_read_tok,
    CAST(coalesce(sum(cache_write_tok), 0) AS BIGINT) AS cache_write_tok,
    round(CAST(sum(CAST(cost AS DECIMAL(38, 12))) FILTER (billable) AS DOUBLE) * 100) / 100
        AS cost_est,
    count(*) FILTER (billable AND cost IS NOT NULL) > 0
        AND count(*) FILTER (billable AND cost IS NULL) > 0 AS cost_partial,
    count(*) FILTER (billable AND cost IS NOT NULL) AS cost_priced_requests,
    count(*) FILTER (billable AND cost IS NULL) AS cost_unpriced_requests
"""


def _projects(where: str = "true") -> str:
    return _with(
        f"SELECT project, {_TOTALS} FROM pe WHERE {where} GROUP BY project", _PRICED
    )


def _query(*dims: str) -> str:
    shown = {"session": "session_id AS session"}
    columns = ", ".join(shown.get(dim, dim) for dim in dims)
    keys = ", ".join({"session": "session_id"}.get(dim, dim) for dim in dims)
    return _with(f"SELECT {columns}, {_TOTALS} FROM pe GROUP BY {keys}", _PRICED)


_LAST_WEEK = f"ts >= {NOW_MS - 7 * DAY_MS} AND ts < {NOW_MS}"

_SESSIONS = f"""
, s AS (
    SELECT session_id, arg_min(project, seq) FILTER (project IS NOT NULL) AS project,
        min(ts) AS first_ts, max(ts) AS last_ts, max(ts) - min(ts) AS span_ms,
        CAST(sum(duration_ms) AS BIGINT) AS duration_ms,
        coalesce(sum(CAST(cost AS DECIMAL(38, 12))) FILTER (billable), 0) AS cost_rank, sum(total_tok) AS total_rank,
        {_TOTALS}
    FROM pe WHERE session_id IS NOT NULL GROUP BY session_id)
SELECT * EXCLUDE (cost_rank, total_rank, sessions) FROM s
ORDER BY CASE WHEN (SELECT max(cost_priced_requests) FROM s) > 0
    THEN cost_rank ELSE total_rank END DESC, total_rank DESC, session_id LIMIT 20
"""

_FILES = """
, touched AS (
    SELECT id, trim(target) AS file, count(*) AS calls
    FROM calls WHERE trim(target) <> '' AND NOT starts_with(trim(target), 'http://')
        AND NOT starts_with(trim(target), 'https://')
    GROUP BY id, trim(target)),
shared AS (SELECT *, count(*) OVER (PARTITION BY id)::DOUBLE AS n FROM touched)
"""

# Whole counts are summed per split size and divided once, then added as decimals.
_FILE_ROWS = f"""{_FILES},
per_split AS (
    SELECT file, n, count(*) AS turns, sum(calls) AS calls,
        sum(input_tok) / n AS i, sum(output_tok) / n AS o,
        sum(cache_read_tok) / n AS r, sum(cache_write_tok) / n AS w,
        sum(CAST(cost AS DECIMAL(38, 12))) FILTER (billable)::DOUBLE / n AS c,
        count(*) FILTER (billable AND cost IS NOT NULL) AS priced,
        count(*) FILTER (billable AND cost IS NULL) AS unpriced
    FROM shared JOIN pe USING (id) GROUP BY file, n),
per_file AS (
    SELECT file, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(calls) AS BIGINT) AS tool_calls,
        coalesce(round(sum(CAST(i AS DECIMAL(38, 12))), 9), 0)::DOUBLE AS i,
        coalesce(round(sum(CAST(o AS DECIMAL(38, 12))), 9), 0)::DOUBLE AS o,
        coalesce(round(sum(CAST(r AS DECIMAL(38, 12))), 9), 0)::DOUBLE AS r,
        coalesce(round(sum(CAST(w AS DECIMAL(38, 12))), 9), 0)::DOUBLE AS w,
        round(sum(CAST(c AS DECIMAL(38, 12))), 9)::DOUBLE AS c,
        CAST(sum(priced) AS BIGINT) AS priced, CAST(sum(unpriced) AS BIGINT) AS unpriced
    FROM per_split GROUP BY file)
SELECT file, 'even-split' AS method, true AS attributed, turns, tool_calls,
    round(i * 100) / 100 AS attributed_input_tok,
    round(o * 100) / 100 AS attributed_output_tok,
    round(r * 100) / 100 AS attributed_cache_read_tok,
    round(w * 100) / 100 AS attributed_cache_write_tok,
    CASE WHEN priced > 0 THEN round(c * 100) / 100 END AS attributed_cost_est,
    priced > 0 AND unpriced > 0 AS cost_partial,
    priced AS cost_priced_events, unpriced AS cost_unpriced_events
FROM per_file
"""

_COMPARE = f"""
, sides AS (
    SELECT ts >= {NOW_MS - 7 * DAY_MS} AS now,
        count(DISTINCT session_id) AS sessions, count(*) FILTER (used) AS requests,
        sum(input_tok) AS i, sum(output_tok) AS o, sum(cache_read_tok) AS r,
        sum(cache_write_tok) AS w, sum(total_tok) AS t,
        CAST(sum(CAST(cost AS DECIMAL(38, 12))) FILTER (billable) AS DOUBLE) AS cost,
        count(*) FILTER (billable AND cost IS NOT NULL) > 0
            AND count(*) FILTER (billable AND cost IS NULL) > 0 AS partial
    FROM pe WHERE ts >= {NOW_MS - 14 * DAY_MS} AND ts < {NOW_MS} GROUP BY 1),
long AS (
    SELECT now, unnest(['sessions', 'requests', 'input tok', 'output tok', 'cache read tok',
            'cache write tok', 'total tok', 'est. cost']) AS metric,
        unnest([sessions::DOUBLE, requests::DOUBLE, i::DOUBLE, o::DOUBLE, r::DOUBLE, w::DOUBLE,
            t::DOUBLE, cost]) AS v FROM sides),
paired AS (
    SELECT metric, max(v) FILTER (now) AS a, max(v) FILTER (NOT now) AS b
    FROM long GROUP BY metric)
SELECT metric, round(a * 100) / 100 AS this_period, round(b * 100) / 100 AS previous_period,
    round((a - b) * 100) / 100 AS delta,
    CASE WHEN b <> 0 THEN round((a - b) / b * 100 * 10) / 10 END AS change_pct,
    metric = 'est. cost' AND (SELECT bool_or(partial) FROM sides) AS partial
FROM paired
"""

_BURN = f"""
, m AS (SELECT * FROM pe WHERE ts >= epoch_ms(date_trunc('month', make_timestamp({NOW_MS} * 1000)))
    AND ts <= {NOW_MS}),
last AS (SELECT project, session_id FROM m ORDER BY ts DESC, seq DESC LIMIT 1)
SELECT last.project,
    CAST((SELECT coalesce(sum(total_tok), 0) FROM m WHERE ts >= {NOW_MS - 3600000}) AS BIGINT)
        AS tokens_per_hour,
    last.session_id,
    coalesce((SELECT max(ts) - min(ts) FROM m WHERE m.session_id = last.session_id), 0)
        AS session_ms,
    CAST(coalesce((SELECT sum(total_tok) FROM m WHERE m.session_id = last.session_id), 0)
        AS BIGINT) AS session_tokens
FROM last
"""

_NOTES = """
SELECT count(*) AS events, count(*) FILTER (used) AS requests,
    count(*) FILTER (is_sidechain) AS sidechain_events,
    count(*) FILTER (used AND model = '<synthetic>') AS synthetic_events,
    (SELECT string_agg(m, ', ' ORDER BY m) FROM (
        SELECT DISTINCT coalesce(model, '(unknown model)') AS m
        FROM pe WHERE billable AND cost IS NULL)) AS unpriced_models,
    0::BIGINT AS lines_skipped
FROM pe
"""

# The prefixes, words and spaces below are what the results rely on.
# The Unicode white space set, as DuckDB character codes.
_SPACE = " || ".join(
    f"chr({code})"
    for code in [*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
)
_FURNITURE = [
    "<local-command-", "<command-name>", "<command-message>", "<command-args>",
    "<bash-input>", "<bash-stdout>", "[Request interrupted",
]
_MARKED = " OR ".join(f"starts_with(body, '{prefix}')" for prefix in _FURNITURE)
_SLUG = """coalesce(nullif(array_to_string(list_filter(
    list_transform(string_split_regex(body, '[^A-Za-z0-9]+'), lambda w: lower(w)),
    lambda w: w <> '' AND w NOT IN ('a', 'an', 'and', 'any', 'for', 'in', 'of', 'on', 'the', 'then',
        'to', 'with'))[1:4], '-'), ''), 'repeated-prompt')"""


def _age(ms: str) -> str:
    secs = f"(greatest({NOW_MS} - {ms}, 0) // 1000)"
    return f"""CASE WHEN {secs} < 60 THEN 'just now'
        WHEN {secs} < 3600 THEN ({secs} // 60) || 'm ago'
        WHEN {secs} < 86400 THEN ({secs} // 3600) || 'h ago'
        ELSE ({secs} // 86400) || 'd ago' END"""


_REPEATS = f"""
prompts AS (
    SELECT CAST(doc_id AS VARCHAR) AS event_id, text, substring(sha256(text), 1, 32) AS text_hash
    FROM documents),
repeats AS (
    SELECT substring(text_hash, 1, 8) AS id, text_hash, count(*) AS count,
        any_value(text) AS text, max(ts) AS last_ts,
        list_sort(list_distinct(list(project) FILTER (project IS NOT NULL))) AS names,
        trim(any_value(text), {_SPACE}) AS body
    FROM prompts JOIN ue ON event_id = ue.id GROUP BY text_hash HAVING count(*) >= 2),
groups AS (
    SELECT *, coalesce(array_to_string(names, ', '), '') AS projects,
        ({_MARKED}) OR (starts_with(body, '/')
            AND length(translate(body, {_SPACE}, '')) = length(body)) AS is_furniture,
        {_SLUG} AS slug,
        CASE WHEN instr(body, chr(10)) = 0 AND length(body) <= 60
            THEN 'slash-command' ELSE 'skill' END AS suggestion,
        {_age('last_ts')} AS last_age
    FROM repeats),
"""

_GROUP_ROWS = """
SELECT id, text_hash, count, text, true AS text_indexed, last_ts, last_age, projects, suggestion,
    CASE WHEN suggestion = 'skill' THEN slug END AS skill_name
FROM groups WHERE NOT is_furniture
"""

_TEXT_OFF = """
SELECT id, text_hash, count, CAST(NULL AS VARCHAR) AS text, false AS text_indexed, last_ts,
    last_age, projects, 'skill' AS suggestion, 'repeated-prompt' AS skill_name
FROM groups
"""

_DRAFTS = """
, labelled AS (
    SELECT *, CASE WHEN coalesce(len(names), 0) = 0 THEN '(no project)'
        WHEN len(names) > 3 THEN array_to_string(names[1:3], ', ') || ', +' || (len(names) - 3)
            || ' more'
        ELSE array_to_string(names, ', ') END AS label,
        count || ' times, last ' || last_age AS seen
    FROM groups WHERE NOT is_furniture)
SELECT id, '---' || chr(10) || 'name: ' || slug || chr(10) || 'description: A prompt sent '
    || seen || '.' || chr(10) || '---' || chr(10) || chr(10) || '# Prompt' || chr(10) || chr(10)
    || 'Sent ' || seen || '. Projects: ' || label || '.' || chr(10) || chr(10)
    || '```' || chr(10) || body || chr(10) || '```' || chr(10) || chr(10) || '# Procedure'
    || chr(10) || chr(10) || 'Describe what you do when you send this prompt.' || chr(10)
    || chr(10) || '<!-- id ' || id || ', text_hash ' || text_hash || ' -->' || chr(10) AS draft
FROM labelled
"""

_LOOKUP = """
, best AS (SELECT id AS wanted FROM groups WHERE NOT is_furniture
    ORDER BY count DESC, last_ts DESC, id LIMIT 1)
SELECT id, text_hash, count, last_ts FROM groups, best
WHERE NOT is_furniture AND (id = wanted OR starts_with(text_hash, wanted))
"""

_PREFIX = "unhex(lpad(to_hex({length}), 16, '0'))"


def _field(text: str) -> str:
    content = f"encode({text})"
    return _PREFIX.format(length=f"octet_length({content})") + f" || {content}"


_ID = " || ".join(
    [
        _field("'agent-a'"),
        _field("coalesce(session_id, '')"),
        _field("id"),
        _PREFIX.format(length="8") + " || unhex(lpad(to_hex(ts), 16, '0'))",
        _field("role"),
        _field("''"),
    ]
)

# What parsing the transcript lines yields: lines that are no records are gone.
_RECORDS = f"""
records AS (
    SELECT * REPLACE ('agent-a' AS agent, 'prov-a' AS provider),
        substring(sha256({_ID}), 1, 32) AS event_key,
        CASE WHEN role = 'user' THEN 'prompt ' || (seq % 40) END AS prompt_text
    FROM raw WHERE seq % 101 <> 0 AND seq % 103 <> 0),
call_text AS (
    SELECT id, string_agg(tool || '=' || coalesce(target, '-'), ',' ORDER BY place, tool, target NULLS FIRST) AS tool_calls
    FROM calls GROUP BY id),
"""

_STORED = """
marked AS (
    SELECT *, coalesce(input_tok, output_tok, cache_read_tok, cache_write_tok) IS NOT NULL
        AND turn_id IS NOT NULL AS takes FROM records),
firsts AS (
    SELECT *, NOT takes OR row_number() OVER (
        PARTITION BY takes, coalesce(session_id, ''), turn_id ORDER BY seq) = 1 AS keeps
    FROM marked),
kept AS (
    SELECT * EXCLUDE (cost_est) REPLACE (
        CASE WHEN keeps THEN input_tok END AS input_tok,
        CASE WHEN keeps THEN output_tok END AS output_tok,
        CASE WHEN keeps THEN cache_read_tok END AS cache_read_tok,
        CASE WHEN keeps THEN cache_write_tok END AS cache_write_tok)
    FROM firsts),
stored AS (
    SELECT k.*, CASE WHEN p.p_in IS NOT NULL AND coalesce(input_tok, output_tok, cache_read_tok,
            cache_write_tok) IS NOT NULL THEN round((
            coalesce(input_tok, 0) * p_in / 1e6 + coalesce(output_tok, 0) * p_out / 1e6
            + coalesce(cache_read_tok, 0) * p_read / 1e6
            + coalesce(cache_write_tok, 0) * coalesce(p_write, p_in) / 1e6) * 1e6) / 1e6 END
            AS cost_est
    FROM kept k LEFT JOIN prices p ON k.provider = p.provider AND k.model = p.model),
"""

_STORED_ROWS = """
SELECT event_key AS id, ts, project, session_id, turn_id, role, model, input_tok, output_tok,
    cache_read_tok, cache_write_tok, cost_est, is_sidechain,
    coalesce(tool_calls, '') AS tool_calls
FROM stored LEFT JOIN call_text USING (id)
"""

_SUMMARY_ROW = """
SELECT 'agent-a' AS adapter, {files}::BIGINT AS files_read, count(*) AS new_events,
    count(*) FILTER (role = 'user') AS new_prompts,
    (SELECT count(*) FROM raw WHERE seq % 101 = 0) AS skipped_unparseable,
    0::BIGINT AS skipped_oversized,
    {duplicates}::BIGINT AS duplicates, {cursors} AS cursors_written
FROM records WHERE {where}
"""

_KPI = """
, texts AS (SELECT agent, count(*) AS n FROM documents JOIN ue ON CAST(doc_id AS VARCHAR) = ue.id
    GROUP BY agent),
n AS (
    SELECT agent,
        count(*) FILTER (coalesce(input_tok, output_tok) IS NOT NULL) AS tokens,
        count(*) FILTER (coalesce(cache_read_tok, cache_write_tok) IS NOT NULL) AS cache,
        count(*) FILTER (used AND cost IS NOT NULL) AS cost,
        count(*) FILTER (id IN (SELECT id FROM calls)) AS tools,
        0::BIGINT AS stop_reason, count(duration_ms) AS duration_ms,
        count(is_sidechain) AS sidechain
    FROM pe GROUP BY agent),
long AS (
    SELECT agent, unnest(['tokens', 'cache', 'cost', 'prompts', 'tools', 'stop_reason',
            'duration_ms', 'sidechain']) AS kpi,
        unnest([tokens, cache, cost, coalesce(texts.n, 0), tools, stop_reason, duration_ms,
            sidechain]) AS recorded
    FROM n LEFT JOIN texts USING (agent))
SELECT *, recorded > 0 AS supported FROM long
"""

_HEALTH = f"""
, m AS (SELECT *, strftime(make_timestamp((ts - seq % 3 * {31 * DAY_MS}) * 1000), '%Y-%m') AS month FROM pe)
SELECT count(DISTINCT month) AS partitions, min(month) AS oldest,
    count(*) AS events, true AS all_bytes,
    (SELECT string_agg(m, ', ' ORDER BY m) FROM (
        SELECT DISTINCT coalesce(model, '(unknown model)') AS m
        FROM pe WHERE used AND cost IS NULL)) AS unpriced_models
FROM m
"""

_EVENT_ROWS = """
SELECT id, ts, agent, provider, model, project, session_id, turn_id, role, input_tok, output_tok,
    cache_read_tok, cache_write_tok, duration_ms, round(cost_est * 100) / 100 AS cost_est,
    is_sidechain
"""


def statements() -> dict[str, str]:
    used = "coalesce(input_tok, output_tok, cache_read_tok, cache_write_tok) IS NOT NULL"
    total = (
        "coalesce(input_tok, 0) + coalesce(output_tok, 0) + coalesce(cache_read_tok, 0)"
        " + coalesce(cache_write_tok, 0)"
    )
    return {
        "events_normalized": _with(
            f"{_EVENT_ROWS}, {used} AS has_usage, {total} AS total_tokens FROM raw"
        ),
        "usage_claimed": _with(
            "SELECT id, input_tok, output_tok, cache_read_tok, cache_write_tok FROM ue"
        ),
        "event_costs": _with(
            "SELECT id, billable, round(cost * 1e6) / 1e6 AS cost FROM pe", _PRICED
        ),
        "report_summary": _with(
            f"SELECT day, grouping(day) = 1 AS is_total, {_TOTALS} FROM pe"
            " GROUP BY GROUPING SETS ((day), ())",
            _PRICED,
        ),
        "report_projects": _projects(),
        "report_models": _with(
            f"SELECT model, {_TOTALS} FROM pe WHERE used GROUP BY model", _PRICED
        ),
        "report_sessions": _with(_SESSIONS, _PRICED),
        "report_tools": _with(
            """SELECT tool, count(*) AS calls,
                round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM calls) * 10) / 10
                    AS share_pct,
                count(DISTINCT id) AS turns, count(DISTINCT target) AS distinct_targets,
                CAST(NULL AS BIGINT) AS failures, CAST(NULL AS DOUBLE) AS fail_rate
            FROM calls GROUP BY tool""",
            _CALLS,
        ),
        "report_files": _with(
            f"{_FILE_ROWS} ORDER BY i + o + r + w DESC, file LIMIT 25",
            _PRICED,
            _CALLS,
        ),
        "attributed_files": _with(_FILE_ROWS, _PRICED, _CALLS),
        "files_shortfall": _with(
            f"""{_FILES} SELECT
                count(*) FILTER (id IN (SELECT id FROM touched)) AS attributed_events,
                count(*) FILTER (used AND id NOT IN (SELECT id FROM touched))
                    AS unattributed_requests FROM pe""",
            _PRICED,
            _CALLS,
        ),
        "report_compare": _with(_COMPARE, _PRICED),
        "query_project_model": _query("project", "model"),
        "query_day_role": _query("day", "role"),
        "query_all_dims": _query(
            "project", "model", "agent", "provider", "day", "session", "role"
        ),
        "window_7d_projects": _projects(_LAST_WEEK),
        "window_project_filter": _with(
            f"SELECT day, {_TOTALS} FROM pe WHERE project = 'proj-3'"
            f" AND ts >= {NOW_MS - 16 * DAY_MS} AND ts < {NOW_MS} GROUP BY day",
            _PRICED,
        ),
        "store_compacted": f"SELECT *, 1::BIGINT AS most_files FROM ({_projects()})",
        "window_months": _projects(
            f"ts - seq % 3 * {31 * DAY_MS} >= {NOW_MS - 50 * DAY_MS}"
            f" AND ts - seq % 3 * {31 * DAY_MS} < {NOW_MS}"
        ),
        "no_sidechain_projects": _projects("is_sidechain IS DISTINCT FROM true"),
        "report_notes": _with(_NOTES, _PRICED),
        "sessions_noted": f"""SELECT n.*, least(20, s.sessions) AS shown, s.sessions
            FROM ({_with(_NOTES, _PRICED)}) n, ({_with(
            "SELECT count(DISTINCT session_id) AS sessions FROM ue")}) s""",
        "compare_notes": _with(
            _NOTES.replace(
                "FROM pe", f"FROM (SELECT * FROM pe WHERE ts >= {NOW_MS - 14 * DAY_MS} AND ts < {NOW_MS})"
            ),
            _PRICED,
        ),
        "unpriced_models": _with(
            """SELECT coalesce(model, '(unknown model)') AS model, count(*) AS requests
            FROM pe WHERE billable AND cost IS NULL GROUP BY 1""",
            _PRICED,
        ),
        "burn_rate": _with(_BURN, _PRICED),
        "hourly_cost": _with(
            """SELECT hour, round(sum(CAST(cost_est AS DECIMAL(20, 9)))::DOUBLE * 100) / 100 AS cost
            FROM ue WHERE cost_est > 0
            GROUP BY hour ORDER BY cost DESC, hour DESC LIMIT 5"""
        ),
        "suggest_groups": _with(_GROUP_ROWS, _REPEATS),
        "suggest_furniture": _with(
            """SELECT count(*) FILTER (NOT is_furniture) AS groups,
                count(*) FILTER (is_furniture) AS furniture FROM groups""",
            _REPEATS.replace("FROM documents", """FROM (SELECT doc_id,
                CASE WHEN length(text) % 3 = 0 THEN '<command-name>' || text ELSE text END AS text
                FROM documents)"""),
        ),
        "suggest_months": _with(_GROUP_ROWS, _REPEATS.replace(
            "max(ts) AS last_ts", f"max(ts - ue.seq % 3 * {31 * DAY_MS}) AS last_ts")),
        "suggest_text_off": _with(_TEXT_OFF, _REPEATS),
        "suggest_drafts": _with(_DRAFTS, _REPEATS),
        "prompts_redacted": _with(
            """SELECT CAST(doc_id AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS text,
                substring(sha256(text), 1, 32) AS text_hash, false AS text_indexed,
                substring(day, 1, 7) AS month
            FROM documents JOIN raw ON doc_id = seq"""
        ),
        "suggest_lookup": _with(_LOOKUP, _REPEATS),
        "transcript_lines": _with(
            """SELECT CASE WHEN seq % 101 = 0 THEN 'unparseable' WHEN seq % 103 = 0 THEN 'skipped'
                ELSE 'record' END AS status, count(*) AS lines FROM raw GROUP BY 1"""
        ),
        "transcript_events": _with(
            """SELECT event_key AS id, ts, project, session_id, turn_id, role, model, input_tok,
                output_tok, cache_read_tok, cache_write_tok, is_sidechain,
                coalesce(tool_calls, '') AS tool_calls
            FROM records LEFT JOIN call_text USING (id)""",
            _CALLS,
            _RECORDS,
        ),
        "transcript_prompts": _with(
            """SELECT event_key AS event_id, prompt_text AS text,
                substring(sha256(prompt_text), 1, 32) AS text_hash
            FROM records WHERE prompt_text IS NOT NULL""",
            _CALLS,
            _RECORDS,
        ),
        "ingest_idempotent": _with(_STORED_ROWS, _CALLS, _RECORDS, _STORED),
        "ingest_incremental": _with(_STORED_ROWS, _CALLS, _RECORDS, _STORED),
        "ingest_summary": _with(
            _SUMMARY_ROW.format(files=8, duplicates=0, cursors="true", where="true"),
            _CALLS,
            _RECORDS,
        ),
        "ingest_project": _with(
            _SUMMARY_ROW.format(
                files=8, duplicates=0, cursors="false", where="project = 'proj-3'"
            ),
            _CALLS,
            _RECORDS,
        ),
        "ingest_first_record": _with(
            _STORED_ROWS,
            _CALLS,
            _RECORDS,
            _STORED.replace("turn_id ORDER BY seq)", "turn_id ORDER BY seq % 2, seq)"),
        ),
        "ingest_hidden_names": _with(
            """SELECT 8::BIGINT AS files_seen, 8::BIGINT AS files_read, count(*) AS new_events,
                0::BIGINT AS unreadable_files FROM records""",
            _CALLS,
            _RECORDS,
        ),
        "ingest_since": _with(
            """SELECT 0 AS run, 8::BIGINT AS files_seen, 0::BIGINT AS files_read,
                0::BIGINT AS new_events
            UNION ALL SELECT 1, 8, 8, (SELECT count(*) FROM records)""",
            _CALLS,
            _RECORDS,
        ),
        "transcript_long_lines": _with(
            """SELECT CASE WHEN seq % 101 = 0 THEN 'unparseable' WHEN seq % 103 = 0 THEN 'skipped'
                ELSE 'record' END AS status, count(*) AS lines,
                CAST(sum(CASE WHEN seq % 101 <> 0 AND seq % 103 <> 0 THEN input_tok END) AS BIGINT)
                    AS input_tok FROM raw GROUP BY 1"""
        ),
        "transcript_bad_bytes": _with(
            """, line AS (
                SELECT seq, seq // 1000 AS file, seq % 1000 AS place, role,
                    seq % 101 = 0 OR (seq % 103 <> 0 AND seq % 89 = 5 AND session_id IS NOT NULL) AS bad,
                    seq % 101 <> 0 AND seq % 103 = 0 AS other
                FROM raw),
            stop AS (
                SELECT DISTINCT file, CASE WHEN file % 2 = 0 THEN 700 ELSE 1000 END AS place
                FROM line WHERE file % 2 = 1 OR place = 700),
            taken AS (
                SELECT l.*, s.place IS NULL OR l.place < s.place AS early
                FROM line l LEFT JOIN stop s USING (file))
            SELECT run, count(*) FILTER (NOT bad AND NOT other AND early = (run = 0)) AS new_events,
                count(*) FILTER (NOT bad AND NOT other AND role = 'user' AND early = (run = 0)) AS new_prompts,
                count(*) FILTER (bad AND (run = 1 OR early))
                    + CASE WHEN run = 0 THEN (SELECT count(*) FROM stop) ELSE 0 END AS skipped_unparseable,
                count(*) FILTER (NOT bad AND NOT other AND early AND run = 1) AS duplicates,
                CASE WHEN run = 0 THEN (SELECT count(*) FROM stop) ELSE 0 END AS files_behind
            FROM taken, (VALUES (0), (1)) runs(run) GROUP BY run"""
        ),
        "rollup_incremental": _with(
            f"""SELECT run, project, model, {_TOTALS}
            FROM pe, (VALUES (0), (1), (2)) runs(run)
            WHERE floor(seq * 3 / (SELECT max(event_id) + 1 FROM events)) <= run
            GROUP BY run, project, model""",
            _CALLS,
            _RECORDS,
            _STORED,
            _PRICED.replace("FROM ue e", "FROM stored e"),
        ),
        "rollup_ragged_window": _projects(
            f"ts - seq % 3 * {31 * DAY_MS} >= {NOW_MS - 45 * DAY_MS - 5_000_000}"
            f" AND ts - seq % 3 * {31 * DAY_MS} < {NOW_MS - 40_000_000}"
        ),
        "stream_counts": _with(
            """SELECT count(*) AS new_events, count(*) FILTER (role = 'user') AS new_prompts,
                (SELECT count(*) FROM raw WHERE seq % 101 = 0) AS skipped_unparseable,
                0::BIGINT AS skipped_oversized, 0::BIGINT AS duplicates FROM records""",
            _CALLS,
            _RECORDS,
        ),
        "event_footprint": "SELECT count(*) AS records, true AS all_files, true AS all_bytes FROM events",
        "changed_files": """
            SELECT 'second' AS folder, count(*) AS lines FROM events
            WHERE event_id >= (SELECT avg(event_id) FROM events)""",
        "stream_ingest": _with(_STORED_ROWS, _CALLS, _RECORDS, _STORED),
        "stream_dedup": _with(_STORED_ROWS, _CALLS, _RECORDS, _STORED),
        "store_roundtrip": _with(
            f"""{_EVENT_ROWS}, coalesce(tool_calls, '') AS tool_calls,
                substring(day, 1, 7) AS month, fmt
            FROM ue LEFT JOIN (
                SELECT id, string_agg(tool || '=' || coalesce(target, '-'), ',' ORDER BY place, tool, target NULLS FIRST)
                    AS tool_calls FROM calls GROUP BY id) USING (id),
                (VALUES ('json'), ('parquet')) formats(fmt)""",
            _CALLS,
        ),
        "scan_stats": _with(
            f"""SELECT count(DISTINCT substring(day, 1, 7)) AS partitions_read,
                count(*) AS lines_read,
                count(*) FILTER (seq % 101 = 0 OR seq % 103 = 0) AS lines_skipped,
                count(*) FILTER (seq % 101 <> 0 AND seq % 103 <> 0 AND NOT coalesce(
                    project = 'proj-3' AND {_LAST_WEEK}, false)) AS events_filtered
            FROM raw"""
        ),
        "store_health": _with(_HEALTH, _PRICED),
        "kpi_coverage": _with(_KPI, _PRICED, _CALLS),
        "source_sessions": _with("SELECT count(DISTINCT session_id) AS sessions FROM raw"),
        "prompt_footprint": """
            SELECT count(*) AS records, true AS all_files, true AS all_bytes FROM documents""",
    }
