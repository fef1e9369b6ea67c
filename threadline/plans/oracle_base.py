"""SQL twins of the stand-in transcripts, written straight over the driver's tables.

The CTEs below never see JSON: they restate the stand-in rules and the fold
semantics over ``events``, so they check the Spark jobs independently.
"""

from __future__ import annotations

IDLE_GAP = 21600

FACTS_CTE = f"""
ev AS (
  SELECT event_id, event_type AS et, user_id AS u, ts,
         CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
         CAST(floor(epoch_us(ts) / 259200000000) AS BIGINT) AS b
  FROM events),
e1 AS (
  SELECT *, u % 5 = 4 AS sub, 's' || u || '-' || b AS stem,
         's' || (u - CASE WHEN u % 5 = 4 THEN 1 ELSE 0 END) || '-' || b AS uuid,
         NOT (et = 'error' AND k = 99) AS ok,
         ['claude-opus-5-20260101', 'claude-opus-4-8', 'claude-sonnet-4-5-20250929',
          'claude-haiku-4-5-20251001', 'claude-fable-5', 'unlisted-model-1', '<synthetic>', NULL
         ][1 + CAST((u * 3 + k) % 8 AS INT)] AS mdl
  FROM ev),
e2 AS (
  SELECT *, CASE WHEN sub THEN 'agent:' ELSE '' END || stem AS key,
         CASE WHEN ok AND k <> 50 THEN ts END AS stamp,
         CASE WHEN ok AND k <> 50 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') END AS iso,
         et IN ('click', 'purchase') AS is_reply,
         ok AND et IN ('view', 'error') AS is_user,
         CASE WHEN NOT ok THEN NULL WHEN et IN ('view', 'error') THEN 'user'
              WHEN et IN ('click', 'purchase') THEN 'assistant'
              ELSE ['ai-title', 'custom-title', 'attachment', 'system', 'mystery'][1 + CAST(k % 5 AS INT)] END AS etype,
         et IN ('click', 'purchase') AND coalesce(mdl, '') <> '<synthetic>' AS used,
         CASE WHEN u % 11 = 0 THEN NULL
              WHEN u % 4 = 1 THEN '/home/ann/projects/app' || (u % 13) || '/.worktree/b' || (u % 3)
              WHEN u % 9 = 2 THEN '/srv/code/lib' || (u % 3)
              ELSE '/home/ann/projects/app' || (u % 13) END AS cwd
  FROM e1),
price(prefix, fast, r_in, r_out) AS (VALUES
  ('claude-fable-5', FALSE, 10000000, 50000000), ('claude-opus-5', FALSE, 5000000, 25000000),
  ('claude-opus-4-8', FALSE, 5000000, 25000000), ('claude-sonnet-4-5', FALSE, 3000000, 15000000),
  ('claude-haiku-4-5', FALSE, 1000000, 5000000), ('claude-opus-5', TRUE, 10000000, 50000000),
  ('claude-opus-4-8', TRUE, 10000000, 50000000)),
rate AS (
  SELECT m.mdl, f.fast AS is_fast,
         arg_max(p.r_in, (CASE WHEN p.fast THEN 1000 ELSE 0 END) + length(p.prefix)) AS r_in,
         arg_max(p.r_out, (CASE WHEN p.fast THEN 1000 ELSE 0 END) + length(p.prefix)) AS r_out
  FROM (SELECT DISTINCT mdl FROM e2) m CROSS JOIN (VALUES (TRUE), (FALSE)) f(fast)
  JOIN price p ON starts_with(m.mdl, p.prefix) AND (f.fast OR NOT p.fast)
  GROUP BY ALL),
e3 AS (
  SELECT e.*,
    CASE WHEN used THEN 100 + 10 * k ELSE 0 END AS tin,
    CASE WHEN used THEN 50 + 7 * k ELSE 0 END AS tout,
    CASE WHEN used THEN 4 * k ELSE 0 END AS decl,
    CASE WHEN used THEN CASE WHEN k % 6 <> 5 AND k % 17 <> 0 THEN 3 * k ELSE 4 * k END ELSE 0 END AS cw5,
    CASE WHEN used AND k % 6 <> 5 AND k % 17 <> 0 THEN k ELSE 0 END AS cw1h,
    CASE WHEN used THEN 1000 + k ELSE 0 END AS cread,
    CASE WHEN used THEN least(8 * k, 50 + 7 * k) ELSE 0 END AS think,
    CASE WHEN used AND k % 10 = 1 THEN k % 3 ELSE 0 END AS ws,
    CASE WHEN used AND k % 10 = 1 AND et = 'purchase' THEN 1 ELSE 0 END AS wf,
    CASE WHEN used THEN CASE WHEN k % 9 = 0 THEN 'priority' ELSE 'standard' END END AS tier,
    CASE WHEN used AND k % 8 = 0 THEN 'fast' END AS speed,
    CASE WHEN is_reply THEN CASE WHEN et = 'purchase' AND k % 30 = 2 THEN 'refusal' ELSE 'end_turn' END END AS stop,
    CASE WHEN et = 'click' THEN ['low', 'high', NULL][1 + CAST(k % 3 AS INT)] END AS effort,
    CASE WHEN is_reply THEN mdl END AS model,
    et = 'view' AND k % 33 = 5 AS interrupted
  FROM e2 e),
e4 AS (
  SELECT e.*,
    coalesce(tin * r_in, 0) AS p_in, coalesce(tout * r_out, 0) AS p_out,
    coalesce((cw5 * 125 + cw1h * 200) * (r_in // 100), 0) AS p_cw, coalesce(cread * 10 * (r_in // 100), 0) AS p_cr,
    is_reply AND model IS NOT NULL AND model <> '<synthetic>' AND r_in IS NULL AS unpriced,
    CASE WHEN is_user AND NOT interrupted
         THEN (et = 'view' AND k % 10 <> 0) OR (et = 'error' AND k % 5 = 0) ELSE FALSE END AS is_prompt,
    CASE WHEN et = 'view' AND interrupted THEN '[Request interrupted by user] ' || k
         WHEN et = 'view' THEN 'please look at item ' || k
         WHEN et = 'error' AND ok AND k % 5 = 0 THEN 'note' END AS ptext
  FROM e3 e LEFT JOIN rate r ON r.mdl = e.model AND r.is_fast = (e.speed IS NOT NULL)),
tool_call AS (
  SELECT key AS session_key, iso AS ts, ['Bash', 'Read', 'Edit', 'Grep', 'Write'][1 + CAST(k % 5 AS INT)] AS tool_name, 0 AS is_error
  FROM e4 WHERE et = 'click'
  UNION ALL SELECT key, iso, 'WebFetch', 0 FROM e4 WHERE et = 'purchase' AND k % 3 = 0
  UNION ALL SELECT key, iso, '(unnamed)', 0 FROM e4 WHERE et = 'purchase' AND k % 12 = 1
  UNION ALL SELECT key, iso, '(error-result)', 1 FROM e4 WHERE et = 'error' AND ok AND k % 2 = 1
  UNION ALL SELECT key, iso, '(error-result)', 1 FROM e4 WHERE et = 'error' AND ok AND k % 10 = 4),
turn AS (
  SELECT key AS session_key, row_number() OVER (PARTITION BY key ORDER BY event_id) AS ordinal, iso AS ts,
         model, effort, tier AS service_tier, speed, stop AS stop_reason, tin AS input_tokens, tout AS output_tokens,
         cw5 AS cache_write_5m, cw1h AS cache_write_1h, cread AS cache_read, think AS thinking_tokens,
         ws AS web_search_requests, wf AS web_fetch_requests,
         round((p_in + p_out + p_cw + p_cr) / 1e12, 8) AS cost_usd
  FROM e4 WHERE is_reply),
facet AS (
  SELECT key, kind, name, count(*) AS n, min(event_id) AS first_line FROM (
    SELECT key, event_id, 'model' AS kind, model AS name FROM e4
    UNION ALL SELECT key, event_id, 'version', '2.1.' || (k % 4) FROM e4 WHERE ok
    UNION ALL SELECT key, event_id, 'effort', effort FROM e4
    UNION ALL SELECT key, event_id, 'service_tier', tier FROM e4
    UNION ALL SELECT key, event_id, 'speed', speed FROM e4
    UNION ALL SELECT key, event_id, 'permission_mode', ['default', 'plan', NULL][1 + CAST(k % 3 AS INT)] FROM e4 WHERE et = 'view'
    UNION ALL SELECT key, event_id, 'prompt_source', 'typed' FROM e4 WHERE et = 'view' AND k % 2 = 0
    UNION ALL SELECT key, event_id, 'prompt_id', 'p' || (k % 20) FROM e4 WHERE et = 'view'
    UNION ALL SELECT key, event_id, 'etype', etype FROM e4
    UNION ALL SELECT key, event_id, 'refusal', 'policy' FROM e4 WHERE et = 'purchase' AND k % 25 = 7
    UNION ALL SELECT key, event_id, 'refusal', 'cyber' FROM e4 WHERE et = 'purchase' AND k % 30 = 2
    UNION ALL SELECT key, event_id, 'attr:skill', 'skill' || (k % 3) FROM e4 WHERE et = 'click' AND k % 4 = 0
    UNION ALL SELECT key, event_id, 'attr:mcp_server', 'mcp' || (k % 2) FROM e4 WHERE et = 'click' AND k % 5 = 1
    UNION ALL SELECT key, event_id, 'attr:agent', 'reviewer' FROM e4 WHERE et = 'purchase' AND k % 6 = 2
  ) WHERE name IS NOT NULL GROUP BY ALL),
attribution AS (SELECT key AS session_key, substr(kind, 6) AS kind, name, n AS count FROM facet WHERE starts_with(kind, 'attr:')),
fmap AS (
  SELECT key, kind, '{{' || string_agg('"' || name || '": ' || n, ', ' ORDER BY name) || '}}' AS js,
         count(*) AS cnt, arg_min(name, (-n, first_line)) AS top
  FROM facet GROUP BY key, kind),
gap AS (
  SELECT key, epoch_us(stamp) - lag(epoch_us(stamp)) OVER (PARTITION BY key ORDER BY stamp) AS g FROM e4 WHERE stamp IS NOT NULL),
eng AS (SELECT key, sum(CASE WHEN g <= {IDLE_GAP}000000 THEN g ELSE 0 END) AS us FROM gap GROUP BY key),
fold AS (
  SELECT key, count(*) AS line_count, count(*) FILTER (NOT ok) AS n_malformed_lines,
    max(u) AS u, bool_or(sub) AS sub, any_value(stem) AS stem, any_value(b) AS b, any_value(uuid) AS any_uuid,
    max(uuid) FILTER (ok) AS session_uuid, max(cwd) FILTER (ok) AS cwd,
    arg_min('br' || (k % 4), event_id) FILTER (ok AND k % 3 = 0) AS git_branch,
    arg_min('slug' || ' ' || k, event_id) FILTER (ok AND k % 7 = 1) AS slug_raw,
    arg_min('2.1.' || (k % 4), event_id) FILTER (ok) AS cc_version,
    arg_min(iso, event_id) FILTER (iso IS NOT NULL) AS first_ts, arg_max(iso, event_id) FILTER (iso IS NOT NULL) AS last_ts,
    arg_min(stamp, event_id) FILTER (stamp IS NOT NULL) AS first_at, arg_max(stamp, event_id) FILTER (stamp IS NOT NULL) AS last_at,
    arg_max('Title ' || k, event_id) FILTER (et = 'signup' AND k % 5 = 0) AS ai_title,
    arg_max('Named ' || k, event_id) FILTER (et = 'signup' AND k % 15 = 1) AS custom_title,
    arg_min(ptext, event_id) FILTER (is_prompt) AS first_prompt_preview,
    bool_or(ok AND et = 'error' AND k = 3) AS shut,
    count(*) FILTER (et = 'click' AND k % 20 = 9) AS n_api_errors,
    count(*) FILTER (et = 'signup' AND k % 5 = 2) AS n_attachments,
    count(*) FILTER (et = 'signup' AND k % 5 = 3) AS n_turn_duration_events,
    coalesce(sum(k * 100) FILTER (et = 'signup' AND k % 5 = 3), 0) AS active_ms,
    count(*) FILTER (is_prompt) AS n_user_prompts, count(*) FILTER (interrupted) AS n_interrupts,
    count(*) FILTER (is_reply) AS n_assistant_turns, count(*) FILTER (stop = 'refusal') AS n_refusals,
    count(*) FILTER (et = 'click') + count(*) FILTER (et = 'purchase' AND k % 3 = 0) + count(*) FILTER (et = 'purchase' AND k % 12 = 1) AS n_tool_uses,
    count(*) FILTER (et = 'error' AND ok) + count(*) FILTER (et = 'error' AND ok AND k % 10 = 4) AS n_tool_results,
    count(*) FILTER (is_reply AND k % 4 = 0) AS n_thinking_blocks,
    sum(tin) AS tok_input, sum(tout) AS tok_output, sum(cw5) AS cw5, sum(cw1h) AS cw1h, sum(decl) AS decl,
    sum(cread) AS tok_cache_read, sum(think) AS tok_thinking, sum(ws) AS ws, sum(wf) AS wf,
    sum(p_in) AS p_in, sum(p_out) AS p_out, sum(p_cw) AS p_cw, sum(p_cr) AS p_cr
  FROM e4 GROUP BY key),
session AS (
  SELECT f.key, session_uuid, CASE WHEN u % 2 = 0 THEN 'archive' ELSE 'live' END AS source_tree,
    CASE WHEN u % 2 = 0 THEN '/archive/label' || (u % 13) || '/20240101-000000+1100_' || any_uuid
           || CASE WHEN sub THEN '/subagents/agent-' ELSE '/' END || stem || '.jsonl'
         ELSE '/live/slug' || (u % 13) || CASE WHEN sub THEN '/' || any_uuid || '/subagents/agent-' ELSE '/' END
           || stem || '.jsonl' END AS source_path,
    CASE WHEN u % 2 = 0 THEN 'label' ELSE 'slug' END || (u % 13) AS container_name,
    CAST(line_count AS BIGINT) AS line_count, CASE WHEN sub THEN 1 ELSE 0 END AS is_subagent,
    CASE WHEN sub THEN any_uuid END AS parent_session_uuid,
    CASE WHEN sub THEN coalesce('ag' || CASE WHEN line_count > n_malformed_lines THEN u END, 'agent-' || stem) END AS agent_id,
    CAST(NULL AS VARCHAR) AS agent_name, cwd,
    CASE WHEN cwd IS NULL THEN NULL WHEN starts_with(cwd, '/srv') THEN 'lib' || (u % 3)
         WHEN u % 4 = 1 THEN 'app' || (u % 13) || '-.worktree-b' || (u % 3) ELSE 'app' || (u % 13) END AS project_label,
    CASE WHEN u % 4 = 1 THEN replace(cwd, '/.worktree/b' || (u % 3), '') ELSE cwd END AS repo_root,
    CASE WHEN cwd IS NOT NULL AND u % 4 = 1 THEN 1 ELSE 0 END AS is_worktree,
    CASE WHEN cwd IS NOT NULL AND u % 4 = 1 THEN 'b' || (u % 3) END AS worktree_name,
    git_branch, first_ts, last_ts,
    round(coalesce(epoch_us(last_at) - epoch_us(first_at), 0) / 1e6, 3) AS wall_seconds,
    round(active_ms / 1000.0, 3) AS active_seconds,
    round(coalesce(g.us, 0) / 1e6, 3) AS engaged_seconds,
    round(greatest(coalesce(epoch_us(last_at) - epoch_us(first_at), 0) - coalesce(g.us, 0), 0) / 1e6, 3) AS idle_seconds,
    strftime(first_at + INTERVAL 11 HOUR, '%Y-%m-%d') AS local_date,
    CAST(hour(first_at + INTERVAL 11 HOUR) AS INT) AS local_hour,
    CAST(isodow(first_at + INTERVAL 11 HOUR) - 1 AS INT) AS local_weekday,
    CASE WHEN first_at IS NOT NULL THEN '+1100' END AS tz_offset,
    n_user_prompts, coalesce(m8.cnt, 0) AS n_prompt_ids, n_assistant_turns, n_tool_uses, n_tool_results,
    n_thinking_blocks, n_attachments, n_turn_duration_events,
    CAST(tok_input AS BIGINT) AS tok_input, CAST(tok_output AS BIGINT) AS tok_output,
    CAST(cw5 AS BIGINT) AS tok_cache_write_5m, CAST(cw1h AS BIGINT) AS tok_cache_write_1h,
    CAST(cw5 + cw1h AS BIGINT) AS tok_cache_write, CAST(decl AS BIGINT) AS tok_cache_write_declared,
    CAST(tok_cache_read AS BIGINT) AS tok_cache_read, CAST(tok_thinking AS BIGINT) AS tok_thinking,
    CAST(tok_input + tok_output + cw5 + cw1h AS BIGINT) AS tok_billable_total,
    CAST(tok_input + tok_cache_read + cw5 + cw1h AS BIGINT) AS tok_context_total,
    round(p_in / 1e12, 8) AS cost_input_usd, round(p_out / 1e12, 8) AS cost_output_usd,
    round(p_cw / 1e12, 8) AS cost_cache_write_usd, round(p_cr / 1e12, 8) AS cost_cache_read_usd,
    round((p_in + p_out + p_cw + p_cr) / 1e12, 8) AS cost_usd,
    m0.top AS primary_model, coalesce(m0.js, '{{}}') AS models_json, coalesce(m1.js, '{{}}') AS cc_versions_json,
    coalesce(m2.js, '{{}}') AS effort_json, coalesce(m3.js, '{{}}') AS service_tiers_json,
    coalesce(m4.js, '{{}}') AS speeds_json, coalesce(m5.js, '{{}}') AS permission_modes_json,
    coalesce(m6.js, '{{}}') AS prompt_sources_json, coalesce(m7.js, '{{}}') AS entry_types_json,
    CASE WHEN line_count > n_malformed_lines THEN CASE WHEN u % 7 = 3 THEN 'sdk-py' ELSE 'cli' END END AS entrypoint,
    CASE WHEN line_count > n_malformed_lines THEN 'external' END AS user_type,
    CASE WHEN sub AND line_count > n_malformed_lines THEN 1 ELSE 0 END AS is_sidechain, cc_version,
    CASE WHEN n_assistant_turns > 0 THEN 1 ELSE 0 END AS is_real,
    CASE WHEN tok_input + tok_output + cw5 + cw1h + tok_cache_read > 0 THEN 1 ELSE 0 END AS has_usage,
    n_api_errors, n_interrupts, n_refusals, coalesce(m9.js, '{{}}') AS refusal_categories_json,
    CASE WHEN shut THEN 1 ELSE 0 END AS interrupted_by_shutdown, n_malformed_lines,
    CAST(ws AS BIGINT) AS web_search_requests, CAST(wf AS BIGINT) AS web_fetch_requests,
    ai_title, custom_title, slug_raw AS slug_title, first_prompt_preview
  FROM fold f LEFT JOIN eng g USING (key)
  LEFT JOIN fmap m0 ON m0.key = f.key AND m0.kind = 'model' LEFT JOIN fmap m1 ON m1.key = f.key AND m1.kind = 'version'
  LEFT JOIN fmap m2 ON m2.key = f.key AND m2.kind = 'effort' LEFT JOIN fmap m3 ON m3.key = f.key AND m3.kind = 'service_tier'
  LEFT JOIN fmap m4 ON m4.key = f.key AND m4.kind = 'speed' LEFT JOIN fmap m5 ON m5.key = f.key AND m5.kind = 'permission_mode'
  LEFT JOIN fmap m6 ON m6.key = f.key AND m6.kind = 'prompt_source' LEFT JOIN fmap m7 ON m7.key = f.key AND m7.kind = 'etype'
  LEFT JOIN fmap m8 ON m8.key = f.key AND m8.kind = 'prompt_id' LEFT JOIN fmap m9 ON m9.key = f.key AND m9.kind = 'refusal')
"""


def overlap_cte(where: str = "TRUE", name: str = "overlap_day") -> str:
    """Day overlap by island merging and an ordered event sweep, over sessions matching ``where``."""
    p = name
    return f"""
{p}_span AS (
  SELECT CAST(first_ts AS TIMESTAMP) + INTERVAL 11 HOUR AS a, CAST(last_ts AS TIMESTAMP) + INTERVAL 11 HOUR AS z
  FROM session WHERE is_real = 1 AND first_ts IS NOT NULL AND {where}),
{p}_cut AS (
  SELECT CAST(d AS DATE) AS d, greatest(a, d) AS lo, least(z, d + INTERVAL 1 DAY) AS hi, d = date_trunc('day', a) AS start
  FROM (SELECT a, z, unnest(generate_series(CAST(date_trunc('day', a) AS TIMESTAMP), CAST(date_trunc('day', z) AS TIMESTAMP), INTERVAL 1 DAY)) AS d
        FROM {p}_span WHERE z >= a)),
{p}_pc AS (SELECT d, epoch_us(lo) AS lo, epoch_us(hi) AS hi, start, row_number() OVER (ORDER BY d, lo, hi) AS rid FROM {p}_cut WHERE lo < hi OR start),
{p}_isl AS (
  SELECT d, lo, hi, sum(fresh) OVER (PARTITION BY d ORDER BY lo, hi, rid ROWS UNBOUNDED PRECEDING) AS grp FROM (
    SELECT d, lo, hi, rid, CASE WHEN lo <= max(hi) OVER (PARTITION BY d ORDER BY lo, hi, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                           THEN 0 ELSE 1 END AS fresh FROM {p}_pc)),
{p}_mrg AS (SELECT d, sum(len) AS merged FROM (SELECT d, grp, max(hi) - min(lo) AS len FROM {p}_isl GROUP BY d, grp) GROUP BY d),
{p}_pk AS (
  SELECT d, greatest(max(live), 0) AS peak FROM (
    SELECT d, sum(delta) OVER (PARTITION BY d ORDER BY t, delta ROWS UNBOUNDED PRECEDING) AS live
    FROM (SELECT d, lo AS t, 1 AS delta FROM {p}_pc UNION ALL SELECT d, hi, -1 FROM {p}_pc)) GROUP BY d),
{p} AS (
  SELECT strftime(s.d, '%Y-%m-%d') AS local_date, s.n AS sessions_active, s.st AS sessions_started,
         round(s.us / 3.6e9, 3) AS summed_hours, round(merged / 3.6e9, 3) AS elapsed_hours,
         round(s.us / nullif(CAST(merged AS DOUBLE), 0), 3) AS concurrency, CAST(peak AS BIGINT) AS max_concurrent
  FROM (SELECT d, count(*) AS n, count(*) FILTER (start) AS st, sum(hi - lo) AS us FROM {p}_pc GROUP BY d) s
  JOIN {p}_mrg USING (d) JOIN {p}_pk USING (d))
"""


def over_facts(select: str, extra: str = "", overlap: bool = False) -> str:
    parts = [FACTS_CTE.strip()]
    if overlap:
        parts.append(overlap_cte().strip())
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n" + select


def usd(c: str, digits: int = 2) -> str:
    return f"CAST(round(sum(CAST({c} AS DECIMAL(20,8))), {digits}) AS DOUBLE)"


def hours(c: str, digits: int = 2) -> str:
    return f"round(CAST(sum(CAST({c} AS DECIMAL(20,3))) AS DOUBLE) / 3600.0, {digits})"


def total(c: str) -> str:
    return f"CAST(sum({c}) AS BIGINT)"
