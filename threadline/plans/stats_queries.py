"""Queries over the statistics ETL, each with its SQL twin."""

from __future__ import annotations

import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.operators import cubes as C
from threadline.operators import facts as K
from threadline.operators import intervals as I
from threadline.operators import reports as R
from threadline.operators import selection as P
from threadline.operators import session as S
from threadline.operators.selection import Span
from threadline.plans import etl
from threadline.plans import standins as X
from threadline.plans.oracle_base import IDLE_GAP, hours, over_facts, overlap_cte, total, usd
from threadline.runtime import new_run_dir, prepare, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SPAN = Span("2024-01-05", "2024-01-24")
IN_SPAN = "local_date BETWEEN '2024-01-05' AND '2024-01-24'"
REAL = f"is_real = 1 AND {IN_SPAN}"
LABEL = "coalesce(project_label, '(unknown)')"
CHILD = f"session_key IN (SELECT key FROM session WHERE {REAL})"
INCLUDE, EXCLUDE, KEEP = ["app", "LIB"], ["app1-", "app3"], ["app1", "lib", "app12", "worktree", "zzz"]

_built: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _once(spark: SparkSession, key: tuple, make: Callable[[], object]):
    cache = _built.setdefault(spark, {})
    if key not in cache:
        cache[key] = make()
    return cache[key]


#: Every tenth transcript has grown since the earlier build, which saw half of its lines or none.
GREW = "part = 3"


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(lines, sizes) of the transcripts, laid down once and then read; a tenth of the files lies in each part.

    They stand for files: reading some parts opens no others, and ``sizes`` is
    what a listing tells without opening any, now and before a part grew.
    """
    prepare(spark)

    def lay_down() -> tuple[DataFrame, DataFrame]:
        part = F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(10)).cast("int")
        lines = stage(X.transcript_lines(spark, sf_dir).withColumn("part", part), f"{new_run_dir(spark, 'lines')}/jsonl", ["part"])
        size = F.octet_length("raw") + 1
        before = F.sum(F.when(F.expr(f"NOT ({GREW}) OR line_no % 2 = 0"), size))
        sizes = lines.groupBy("path", "part").agg(F.sum(size).alias("size_bytes"), before.alias("before"))
        return lines, stage(sizes, f"{new_run_dir(spark, 'lines')}/sizes")

    return _once(spark, ("lines", sf_dir), lay_down)


def facts_for(spark: SparkSession, sf_dir: str) -> etl.Facts:
    """The published facts of a data folder, built once per session and then only read."""
    lines, sizes = _files(spark, sf_dir)
    listing = sizes.select("path", "size_bytes", F.lit("2024-02-02").cast("timestamp").alias("modified"))
    return _once(spark, ("facts", sf_dir), lambda: etl.build_facts(spark, lines.drop("part"), listing, X.ZONE, idle_gap=IDLE_GAP))


def earlier_facts(spark: SparkSession, sf_dir: str) -> etl.Facts:
    """What a build found before a tenth of the files grew."""
    lines, sizes = _files(spark, sf_dir)
    before = lines.where(f"NOT ({GREW}) OR line_no % 2 = 0").drop("part")
    listing = sizes.where("before is not null").select("path", F.col("before").alias("size_bytes"), F.lit("2024-02-01").cast("timestamp").alias("modified"))
    return _once(spark, ("earlier", sf_dir), lambda: etl.build_facts(spark, before, listing, X.ZONE, idle_gap=IDLE_GAP))


def grown_facts(spark: SparkSession, sf_dir: str) -> etl.Facts:
    """An incremental build over the earlier one; only the files that grew are opened."""
    lines, sizes = _files(spark, sf_dir)
    modified = F.when(F.expr(GREW), "2024-02-02").otherwise("2024-02-01").cast("timestamp")
    listing = sizes.select("path", "size_bytes", modified.alias("modified"))
    return etl.build_facts(spark, lines.where(GREW).drop("part"), listing, X.ZONE, idle_gap=IDLE_GAP, previous=earlier_facts(spark, sf_dir))


def changed_facts(spark: SparkSession, sf_dir: str) -> etl.Facts:
    """The incremental build, done once per session."""
    return _once(spark, ("grown", sf_dir), lambda: grown_facts(spark, sf_dir))


def _add(name: str, run: Callable[[etl.Facts], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(facts_for(spark, sf_dir))
    if sql is not None:
        ORACLE[name] = sql


def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per session, what an incremental build knows of it in every fact table."""
    f = changed_facts(spark, sf_dir)
    per = lambda df, out: df.groupBy(F.col("session_key").alias("key")).agg(F.count(F.lit(1)).alias(out))
    rows = f.session.select("key", "line_count", "first_ts", "last_ts", "tok_billable_total", "cost_usd", "engaged_seconds", "primary_model", "models_json")
    for name, df in (("turns", f.turn), ("calls", f.tool_call), ("uses", f.attribution)):
        rows = rows.join(per(df, name), "key", "left").fillna(0, [name])
    return rows.join(f.entry.groupBy("key").agg(F.count(F.lit(1)).alias("entries")), "key")


QUERIES["s01_incremental_build"] = _incremental
ORACLE["s01_incremental_build"] = over_facts("""
SELECT key, line_count, first_ts, last_ts, tok_billable_total, cost_usd, engaged_seconds, primary_model, models_json,
  (SELECT count(*) FROM turn t WHERE t.session_key = s.key) AS turns, (SELECT count(*) FROM tool_call t WHERE t.session_key = s.key) AS calls,
  (SELECT count(*) FROM attribution t WHERE t.session_key = s.key) AS uses, line_count AS entries
FROM session s""")


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed entries straight from the lines that were laid down, with nothing staged in between."""
    lines, sizes = _files(spark, sf_dir)
    return etl.entries_of(lines.drop("part"), etl.keep_largest(etl.discover(sizes.select("path", "size_bytes"))))


def _s01(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _fresh(spark, sf_dir)
    return rows.groupBy(F.coalesce("etype", F.lit("(bad)")).alias("etype")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.count(F.when(F.col("is_bad"), 1)).alias("malformed"),
        F.count("ts").alias("stamped"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("thinking_tokens").alias("thinking_tokens"),
        F.sum("cache_write_1h").alias("cache_write_1h"),
    )


QUERIES["s01_entry_census"] = _s01
ORACLE["s01_entry_census"] = over_facts(f"""
SELECT coalesce(etype, '(bad)') AS etype, count(*) AS entries, count(*) FILTER (NOT ok) AS malformed, count(stamp) AS stamped,
       {total('tin')} AS input_tokens, {total('think')} AS thinking_tokens, {total('cw1h')} AS cache_write_1h
FROM e4 GROUP BY 1""")

_add("s03_s04_w01_discovery", lambda f: f.listing.groupBy("source_tree", "container_name", "is_subagent").agg(
        F.count(F.lit(1)).alias("files"), F.count("parent_session_uuid").alias("with_parent")),
     over_facts("""SELECT source_tree, container_name, is_subagent, count(*) AS files, count(parent_session_uuid) AS with_parent
FROM session GROUP BY ALL"""))

_SESSION_COLS = [c for c in S.SESSION_COLUMNS if c not in ("size_bytes",)]
_add("a01_p19_session_fold", lambda f: f.session.select(*_SESSION_COLS),
     over_facts(f"SELECT {', '.join(_SESSION_COLS)} FROM session"))
_add("w14_f10_turn", lambda f: f.turn, over_facts("SELECT * FROM turn"))
_add("f13_tool_call", lambda f: f.tool_call.groupBy("session_key", "tool_name").agg(
        F.count(F.lit(1)).alias("calls"), F.sum("is_error").alias("errors"), F.min("ts").alias("first_ts")),
     over_facts(f"SELECT session_key, tool_name, count(*) AS calls, {total('is_error')} AS errors, min(ts) AS first_ts FROM tool_call GROUP BY ALL"))
_add("a09_attribution", lambda f: f.attribution, over_facts("SELECT * FROM attribution"))


def _w03(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = X.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = S.engaged_seconds(rows, "user_id", "ts", IDLE_GAP)
    return out.select("user_id", F.round(F.col("engaged_micros") / 1e6, 3).alias("engaged_seconds"))


QUERIES["w03_engaged_seconds"] = _w03
ORACLE["w03_engaged_seconds"] = f"""
SELECT user_id, round(sum(CASE WHEN g <= {IDLE_GAP}000000 THEN g ELSE 0 END) / 1e6, 3) AS engaged_seconds
FROM (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM events)
GROUP BY user_id"""
_add("w04_overlap_day", lambda f: f.overlap_day, over_facts("SELECT * FROM overlap_day", overlap=True))

#: After a tenth of the files grew: only the days they touch are swept, from the stored edges.
QUERIES["w04_overlap_after_change"] = lambda s, d: changed_facts(s, d).overlap_day
ORACLE["w04_overlap_after_change"] = over_facts("SELECT * FROM overlap_day", overlap=True)

# ---- views ------------------------------------------------------------------
_add("a20_v_project", lambda f: R.view_project(f.session), over_facts(f"""
SELECT coalesce(repo_root, cwd, '(unknown)') AS repo_root, {LABEL} AS project_label, count(*) AS files_total,
  {total('is_real')} AS sessions_real, {total('is_subagent')} AS subagent_files, {total('is_worktree')} AS worktree_files,
  {hours('wall_seconds')} AS wall_hours, {hours('engaged_seconds')} AS engaged_hours, {hours('active_seconds')} AS active_hours,
  {total('tok_input')} AS tok_input, {total('tok_output')} AS tok_output, {total('tok_cache_write')} AS tok_cache_write,
  {total('tok_cache_read')} AS tok_cache_read, {total('tok_billable_total')} AS tok_billable_total, {usd('cost_usd')} AS cost_usd,
  min(first_ts) AS first_seen, max(last_ts) AS last_seen FROM session GROUP BY 1, 2"""))
_add("a21_v_daily", lambda f: R.view_daily(f.session), over_facts(f"""
SELECT local_date, count(*) AS files_total, {total('is_real')} AS sessions_real, count(DISTINCT repo_root) AS projects_touched,
  {hours('wall_seconds')} AS wall_hours, {hours('engaged_seconds')} AS engaged_hours, {hours('active_seconds')} AS active_hours,
  {total('n_user_prompts')} AS prompts, {total('n_tool_uses')} AS tool_calls,
  {total('tok_input + tok_output + tok_cache_write')} AS tok_billable, {total('tok_cache_read')} AS tok_cache_read, {usd('cost_usd')} AS cost_usd
FROM session WHERE local_date IS NOT NULL GROUP BY local_date"""))
_add("a22_v_hourly", lambda f: R.view_hourly(f.session), over_facts(f"""
SELECT local_weekday, local_hour, count(*) AS files_total, {total('is_real')} AS sessions_real,
  {hours('engaged_seconds')} AS engaged_hours, {usd('cost_usd')} AS cost_usd FROM session WHERE local_hour IS NOT NULL GROUP BY 1, 2"""))
_MODEL_SUMS = f"""count(*) AS turns, count(DISTINCT session_key) AS sessions, {total('input_tokens')} AS tok_input,
  {total('output_tokens')} AS tok_output, {total('thinking_tokens')} AS tok_thinking,
  {total('cache_write_5m + cache_write_1h')} AS tok_cache_write, {total('cache_read')} AS tok_cache_read, {usd('cost_usd')} AS cost_usd"""
_add("a23_v_model", lambda f: R.view_model(f.turn), over_facts(f"SELECT model, {_MODEL_SUMS} FROM turn GROUP BY model"))
_add("a24_v_tool", lambda f: R.view_tool(f.tool_call), over_facts(f"""
SELECT tool_name, count(*) AS calls, {total('is_error')} AS errors, count(DISTINCT session_key) AS sessions FROM tool_call GROUP BY 1"""))
_add("a25_v_attribution", lambda f: R.view_attribution(f.attribution), over_facts(f"""
SELECT kind, name, {total('count')} AS uses, count(DISTINCT session_key) AS sessions FROM attribution GROUP BY 1, 2"""))

# ---- report tables ----------------------------------------------------------


def _long(table: str, where: str, metrics: dict[str, str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({e} AS VARCHAR) AS value FROM {table} WHERE {where}" for m, e in metrics.items()
    )


_add("a26_overview", lambda f: R.overview(f.session, f.overlap_day, SPAN), over_facts(
    _long("session", REAL, {
        "Date range": "substr(min(first_ts), 1, 10) || ' to ' || substr(max(last_ts), 1, 10)",
        "Days with activity": "count(DISTINCT local_date)", "Real sessions": "count(*)",
        "Sub-agent sessions": "sum(is_subagent)", "Projects (repositories)": "count(DISTINCT repo_root)",
        "Worktree sessions": "count(*) FILTER (is_worktree = 1)", "Prompts": "sum(n_user_prompts)",
        "Assistant turns": "sum(n_assistant_turns)", "Tool calls": "sum(n_tool_uses)",
        "Engaged hours": hours("engaged_seconds", 1), "Turn-duration hours": hours("active_seconds", 1),
        "Input tokens": "sum(tok_input)", "Output tokens": "sum(tok_output)", "of which thinking": "sum(tok_thinking)",
        "Cache write tokens": "sum(tok_cache_write)", "Cache read tokens": "sum(tok_cache_read)",
        "Cost, API list price": "round(sum(CAST(cost_usd AS DECIMAL(20,8))), 2)",
    }) + "\nUNION ALL " + _long("session", "TRUE", {"Distinct transcripts": "count(*)", "Sub-agent transcripts": "sum(is_subagent)"})
    + "\nUNION ALL " + _long("overlap_day", IN_SPAN, {
        "Elapsed hours (real clock)": "round(sum(CAST(elapsed_hours AS DECIMAL(20,3))), 1)",
        "Summed hours": "round(sum(CAST(summed_hours AS DECIMAL(20,3))), 1)"}), overlap=True))
_add("a27_j03_daily", lambda f: R.daily(f.session, f.overlap_day, SPAN), over_facts(f"""
SELECT s.local_date AS date, count(*) AS sessions, count(DISTINCT repo_root) AS projects_touched,
  {hours('engaged_seconds')} AS engaged_hours, {hours('active_seconds')} AS active_hours,
  coalesce(any_value(o.elapsed_hours), 0) AS elapsed_hours, coalesce(any_value(o.summed_hours), 0) AS summed_hours,
  coalesce(any_value(o.max_concurrent), 0) AS max_concurrent, coalesce(any_value(o.concurrency), 0) AS concurrency,
  {total('n_user_prompts')} AS prompts, {total('n_tool_uses')} AS tool_calls, {total('tok_input')} AS tok_input,
  {total('tok_output')} AS tok_output, {total('tok_thinking')} AS tok_thinking, {total('tok_cache_write')} AS tok_cache_write,
  {total('tok_cache_read')} AS tok_cache_read, {total('tok_billable_total')} AS tok_billable, {usd('cost_usd')} AS cost_usd
FROM session s LEFT JOIN overlap_day o ON o.local_date = s.local_date
WHERE s.is_real = 1 AND s.{IN_SPAN} GROUP BY s.local_date""", overlap=True))
_WEEK = "strftime(CAST(local_date AS DATE), '%Y-W%W')"
_add("a28_weekly", lambda f: R.weekly(f.session), over_facts(f"""
SELECT {_WEEK} AS week, min(local_date) AS week_starting, count(*) AS sessions, count(DISTINCT repo_root) AS projects_touched,
  {hours('engaged_seconds')} AS engaged_hours, {hours('active_seconds')} AS active_hours, {total('n_user_prompts')} AS prompts,
  {total('n_tool_uses')} AS tool_calls, {total('tok_output')} AS tok_output, {total('tok_cache_read')} AS tok_cache_read,
  {total('tok_billable_total')} AS tok_billable, {usd('cost_usd')} AS cost_usd
FROM session WHERE is_real = 1 AND local_date IS NOT NULL GROUP BY 1"""))
_add("a29_monthly", lambda f: R.monthly(f.session), over_facts(f"""
SELECT substr(local_date, 1, 7) AS month,
  CASE WHEN substr(local_date, 1, 7) IN ((SELECT substr(min(local_date), 1, 7) FROM session WHERE is_real = 1),
       (SELECT substr(max(local_date), 1, 7) FROM session WHERE is_real = 1)) THEN 1 ELSE 0 END AS is_partial,
  CASE WHEN substr(local_date, 1, 7) >= (SELECT substr(min(local_date), 1, 7) FROM session WHERE is_real = 1 AND tok_thinking > 0) THEN 1 ELSE 0 END AS thinking_recorded,
  count(*) AS sessions, count(DISTINCT repo_root) AS projects_touched, count(DISTINCT local_date) AS active_days,
  {hours('engaged_seconds')} AS engaged_hours, {hours('active_seconds')} AS active_hours, {total('n_user_prompts')} AS prompts,
  {total('n_tool_uses')} AS tool_calls, {total('n_assistant_turns')} AS assistant_turns, {total('tok_input')} AS tok_input,
  {total('tok_output')} AS tok_output, {total('tok_thinking')} AS tok_thinking, {total('tok_cache_write')} AS tok_cache_write,
  {total('tok_cache_read')} AS tok_cache_read, {total('tok_billable_total')} AS tok_billable, {usd('cost_usd')} AS cost_usd
FROM session WHERE is_real = 1 AND local_date IS NOT NULL GROUP BY 1"""))
_add("a30_projects", lambda f: R.projects(f.session, SPAN), over_facts(f"""
SELECT {LABEL} AS project, count(*) AS sessions, {total('is_worktree')} AS is_worktree_sessions,
  count(DISTINCT local_date) AS active_days, {hours('engaged_seconds')} AS engaged_hours, {hours('active_seconds')} AS active_hours,
  round(CAST(sum(CAST(engaged_seconds AS DECIMAL(20,3))) AS DOUBLE) / count(*) / 60.0, 1) AS avg_session_minutes,
  {total('n_user_prompts')} AS prompts, {total('n_tool_uses')} AS tool_calls, {total('n_assistant_turns')} AS assistant_turns,
  {total('tok_input')} AS tok_input, {total('tok_output')} AS tok_output, {total('tok_cache_write')} AS tok_cache_write,
  {total('tok_cache_read')} AS tok_cache_read, {total('tok_billable_total')} AS tok_billable, {usd('cost_usd')} AS cost_usd,
  min(first_ts) AS first_seen, max(last_ts) AS last_seen FROM session WHERE {REAL} GROUP BY 1"""))
_TOP12 = f"""top12 AS (SELECT {LABEL} AS project, sum(CAST(cost_usd AS DECIMAL(20,8))) AS cost FROM session WHERE {REAL}
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12)"""
_add("o02_top_labels", lambda f: R.top_labels(f.session, SPAN),
     over_facts("SELECT project, CAST(round(cost, 2) AS DOUBLE) AS cost_usd FROM top12", _TOP12))
_add("a31_project_month", lambda f: R.project_month(f.session, SPAN), over_facts(f"""
SELECT substr(local_date, 1, 7) AS month, CASE WHEN {LABEL} IN (SELECT project FROM top12) THEN {LABEL} ELSE '(other)' END AS project,
  count(*) AS sessions, {hours('engaged_seconds')} AS engaged_hours, {total('tok_billable_total')} AS tok_billable, {usd('cost_usd')} AS cost_usd
FROM session WHERE {REAL} GROUP BY 1, 2""", _TOP12))
_DAYNAME = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][1 + local_weekday]"
_add("a32_hour_heatmap", lambda f: R.hour_heatmap(f.session, SPAN), over_facts(f"""
SELECT local_weekday AS weekday, {_DAYNAME} AS weekday_name, local_hour AS hour, count(*) AS sessions,
  {hours('engaged_seconds')} AS engaged_hours, {total('n_user_prompts')} AS prompts, {usd('cost_usd')} AS cost_usd
FROM session WHERE {REAL} GROUP BY 1, 2, 3"""))
_add("a33_by_weekday", lambda f: R.by_weekday(f.session), over_facts(f"""
SELECT local_weekday AS weekday, {_DAYNAME} AS weekday_name, count(*) AS sessions, count(DISTINCT local_date) AS active_days,
  {hours('engaged_seconds')} AS engaged_hours,
  round(CAST(sum(CAST(engaged_seconds AS DECIMAL(20,3))) AS DOUBLE) / 3600.0 / count(DISTINCT local_date), 2) AS engaged_hours_per_active_day,
  {total('n_user_prompts')} AS prompts, {usd('cost_usd')} AS cost_usd
FROM session WHERE is_real = 1 AND local_weekday IS NOT NULL GROUP BY 1, 2"""))
_add("a34_j02_models", lambda f: R.models(f.turn, f.session, SPAN), over_facts(f"""
SELECT model, {_MODEL_SUMS}, round(sum(output_tokens) / CAST(count(*) AS DOUBLE), 1) AS avg_out_per_turn,
  min(ts) AS first_used, max(ts) AS last_used FROM turn WHERE {CHILD} GROUP BY model"""))
_add("a35_model_month", lambda f: R.model_month(f.turn, f.session, SPAN), over_facts(f"""
SELECT substr(ts, 1, 7) AS month_utc, model, count(*) AS turns, {total('output_tokens')} AS tok_output,
  {total('cache_read')} AS tok_cache_read, {usd('cost_usd')} AS cost_usd
FROM turn WHERE ts IS NOT NULL AND {CHILD} GROUP BY 1, 2"""))
_add("a36_tools", lambda f: R.tools(f.tool_call, f.session, SPAN), over_facts(f"""
SELECT tool_name AS tool, count(*) AS calls, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct_of_calls,
  {total('is_error')} AS error_results, count(DISTINCT session_key) AS sessions FROM tool_call WHERE {CHILD} GROUP BY 1"""))
_add("a37_p05_skills_agents", lambda f: R.skills_agents(f.attribution, f.session, SPAN), over_facts(f"""
SELECT kind, name, {total('count')} AS uses, count(DISTINCT session_key) AS sessions FROM attribution WHERE {CHILD} GROUP BY 1, 2"""))
_add("a38_worktrees", lambda f: R.worktrees(f.session, SPAN), over_facts(f"""
SELECT coalesce(worktree_name, '(none)') AS worktree, {LABEL} AS project, count(*) AS sessions, {hours('engaged_seconds')} AS engaged_hours,
  {total('tok_billable_total')} AS tok_billable, {usd('cost_usd')} AS cost_usd, min(first_ts) AS first_seen, max(last_ts) AS last_seen
FROM session WHERE {REAL} AND is_worktree = 1 GROUP BY 1, 2"""))
_add("a39_p06_concurrency", lambda f: R.concurrency(f.overlap_day, SPAN), over_facts(f"""
SELECT local_date AS date, * EXCLUDE (local_date) FROM overlap_day WHERE {IN_SPAN}""", overlap=True))
_CASE = "CASE " + " ".join(f"WHEN engaged_seconds < {b} THEN {i + 1}" for i, (b, _) in enumerate(R.SIZE_BUCKETS[:-1])) + " ELSE 7 END"
_NAMES = "[" + ", ".join(f"'{n}'" for _, n in R.SIZE_BUCKETS) + "]"
_add("a40_session_sizes", lambda f: R.session_sizes(f.session), over_facts(f"""
SELECT {_CASE} AS sort, {_NAMES}[{_CASE}] AS bucket, count(*) AS sessions, {total('n_user_prompts')} AS prompts,
  {total('n_tool_uses')} AS tool_calls, {total('tok_billable_total')} AS tok_billable, {usd('cost_usd')} AS cost_usd
FROM session WHERE is_real = 1 GROUP BY 1, 2"""))
_add("a41_versions", lambda f: R.versions(f.session, SPAN), over_facts(f"""
SELECT cc_version AS version, count(*) AS sessions, min(local_date) AS first_day, max(local_date) AS last_day,
  {hours('engaged_seconds')} AS engaged_hours, {usd('cost_usd')} AS cost_usd, min(first_ts) AS first_seen
FROM session WHERE {REAL} AND cc_version IS NOT NULL GROUP BY 1"""))
_FULL = ["tok_input / tok_output / tok_cache_*", "cost_usd", "engaged_hours", "active_hours",
         "elapsed_hours / concurrency", "web_search / web_fetch counts"]
_add("a42_data_coverage", lambda f: R.data_coverage(f.session), over_facts(
    """SELECT 'tok_thinking' AS measure, min(local_date) FILTER (tok_thinking > 0) AS valid_from, substr(max(last_ts), 1, 10) AS valid_to
FROM session WHERE is_real = 1""" + "".join(
        f"\nUNION ALL SELECT '{m}', substr(min(first_ts), 1, 10), substr(max(last_ts), 1, 10) FROM session WHERE is_real = 1" for m in _FULL)
    + "\nUNION ALL SELECT 'last month (all columns)', substr(max(local_date), 1, 7) || '-01', max(local_date) FROM session WHERE is_real = 1"))


def _top_sql(k: int, by: str) -> str:
    return over_facts(f"""
SELECT key, {LABEL} AS project, local_date AS date, round(engaged_seconds / 60.0, 1) AS engaged_minutes,
  round(wall_seconds / 3600.0, 2) AS wall_hours, n_user_prompts AS prompts, n_tool_uses AS tool_calls,
  n_assistant_turns AS assistant_turns, tok_output, tok_cache_read, tok_billable_total AS tok_billable,
  CAST(round(CAST(cost_usd AS DECIMAL(20,8)), 2) AS DOUBLE) AS cost_usd, primary_model AS model,
  coalesce(custom_title, ai_title, slug_title, '') AS title
FROM session WHERE {REAL} ORDER BY {by} DESC, key LIMIT {k}""")


_add("o01_top_sessions", lambda f: R.top_sessions(f.session, SPAN), _top_sql(200, "session.cost_usd"))
_add("o03_longest_sessions", lambda f: R.top_sessions(f.session, SPAN, 25, "engaged_seconds"), _top_sql(25, "engaged_seconds"))
_add("a94_self_checks", lambda f: R.self_checks(f.session, f.turn, f.overlap_day), over_facts("""
SELECT 'cache_split_disagrees' AS check_name, CAST(count(*) FILTER (tok_cache_write <> tok_cache_write_declared) AS DOUBLE) AS value FROM session
UNION ALL SELECT 'real_turns_missing_usage', count(*) FILTER (has_usage = 0 AND n_assistant_turns > 0 AND models_json <> '{"<synthetic>": 1}') FROM session
UNION ALL SELECT 'synthetic_only_sessions', count(*) FILTER (models_json = '{"<synthetic>": 1}') FROM session
UNION ALL SELECT 'distinct_utc_offsets', count(DISTINCT coalesce(tz_offset, '')) FROM session
UNION ALL SELECT 'thinking_exceeds_output', count(*) FILTER (thinking_tokens > output_tokens) FROM turn
UNION ALL SELECT 'days_over_24h', count(*) FILTER (elapsed_hours > 24.001) FROM overlap_day
UNION ALL SELECT 'session_vs_turn_cost_delta', round((SELECT sum(CAST(cost_usd AS DECIMAL(20,8))) FROM session) - (SELECT sum(CAST(cost_usd AS DECIMAL(20,8))) FROM turn), 4)""", overlap=True))
_add("a95_unpriced_models", lambda f: R.unpriced_models(f.entry), over_facts(
    "SELECT model, count(*) AS turns FROM e4 WHERE unpriced GROUP BY 1"))
_add("p18_synthetic_only", lambda f: f.session.where(F.col("models_json") == '{"<synthetic>": 1}').select("key", "n_assistant_turns"),
     over_facts("""SELECT key, n_assistant_turns FROM session WHERE models_json = '{"<synthetic>": 1}'"""))

# ---- facts card -------------------------------------------------------------
_SCOPE = K.Scope(SPAN)


def _chosen(f: etl.Facts) -> K.Scope:
    return K.Scope(SPAN, P.selected_labels(f.session, INCLUDE, EXCLUDE))


_TICKED = """(project_label ILIKE '%app%' OR project_label ILIKE '%lib%')
  AND NOT (project_label ILIKE '%app1-%' OR project_label ILIKE '%app3%')"""
_CHOSEN = f"project_label IN (SELECT project_label FROM session WHERE is_real = 1 AND {_TICKED})"


def _core_sql(where: str) -> str:
    r = "FILTER (is_real = 1)"
    h = lambda c: f"round(coalesce(CAST(sum(CAST({c} AS DECIMAL(20,3))) {r} AS DOUBLE), 0) / 3600.0, 1)"
    t = lambda c: f"CAST(sum({c}) {r} AS BIGINT)"
    return f"""SELECT count(*) AS files_total, {total('is_real')} AS sessions_real, {total('is_subagent')} AS subagents,
  {t('is_subagent')} AS subagents_real, {t('n_user_prompts')} AS prompts, {t('n_tool_uses')} AS tool_calls, {t('n_assistant_turns')} AS turns,
  {h('engaged_seconds')} AS engaged_h, {h('active_seconds')} AS active_h, {h('wall_seconds')} AS wall_h,
  {t('tok_input')} AS tok_in, {t('tok_output')} AS tok_out, {t('tok_thinking')} AS tok_think, {t('tok_cache_write')} AS tok_cw,
  {t('tok_cache_read')} AS tok_cr, CAST(round(coalesce(sum(CAST(cost_usd AS DECIMAL(20,8))) {r}, 0), 2) AS DOUBLE) AS cost,
  count(DISTINCT repo_root) {r} AS repos, count(DISTINCT project_label) {r} AS labels, {t('is_worktree')} AS worktree_sessions,
  count(DISTINCT local_date) {r} AS active_days, substr(min(first_ts) {r}, 1, 10) AS span_lo, substr(max(last_ts) {r}, 1, 10) AS span_hi
FROM session WHERE {where}"""


_add("a50_core_counts", lambda f: K.core_counts(f.session, _SCOPE), over_facts(_core_sql(IN_SPAN)))
_add("a50_p09_core_counts_selected", lambda f: K.core_counts(f.session, _chosen(f)), over_facts(_core_sql(f"{IN_SPAN} AND {_CHOSEN}")))
_add("a56_ratios", lambda f: K.derived_ratios(K.core_counts(f.session, _SCOPE)), over_facts(f"""
SELECT round(100.0 * (files_total - sessions_real) / files_total, 1) AS shell_pct, round(CAST(files_total AS DOUBLE) / sessions_real, 1) AS inflate,
  CAST(round(CAST(tok_cr AS DOUBLE) / tok_out) AS BIGINT) AS cr_ratio FROM core""", f"core AS ({_core_sql(IN_SPAN)})"))


def _hours_sql(days: str) -> str:
    s = lambda c: f"CAST(sum(CAST({c} AS DECIMAL(20,3))) AS DOUBLE)"
    return f"""SELECT round({s('elapsed_hours')}, 1) AS elapsed_h, round({s('summed_hours')}, 1) AS summed_h,
  round({s('elapsed_hours')} / count(*), 1) AS mean_elapsed, round(max(elapsed_hours), 1) AS max_elapsed,
  count(*) FILTER (elapsed_hours > 24.001) AS days_over_24h FROM {days} WHERE {IN_SPAN}"""


_add("a51_hours_overlap", lambda f: K.hours_and_overlap(K.overlap_days(f.session, f.overlap_day, X.ZONE, _SCOPE)),
     over_facts(_hours_sql("overlap_day"), overlap=True))
_add("a57_overlap_selected", lambda f: K.overlap_days(f.session, f.overlap_day, X.ZONE, _chosen(f)),
     over_facts(f"SELECT * FROM sel WHERE {IN_SPAN}", overlap_cte(_CHOSEN, "sel")))
QUERIES["a57_overlap_after_change"] = lambda s, d: (lambda f: K.overlap_days(f.session, f.overlap_day, X.ZONE, _chosen(f), f.edges))(changed_facts(s, d))
ORACLE["a57_overlap_after_change"] = ORACLE["a57_overlap_selected"]
_add("a51_child_counts", lambda f: K.child_counts(f.turn, f.tool_call, f.session, _chosen(f)), over_facts(f"""
SELECT 'turn_rows' AS fact, count(*) AS value FROM turn WHERE session_key IN (SELECT key FROM session WHERE {REAL} AND {_CHOSEN})
UNION ALL SELECT 'tool_rows', count(*) FROM tool_call WHERE session_key IN (SELECT key FROM session WHERE {REAL} AND {_CHOSEN})"""))
_add("a52_month_boundaries", lambda f: K.month_boundaries(K.real_days(f.session)), over_facts("""
SELECT substr(min(local_date), 1, 7) AS first_month, min(local_date) AS first_day,
  count(DISTINCT local_date) FILTER (substr(local_date, 1, 7) = (SELECT substr(min(local_date), 1, 7) FROM session WHERE is_real = 1)) AS first_month_days,
  substr(max(local_date), 1, 7) AS last_month, max(local_date) AS last_day,
  count(DISTINCT local_date) FILTER (substr(local_date, 1, 7) = (SELECT substr(max(local_date), 1, 7) FROM session WHERE is_real = 1)) AS last_month_days,
  min(local_date) FILTER (tok_thinking > 0) AS thinking_from, '2.1.228' AS thinking_version
FROM session WHERE is_real = 1"""))
_add("a53_busiest_day", lambda f: K.busiest_day(K.real_days(f.session, _SCOPE), K.overlap_days(f.session, f.overlap_day, X.ZONE, _SCOPE)),
     over_facts(f"""
SELECT b.local_date AS busiest_day, b.n AS busiest_n, b.h AS busiest_engaged, o.elapsed_hours AS busiest_elapsed,
  p.max_concurrent AS peak_concurrent, p.local_date AS peak_concurrent_day
FROM (SELECT local_date, count(*) AS n, {hours('engaged_seconds', 1)} AS h FROM session WHERE {REAL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) b
LEFT JOIN overlap_day o ON o.local_date = b.local_date
CROSS JOIN (SELECT * FROM overlap_day WHERE {IN_SPAN} ORDER BY max_concurrent DESC, local_date LIMIT 1) p""", overlap=True))
_add("a54_label_spread", lambda f: K.label_spread(f.session, _SCOPE), over_facts(f"""
SELECT count(*) AS multi_label_repos, {total('n - 1')} AS extra_labels,
  (SELECT count(DISTINCT project_label) FROM session WHERE {REAL} AND is_worktree = 1) AS worktree_labels
FROM (SELECT count(DISTINCT project_label) AS n FROM session WHERE {REAL} GROUP BY repo_root HAVING count(DISTINCT project_label) > 1)"""))
_add("a55_offsets", lambda f: K.offsets(f.session, _SCOPE), over_facts(f"""
SELECT tz_offset, count(*) FILTER ({IN_SPAN}) AS sessions, count(*) FILTER (tz_offset = '+1100') AS dst_sessions_all
FROM session WHERE is_real = 1 AND tz_offset IS NOT NULL GROUP BY 1"""))


def _card(f: etl.Facts) -> DataFrame:
    """The card's text rows, numbers as numbers."""
    number = F.col("value").try_cast("double")
    rows = K.card(f.session, f.turn, f.tool_call, f.overlap_day, X.ZONE, _SCOPE).where("value is not null")
    return rows.select("fact", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))


_CARD_PARTS = {
    "core": _core_sql(IN_SPAN),
    "ratio": """SELECT round(100.0 * (files_total - sessions_real) / files_total, 1) AS shell_pct, round(CAST(files_total AS DOUBLE) / sessions_real, 1) AS inflate,
  CAST(round(CAST(tok_cr AS DOUBLE) / tok_out) AS BIGINT) AS cr_ratio FROM core""",
    "hour": _hours_sql("overlap_day"),
    "month": f"""SELECT substr(min(local_date), 1, 7) AS first_month, min(local_date) AS first_day,
  count(DISTINCT local_date) FILTER (substr(local_date, 1, 7) = (SELECT substr(min(local_date), 1, 7) FROM session WHERE {REAL})) AS first_month_days,
  substr(max(local_date), 1, 7) AS last_month, max(local_date) AS last_day,
  count(DISTINCT local_date) FILTER (substr(local_date, 1, 7) = (SELECT substr(max(local_date), 1, 7) FROM session WHERE {REAL})) AS last_month_days,
  min(local_date) FILTER (tok_thinking > 0) AS thinking_from, '2.1.228' AS thinking_version FROM session WHERE {REAL}""",
    "busy": f"""SELECT b.local_date AS busiest_day, b.n AS busiest_n, b.h AS busiest_engaged, o.elapsed_hours AS busiest_elapsed,
  p.max_concurrent AS peak_concurrent, p.local_date AS peak_concurrent_day
FROM (SELECT local_date, count(*) AS n, {hours('engaged_seconds', 1)} AS h FROM session WHERE {REAL} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) b
LEFT JOIN overlap_day o ON o.local_date = b.local_date
CROSS JOIN (SELECT * FROM overlap_day WHERE {IN_SPAN} ORDER BY max_concurrent DESC, local_date LIMIT 1) p""",
    "spread": f"""SELECT count(*) AS multi_label_repos, {total('n - 1')} AS extra_labels,
  (SELECT count(DISTINCT project_label) FROM session WHERE {REAL} AND is_worktree = 1) AS worktree_labels
FROM (SELECT count(DISTINCT project_label) AS n FROM session WHERE {REAL} GROUP BY repo_root HAVING count(DISTINCT project_label) > 1)""",
    "dst": f"""SELECT count(*) FILTER (tz_offset = '+1100' AND {IN_SPAN}) AS dst_sessions, count(*) FILTER (tz_offset = '+1100') AS dst_sessions_all
FROM session WHERE is_real = 1""",
    "child": f"""SELECT (SELECT count(*) FROM turn WHERE {CHILD}) AS turn_rows, (SELECT count(*) FROM tool_call WHERE {CHILD}) AS tool_rows""",
}
_add("a58_k05_card", _card, over_facts("""
SELECT fact, try_cast(value AS DOUBLE) AS number, CASE WHEN try_cast(value AS DOUBLE) IS NULL THEN value END AS text FROM (
""" + " UNION ALL ".join(f"SELECT fact, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM {n}) ON COLUMNS(*) INTO NAME fact VALUE value)" for n in _CARD_PARTS)
+ ")", ", ".join(f"{n} AS ({sql})" for n, sql in _CARD_PARTS.items()), overlap=True))

# ---- cubes and panels -------------------------------------------------------
_IDS = lambda c, order: f"""(SELECT v, row_number() OVER (ORDER BY o, v) - 1 AS id FROM (
  SELECT coalesce({c}, '') AS v, min({order}) AS o FROM session WHERE {REAL} GROUP BY 1))"""  # noqa: E731
_FS = "(local_date, local_hour, key)"
_add("a63_k03_cube_sessions", lambda f: C.cube_sessions(f.session, SPAN), over_facts(f"""
SELECT row_number() OVER (ORDER BY local_date, local_hour, key) - 1 AS row_id, local_date, local_hour, local_weekday,
  p.id AS project_id, r.id AS repo_id, is_worktree AS worktree, round(engaged_seconds, 1) AS engaged_sec, round(cost_usd, 4) AS cost,
  tok_input, tok_output, tok_cache_write, tok_cache_read, tok_thinking, v.id AS version_id, m.id AS model_id,
  round(wall_seconds, 1) AS wall_sec, round(active_seconds, 1) AS active_sec, n_user_prompts AS prompts, n_tool_uses AS tool_uses,
  n_assistant_turns AS turns, CASE WHEN is_subagent = 1 THEN 1 WHEN entrypoint = 'sdk-cli' THEN 2 ELSE 0 END AS kind
FROM session s JOIN {_IDS('project_label', _FS)} p ON p.v = coalesce(s.project_label, '')
JOIN {_IDS('repo_root', _FS)} r ON r.v = coalesce(s.repo_root, '')
JOIN {_IDS('cc_version', _FS)} v ON v.v = coalesce(s.cc_version, '')
JOIN {_IDS('primary_model', _FS)} m ON m.v = coalesce(s.primary_model, '') WHERE {REAL}"""))
_add("a60_cube_models", lambda f: C.cube_models(f.turn, f.session, SPAN), over_facts(f"""
SELECT session_key, model, {usd('cost_usd', 4)} AS cost, {total('input_tokens')} AS tok_input, {total('output_tokens')} AS tok_output,
  {total('cache_write_5m + cache_write_1h')} AS tok_cache_write, {total('cache_read')} AS tok_cache_read, {total('thinking_tokens')} AS tok_thinking
FROM turn WHERE model IS NOT NULL AND {CHILD} GROUP BY 1, 2"""))
_add("a61_cube_tools", lambda f: C.cube_tools(f.tool_call, f.session, SPAN), over_facts(f"""
SELECT session_key, tool_name, count(*) AS count, {total('is_error')} AS errors FROM tool_call WHERE {CHILD} GROUP BY 1, 2"""))
_add("a62_cube_attribution", lambda f: C.cube_attribution(f.attribution, f.session, SPAN), over_facts(f"""
SELECT *, list_position(['agent', 'mcp_server', 'mcp_tool', 'plugin', 'skill'], kind) - 1 AS kind_id FROM attribution WHERE {CHILD}"""))
_add("a64_calendar", lambda f: C.wall_days(f.session, SPAN), over_facts(f"""
SELECT strftime(d, '%Y-%m-%d') AS local_date, CAST(row_number() OVER (ORDER BY d) - 1 AS BIGINT) AS day_id
FROM (SELECT unnest(generate_series(min(CAST(local_date AS DATE)), max(CAST(local_date AS DATE)), INTERVAL 1 DAY)) AS d FROM session WHERE {REAL})"""))
_WO = "(local_date, first_ts, key)"
_add("k04_wall_sessions", lambda f: C.wall_sessions(f.session, SPAN), over_facts(f"""
SELECT key, datediff('day', (SELECT min(CAST(local_date AS DATE)) FROM session WHERE {REAL}), CAST(local_date AS DATE)) AS day_id,
  CAST(hour(t) * 3600 + minute(t) * 60 + second(t) AS INT) AS start_sec,
  CAST(round_even((epoch_us(CAST(last_ts AS TIMESTAMP)) - epoch_us(CAST(first_ts AS TIMESTAMP))) / 1e6, 0) AS BIGINT) AS dur_sec,
  round(engaged_seconds, 1) AS engaged_sec, p.id AS project_id,
  CASE WHEN is_subagent = 1 THEN 1 WHEN entrypoint = 'sdk-cli' THEN 2 ELSE 0 END AS kind, m.id AS model_id,
  CAST(round(CAST(cost_usd AS DECIMAL(20,8)) * 1000, 0) AS BIGINT) AS cost_milli
FROM (SELECT *, CAST(first_ts AS TIMESTAMP) + INTERVAL 11 HOUR AS t FROM session WHERE {REAL}) s
JOIN {_IDS('project_label', _WO)} p ON p.v = coalesce(s.project_label, '')
JOIN {_IDS('primary_model', _WO)} m ON m.v = coalesce(s.primary_model, '')"""))
_add("j13_parent_edges", lambda f: C.parent_edges(f.session), over_facts("""
SELECT c.key AS child_key, p.key AS parent_key FROM session c
JOIN (SELECT session_uuid, arg_min(key, (local_date, first_ts, key)) AS key FROM session WHERE is_real = 1 AND is_subagent = 0 AND session_uuid IS NOT NULL GROUP BY 1) p
  ON p.session_uuid = c.parent_session_uuid WHERE c.is_real = 1 AND c.is_subagent = 1"""))
_add("w05_day_segments", lambda f: I.day_segments(
        f.session.where("is_real = 1").select("key", I.times.parse_instant(F.col("first_ts")).alias("begin"),
                                               I.times.parse_instant(F.col("last_ts")).alias("end")), X.ZONE, ["key"])
        .select("key", "local_date", F.round("start_second", 3).alias("start_second"), F.round("end_second", 3).alias("end_second")),
     over_facts("""
SELECT key, strftime(d, '%Y-%m-%d') AS local_date, round((epoch_us(greatest(a, d)) - epoch_us(d)) / 1e6, 3) AS start_second,
  round((epoch_us(least(z, d + INTERVAL 1 DAY)) - epoch_us(d)) / 1e6, 3) AS end_second
FROM (SELECT key, a, z, unnest(generate_series(CAST(date_trunc('day', a) AS TIMESTAMP), CAST(date_trunc('day', z) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM (
  SELECT key, CAST(first_ts AS TIMESTAMP) + INTERVAL 11 HOUR AS a, CAST(last_ts AS TIMESTAMP) + INTERVAL 11 HOUR AS z FROM session WHERE is_real = 1 AND first_ts IS NOT NULL))
WHERE greatest(a, d) < least(z, d + INTERVAL 1 DAY) OR d = date_trunc('day', a)"""))
_FAMILY = "coalesce(nullif(regexp_extract(lower(model), '(opus|sonnet|haiku|fable)', 1), ''), model)"
_add("a65_model_families", lambda f: C.model_families(f.turn, f.session, SPAN), over_facts(f"""
SELECT {_FAMILY} AS family, count(*) AS turns, {total('output_tokens')} AS tok_output, {usd('cost_usd')} AS cost_usd
FROM turn WHERE model IS NOT NULL AND model <> '<synthetic>' AND {CHILD} GROUP BY 1"""))
_add("a66_folded_projects", lambda f: C.folded_projects(f.session, SPAN), over_facts(f"""
SELECT split_part({LABEL}, '-.worktree-', 1) AS project, count(*) AS sessions, {hours('engaged_seconds')} AS engaged_hours, {usd('cost_usd')} AS cost_usd
FROM session WHERE {REAL} GROUP BY 1"""))
_add("a67_weekly_concurrency", lambda f: C.weekly_concurrency(f.overlap_day), over_facts(f"""
SELECT week, summed_hours, elapsed_hours, max_concurrent, round(summed_hours / elapsed_hours, 2) AS concurrency FROM (
  SELECT {_WEEK} AS week, CAST(sum(CAST(summed_hours AS DECIMAL(20,3))) AS DOUBLE) AS summed_hours,
    CAST(sum(CAST(elapsed_hours AS DECIMAL(20,3))) AS DOUBLE) AS elapsed_hours, max(max_concurrent) AS max_concurrent FROM overlap_day GROUP BY 1)""", overlap=True))
_add("a68_session_length", lambda f: C.session_length(f.session), over_facts("""
SELECT count(*) AS sessions, round(quantile_cont(engaged_seconds, 0.5), 2) AS median_seconds,
  round(CAST(sum(CAST(engaged_seconds AS DECIMAL(20,3))) AS DOUBLE) / count(*), 2) AS mean_seconds FROM session WHERE is_real = 1 AND is_subagent = 0"""))
_add("a69_missing_days", lambda f: C.missing_days(f.session, by="project_label"), over_facts("""
SELECT project_label, strftime(d, '%Y-%m-%d') AS local_date FROM (
  SELECT project_label, unnest(generate_series(min(CAST(local_date AS DATE)), max(CAST(local_date AS DATE)), INTERVAL 1 DAY)) AS d
  FROM session WHERE is_real = 1 AND project_label IS NOT NULL AND local_date IS NOT NULL GROUP BY 1) x
WHERE NOT EXISTS (SELECT 1 FROM session s WHERE is_real = 1 AND s.project_label = x.project_label AND s.local_date = strftime(x.d, '%Y-%m-%d'))"""))
_add("a70_engaged_by_day", lambda f: C.engaged_by_day(f.session, SPAN), over_facts(f"""
SELECT local_date, count(*) AS sessions, {hours('engaged_seconds')} AS engaged_hours FROM session WHERE {REAL} AND is_subagent = 0 GROUP BY 1"""))
_add("p11_population", lambda f: C.population(f.session, SPAN), over_facts(f"""
SELECT {usd('cost_usd')} AS cost_usd, {total('n_tool_uses')} AS tool_calls, count(*) FILTER (is_subagent = 0) AS sessions,
  round(CAST(sum(CAST(engaged_seconds AS DECIMAL(20,3))) FILTER (is_subagent = 0) AS DOUBLE) / 3600.0, 2) AS engaged_hours FROM session WHERE {REAL}"""))
_add("a71_p10_kind_counts", lambda f: C.kind_counts(f.session, SPAN), over_facts(f"""
SELECT CASE WHEN is_subagent = 1 THEN 'subagent' WHEN entrypoint = 'sdk-cli' THEN 'automated' ELSE 'mine' END AS kind, count(*) AS sessions
FROM session WHERE {REAL} GROUP BY 1"""))
_add("o04_top_per_kind", lambda f: C.top_per_kind(f.attribution, f.session, SPAN, 2), over_facts(f"""
SELECT * FROM (SELECT kind, name, uses, CAST(row_number() OVER (PARTITION BY kind ORDER BY uses DESC, name) AS INT) AS rank
FROM (SELECT kind, name, {total('count')} AS uses FROM attribution WHERE {CHILD} GROUP BY 1, 2)) WHERE rank <= 2"""))
_add("o09_recent_projects", lambda f: C.recent_projects(f.session), over_facts(f"""
SELECT {LABEL} AS project, max(local_date) AS last_day, count(*) AS sessions FROM session WHERE is_real = 1 GROUP BY 1"""))

# ---- selection and review ---------------------------------------------------
_add("p01_p02_window", lambda f: P.real_sessions(f.session, SPAN).select("key", "local_date"), over_facts(f"SELECT key, local_date FROM session WHERE {REAL}"))
_add("p03_instant_window", lambda f: f.session.where(
        P.in_instants(I.times.parse_instant(F.col("first_ts")), "2024-01-05", "2024-01-09T12:00:00+02:00", X.ZONE)).select("key", "first_ts"),
     over_facts("""SELECT key, first_ts FROM session WHERE first_ts IS NOT NULL AND CAST(first_ts AS TIMESTAMP) >= TIMESTAMP '2024-01-04 13:00:00'
  AND CAST(first_ts AS TIMESTAMP) <= TIMESTAMP '2024-01-09 10:00:00'"""))
_add("p08_ticked_projects", lambda f: P.ticked_projects(P.project_labels(f.session), INCLUDE, EXCLUDE), over_facts(f"""
SELECT DISTINCT project_label, {_TICKED} AS ticked FROM session WHERE is_real = 1 AND project_label IS NOT NULL"""))
_add("u02_selected_labels", lambda f: P.selected_labels(f.session, INCLUDE, EXCLUDE), over_facts(f"""
SELECT DISTINCT project_label FROM session WHERE is_real = 1 AND project_label IS NOT NULL AND {_TICKED}"""))
_HELD = "list_filter([" + ", ".join(f"'{p}'" for p in KEEP) + "], lambda p: contains(lower(project_label), p))"
_REVIEW = f"""rv AS (SELECT project_label, in_window, all_time, CASE WHEN NOT ({_TICKED}) THEN 'skipped' WHEN len({_HELD}) > 0 THEN 'reviewed' ELSE 'unreviewed' END AS bucket,
  CASE WHEN {_TICKED} THEN {_HELD} WHEN len(barred) > 0 THEN barred ELSE ['not in the include allowlist'] END AS why
FROM (SELECT project_label, count(*) FILTER ({IN_SPAN}) AS in_window, count(*) AS all_time,
        list_filter(['app1-', 'app3'], lambda p: contains(lower(project_label), p)) AS barred
      FROM session WHERE is_real = 1 AND project_label IS NOT NULL GROUP BY 1))"""


def _rv(f: etl.Facts) -> DataFrame:
    return P.review(f.session, KEEP, INCLUDE, EXCLUDE, SPAN)


_add("a80_p07_review", lambda f: _rv(f).withColumn("why", F.array_join("why", "|")),
     over_facts("SELECT project_label, in_window, all_time, bucket, array_to_string(why, '|') AS why FROM rv", _REVIEW))
_add("a81_pattern_ownership", lambda f: P.pattern_ownership(_rv(f).where("bucket = 'reviewed'"), KEEP), over_facts(f"""
SELECT p.pattern, CAST(coalesce(sum(in_window), 0) AS BIGINT) AS in_window, CAST(coalesce(sum(all_time), 0) AS BIGINT) AS all_time,
  count(project_label) AS projects, count(*) FILTER (len(why) = 1) AS only
FROM (SELECT unnest([{', '.join(f"'{p}'" for p in KEEP)}]) AS pattern) p
LEFT JOIN rv ON bucket = 'reviewed' AND list_contains(why, p.pattern) GROUP BY 1""", _REVIEW))
_add("a82_dead_patterns", lambda f: P.dead_patterns(P.project_labels(f.session), KEEP + EXCLUDE), over_facts(f"""
SELECT pattern FROM (SELECT unnest([{', '.join(f"'{p}'" for p in KEEP + EXCLUDE)}]) AS pattern) p
WHERE NOT EXISTS (SELECT 1 FROM session WHERE is_real = 1 AND contains(lower(project_label), p.pattern))"""))
_add("a83_redundancy", lambda f: P.redundancy(_rv(f).where("bucket = 'reviewed'"), KEEP), over_facts("""
SELECT z.pattern, CASE WHEN g.g IS NULL THEN 'alone' ELSE 'group' END AS verdict, array_to_string(g.g, ',') AS keep_one_of
FROM z LEFT JOIN minimal g ON list_contains(g.g, z.pattern)""", _REVIEW + """,
sets AS (SELECT DISTINCT list_sort(why) AS m FROM rv WHERE bucket = 'reviewed'),
z AS (SELECT pattern FROM (SELECT unnest(m) AS pattern, len(m) = 1 AS sole FROM sets) GROUP BY 1 HAVING NOT bool_or(sole)),
grp AS (SELECT m AS g FROM sets WHERE list_has_all((SELECT list(pattern) FROM z), m)),
minimal AS (SELECT g FROM grp a WHERE NOT EXISTS (SELECT 1 FROM grp b WHERE len(b.g) < len(a.g) AND list_has_all(a.g, b.g)))"""))
_add("a84_u04_unacknowledged", lambda f: P.unacknowledged(
        P.project_labels(f.session), "project_label",
        f.session.where("is_worktree = 1").select(F.col("project_label").alias("item"))
        .union(f.session.where("project_label like 'lib%'").select("project_label"))),
     over_facts("""SELECT DISTINCT project_label FROM session WHERE is_real = 1 AND project_label IS NOT NULL AND project_label NOT IN (
  SELECT project_label FROM session WHERE project_label IS NOT NULL AND (is_worktree = 1 OR project_label LIKE 'lib%'))"""))
