"""Sources, scalar functions, sinks and streams, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline import sinks
from threadline.functions import pricing, times
from threadline.operators import catalog as C
from threadline.operators import conversation as T
from threadline.operators import cubes as D
from threadline.operators import facts as K
from threadline.operators import intervals as I
from threadline.operators import redact as R
from threadline.operators import selection as P
from threadline.plans import standins as X
from threadline.plans import standins_catalog as Z
from threadline.plans import stats_queries as Q
from threadline.plans.catalog_queries import _LOG

from threadline.plans.oracle_base import FACTS_CTE, IDLE_GAP, over_facts
from threadline.plans.talk_queries import _TALK, talk_for
from threadline.runtime import new_run_dir, prepare, stage
from threadline.sources import logs as L
from threadline.sources import transcripts as S
from threadline.streaming import jobs as J

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(prepare(spark), sf_dir)
    if sql is not None:
        ORACLE[name] = sql


_EV = """ev AS (SELECT event_id AS n, event_type AS et, user_id AS u, ts, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)"""

# ---- sources -------------------------------------------------------------------


def _loglines(s: SparkSession, d: str) -> DataFrame:
    """A document per conversation row: an array of entries, a bad array, or plain JSON."""
    rows = X.table(s, d, "conversations")
    entry = lambda kind: F.struct(F.lit(kind).alias("type"), F.col("text").alias("body"))
    good = F.to_json(F.struct(F.array(entry("user"), entry("assistant")).alias("loglines"), F.lit(1).alias("v")))
    mixed = F.lit('{"loglines": [{"type": "user"}, 7, "x"]}')
    bad = F.lit('{"loglines": "none"}')
    plain = F.lit('{"type": "user"}')
    pick = (F.col("conv_id") + F.col("turn")) % 5
    raw = F.when(pick == 0, bad).when(pick == 1, mixed).when(pick == 2, plain).otherwise(F.concat(F.lit("﻿"), good))
    return rows.select(F.concat_ws("/", F.lit("/doc"), "conv_id", "turn").alias("path"), raw.alias("raw"))


def _s02(s: SparkSession, d: str) -> DataFrame:
    rows = S.explode_loglines(_loglines(s, d))
    kind = F.try_variant_get("v", "$.type", "string")
    return rows.groupBy(F.coalesce(kind, F.lit("(bad)")).alias("type")).agg(F.count(F.lit(1)).alias("entries"), F.countDistinct("path").alias("documents"))


_add("s02_loglines", _s02, """WITH p AS (SELECT (conv_id + turn) % 5 AS p FROM conversations)
SELECT 'user' AS type, count(*) AS entries, count(*) AS documents FROM p WHERE p IN (1, 3, 4)
UNION ALL SELECT 'assistant', count(*), count(*) FROM p WHERE p IN (3, 4)
UNION ALL SELECT '(bad)', sum(CASE p WHEN 0 THEN 1 ELSE 2 END)::BIGINT, count(*) FROM p WHERE p IN (0, 1)""")


def _tree(s: SparkSession, d: str) -> DataFrame:
    k, e = F.col("k"), F.col("event_id")
    path = (
        F.when(k % 6 == 0, F.concat(F.lit("/x/node_modules/a"), e, F.lit(".jsonl")))
        .when(k % 6 == 1, F.concat(F.lit("/x/p/memory/m"), e, F.lit(".jsonl")))
        .when(k % 6 == 2, F.concat(F.lit("/x/p/s/subagents/agent-"), e, F.lit(".jsonl")))
        .when(k % 6 == 3, F.concat(F.lit("/x/p/agent-"), e, F.lit(".jsonl")))
        .when(k % 6 == 4, F.concat(F.lit("/x/p/"), e, F.lit(".txt")))
        .otherwise(F.concat(F.lit("/x/p/"), e, F.lit(".jsonl")))
    )
    return X.shaped_events(s, d).select(path.alias("path"), k.alias("size_bytes"), F.when(F.col("u") % 2 == 0, "archive").otherwise("live").alias("source_tree"))


_PATH = """tree AS (SELECT n, k, u, CASE k % 6 WHEN 0 THEN '/x/node_modules/a' || n || '.jsonl' WHEN 1 THEN '/x/p/memory/m' || n || '.jsonl' WHEN 2 THEN '/x/p/s/subagents/agent-' || n || '.jsonl'
  WHEN 3 THEN '/x/p/agent-' || n || '.jsonl' WHEN 4 THEN '/x/p/' || n || '.txt' ELSE '/x/p/' || n || '.jsonl' END AS path FROM ev)"""
_add("s05_prune_tree", lambda s, d: S.prune_tree(_tree(s, d), ["node_modules", ".git"], "/x").select("path"), f"WITH {_EV}, {_PATH} SELECT path FROM tree WHERE k % 6 IN (2, 3, 5)")
_add("s06_o08_bounded_listing", lambda s, d: S.split_sessions(S.prune_tree(_tree(s, d), [], "/x"), 100).select("path", "is_subagent"), f"""WITH {_EV}, {_PATH}
SELECT path, CAST(k % 6 IN (2, 3) AS INT) AS is_subagent FROM tree WHERE k % 6 NOT IN (1, 4) ORDER BY path LIMIT 100""")
_add("s16_sample_paths", lambda s, d: S.sample_paths(_tree(s, d), 100, 20260821).select("path", "source_tree"), f"""WITH {_EV}, {_PATH}
SELECT path, CASE WHEN u % 2 = 0 THEN 'archive' ELSE 'live' END AS source_tree FROM tree QUALIFY row_number() OVER (PARTITION BY u % 2 ORDER BY sha256('20260821:' || path)) <= 100""")


def _objects(s: SparkSession, d: str) -> DataFrame:
    i, h = F.col("doc_id"), F.sha2("text", 256)
    folder = F.when(i % 11 == 3, F.lit("zz")).otherwise(F.substring(h, 1, 2))
    name = F.when(i % 13 == 4, F.lit("readme")).otherwise(h)
    text = F.when(i % 17 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return X.table(s, d, "documents").select(F.concat(F.lit("/objects/"), folder, F.lit("/"), name, F.lit(".jsonl")).alias("path"), text.cast("binary").alias("content"))


_add("s12_stored_objects", lambda s, d: L.stored_objects(_objects(s, d)), """
SELECT sha256(text) AS address, sha256(CASE WHEN doc_id % 17 = 5 THEN text || '!' ELSE text END) AS actual FROM documents WHERE doc_id % 11 <> 3 AND doc_id % 13 <> 4""")


def _project_docs(s: SparkSession, d: str) -> DataFrame:
    u = F.col("n_nationkey")
    body = F.to_json(F.struct(F.col("n_name").alias("label"), F.array(F.struct(F.concat(F.lit("/home/"), "n_name").alias("path")), F.struct(F.lit("/srv").alias("path"))).alias("aliases")))
    raw = F.when(u % 5 == 4, F.lit("{cut")).otherwise(body)
    return X.table(s, d, "nation").select(F.concat(F.lit("/arch/"), "n_name", F.lit("/project.json")).alias("path"), raw.alias("raw"))


_add("s14_project_sidecars", lambda s, d: L.project_sidecars(_project_docs(s, d)), """
SELECT '/arch/' || n_name AS folder, n_name AS label, unnest(['/home/' || n_name, '/srv']) AS alias FROM nation WHERE n_nationkey % 5 <> 4""")


def _split_history(s: SparkSession, d: str) -> DataFrame:
    root = new_run_dir(s, "history")
    lines = Z.history_lines(s, d)
    sinks.split_history(L.history_rows(lines), root)
    # Each line of the split against the line of the history it came from, byte for byte.
    before = lines.select("line_no", F.sha2("raw", 256).alias("_before"))
    split = s.read.parquet(root).select("session_uuid", "line_no", F.sha2("raw", 256).alias("raw_sha256"))
    return split.join(before, "line_no").select("session_uuid", "line_no", (F.col("raw_sha256") == F.col("_before")).alias("intact"))


_add("k11_split_history", _split_history, f"WITH {_LOG} SELECT session_uuid, n AS line_no, true AS intact FROM hist")

# ---- longest prefix --------------------------------------------------------------


def _prefix(s: SparkSession, d: str) -> DataFrame:
    part = X.table(s, d, "part")
    prices = part.where("length(p_brand) = 7 or p_brand like 'Brand#2%'").select(
        F.col("p_brand").alias("prefix"), F.substring("p_brand", 7, 2).cast("bigint").alias("rate")
    ).distinct()
    out = pricing.longest_prefix(part.select("p_partkey", "p_brand"), "p_brand", prices, "prefix", ["rate"])
    return out.select("p_partkey", "p_brand", "matched_prefix", "rate")


_add("j01_longest_prefix", _prefix, """WITH pr AS (SELECT DISTINCT p_brand AS prefix, CAST(substr(p_brand, 7, 2) AS BIGINT) AS rate FROM part WHERE length(p_brand) = 7 OR p_brand LIKE 'Brand#2%')
SELECT p_partkey, p_brand, prefix AS matched_prefix, rate FROM part LEFT JOIN pr ON starts_with(p_brand, prefix)
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) = 1""")

# ---- scalar functions --------------------------------------------------------------
_add("f01_f02_times", lambda s, d: X.shaped_events(s, d).select(
        "event_id", F.unix_micros(times.parse_instant(_spelling())).alias("us"), times.local_date_text(F.col("ts"), X.ZONE).alias("day"),
        times.offset_text(F.col("ts"), X.ZONE).alias("off"), times.offset_text_to_minutes(_offset()).alias("minutes")), f"""WITH {_EV}
SELECT n AS event_id, CASE k % 5 WHEN 4 THEN NULL WHEN 3 THEN epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) WHEN 2 THEN epoch_us(date_trunc('second', ts)) - 19800000000 ELSE epoch_us(ts) END AS us,
  strftime(ts + INTERVAL 11 HOUR, '%Y-%m-%d') AS day, '+1100' AS off, CASE k % 3 WHEN 0 THEN 600 WHEN 1 THEN -330 ELSE 0 END AS minutes FROM ev""")


def _spelling() -> Column:
    """One instant written in the ways transcripts do: zoned, naive, offset, bare date, broken."""
    k, ts = F.col("k"), F.col("ts")
    return (
        F.when(k % 5 == 0, F.col("iso")).when(k % 5 == 1, F.regexp_replace("iso", "Z$", ""))
        .when(k % 5 == 2, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0530")))
        .when(k % 5 == 3, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.lit("2024-13-99T00:00:00Z"))
    )


def _offset() -> Column:
    k = F.col("k")
    return F.when(k % 3 == 0, F.lit("+1000")).when(k % 3 == 1, F.lit("-0530")).otherwise(F.lit("1x00"))


_add("f05_folder_names", lambda s, d: _folder_names(s, d), f"""WITH {_EV}
SELECT n AS event_id, CASE WHEN k % 9 = 8 THEN 'undated' ELSE strftime(ts + INTERVAL 11 HOUR, '%Y%m%d-%H%M%S') || '+1100' END || '_' || CASE WHEN k % 2 = 0 THEN 'u' || u ELSE 'session-' || n END AS folder FROM ev""")


def _folder_names(s: SparkSession, d: str) -> DataFrame:
    from threadline.operators.integrity import folder_name

    k = F.col("k")
    at = F.when(k % 9 != 8, F.col("ts"))
    uuid = F.when(k % 2 == 0, F.concat(F.lit("u"), "u"))
    return X.shaped_events(s, d).select("event_id", folder_name(at, uuid, X.ZONE, F.concat(F.lit("session-"), "event_id")).alias("folder"))


_add("f30_elapsed_labels", lambda s, d: X.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", times.elapsed_label(F.floor(F.col("l_extendedprice")) * F.col("l_linenumber") - 2000).alias("shown")), """
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) * l_linenumber - 2000 AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s < 0 THEN NULL WHEN s < 60 THEN s || ' s' WHEN s < 3600 THEN s // 60 || ' min ' || s % 60 || ' s'
  WHEN s < 86400 THEN s // 3600 || CASE WHEN s // 3600 = 1 THEN ' hr ' ELSE ' hrs ' END || s // 60 % 60 || ' m'
  ELSE s // 86400 || CASE WHEN s // 86400 = 1 THEN ' day ' ELSE ' days ' END || s // 3600 % 24 || ' h' END AS shown FROM x""")
_add("f23_f31_one_line", lambda s, d: X.table(s, d, "documents").select("doc_id", F.sha2(T.one_line(F.col("text"), 80), 256).alias("line_hash"), T.looks_failed(F.col("text")).alias("failed")), r"""
WITH x AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, lower(substr(ltrim(text, ' ' || chr(10) || chr(9) || chr(13)), 1, 200)) AS h FROM documents)
SELECT doc_id, sha256(CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 77) || '...' END) AS line_hash, starts_with(h, 'error') OR starts_with(h, 'traceback') OR contains(h, '<tool_use_error>') AS failed FROM x""")
_add("f28_unencodable", lambda s, d: _surrogates(s, d), f"""WITH {_EV} SELECT n AS event_id, CAST(k % 4 AS BIGINT) AS unencodable FROM ev""")


def _surrogates(s: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit('{"type":"user","message":{"content":"'), F.repeat(F.lit("a\\ud83d "), (F.col("k") % 4).cast("int")),
        # A legal pair and an escaped backslash count as nothing.
        F.repeat(F.lit("b\\ud83d\\ude00 c\\\\ud83d "), (F.col("k") % 3).cast("int")), F.lit('"}}'))
    lines = X.shaped_events(s, d).select(F.col("event_id").alias("path"), F.lit(1).cast("bigint").alias("line_no"), raw.alias("raw"))
    return T.conversation_entries(S.parse_lines(lines)).select(F.col("path").alias("event_id"), F.col("unencodable").cast("bigint").alias("unencodable"))


# ---- blocks of the event transcripts ------------------------------------------------


def _event_blocks(s: SparkSession, d: str) -> DataFrame:
    entries = T.conversation_entries(S.parse_lines(X.transcript_lines(s, d)))
    rows = T.model_entries(entries).select("etype", F.explode("blocks").alias("b"), "is_sidechain")
    return rows.groupBy("etype", "is_sidechain", F.col("b.kind").alias("kind")).agg(F.count(F.lit(1)).alias("blocks"), F.count("b.unknown").alias("unknown"))


_add("f22_f24_event_blocks", _event_blocks, f"""WITH {FACTS_CTE},
r AS (SELECT etype, sub, et, k FROM e4 WHERE ok UNION ALL SELECT etype, sub, et, k FROM e4 WHERE ok AND u % 6 = 0 AND k < 80),
x AS (
  SELECT etype, sub, 'subagent' AS kind, 1 AS n FROM r WHERE sub AND et = 'view' UNION ALL
  SELECT etype, sub, 'subagent', 1 + CAST(k % 10 = 4 AS INT) + CAST(k % 5 = 0 AS INT) FROM r WHERE sub AND et = 'error' UNION ALL
  SELECT etype, sub, 'subagent', 2 + CAST(k % 4 = 0 AS INT) FROM r WHERE sub AND et = 'click' UNION ALL
  SELECT etype, sub, 'subagent', CAST(k % 4 = 0 AS INT) + CAST(k % 3 = 0 AS INT) + CAST(k % 12 = 1 AS INT) FROM r WHERE sub AND et = 'purchase' UNION ALL
  SELECT etype, sub, 'machinery', 1 FROM r WHERE NOT sub AND et = 'view' AND k % 10 = 0 UNION ALL
  SELECT etype, sub, 'tool_result', 1 + CAST(k % 10 = 4 AS INT) FROM r WHERE NOT sub AND et = 'error' UNION ALL
  SELECT etype, sub, 'assistant_text', 1 FROM r WHERE NOT sub AND et = 'error' AND k % 5 = 0 UNION ALL
  SELECT etype, sub, 'assistant_text', 1 FROM r WHERE NOT sub AND et = 'click' UNION ALL
  SELECT etype, sub, 'tool_use', 1 FROM r WHERE NOT sub AND et = 'click' UNION ALL
  SELECT etype, sub, 'thinking', 1 FROM r WHERE NOT sub AND et IN ('click', 'purchase') AND k % 4 = 0 UNION ALL
  SELECT etype, sub, 'tool_use', CAST(k % 3 = 0 AS INT) + CAST(k % 12 = 1 AS INT) FROM r WHERE NOT sub AND et = 'purchase' UNION ALL
  SELECT etype, sub, 'machinery', 1 FROM r WHERE et = 'signup' AND k % 5 IN (3, 4))
SELECT etype, sub AS is_sidechain, kind, CAST(sum(n) AS BIGINT) AS blocks, CASE WHEN etype = 'mystery' THEN CAST(sum(n) AS BIGINT) ELSE 0 END AS unknown FROM x GROUP BY etype, sub, kind HAVING sum(n) > 0""")

# ---- lanes -----------------------------------------------------------------------------


def _segments(s: SparkSession, d: str) -> DataFrame:
    sessions = Q.facts_for(s, d).session.where("is_real = 1")
    spans = sessions.select("key", times.parse_instant(F.col("first_ts")).alias("begin"), times.parse_instant(F.col("last_ts")).alias("end"))
    return I.pack_lanes(I.day_segments(spans, X.ZONE, ["key"]))


def _lanes(s: SparkSession, d: str) -> DataFrame:
    return _segments(s, d).groupBy("local_date").agg(F.count(F.lit(1)).alias("segments"), (F.max("lane") + 1).cast("bigint").alias("lanes"))


# A day needs as many lanes as its peak overlap, or one more than is open where a zero-length segment falls.
_add("w06_lanes", _lanes, over_facts("""
SELECT local_date, sessions_active AS segments, greatest(max_concurrent, coalesce(z.lanes, 0)) AS lanes FROM overlap_day o
LEFT JOIN (SELECT strftime(p.d, '%Y-%m-%d') AS day, max(1 + (SELECT count(*) FROM overlap_day_pc q WHERE q.d = p.d AND q.lo < p.lo AND q.hi > p.lo)) AS lanes
           FROM overlap_day_pc p WHERE p.lo = p.hi GROUP BY 1) z ON z.day = o.local_date""", overlap=True))

_micros = lambda c: F.round(F.col(c) * 1e6).cast("bigint")
# The lane of every segment: in start order, the first lane whose segment has ended, else a new one.
_add("w06_lane_of_segment", lambda s, d: _segments(s, d).select("local_date", _micros("start_second").alias("start_us"), _micros("end_second").alias("end_us"), F.col("lane").cast("bigint").alias("lane")),
     over_facts("""
SELECT strftime(d, '%Y-%m-%d') AS local_date, lo - epoch_us(CAST(d AS TIMESTAMP)) AS start_us, hi - epoch_us(CAST(d AS TIMESTAMP)) AS end_us, CAST(lane - 1 AS BIGINT) AS lane FROM pk""", """
sq AS (SELECT d, lo, hi, row_number() OVER (PARTITION BY d ORDER BY lo, hi) AS i FROM overlap_day_pc),
pk AS (SELECT d, i, lo, hi, CAST(1 AS BIGINT) AS lane, [hi] AS ends FROM sq WHERE i = 1
  UNION ALL SELECT d, i, lo, hi, lane, CASE WHEN lane <= len(ends) THEN list_concat(list_concat(ends[1 : lane - 1], [hi]), ends[lane + 1 : len(ends)]) ELSE list_append(ends, hi) END AS ends
  FROM (SELECT x.d, x.i, x.lo, x.hi, p.ends, CAST(coalesce(list_position(list_transform(p.ends, lambda e: e <= x.lo), true), len(p.ends) + 1) AS BIGINT) AS lane
    FROM pk p JOIN sq x ON x.d = p.d AND x.i = p.i + 1))""", overlap=True).replace("WITH ", "WITH RECURSIVE ", 1))

# ---- sinks --------------------------------------------------------------------------------


def _published(s: SparkSession, d: str) -> DataFrame:
    f = Q.facts_for(s, d)
    root = new_run_dir(s, "publish")
    sinks.publish({"session": f.session, "turn": f.turn, "tool_call": f.tool_call, "attribution": f.attribution}, root, "run-1")
    return sinks.published(s, root, "session").groupBy("month").agg(F.count(F.lit(1)).alias("sessions"))


_add("k01_publish", _published, over_facts("SELECT coalesce(substr(local_date, 1, 7), 'undated') AS month, count(*) AS sessions FROM session GROUP BY 1"))


def _exported(s: SparkSession, d: str) -> DataFrame:
    f = Q.facts_for(s, d)
    root = new_run_dir(s, "csv")
    sinks.export_csv(D.engaged_by_day(f.session), root, order=["local_date"])
    return s.read.option("header", "true").schema("local_date string, sessions bigint, engaged_hours double").csv(root)


_add("k02_o10_csv_export", _exported, over_facts("""SELECT local_date, count(*) AS sessions, round(CAST(sum(CAST(engaged_seconds AS DECIMAL(20,3))) AS DOUBLE) / 3600.0, 2) AS engaged_hours
FROM session WHERE is_real = 1 AND is_subagent = 0 AND local_date IS NOT NULL GROUP BY 1"""))
_add("k06_build_report", lambda s, d: sinks.build_report(Q.facts_for(s, d)), over_facts("""
SELECT 'rows:session' AS item, CAST(count(*) AS VARCHAR) AS value FROM session UNION ALL SELECT 'rows:turn', CAST(count(*) AS VARCHAR) FROM turn
UNION ALL SELECT 'rows:tool_call', CAST(count(*) AS VARCHAR) FROM tool_call UNION ALL SELECT 'rows:attribution', CAST(count(*) AS VARCHAR) FROM attribution
UNION ALL SELECT 'rows:overlap_day', CAST(count(*) AS VARCHAR) FROM overlap_day
UNION ALL SELECT 'unpriced:' || model, CAST(count(*) AS VARCHAR) FROM e4 WHERE unpriced GROUP BY model
UNION ALL SELECT 'check:' || check_name, CAST(CAST(value AS DOUBLE) AS VARCHAR) FROM (""" + Q.ORACLE["a94_self_checks"] + ")", overlap=True))


def _sink_rows(s: SparkSession, parts: dict[str, DataFrame], label: str) -> DataFrame:
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias(label), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def _all_exports(s: SparkSession, d: str) -> DataFrame:
    """The nine exports, read back: position, rows, and whether the first column came back in its order."""
    root = new_run_dir(s, "exports")
    names = sinks.export_views(Q.facts_for(s, d), root)
    back = {n: s.read.option("header", "true").option("multiLine", "true").csv(f"{root}/{n}") for n in names}
    notes = s.read.text([f"{root}/{n}_note" for n in names]).select(F.col("value").alias("note")).distinct()
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("export")).alias("place")
    rows = _sink_rows(s, back, "export").select("export", place, "rows")
    return rows.join(notes.withColumn("_one", F.lit(1)), F.col("_one") == 1).drop("_one")


_EXPORTS = {"sessions": "SELECT 1 FROM session", "turns": "SELECT 1 FROM turn", "projects": Q.ORACLE["a20_v_project"], "daily": Q.ORACLE["a21_v_daily"],
            "hourly": Q.ORACLE["a22_v_hourly"], "models": Q.ORACLE["a23_v_model"], "tools": Q.ORACLE["a24_v_tool"], "attribution": Q.ORACLE["a25_v_attribution"],
            "overlap": "SELECT 1 FROM overlap_day"}
_add("k02_all_exports", _all_exports, over_facts(" UNION ALL ".join(
    f"SELECT '{name}' AS export, CAST({i + 1} AS BIGINT) AS place, (SELECT count(*) FROM ({sql})) AS rows, '{sinks.COST_NOTE}' AS note"
    for i, (name, sql) in enumerate(_EXPORTS.items())), overlap=True))


def _cubes_written(s: SparkSession, d: str) -> DataFrame:
    """Dashboard cube and day wall, written part by part and read back."""
    f, root = Q.facts_for(s, d), new_run_dir(s, "cube")
    parts = {
        "sessions": D.cube_sessions(f.session, Q.SPAN), "models": D.cube_models(f.turn, f.session, Q.SPAN), "tools": D.cube_tools(f.tool_call, f.session, Q.SPAN),
        "attribution": D.cube_attribution(f.attribution, f.session, Q.SPAN), "wall_days": D.wall_days(f.session, Q.SPAN), "wall_sessions": D.wall_sessions(f.session, Q.SPAN),
    }
    sinks.write_cube(parts, root)
    return _sink_rows(s, {n: s.read.schema(df.schema).json(f"{root}/{n}") for n, df in parts.items()}, "part")


_CUBE_TWINS = {"sessions": "a63_k03_cube_sessions", "models": "a60_cube_models", "tools": "a61_cube_tools", "attribution": "a62_cube_attribution",
               "wall_days": "a64_calendar", "wall_sessions": "k04_wall_sessions"}
_add("k03_k04_written_cubes", _cubes_written, " UNION ALL ".join(
    f"SELECT '{part}' AS part, (SELECT count(*) FROM ({Q.ORACLE[name]})) AS rows" for part, name in _CUBE_TWINS.items()))


def _header(s: SparkSession, d: str) -> DataFrame:
    f = Q.facts_for(s, d)
    scope = K.Scope(Q.SPAN, P.selected_labels(f.session, Q.INCLUDE, Q.EXCLUDE))
    return K.header(f.meta, scope, "sessions with is_real = 1").withColumn("projects", F.array_join("projects", ","))


_add("k07_header", _header, over_facts(f"""SELECT 'Australia/Melbourne' AS timezone, '2026-08-23' AS prices_read_on, '2024-01-05 to 2024-01-24' AS window_desc, '2024-01-05' AS since, '2024-01-24' AS until,
  'sessions with is_real = 1' AS rows, TRUE AS project_filter_applied, string_agg(project_label, ',' ORDER BY project_label) AS projects, count(*) AS project_count
FROM (SELECT DISTINCT project_label FROM session WHERE is_real = 1 AND {Q._TICKED})"""))


def _rebuilt(s: SparkSession, d: str) -> DataFrame:
    talk = talk_for(s, d)
    folded = T.parse_fold(talk.entries)
    payload = folded.select("path", F.sha2("path", 256).alias("hash"), F.lit(10).cast("bigint").alias("size_bytes"), F.lit("2024-02-01").alias("captured_at"))
    rows, _ = C.rebuild_catalogue(folded, payload)
    return rows.select("id", "path", "hash", "session_uuid", "short", "supersedes")


_add("k14_rebuild_catalogue", _rebuilt, f"""WITH {_TALK}, p AS (SELECT path, any_value(c) AS c, coalesce(arg_max(stamp, t) FILTER (stamp IS NOT NULL), '2024-02-01') AS w FROM cv GROUP BY 1)
SELECT row_number() OVER (ORDER BY substr(w, 1, 10), w, path) AS id, path, sha256(path) AS hash, 'conv-' || c AS session_uuid, substr(sha256(path), 1, 12) AS short, CAST(NULL AS VARCHAR) AS supersedes FROM p""")


def _shared(s: SparkSession, d: str) -> DataFrame:
    root = new_run_dir(s, "share")
    # Redacted and scanned once; the gate, the corpus and the reports read the stored results.
    docs = stage(R.redact_text(X.table(s, d, "documents").select("doc_id", "text"), "text", R.redaction_patterns()), f"{root}/redacted")
    findings = stage(R.secret_findings(docs, "doc_id", "text"), f"{root}/found")
    sinks.share(docs, findings, R.redaction_report(docs), root, allow_findings=True)
    return s.read.parquet(f"{root}/corpus").select("doc_id", F.sha2("text", 256).alias("redacted_hash"))


_add("k10_share", _shared, f"SELECT doc_id, sha256(regexp_replace(text, '{R.EMAIL}', '[REDACTED]', 'g')) AS redacted_hash FROM documents")

# ---- streams --------------------------------------------------------------------------------


def _arriving(s: SparkSession, d: str, label: str, run, order: Column | None = None, parts: int = 3) -> str:
    """Run a stream job ``parts`` times on one checkpoint; before each run the next part of the events arrives."""
    root = new_run_dir(s, label)
    rows = X.table(s, d, "events")
    order = F.unix_micros(F.col("ts").cast("timestamp")) if order is None else order
    first, last = rows.agg(F.min(order), F.max(order)).first()
    share = F.least(F.floor((order - first) * parts / max(last - first, 1)), F.lit(parts - 1)) if first is not None else F.lit(0)
    for part in range(parts):
        rows.where(share == part).write.parquet(f"{root}/in/{part}")
        arrived = s.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in")
        run(arrived.withColumn("ts", F.col("ts").cast("timestamp")), root)
    return root


def _appended_stream(s: SparkSession, d: str, label: str, frame) -> DataFrame:
    root = _arriving(s, d, label, lambda rows, at: J.run_to_end(frame(rows), f"{at}/cp", f"{at}/out"))
    return s.read.parquet(f"{root}/out")


def _t01(s: SparkSession, d: str) -> DataFrame:
    def run(events: DataFrame, root: str) -> None:
        rows = events.select(
            F.col("event_id").alias("line_no"), F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props")).alias("raw"))
        J.ingest(rows, f"{root}/cp", f"{root}/out")

    root = _arriving(s, d, "t01", run)
    return s.read.parquet(f"{root}/out").groupBy("is_bad").agg(F.count(F.lit(1)).alias("entries"))


_add("t01_stream_ingest", _t01, "SELECT event_type = 'error' AS is_bad, count(*) AS entries FROM events GROUP BY 1")


def _t02(s: SparkSession, d: str) -> DataFrame:
    def run(events: DataFrame, root: str) -> None:
        rows = events.select(F.col("event_id").alias("id"), F.sha2(F.concat_ws("-", "user_id", "event_type"), 256).alias("hash"), F.col("ts").alias("at"))
        J.event_actions(rows, f"{root}/cp", root, 43200, buckets=8)

    root = _arriving(s, d, "t02", run, F.col("event_id"), 6)
    return s.read.parquet(f"{root}/actions").select("id", "hash", "action")


_add("t02_stream_actions", _t02, """SELECT event_id AS id, sha256(user_id || '-' || event_type) AS hash,
  CASE WHEN lag(ts) OVER w IS NULL THEN 'stored' WHEN ts - lag(ts) OVER w <= INTERVAL 43200 SECOND THEN 'duplicate-invocation' ELSE 'skipped_unchanged' END AS action
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)""")


def _t03(s: SparkSession, d: str) -> DataFrame:
    def frame(events: DataFrame) -> DataFrame:
        started = events.where("event_type = 'signup'").select(F.col("user_id").alias("session"), F.col("ts").alias("started_at"))
        finished = events.where("event_type = 'purchase'").select(F.col("user_id").alias("session"), F.col("ts").alias("finished_at"))
        return J.unfinished(started, finished, "6 hours")

    return _appended_stream(s, d, "t03", frame).select("session", F.unix_micros("started_at").alias("started_us"))


# A start is judged once both streams have passed its grace.
_add("t03_stream_unfinished", _t03, """WITH wm AS (SELECT least(max(ts) FILTER (event_type = 'signup'), max(ts) FILTER (event_type = 'purchase')) - INTERVAL 1 MINUTE AS at FROM events)
SELECT user_id AS session, epoch_us(ts) AS started_us FROM events s, wm WHERE event_type = 'signup' AND ts + INTERVAL 6 HOUR <= wm.at
AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_type = 'purchase' AND f.user_id = s.user_id AND f.ts >= s.ts AND f.ts <= s.ts + INTERVAL 6 HOUR)""")


def _t04(s: SparkSession, d: str) -> DataFrame:
    out = _appended_stream(s, d, "t04", lambda e: J.activity_sessions(e.select("user_id", "ts"), "user_id", gap=f"{IDLE_GAP} seconds"))
    return out.select("user_id", F.unix_micros("first_at").alias("first_us"), F.unix_micros("last_at").alias("last_us"), "events", "active_seconds")


_add("t04_stream_sessions", _t04, f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL {IDLE_GAP} SECOND THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
h AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*) AS events, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 3) AS active_seconds FROM h GROUP BY user_id, i
HAVING max(ts) + INTERVAL {IDLE_GAP} SECOND <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")


#: Text in one arriving file of ``t05_stream_heads``.
ARRIVING_BYTES = 128 << 20


def _t05(s: SparkSession, d: str) -> DataFrame:
    root = new_run_dir(s, "t05")
    day = lambda c: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int")), "yyyy-MM-dd")
    i = F.col("doc_id")
    docs = X.table(s, d, "documents")
    # One file a batch: six, or as many as keep a file bounded. All rows of an id arrive together.
    parts = max(6, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ARRIVING_BYTES))
    part = F.pmod(F.xxhash64(i), F.lit(parts)).cast("int")
    # More tasks than parts, so that few parts meet in one.
    docs.withColumn("part", part).repartition(4 * parts, "part").write.partitionBy("part").parquet(f"{root}/in")
    arriving = s.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{root}/in")
    rows = arriving.select(
        i.alias("id"), F.sha2("text", 256).alias("hash"), F.concat_ws("-", "source", "lang").alias("session_uuid"),
        F.when(i % 13 != 0, day(i * 37 % 200)).alias("last_ts"), F.lit("2024-03-01").alias("captured_at"))
    last = J.maintain_heads(rows, f"{root}/cp", f"{root}/heads", buckets=8)
    schema = "id bigint, hash string, session_uuid string, last_ts string, captured_at string"
    return J.latest_heads(s, f"{root}/heads", last, schema, buckets=8).select("id", "session_uuid", "hash", "n_versions")


_add("t05_stream_heads", _t05, """SELECT doc_id AS id, source || '-' || lang AS session_uuid, sha256(text) AS hash, count(*) OVER (PARTITION BY source, lang) AS n_versions FROM documents
QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY coalesce(CASE WHEN doc_id % 13 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id * 37 % 200 AS INT), '%Y-%m-%d') END, '2024-03-01') DESC, doc_id DESC) = 1""")
_add("t06_stream_daily", lambda s, d: _appended_stream(s, d, "t06", lambda e: J.daily_counts(e.select("ts"))),
     """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events GROUP BY 1
HAVING CAST(max(ts) AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")

# ---- single aspects of the session fold ---------------------------------------------------------


def _facts(name: str, run, sql: str | None) -> None:
    _add(name, lambda s, d: run(Q.facts_for(s, d)), sql)


_FIRST = "key, session_uuid, cwd, git_branch, slug_title, cc_version, entrypoint, user_type, agent_id, ai_title, custom_title, first_ts, last_ts"
_facts("a02_a03_a04_first_last", lambda f: f.session.select(*_FIRST.split(", ")), over_facts(f"SELECT {_FIRST} FROM session"))
_MAPS = "key, primary_model, models_json, cc_versions_json, effort_json, service_tiers_json, speeds_json, permission_modes_json, prompt_sources_json, entry_types_json, refusal_categories_json"
_facts("a05_a06_frequency_maps", lambda f: f.session.select(*_MAPS.split(", ")), over_facts(f"SELECT {_MAPS} FROM session"))
_FLAGS = "key, is_sidechain, interrupted_by_shutdown, n_prompt_ids, n_user_prompts, n_interrupts, n_tool_results"
_facts("a07_a08_f12_f14_flags", lambda f: f.session.select(*_FLAGS.split(", ")), over_facts(f"SELECT {_FLAGS} FROM session"))
_facts("f09_usage", lambda f: f.entry.where("is_reply").select(
        "line_no", "input_tokens", "output_tokens", "cache_write_5m", "cache_write_1h", "cache_write_declared", "cache_read", "thinking_tokens", "service_tier", "speed"),
     over_facts("""SELECT event_id AS line_no, tin AS input_tokens, tout AS output_tokens, cw5 AS cache_write_5m, cw1h AS cache_write_1h, decl AS cache_write_declared,
  cread AS cache_read, think AS thinking_tokens, tier AS service_tier, speed FROM e4 WHERE is_reply"""))
_facts("f03_f04_local_seconds", lambda f: f.session.where("first_ts is not null").select(
        "key", times.offset_text_to_minutes(F.col("tz_offset")).alias("minutes"),
        times.local_seconds_of_day(times.parse_instant(F.col("first_ts")), F.col("tz_offset")).alias("second"),
        times.duration_seconds(times.parse_instant(F.col("first_ts")), times.parse_instant(F.col("last_ts"))).alias("duration")), over_facts("""
SELECT key, 660 AS minutes, CAST(hour(t) * 3600 + minute(t) * 60 + second(t) AS INT) AS second, CAST(round_even((epoch_us(z) - epoch_us(t)) / 1e6, 0) AS BIGINT) AS duration
FROM (SELECT key, CAST(first_ts AS TIMESTAMP) + INTERVAL 11 HOUR AS t, CAST(last_ts AS TIMESTAMP) + INTERVAL 11 HOUR AS z FROM session WHERE first_ts IS NOT NULL)"""))


def _u01(s: SparkSession, d: str) -> DataFrame:
    from threadline.plans import etl

    listing = X.transcript_lines(s, d).groupBy("path").agg(F.sum(F.octet_length("raw") + 1).alias("size_bytes"))
    found = etl.discover(listing)
    return found.groupBy("source_tree", "is_subagent").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("key").alias("keys"))


_add("u01_both_trees", _u01, over_facts("""SELECT source_tree, CAST(sub AS INT) AS is_subagent, count(*) AS files, count(*) AS keys FROM (
  SELECT DISTINCT CASE WHEN u % 2 = 0 THEN 'archive' ELSE 'live' END AS source_tree, sub, key FROM e4
  UNION SELECT DISTINCT 'live', sub, key FROM e4 WHERE u % 6 = 0 AND k < 80) GROUP BY ALL"""))

# ---- texts ---------------------------------------------------------------------------------------


def _media(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    data = F.repeat(F.lit("A"), (k * 40).cast("int"))
    block = F.to_json(F.struct(F.lit("image").alias("type"), F.struct(F.when(k % 3 != 0, F.lit("image/png")).alias("media_type"), data.alias("data")).alias("source")))
    rows = X.shaped_events(s, d).select("event_id", F.parse_json(block).alias("b"))
    return rows.select("event_id", T.media_marker(F.col("b")).alias("shown"))


_add("f20_media_marker", _media, f"""WITH {_EV}, x AS (SELECT n, concat_ws(' · ', CASE WHEN k % 3 <> 0 THEN 'image/png' END, CASE WHEN k > 0 THEN format('{{:,}}', k * 30) || ' bytes' END) AS d FROM ev)
SELECT n AS event_id, 'attachment (image)' || CASE WHEN d <> '' THEN ': ' || d ELSE '' END AS shown FROM x""")


def _talkish(s: SparkSession, d: str) -> DataFrame:
    """One entry per event: attachments, strings, lists and replies, for the text rules."""
    k = F.col("k")
    raw = (
        F.when(k % 4 == 0, F.concat(F.lit('{"type":"attachment","attachment":{"type":"file","filename":"f'), k, F.lit('","content":{"content":"body"}}}')))
        .when(k % 4 == 1, F.concat(F.lit('{"type":"attachment","attachment":{"type":"hook","filename":"f'), k, F.lit('"}}')))
        .when(k % 4 == 2, F.concat(F.lit('{"type":"assistant","message":{"content":[{"type":"text","text":"'), F.when(k % 8 == 2, F.lit("  ")).otherwise(F.lit(" said ")), F.lit('"},{"type":"text","text":"more"}]}}')))
        .otherwise(F.lit('{"type":"user","message":{"content":"  typed "}}'))
    )
    lines = X.shaped_events(s, d).select(F.col("event_id").alias("path"), F.lit(1).cast("bigint").alias("line_no"), raw.alias("raw"))
    return T.conversation_entries(S.parse_lines(lines))


_add("f21_attachments", lambda s, d: T.model_entries(_talkish(s, d).where("etype = 'attachment'")).select(F.col("path").alias("event_id"), F.explode("blocks").alias("b")).select("event_id", "b.kind", "b.text"),
     f"""WITH {_EV} SELECT n AS event_id, CASE WHEN k % 4 = 0 THEN 'attachment' ELSE 'machinery' END AS kind,
  CASE WHEN k % 4 = 0 THEN 'attachment (file): f' || k || chr(10) || chr(10) || 'body' ELSE 'attachment:hook f' || k END AS text FROM ev WHERE k % 4 < 2""")
_add("f11_f26_content_text", lambda s, d: _talkish(s, d).where("etype <> 'attachment'").select(
        F.col("path").alias("event_id"), T.content_text(F.col("text"), F.col("items")).alias("shown"), T.substantive(F.col("text"), F.col("items")).alias("real")), f"""WITH {_EV}
SELECT n AS event_id, CASE WHEN k % 4 = 3 THEN 'typed' WHEN k % 8 = 2 THEN 'more' ELSE 'said  more' END AS shown, TRUE AS real FROM ev WHERE k % 4 >= 2""")


def _classes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    text = (
        F.when(k % 5 == 0, F.lit(" <task-notification> x")).when(k % 5 == 1, F.lit("Stop hook feedback: y"))
        .when(k % 5 == 2, F.lit("<system-reminder>only</system-reminder>")).otherwise(F.lit("real <task-notification> mention"))
    )
    no = F.lit(False)
    return X.shaped_events(s, d).select("event_id", T.prompt_class(F.lit("user"), text, k % 7 == 3, no, k % 11 == 5).alias("class"))


_add("f18_prompt_class", _classes, f"""WITH {_EV}
SELECT n AS event_id, CASE WHEN k % 11 = 5 THEN NULL WHEN k % 5 = 0 THEN 'task_notification' WHEN k % 5 = 1 THEN 'stop_hook' WHEN k % 5 = 2 OR k % 7 = 3 THEN 'machinery' ELSE 'prompt' END AS class FROM ev""")
_add("f27_f40_titles", lambda s, d: X.shaped_events(s, d).select(
        "event_id", T.title(F.when(F.col("k") % 5 == 0, F.lit("own")), F.when(F.col("k") % 3 == 0, F.lit("made")), F.when(F.col("k") % 2 == 0, F.lit("")).otherwise(F.lit("slug")),
        F.when(F.col("k") % 4 == 0, F.lit("<system-reminder>not\nthis</system-reminder>\n line one \nline two")).otherwise(F.lit("(no summary)"))).alias("title")), f"""WITH {_EV}
SELECT n AS event_id, CASE WHEN k % 5 = 0 THEN 'own' WHEN k % 3 = 0 THEN 'made' WHEN k % 2 = 1 THEN 'slug' WHEN k % 4 = 0 THEN 'line one' ELSE 'session' END AS title FROM ev""")

# ---- appended tables -------------------------------------------------------------------------------


def _appended(s: SparkSession, d: str) -> DataFrame:
    """Events appended in two runs, a coverage row, and the history kept under its own hash."""
    root = new_run_dir(s, "append")
    rows = Z.keyed_events(s, d).select(F.col("event_id").alias("id"), F.col("et").alias("action"))
    sinks.append_rows(rows.where("id % 2 = 0"), f"{root}/event")
    sinks.append_rows(rows.where("id % 2 = 1"), f"{root}/event")
    return s.read.parquet(f"{root}/event").groupBy("action").agg(F.count(F.lit(1)).alias("events"))


_add("k13_append_events", _appended, "SELECT event_type AS action, count(*) AS events FROM events GROUP BY 1")


def _coverage(s: SparkSession, d: str) -> DataFrame:
    from threadline.operators import health as H
    from threadline.plans.catalog_queries import _man, _sidecars

    row = sinks.coverage_snapshot(H.sidecar_coverage(L.sidecar_notices(_sidecars(s, d))), H.prompt_coverage(_man(s, d)), "2024-02-01")
    root = new_run_dir(s, "coverage")
    sinks.append_rows(row, root)
    return s.read.parquet(root).select("folders", "sessions_total", F.col("at").alias("taken_at"))


_add("k15_coverage_snapshot", _coverage, f"""WITH {_LOG}
SELECT (SELECT count(DISTINCT uuid) FROM evs WHERE et = 'view' AND k % 10 < 2) AS folders,
  (SELECT count(DISTINCT doc_id // 20) FROM documents WHERE doc_id % 5 <> 0 AND doc_id // 20 % 7 <> 6) AS sessions_total, '2024-02-01' AS taken_at""")


def _snapshots(s: SparkSession, d: str) -> DataFrame:
    """A history file stored once per distinct content, however often it is offered."""
    docs = Z.payloads(s, d).select("id", "hash")
    root = new_run_dir(s, "snapshot")
    sinks.append_rows(C.put_new(docs, docs.limit(0)), root)
    sinks.append_rows(C.put_new(docs, s.read.parquet(root)), root)
    return s.read.parquet(root)


_add("k18_s13_snapshots", _snapshots, "SELECT min(doc_id) AS id, sha256(text) AS hash FROM documents GROUP BY 2")
