"""Queries over catalogue, registry, logs and folders, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.operators import catalog as C
from threadline.operators import health as H
from threadline.operators import integrity as G
from threadline.plans import standins_catalog as Z
from threadline.plans.oracle_base import over_facts, total
from threadline.plans.standins import table
from threadline.plans.stats_queries import facts_for
from threadline.runtime import prepare
from threadline.sources import logs as L

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
NOW = Z.NOW


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(prepare(spark), sf_dir)
    if sql is not None:
        ORACLE[name] = sql


def _facts(name: str, run, sql: str | None) -> None:
    _add(name, lambda s, d: run(facts_for(s, d)), sql)


_PAY = """pay AS (
  SELECT doc_id AS id, sha256(text) AS hash, CASE WHEN doc_id % 10 <> 9 THEN source || '-' || lang || '-' || (doc_id % 7) END AS session_uuid,
    CAST(regexp_extract(source, '([0-9]+)$', 1) AS BIGINT) AS project_id, source, text,
    strftime(DATE '2024-01-01' + CAST(doc_id * 37 % 200 - doc_id % 5 + 5 AS INT), '%Y-%m-%d') AS first_ts,
    CASE WHEN doc_id % 13 <> 0 THEN strftime(DATE '2024-01-01' + CAST(doc_id * 37 % 200 + 5 AS INT), '%Y-%m-%d') END AS last_ts,
    strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id * 61), '%Y-%m-%dT%H:%M:%SZ') AS captured_at,
    CAST(strlen(text) AS BIGINT) AS size_bytes, length(text) - length(replace(text, chr(10), '')) + 1 AS line_count,
    CAST(doc_id % 8 = 0 AS INT) AS hidden
  FROM documents)"""
_VER = _PAY + """,
ver AS (SELECT *, coalesce(session_uuid, 'row-' || id) AS chain FROM pay QUALIFY row_number() OVER (PARTITION BY hash ORDER BY id) = 1),
head AS (SELECT *, count(*) OVER (PARTITION BY chain) AS n_versions FROM ver
  QUALIFY row_number() OVER (PARTITION BY chain ORDER BY coalesce(last_ts, captured_at) DESC, captured_at DESC, id DESC) = 1)"""
_VCOLS = "id, hash, session_uuid, project_id, first_ts, last_ts, captured_at, size_bytes, line_count, hidden"

# ---- payload identity and version chains ------------------------------------
_add("k12_put_new", lambda s, d: C.put_new(Z.payloads(s, d), _labelled(s, d)).select("id", "hash", "size_bytes"), f"""WITH {_PAY}
SELECT id, hash, size_bytes FROM pay WHERE hash NOT IN (SELECT hash FROM pay WHERE id IN (SELECT doc_id FROM labels))
QUALIFY row_number() OVER (PARTITION BY hash ORDER BY id) = 1""")


def _labelled(s: SparkSession, d: str) -> DataFrame:
    """Payloads on the catalogue's side: the labelled documents."""
    held = table(s, d, "labels").select(F.col("doc_id").alias("id"))
    return Z.payloads(s, d).join(held, "id", "left_semi")


_add("j10_f33_unknown_payloads", lambda s, d: C.unknown_payloads(Z.payloads(s, d), _labelled(s, d)).select("id", "hash"), f"""WITH {_PAY}
SELECT id, hash FROM pay WHERE hash NOT IN (SELECT hash FROM pay WHERE id IN (SELECT doc_id FROM labels))""")
_add("w02_heads", lambda s, d: C.heads(Z.versions(s, d)), f"WITH {_VER} SELECT {_VCOLS}, n_versions FROM head")
_add("p22_visible_heads", lambda s, d: C.visible_heads(Z.versions(s, d)).where(
        (F.col("first_ts") >= "2024-02-01") & (F.col("first_ts") < "2024-05-01")).select("id", "hash", "first_ts"),
     f"WITH {_VER} SELECT id, hash, first_ts FROM head WHERE hidden = 0 AND first_ts >= '2024-02-01' AND first_ts < '2024-05-01'")
_add("w19_multi_version_heads", lambda s, d: C.multi_version_heads(Z.versions(s, d)).select("id", "session_uuid", "n_versions"),
     f"WITH {_VER} SELECT id, session_uuid, n_versions FROM head WHERE session_uuid IS NOT NULL AND n_versions >= 2")
_add("j05_versions_with_project", lambda s, d: C.with_project(Z.versions(s, d), Z.projects(s, d)).select("id", "label"),
     f"WITH {_VER} SELECT id, source AS label FROM ver")
_add("w18_supersedes", lambda s, d: C.supersedes(Z.versions(s, d), 64).select("id", "supersedes"), f"""WITH {_VER}
SELECT id, arg_max(hash, (coalesce(last_ts, captured_at), captured_at, id)) OVER (PARTITION BY chain ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS supersedes FROM ver""")
# The driver's hashes never meet at 12 digits, so the first ten are flattened here.
_add("w17_short_keys", lambda s, d: C.short_keys(Z.versions(s, d).select("id", F.concat(F.lit("0" * 10), F.substring("hash", 1, 54)).alias("hash"))),
     f"""WITH {_VER}, flat AS (SELECT id, '0000000000' || substr(hash, 1, 54) AS hash FROM ver)
SELECT id, hash, substr(hash, 1, CAST(min(n) AS INT)) AS short FROM (
  SELECT id, hash, n, min(id) OVER (PARTITION BY n, substr(hash, 1, CAST(n AS INT))) AS owner FROM flat CROSS JOIN (SELECT unnest(range(12, 65, 4)) AS n))
WHERE owner = id GROUP BY id, hash""")
_add("w20_write_outcomes", lambda s, d: C.write_outcomes(
        Z.payloads(s, d).select("id", F.coalesce("session_uuid", F.lit("none")).alias("folder"), "hash", (F.col("size_bytes") - F.col("size_bytes") % 500).alias("size_bytes")), 64)
        .select("id", "folder", "outcome"), f"""WITH {_PAY}, w AS (SELECT id, coalesce(session_uuid, 'none') AS folder, hash, size_bytes - size_bytes % 500 AS size FROM pay),
h AS (SELECT *, max(size) OVER p AS top, arg_max(hash, (size, -id)) OVER p AS held FROM w WINDOW p AS (PARTITION BY folder ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, folder, CASE WHEN top IS NULL THEN 'written' WHEN size > top THEN 'replaced' WHEN size < top THEN 'refused_smaller' WHEN hash = held THEN 'unchanged' ELSE 'refused_different' END AS outcome FROM h""")
def _actions(s: SparkSession, d: str) -> DataFrame:
    rows = Z.keyed_events(s, d).select(F.col("event_id").alias("id"), F.sha2(F.concat_ws("-", "u", "et"), 256).alias("hash"), F.col("ts").alias("at"))
    return C.event_actions(rows, 43200, 2000)


_ACT = """act AS (SELECT event_id AS id, sha256(user_id || '-' || event_type) AS hash,
  CASE WHEN lag(ts) OVER w IS NULL THEN 'stored' WHEN ts - lag(ts) OVER w <= INTERVAL 43200 SECOND THEN 'duplicate-invocation' ELSE 'skipped_unchanged' END AS action
  FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id))"""
_add("w07_event_actions", lambda s, d: _actions(s, d).select("id", "hash", "action"), f"WITH {_ACT} SELECT * FROM act")
_add("a92_outcome_counts", lambda s, d: H.outcome_counts(_actions(s, d)), f"WITH {_ACT} SELECT action, count(*) AS n FROM act GROUP BY 1")
_add("a93_unchanged_event", lambda s, d: H.unchanged_event(_actions(s, d), "2024-02-01T00:00:00Z"), f"""WITH {_ACT}
SELECT 'sweep-unchanged' AS action, CAST(NULL AS VARCHAR) AS session_hash, count(*) || ' unchanged' AS detail, '2024-02-01T00:00:00Z' AS at
FROM act WHERE action = 'skipped_unchanged'""".replace(" AS at\n", ' AS "at"\n'))


def _copies(s: SparkSession, d: str, odd: bool) -> DataFrame:
    rows = Z.payloads(s, d).select("id", "hash", F.concat_ws("/", "project_id", F.col("id") % 9).alias("path"), F.timestamp_seconds(F.col("id")).alias("seen_at"))
    return rows.where("id % 3 = 0") if not odd else rows


_add("k17_content_history", lambda s, d: C.content_history(_copies(s, d, True), _copies(s, d, False)).select("id", "path", "hash"), f"""WITH {_PAY},
c AS (SELECT id, hash, project_id || '/' || (id % 9) AS path FROM pay)
SELECT id, path, hash FROM c WHERE (path, hash) NOT IN (SELECT (path, hash) FROM c WHERE id % 3 = 0)
QUALIFY row_number() OVER (PARTITION BY path, hash ORDER BY id) = 1""")
_add("k17_latest_content", lambda s, d: C.latest_content(_copies(s, d, True)).select("id", "path", "hash"), f"""WITH {_PAY}
SELECT id, project_id || '/' || (id % 9) AS path, hash FROM pay QUALIFY row_number() OVER (PARTITION BY project_id, id % 9 ORDER BY id DESC) = 1""")
_add("f34_grew_by_append", lambda s, d: Z.live_children(s, d).groupBy("grew").agg(F.count(F.lit(1)).alias("n")),
     "SELECT doc_id % 9 = 0 AS grew, count(*) AS n FROM documents WHERE doc_id % 7 <> 0 GROUP BY 1")
_add("k16_import_outcomes", lambda s, d: C.import_outcomes(
        Z.payloads(s, d).withColumn("kind", F.when(F.col("id") % 6 == 5, "not-a-session").otherwise("session")), _labelled(s, d)).select("id", "outcome"), f"""WITH {_PAY}
SELECT id, CASE WHEN id % 6 = 5 THEN 'not_a_session' WHEN hash IN (SELECT hash FROM pay WHERE id IN (SELECT doc_id FROM labels)) THEN 'already_stored' ELSE 'stored' END AS outcome FROM pay""")
_add("p21_stale_folders", lambda s, d: _stale(s, d).select("folder"), f"""WITH {_PAY}
SELECT 'f' || id AS folder FROM pay WHERE id % 4 = 0 OR id % 6 = 1""")


def _stale(s: SparkSession, d: str) -> DataFrame:
    rows = Z.payloads(s, d).select(
        F.col("id"), F.concat(F.lit("f"), "id").alias("folder"), F.col("hash").alias("source_hash"), F.lit("c1").alias("config_hash"),
        F.lit("1.0").alias("renderer_version"), F.sha2(F.col("id").cast("string"), 256).alias("children_hash"))
    current = rows.where("id % 4 <> 0").withColumn("renderer_version", F.when(F.col("id") % 6 == 1, "0.9").otherwise("1.0"))
    return C.stale_folders(rows, current)


_add("j33_short_payload_heads", lambda s, d: C.short_payload_heads(Z.versions(s, d), Z.versions(s, d).select(
        "hash", F.concat(F.lit("/src/"), "id").alias("path"), (F.col("size_bytes") + F.when(F.col("id") % 3 == 0, 10).otherwise(0)).alias("size_bytes"))), f"""WITH {_VER}
SELECT session_uuid, hash, size_bytes AS stored_bytes, '/src/' || id AS path, size_bytes + 10 AS source_bytes FROM head
WHERE session_uuid IS NOT NULL AND n_versions >= 2 AND id % 3 = 0""")
_add("p23_hidden_changes", lambda s, d: C.hidden_changes(Z.versions(s, d), Z.versions(s, d).where("id % 5 <> 0").select(
        "hash", (F.col("size_bytes") < 400).cast("int").alias("hidden"))).select("id", "verdict"), f"""WITH {_VER}
SELECT id, CASE WHEN id % 5 = 0 THEN 'missing' WHEN hidden <> CAST(size_bytes < 400 AS INT) THEN 'flipped' ELSE 'unchanged' END AS verdict FROM ver""")
_add("a85_stored_totals", lambda s, d: H.stored_totals(Z.versions(s, d)), f"WITH {_VER} SELECT count(*) AS sessions, {total('size_bytes')} AS stored_bytes FROM ver")
_add("a12_last_capture", lambda s, d: H.last_capture(Z.versions(s, d)), f"WITH {_VER} SELECT max(captured_at) AS last_capture FROM ver")
_add("o05_j04_recent_captures", lambda s, d: H.recent_captures(Z.versions(s, d), Z.projects(s, d).where("id % 2 = 0"), 50).select("id", "label", "captured_at"), f"""WITH {_VER}
SELECT id, CASE WHEN project_id % 2 = 0 THEN source END AS label, captured_at FROM ver ORDER BY captured_at DESC, id DESC LIMIT 50""")
_add("o07_recent_heads", lambda s, d: H.recent_heads(C.short_keys(C.heads(Z.versions(s, d))), 25, ["0"]).select("id", "first_ts", "short"), f"""WITH {_VER}
SELECT id, first_ts, substr(hash, 1, 12) AS short FROM head ORDER BY first_ts DESC NULLS LAST, id DESC LIMIT 25""")
_add("a96_unreadable_heads", lambda s, d: _unreadable(s, d), f"""WITH {_VER}, b AS (SELECT *, '/a/' || id AS path, id % 4 = 1 AS found FROM head WHERE session_uuid IS NULL)
SELECT count(*) AS checked, count(*) FILTER (NOT found AND hidden = 0) AS visible_missing, count(*) FILTER (NOT found AND hidden = 1) AS hidden_missing,
  min(path) FILTER (NOT found AND hidden = 0) AS first_example FROM b""")


def _unreadable(s: SparkSession, d: str) -> DataFrame:
    head = C.heads(Z.versions(s, d)).withColumn("path", F.concat(F.lit("/a/"), "id"))
    return H.unreadable_heads(head, head.where("id % 4 = 1").select("path"))


# ---- store against catalogue -------------------------------------------------


def _store(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return Z.versions(s, d).where("id % 3 <> 0").select(
        F.col("hash").alias("address"),
        F.when(i % 50 == 1, F.sha2(F.concat("hash", F.lit("x")), 256)).when(i % 50 != 2, F.col("hash")).alias("actual"))


def _rows(s: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    return Z.versions(s, d).where("id % 4 <> 0").select(F.when(i % 97 == 5, None).when(i % 89 == 6, F.concat(F.lit("zz"), i)).otherwise(F.col("hash")).alias("hash"))


_SIDES = """st AS (SELECT hash AS address, CASE WHEN id % 50 = 1 THEN sha256(hash || 'x') WHEN id % 50 <> 2 THEN hash END AS actual FROM ver WHERE id % 3 <> 0),
cat AS (SELECT DISTINCT coalesce(CASE WHEN id % 97 = 5 THEN NULL WHEN id % 89 = 6 THEN 'zz' || id ELSE hash END, '<null>') AS address FROM ver WHERE id % 4 <> 0)"""
_add("j12_verify_store", lambda s, d: H.verify_store(_store(s, d), _rows(s, d)), f"""WITH {_VER}, {_SIDES}
SELECT coalesce(st.address, cat.address) AS address, CASE WHEN st.address IS NULL AND length(cat.address) <> 64 THEN 'malformed' WHEN st.address IS NULL THEN 'missing'
  WHEN actual IS NULL THEN 'unreadable' WHEN actual <> st.address THEN 'corrupted' ELSE 'orphan' END AS action
FROM st FULL OUTER JOIN cat ON st.address = cat.address WHERE NOT (st.address IS NOT NULL AND cat.address IS NOT NULL AND coalesce(actual = st.address, FALSE))""")
_add("j11_orphans", lambda s, d: H.orphans(_store(s, d), _rows(s, d)).select("address"), f"""WITH {_VER}, {_SIDES}
SELECT address FROM st WHERE address NOT IN (SELECT address FROM cat)""")

# ---- registry ----------------------------------------------------------------
_CAP = """cap AS (SELECT event_id AS id, '/home/ann/projects/app.' || user_id AS cwd, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, user_id AS u FROM events),
keyed AS (SELECT id, CASE WHEN k % 5 = 0 THEN 'payload_cwd' WHEN k % 5 = 1 THEN 'jsonl_cwd' WHEN k % 11 <> 10 THEN 'transcript_dir' ELSE 'unresolved' END AS resolution_source,
  CASE WHEN k % 5 IN (0, 1) THEN 'cwd' ELSE 'encoded_dir' END AS kind,
  CASE WHEN k % 11 <> 10 THEN regexp_replace(cwd, '[/_.]', '-', 'g') ELSE '' END AS enc,
  CASE WHEN k % 5 IN (0, 1) THEN cwd WHEN k % 11 <> 10 THEN regexp_replace(cwd, '[/_.]', '-', 'g') ELSE '_unresolved' END AS claim FROM cap),
users AS (SELECT DISTINCT user_id AS u, '/home/ann/projects/app.' || user_id AS cwd FROM events),
alias AS (SELECT u + 1 AS project_id, cwd AS path, 'cwd' AS kind FROM users WHERE u % 10 = 0
  UNION ALL SELECT u + 1, regexp_replace(cwd, '[/_.]', '-', 'g'), 'encoded_dir' FROM users WHERE u % 10 IN (0, 1)),
firsts AS (SELECT kind, claim, min(id) AS first_id, arg_min(struct_pack(k := ck, c := cc), (id, ck)) AS own FROM (
    SELECT id, kind, claim, kind AS ck, claim AS cc FROM keyed UNION ALL SELECT id, 'encoded_dir', enc, kind, claim FROM keyed WHERE kind = 'cwd' AND enc <> '') x
  WHERE NOT EXISTS (SELECT 1 FROM alias a WHERE a.kind = x.kind AND a.path = x.claim) GROUP BY 1, 2),
made AS (SELECT kind, claim, (SELECT max(project_id) FROM alias) + row_number() OVER (ORDER BY first_id, claim) AS id FROM firsts WHERE own.k = kind AND own.c = claim)"""


def _resolved(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    alias = Z.aliases(s, d)
    return C.resolve_projects(Z.captures(s, d), alias, alias.select(F.col("project_id").alias("id")).distinct())


_add("j21_resolve_projects", lambda s, d: _resolved(s, d)[0].select("id", "resolution_source", "session_cwd", "project_id"), f"""WITH {_CAP}
SELECT k.id, resolution_source, CASE WHEN k.kind = 'cwd' THEN k.claim END AS session_cwd,
  coalesce(a.project_id, b.project_id, m.id) AS project_id
FROM keyed k LEFT JOIN alias a ON a.kind = k.kind AND a.path = k.claim LEFT JOIN firsts f ON f.kind = k.kind AND f.claim = k.claim
LEFT JOIN alias b ON b.kind = f.own.k AND b.path = f.own.c LEFT JOIN made m ON m.kind = f.own.k AND m.claim = f.own.c""")
_add("j21_created_projects", lambda s, d: _resolved(s, d)[1], f"""WITH {_CAP}
SELECT id, CASE WHEN claim = '_unresolved' THEN '_unresolved' WHEN kind = 'cwd' THEN replace(claim, '/home/ann/projects/', '') ELSE replace(replace(claim, '-home-ann-projects-', ''), '-', '-') END AS label, kind, claim FROM made""")
_add("j06_cwds_for_directory", lambda s, d: C.cwds_for_directory(Z.aliases(s, d)), f"""WITH {_CAP}
SELECT e.path AS encoded_dir, c.path AS cwd FROM alias e JOIN alias c USING (project_id) WHERE e.kind = 'encoded_dir' AND c.kind = 'cwd'""")


def _merged(s: SparkSession, d: str) -> DataFrame:
    alias = Z.payloads(s, d).select("project_id", F.concat(F.lit("/p/"), "session_uuid").alias("path")).where("path is not null").distinct()
    project, alias, rows = C.merge_projects(C.rename_project(Z.projects(s, d), 2, "two"), alias, Z.versions(s, d), 1, 3)
    return C.project_summary(project, rows, alias)


_add("j22_a88_merged_projects", _merged, f"""WITH {_VER}, al AS (SELECT DISTINCT CASE WHEN project_id = 3 THEN 1 ELSE project_id END AS project_id, project_id AS was, '/p/' || session_uuid AS path FROM pay WHERE session_uuid IS NOT NULL)
SELECT p.project_id, CASE WHEN p.project_id = 2 THEN 'two' ELSE p.source END AS label, CAST(p.project_id = 3 AS INT) AS retired,
  (SELECT count(*) FROM ver v WHERE CASE WHEN v.project_id = 3 THEN 1 ELSE v.project_id END = p.project_id) AS sessions,
  (SELECT count(*) FROM al WHERE al.project_id = p.project_id) AS aliases, (SELECT min(path) FROM al WHERE al.project_id = p.project_id) AS first_path
FROM (SELECT DISTINCT project_id, source FROM pay) p""")


def _moved(s: SparkSession, d: str) -> DataFrame:
    alias = Z.aliases(s, d)
    first = alias.where("kind = 'cwd'").agg(F.min("project_id")).first()[0]
    return C.move_project(alias, first, f"/home/ann/projects/app.{first - 1}", "/srv/new_home/app.one", "2024-02-01")


_add("j22_moved_project", _moved, f"""WITH {_CAP}, m AS (SELECT min(project_id) AS id FROM alias WHERE kind = 'cwd')
SELECT project_id, path, kind, '2023-12-01' AS first_seen, CASE WHEN project_id = m.id AND kind = 'cwd' THEN '2024-02-01' ELSE '2023-12-31' END AS last_seen FROM alias, m
UNION ALL SELECT id, p, k, '2024-02-01', '2024-02-01' FROM m, (VALUES ('/srv/new_home/app.one', 'cwd'), ('-srv-new-home-app-one', 'encoded_dir')) v(p, k)""")
_add("j20_directory_labels", lambda s, d: C.directory_labels(
        # A quarter of the directories is known under another name to the first source only.
        Z.keyed_events(s, d).select(F.when(F.col("u") % 4 == 0, -F.col("u")).otherwise(F.col("u")).alias("directory"), F.col("et").alias("label")),
        Z.keyed_events(s, d).select(F.col("u").alias("directory"), F.concat(F.lit("far "), F.col("et")).alias("label"))), """
WITH ev AS (SELECT user_id AS u, event_type AS et, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events),
a AS (SELECT u, arg_min(et, (-n, et)) AS l FROM (SELECT CASE WHEN u % 4 = 0 THEN -u ELSE u END AS u, et, count(*) AS n FROM ev GROUP BY ALL) GROUP BY u),
b AS (SELECT u, arg_min(et, (-n, et)) AS l FROM (SELECT u, 'far ' || et AS et, count(*) AS n FROM ev GROUP BY ALL) GROUP BY u)
SELECT coalesce(a.u, b.u) AS directory, coalesce(a.l, b.l) AS label FROM a FULL OUTER JOIN b ON a.u = b.u""")
_facts("p13_classify_payloads", lambda f: C.classify_payloads(f.entry).join(f.listing.select("path", "key"), "path").select("key", "talk", "agent_talk", "kind"), over_facts("""
SELECT key, count(*) FILTER (etype IN ('user', 'assistant')) AS talk, count(*) FILTER (etype IN ('user', 'assistant') AND sub) AS agent_talk,
  CASE WHEN talk = 0 THEN 'not-a-session' WHEN agent_talk = talk THEN 'subagent' ELSE 'session' END AS kind FROM e4 GROUP BY 1"""))
_facts("j31_attach_subagents", lambda f: C.attach_subagents(
        f.session.where("is_subagent = 1").select("key", "parent_session_uuid"),
        f.session.where("is_subagent = 0 and is_real = 1 and session_uuid is not null").select("session_uuid", F.col("container_name").alias("label")))
        .select("key", "label"), over_facts("""
SELECT c.key, coalesce(p.container_name, '_orphaned-subagents') AS label FROM session c
LEFT JOIN session p ON p.session_uuid = c.parent_session_uuid AND p.is_subagent = 0 AND p.is_real = 1 WHERE c.is_subagent = 1"""))
_facts("j07_reconcile_statistics", lambda f: G.reconcile_statistics(f.session, f.session.where("is_subagent = 0").select(
        "session_uuid", (F.col("line_count") + F.when(F.length("key") % 3 == 0, 1).otherwise(0)).alias("line_count"), "first_ts",
        F.when(F.col("local_hour") != 5, F.col("last_ts")).alias("last_ts"))), over_facts("""
SELECT count(*) AS pairs, count(*) FILTER (length(key) % 3 = 0) AS line_mismatches,
  count(*) FILTER (length(key) % 3 <> 0 AND NOT coalesce(local_hour <> 5, FALSE) AND last_ts IS NOT NULL) AS ts_mismatches
FROM session WHERE is_subagent = 0 AND session_uuid IS NOT NULL"""))

# ---- logs ----------------------------------------------------------------------
_LOG = """ev AS (SELECT event_id AS n, event_type AS et, user_id AS u, ts, CAST(floor(epoch_us(ts) / 259200000000) AS BIGINT) AS b,
  CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso FROM events),
evs AS (SELECT *, printf('%08x-0000-4000-8000-%012d', b, u) AS uuid FROM ev),
rec AS (SELECT n, 'c' || u AS session, uuid, k, u, b, et, CASE WHEN k <> 50 THEN iso END AS at_raw, CASE WHEN k <> 50 THEN ts END AS at_ts FROM evs WHERE NOT (et = 'click' AND k % 6 = 5)),
cand AS (SELECT n, uuid AS session_uuid, at_ts AS ts, 'unreadable transcript ' || uuid AS message FROM rec
  WHERE et = 'error' AND k % 7 > 1 AND at_ts <= TIMESTAMP '2024-01-24 23:00:00'),
firstc AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY session_uuid ORDER BY n) = 1),
hist AS (SELECT uuid AS session_uuid, n, k, date_trunc('millisecond', ts) AS ts, k % 4 <> 3 AND k % 6 <> 0 AS quiet FROM evs WHERE et = 'view'),
onrec AS (SELECT uuid AS session_uuid, max(at_raw) AS newest_at FROM rec r WHERE et = 'view' AND k % 3 = 0
  AND n > coalesce((SELECT max(n) FROM rec c WHERE c.uuid = r.uuid AND c.et = 'view' AND c.k % 3 = 1), -1) GROUP BY 1)"""
_EMPTY = """CASE WHEN (SELECT count(*) FROM hist h WHERE h.session_uuid = f.session_uuid) > 0
  THEN (SELECT bool_and(quiet) FROM hist h WHERE h.session_uuid = f.session_uuid)
  ELSE (SELECT min(ts) FROM hist) < f.ts AND EXISTS (SELECT 1 FROM evs x WHERE x.uuid = f.session_uuid AND x.u % 2 = 0) END"""


def _log(s: SparkSession, d: str) -> DataFrame:
    return L.log_records(Z.capture_log(s, d))


def _hist(s: SparkSession, d: str) -> DataFrame:
    return L.history_rows(Z.history_lines(s, d))


_add("s08_log_records", lambda s, d: _log(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("records"), F.count("ts").alias("stamped"), F.count("message").alias("with_message")), f"""WITH {_LOG}
SELECT CASE WHEN et = 'error' THEN 'error' WHEN et = 'signup' THEN 'companions-started' WHEN et = 'purchase' THEN 'companions-done'
  WHEN et = 'view' THEN ['unrecoverable', 'unrecoverable-retracted', 'repair-refused'][1 + CAST(k % 3 AS INT)]
  ELSE ['repair-refusal-resolved', 'sweep-started', 'info', 'repair-summary', 'writer-held'][1 + CAST(k % 6 AS INT)] END AS status,
  count(*) AS records, count(at_ts) AS stamped, count(*) FILTER (et = 'error' OR (et = 'view' AND k % 3 = 2) OR (et = 'click' AND k % 6 IN (1, 2, 3))) AS with_message FROM rec GROUP BY 1""")
_add("p15_p16_error_candidates", lambda s, d: H.error_candidates(_log(s, d), NOW).select("line_no", "session_uuid", F.unix_micros("ts").alias("at_us"), "message"), f"""WITH {_LOG}
SELECT n AS line_no, session_uuid, epoch_us(ts) AS at_us, message FROM cand""")
_add("p17_said_nothing", lambda s, d: H.said_nothing(H.error_candidates(_log(s, d), NOW), _hist(s, d), Z.session_ids(s, d, "u % 2 = 0")).select("line_no", "is_empty"), f"""WITH {_LOG}
SELECT n AS line_no, {_EMPTY} AS is_empty FROM cand f""")
_add("j09_unrecoverable", lambda s, d: H.unrecoverable(H.error_candidates(_log(s, d), NOW), Z.session_ids(s, d, "u % 3 = 0"), Z.session_ids(s, d, "b % 3 = 0"),
        Z.event_versions(s, d), _hist(s, d), Z.session_ids(s, d, "u % 2 = 0")).select("line_no", "session_uuid", "message"), f"""WITH {_LOG}
SELECT n AS line_no, session_uuid, message FROM firstc f WHERE EXISTS (SELECT 1 FROM evs x WHERE x.uuid = f.session_uuid AND u % 3 <> 0 AND b % 3 <> 0 AND (u + b) % 4 <> 0) AND NOT {_EMPTY}""")
_add("w08_on_record", lambda s, d: H.on_record(_log(s, d)), f"WITH {_LOG} SELECT * FROM onrec")
_add("a12_known_losses", lambda s, d: H.known_losses(_log(s, d)), f"WITH {_LOG} SELECT count(*) AS losses, max(newest_at) AS newest_at FROM onrec")
_add("j30_retractable", lambda s, d: H.retractable(_log(s, d), NOW, _hist(s, d), Z.session_ids(s, d, "u % 2 = 0")).select("line_no", "session_uuid"), f"""WITH {_LOG}
SELECT n AS line_no, session_uuid FROM firstc f WHERE session_uuid IN (SELECT session_uuid FROM onrec) AND {_EMPTY}""")
_add("w08_open_refusals", lambda s, d: H.open_refusals(_log(s, d)).select("session_uuid", "first_at", F.array_join("messages", "|").alias("messages")), f"""WITH {_LOG},
rf AS (SELECT *, et = 'view' AND k % 3 = 2 AS refused, et = 'click' AND k % 6 = 4 AND at_raw IS NOT NULL AS held FROM rec)
SELECT uuid AS session_uuid, arg_min(coalesce(at_raw, ''), n) AS first_at, coalesce(array_to_string(list_sort(list(DISTINCT 'm' || (k % 4)) FILTER (refused)), '|'), '') AS messages FROM rf r
WHERE (refused OR held) AND n > coalesce((SELECT max(n) FROM rec c WHERE c.uuid = r.uuid AND c.et = 'click' AND c.k % 6 = 0), -1) GROUP BY 1""")
_add("j17_stalled_companions", lambda s, d: H.stalled_companions(
        # Companions of a session are told apart, or each would have finished some time.
        _log(s, d).withColumn("session", F.concat("session", F.lit("/"), F.col("line_no") % 7)), NOW).select("session", F.unix_micros("started_at").alias("started_us")), f"""WITH {_LOG},
w AS (SELECT * REPLACE (session || '/' || n % 7 AS session) FROM rec WHERE at_ts >= TIMESTAMP '2024-01-18')
SELECT session, epoch_us(arg_max(at_ts, n)) AS started_us FROM w WHERE et = 'signup' AND session NOT IN (SELECT session FROM w WHERE et = 'purchase' OR (et = 'error' AND k % 7 = 1))
GROUP BY 1 HAVING arg_max(at_ts, n) <= TIMESTAMP '2024-01-24 23:55:00'""")
_add("w09_job_states", lambda s, d: H.job_states(_log(s, d), NOW).select("job", "state", F.unix_micros("last_start").alias("start_us")), f"""WITH {_LOG},
j AS (SELECT CASE WHEN et = 'error' THEN 'repair' ELSE 'sweep' END AS job, n, at_ts, et = 'click' AND k % 6 = 1 AS st FROM rec
  WHERE (et = 'click' AND k % 6 IN (1, 2)) OR (et = 'error' AND k % 7 = 0)),
p AS (SELECT job, max(n) FILTER (st AND at_ts IS NOT NULL) AS s, arg_max(at_ts, n) FILTER (st AND at_ts IS NOT NULL) AS ls, max(n) FILTER (NOT st) AS c FROM j GROUP BY 1)
SELECT job, CASE WHEN s IS NULL THEN 'never_started' WHEN c > s THEN 'finished' WHEN ls > TIMESTAMP '2024-01-24 23:58:00' THEN 'starting' ELSE 'unfinished' END AS state, epoch_us(ls) AS start_us FROM p""")
_SWEEP = """sw AS (SELECT n, at_ts, k, k % 6 = 1 AS st FROM rec WHERE et = 'click' AND k % 6 IN (1, 2){0}),
lastsw AS (SELECT * FROM sw ORDER BY n DESC LIMIT 1)
SELECT k % 5 AS failed, k AS items, epoch_us(at_ts) AS finished_us FROM lastsw WHERE NOT st AND at_ts IS NOT NULL AND k % 4 <> 3"""
_add("w10_sweep_outcome", lambda s, d: H.latest_sweep_outcome(_log(s, d)).select("failed", "items", F.unix_micros("finished_at").alias("finished_us")),
     f"WITH {_LOG}, " + _SWEEP.format(""))
_add("w11_repair_summary", lambda s, d: H.latest_repair_summary(_log(s, d)), f"""WITH {_LOG}
SELECT n AS line_no, at_raw AS "at", 'refused ' || k AS message FROM rec WHERE et = 'click' AND k % 6 = 3 ORDER BY n DESC LIMIT 1""")
_add("o06_recent_errors", lambda s, d: H.recent_errors(_log(s, d), 20).select("line_no", "at"), f"""WITH {_LOG}
SELECT n AS line_no, at_raw AS "at" FROM rec WHERE et = 'error' ORDER BY n DESC LIMIT 20""")
_add("j26_s09_dead_hook_runs", lambda s, d: H.dead_hook_runs(L.log_records(Z.hook_log(s, d)), Z.event_versions(s, d), _log(s, d), NOW)
        .select("session", F.unix_micros("started_at").alias("started_us"), "severity"), f"""WITH {_LOG},
h AS (SELECT uuid AS session, arg_max(et, n) AS et, arg_max(ts, n) AS ts, any_value(u) AS u, any_value(b) AS b FROM evs WHERE et IN ('view', 'click', 'error') AND ts >= TIMESTAMP '2024-01-18' GROUP BY 1)
SELECT session, epoch_us(ts) AS started_us, CASE WHEN (u + b) % 4 = 0 THEN 'captured'
  WHEN (SELECT max(at_ts) FROM rec WHERE et = 'click' AND k % 6 = 2) > ts THEN 'blocking' ELSE 'warning' END AS severity
FROM h WHERE et = 'view' AND ts <= TIMESTAMP '2024-01-24 23:58:00'""")
_add("j29_pipeline_state", lambda s, d: H.pipeline_state(_log(s, d), NOW), f"""WITH {_LOG}
SELECT session AS short, arg_max(at_ts, n) >= TIMESTAMP '2024-01-24 23:55:00' AS in_flight FROM rec WHERE et IN ('signup', 'purchase') AND at_ts >= TIMESTAMP '2024-01-18' GROUP BY 1""")

# ---- gaps ----------------------------------------------------------------------


def _source(s: SparkSession, d: str) -> DataFrame:
    rows = Z.activity(s, d)
    agent = F.col("u") % 4 == 3
    name = F.when(agent, F.concat(F.lit("agent-"), "session_uuid")).when(F.col("u") % 9 == 0, F.concat("session_uuid", F.lit(".orphaned-1"))).otherwise(F.col("session_uuid"))
    return rows.select(F.concat(F.lit("/live/p/"), name, F.lit(".jsonl")).alias("path"), agent.cast("int").alias("is_subagent"))


_add("j08_uncaptured", lambda s, d: H.uncaptured(_source(s, d), Z.event_versions(s, d), Z.session_ids(s, d, "b % 2 = 0").select(F.col("session_uuid").alias("agent_id"))), f"""WITH {_LOG}
SELECT DISTINCT 'session' AS kind, uuid AS name FROM evs WHERE u % 4 <> 3 AND u % 9 <> 0 AND (u + b) % 4 <> 0
UNION ALL SELECT DISTINCT 'subagent', 'agent-' || uuid FROM evs WHERE u % 4 = 3 AND b % 2 <> 0""")
_add("j18_dispatch_gap", lambda s, d: H.dispatch_gap(Z.activity(s, d), Z.event_versions(s, d), L.log_records(Z.hook_log(s, d)), NOW)
        .select("session_uuid", F.unix_micros("last_ts").alias("last_us")), f"""WITH {_LOG}
SELECT uuid AS session_uuid, epoch_us(max(ts)) AS last_us FROM evs WHERE (u + b) % 4 <> 0 AND uuid NOT IN (SELECT uuid FROM evs WHERE et = 'view' AND ts >= TIMESTAMP '2024-01-18')
GROUP BY 1 HAVING max(ts) >= TIMESTAMP '2024-01-18' AND max(ts) < TIMESTAMP '2024-01-24 23:45:00'""")
_add("j19_overdue", lambda s, d: H.overdue(Z.activity(s, d), Z.event_versions(s, d)).select("session_uuid", F.unix_micros("last_ts").alias("last_us")), f"""WITH {_LOG},
a AS (SELECT uuid, max(ts) AS last, any_value((u + b) % 4 = 0) AS held FROM evs GROUP BY 1)
SELECT uuid AS session_uuid, epoch_us(last) AS last_us FROM a WHERE NOT held AND last < (SELECT max(last) FROM a) - INTERVAL 24 HOUR""")
_add("j16_stranded", lambda s, d: H.stranded(Z.session_ids(s, d, "u % 5 = 0"), Z.session_ids(s, d, "b % 3 = 0"), "session_uuid"), f"""WITH {_LOG}
SELECT DISTINCT uuid AS session_uuid FROM evs WHERE u % 5 = 0 AND b % 3 <> 0""")
_add("s07_history_rows", lambda s, d: _hist(s, d).select("line_no", "session_uuid", F.unix_millis("ts").alias("at_ms"), "display", F.coalesce(F.size("pasted"), F.lit(0)).alias("pastes")), f"""WITH {_LOG}
SELECT n AS line_no, session_uuid, epoch_ms(ts) AS at_ms, CASE WHEN k % 2 = 0 THEN '/quit' WHEN k % 4 = 1 THEN ' /exit ' ELSE 'hello' END AS display, CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS pastes FROM hist""")
_add("j14_known_prompts", lambda s, d: H.known_prompts(_hist(s, d), Z.event_versions(s, d)).select("line_no", "session_uuid"), f"""WITH {_LOG}
SELECT n AS line_no, uuid AS session_uuid FROM evs WHERE et = 'view' AND (u + b) % 4 = 0""")
_add("j15_paste_presence", lambda s, d: H.paste_presence(L.paste_references(_hist(s, d)), L.paste_references(_hist(s, d)).where("substring(content_hash, 2) % 36 = 0").select("content_hash")), f"""WITH {_LOG}
SELECT DISTINCT session_uuid, 'h' || k AS content_hash, CASE WHEN k % 36 = 0 THEN 'present' ELSE 'missing' END AS state FROM hist WHERE k % 12 = 0""")
_add("u03_uuid_sets", lambda s, d: Z.session_ids(s, d, "u % 3 = 0").withColumn("held_by", F.lit("source")).unionByName(
        Z.event_versions(s, d).select("session_uuid").distinct().withColumn("held_by", F.lit("catalogue"))), f"""WITH {_LOG}
SELECT DISTINCT uuid AS session_uuid, 'source' AS held_by FROM evs WHERE u % 3 = 0 UNION ALL SELECT DISTINCT uuid, 'catalogue' FROM evs WHERE (u + b) % 4 = 0""")
_CHK = """ck AS (SELECT user_id AS monitor, ts, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS backlog, event_type IN ('error', 'view', 'click') AS broken FROM events)"""
_add("a97_backlog_growth", lambda s, d: H.backlog_growth(Z.checks(s, d)).select("monitor", "order_us", F.round("per_hour", 3).alias("per_hour")), f"""WITH {_CHK}
SELECT monitor, epoch_us(ts) AS order_us, CASE WHEN h > 0.01 THEN round((backlog - pb) / h, 3) END AS per_hour FROM (
  SELECT *, lag(backlog) OVER w AS pb, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS h FROM ck WINDOW w AS (PARTITION BY monitor ORDER BY ts))""")
_add("w21_a98_outages", lambda s, d: H.outages(Z.checks(s, d)).select("monitor", "order_us", F.unix_micros("broken_since").alias("since_us"), "tier"), f"""WITH {_CHK},
f AS (SELECT *, NOT coalesce(lag(broken) OVER w AND ts - lag(ts) OVER w <= INTERVAL 3600 SECOND, FALSE) AS fresh FROM ck WINDOW w AS (PARTITION BY monitor ORDER BY ts)),
g AS (SELECT monitor, ts, broken, max(CASE WHEN broken AND fresh THEN ts END) OVER (PARTITION BY monitor ORDER BY ts ROWS UNBOUNDED PRECEDING) AS since FROM f)
SELECT monitor, epoch_us(ts) AS order_us, epoch_us(since) AS since_us, CASE WHEN ts - since < INTERVAL 1800 SECOND THEN 0 WHEN ts - since < INTERVAL 7200 SECOND THEN 1 ELSE 2 END AS tier FROM g WHERE broken""")

# ---- folders -------------------------------------------------------------------
_FOLD = """ch AS (SELECT doc_id AS d, '/archive/label' || (doc_id // 20 % 9) || '/20240101-000000+0000_f' || (doc_id // 20) AS folder, 'c' || doc_id AS name, text, doc_id // 20 AS f FROM documents),
rc AS (SELECT folder, name, sha256(text) AS sha, strlen(text) AS bytes, d FROM ch WHERE d % 5 <> 0 AND f % 7 <> 6),
lv AS (SELECT folder, name, d, sha256(CASE WHEN d % 9 = 0 THEN text || 'more' WHEN d % 11 = 0 THEN 'x' || text ELSE text END) AS sha,
  strlen(CASE WHEN d % 9 = 0 THEN text || 'more' WHEN d % 11 = 0 THEN 'x' || text ELSE text END) AS bytes FROM ch WHERE d % 7 <> 0)"""


def _man(s: SparkSession, d: str) -> DataFrame:
    return L.manifests(Z.manifest_documents(s, d))


def _recorded(s: SparkSession, d: str) -> DataFrame:
    return L.manifest_children(_man(s, d), "subagents", "agent_id")


def _live_known(s: SparkSession, d: str) -> DataFrame:
    """Live children of folders whose manifest can be read."""
    return Z.live_children(s, d).join(_man(s, d).select("folder"), "folder", "left_semi")


_PROB = """prob AS (SELECT rc.folder, rc.name, CASE WHEN lv.name IS NULL THEN 'sub-agent ' || rc.name || ' is missing' ELSE 'sub-agent ' || rc.name || ' does not match its hash' END AS problem
  FROM rc LEFT JOIN lv USING (folder, name) WHERE lv.name IS NULL OR lv.sha <> rc.sha)"""
_add("s10_a87_prompt_coverage", lambda s, d: H.prompt_coverage(_man(s, d)), f"""WITH {_FOLD}, m AS (SELECT folder, min(d) AS d FROM ch WHERE d % 5 <> 0 AND f % 7 <> 6 GROUP BY 1)
SELECT count(*) AS sessions_total, count(*) FILTER (d % 3 = 0) AS with_prompts, count(*) FILTER (d % 2 = 0) AS with_pastes FROM m""")
_add("j23_child_problems", lambda s, d: G.child_problems(_recorded(s, d), Z.live_children(s, d), "sub-agent"), f"WITH {_FOLD}, {_PROB} SELECT * FROM prob")
_add("j24_kept_records", lambda s, d: G.kept_records(_recorded(s, d), _live_known(s, d), True), f"""WITH {_FOLD}, l2 AS (SELECT * FROM lv WHERE d // 20 % 7 <> 6 AND folder IN (SELECT folder FROM rc))
SELECT coalesce(rc.folder, l2.folder) AS folder, coalesce(rc.name, l2.name) AS name,
  CASE WHEN l2.name IS NULL OR (rc.sha <> l2.sha AND l2.d % 9 <> 0) THEN rc.sha ELSE l2.sha END AS sha256,
  CASE WHEN l2.name IS NULL OR (rc.sha <> l2.sha AND l2.d % 9 <> 0) THEN rc.bytes ELSE l2.bytes END AS bytes,
  CASE WHEN rc.name IS NULL THEN 'added' WHEN l2.name IS NULL THEN 'vanished_kept' WHEN rc.sha = l2.sha THEN 'same' WHEN l2.d % 9 = 0 THEN 'grown' ELSE 'changed_kept' END AS reason
FROM rc FULL OUTER JOIN l2 ON rc.folder = l2.folder AND rc.name = l2.name""")


def _pages_of(s: SparkSession, d: str) -> DataFrame:
    """Generated files present: every folder lacks one in five of them."""
    f = _man(s, d).select("folder", F.posexplode(F.array(*[F.lit(n) for n in G.GENERATED])).alias("i", "name"))
    return f.where((F.regexp_extract("folder", r"(\d+)$", 1).cast("bigint") + F.col("i")) % 5 != 0).select("folder", "name")


def _payload_of(s: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("folder", r"(\d+)$", 1).cast("bigint")
    return _man(s, d).where(n % 8 != 0).select("folder", F.sha2(F.when(n % 4 == 1, F.concat("folder", F.lit("!"))).otherwise(F.col("folder")), 256).alias("sha256"))


def _named(s: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("folder", r"(\d+)$", 1).cast("bigint")
    return _man(s, d).select("folder", F.timestamp_seconds(F.lit(1704067200) + F.when(n % 6 == 0, 3600).otherwise(0)).alias("first_at"), F.concat(F.lit("f"), n).alias("session_uuid"))


def _problems(s: SparkSession, d: str) -> DataFrame:
    return G.folder_report(
        G.child_problems(_recorded(s, d), Z.live_children(s, d), "sub-agent"), G.missing_pages(_man(s, d), _pages_of(s, d)),
        G.payload_problems(_man(s, d), _payload_of(s, d)), G.name_problems(_named(s, d), "UTC"))


_REPORT = _PROB + """,
mf AS (SELECT DISTINCT folder, f FROM ch WHERE d % 5 <> 0 AND f % 7 <> 6),
allp AS (SELECT * FROM prob
  UNION ALL SELECT folder, g.name, 'missing ' || g.name FROM mf JOIN (SELECT unnest(['transcript.md', 'transcript.compact.md', 'conversation.html', 'conversation.compact.html', 'manifest.json']) AS name, unnest(range(5)) AS i) g ON (f + i) % 5 = 0
  UNION ALL SELECT folder, '', CASE WHEN f % 8 = 0 THEN 'no session payload in the folder' ELSE 'payload does not match its manifest' END FROM mf WHERE f % 8 = 0 OR f % 4 = 1
  UNION ALL SELECT folder, '', 'folder name disagrees with its payload: want 20240101-010000+0000_f' || f FROM mf WHERE f % 6 = 0)"""
_add("j28_f39_folder_report", _problems, f"WITH {_FOLD}, {_REPORT} SELECT folder, name, problem FROM allp")


def _explained(s: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("folder", r"(\d+)$", 1).cast("bigint")
    head = _man(s, d).select("folder", (n % 3 == 0).alias("payload_is_head"), (n % 2 == 0).alias("grew"), F.concat(F.lit("s"), n % 10).alias("short"))
    pipeline = s.range(10).select(F.concat(F.lit("s"), "id").alias("short"), (F.col("id") % 2 == 0).alias("in_flight"))
    return G.explain_problems(_problems(s, d), head, pipeline)


_add("j29_explain_problems", _explained, f"""WITH {_FOLD}, {_REPORT},
q AS (SELECT p.folder, p.name, p.problem, f, p.problem = 'payload does not match its manifest' AND f % 3 = 0 AS recap FROM allp p JOIN mf USING (folder))
SELECT folder, count(*) AS problems, CASE WHEN bool_and((starts_with(problem, 'missing ') OR recap) AND f % 10 % 2 = 0) THEN 'pending'
  WHEN bool_and((starts_with(problem, 'missing ') AND name <> 'manifest.json') OR recap OR (starts_with(problem, 'sub-agent') AND ends_with(problem, 'hash') AND f % 2 = 0)) THEN 'explained' ELSE 'unexplained' END AS verdict
FROM q GROUP BY folder""")
_add("j32_unvouched_copies", lambda s, d: G.unvouched_copies(Z.live_children(s, d), Z.payloads(s, d).select(F.col("hash").alias("sha256"))), f"""WITH {_FOLD}
SELECT folder, count(*) AS unvouched FROM lv WHERE sha NOT IN (SELECT sha256(text) FROM documents) GROUP BY 1""")


def _snapshot(s: SparkSession, d: str, after: bool) -> DataFrame:
    rows = Z.payloads(s, d).select(F.concat(F.lit("/t/"), "id").alias("path"), F.when(F.col("id") % 2 == 0, "archive").otherwise("live").alias("tree"), "size_bytes", F.col("hash").alias("sha256"), F.col("id").alias("modified"), "id")
    if not after:
        return rows.where("id % 3 = 0")
    return rows.where("id % 3 = 0 and id % 10 <> 0 or id % 3 = 1 and id % 2 = 1").withColumns({
        "sha256": F.when(F.col("id") % 7 == 0, F.lit("x")).otherwise(F.col("sha256")),
        "modified": F.when(F.col("id") % 11 == 0, F.lit(-1)).otherwise(F.col("modified"))})


_add("j27_compare_snapshots", lambda s, d: G.compare_snapshots(_snapshot(s, d, False), _snapshot(s, d, True)), """
SELECT '/t/' || doc_id AS item, CASE WHEN doc_id % 10 = 0 THEN 'vanished' ELSE 'changed' END AS failure FROM documents WHERE doc_id % 3 = 0 AND (doc_id % 10 = 0 OR doc_id % 7 = 0 OR doc_id % 11 = 0)
UNION ALL SELECT 'archive', 'shrank'""")


def _sidecars(s: SparkSession, d: str) -> DataFrame:
    rows = Z.keyed_events(s, d).where("et = 'view' and k % 10 < 3")
    body = F.to_json(F.struct(F.when(F.col("k") % 10 == 0, F.array(F.concat(F.lit("n"), "k"))).alias("unarchived"), F.when(F.col("k") % 10 == 1, F.array(F.lit("odd"))).alias("refused")))
    return rows.select(F.concat(F.lit("/a/"), "uuid", F.lit("/sidecars.json")).alias("path"), body.alias("raw"))


_add("s11_a86_sidecar_coverage", lambda s, d: H.sidecar_coverage(L.sidecar_notices(_sidecars(s, d))), f"""WITH {_LOG},
nm AS (SELECT DISTINCT '/a/' || uuid AS folder, CASE WHEN k % 10 = 0 THEN 'n' || k ELSE 'odd' END AS name FROM evs WHERE et = 'view' AND k % 10 < 2),
p AS (SELECT folder, string_agg(name, ', ' ORDER BY name) AS names FROM nm GROUP BY 1)
SELECT count(*) AS folders, arg_min(folder || ': ' || names, folder) AS first_example FROM p""")


def _beside(s: SparkSession, d: str) -> DataFrame:
    """Entries of project folders: a sidecar folder per customer, a transcript beside two thirds of them, and odd files."""
    i = F.col("c_custkey")
    parent = F.concat(F.lit("/p/"), F.col("c_nationkey"))
    rows = table(s, d, "customer").select(
        parent.alias("parent"),
        F.inline(F.array(
            F.struct(F.concat(F.lit("u"), i).alias("name"), F.lit(True).alias("is_dir")),
            F.struct(F.when(i % 3 != 0, F.concat(F.lit("u"), i, F.lit(".jsonl"))).alias("name"), F.lit(False).alias("is_dir")),
            F.struct(F.when(i % 7 == 2, F.concat(F.lit("notes"), i, F.lit(".txt"))).alias("name"), F.lit(False).alias("is_dir")),
            F.struct(F.when(i % 5 == 1, F.lit("memory")).alias("name"), F.lit(True).alias("is_dir")),
            F.struct(F.when(i % 5 == 2, F.lit(".DS_Store")).alias("name"), F.lit(False).alias("is_dir")))))
    return rows.where("name is not null").distinct()


_add("a86_sidecar_gap", lambda s, d: H.sidecar_gap(L.sidecar_notices(_sidecars(s, d)), _beside(s, d)), f"""WITH {_LOG},
nm AS (SELECT DISTINCT '/a/' || uuid AS folder, CASE WHEN k % 10 = 0 THEN 'n' || k ELSE 'odd' END AS name FROM evs WHERE et = 'view' AND k % 10 < 2),
p AS (SELECT folder, string_agg(name, ', ' ORDER BY name) AS names FROM nm GROUP BY 1)
SELECT count(*) AS folders, arg_min(folder || ': ' || names, folder) AS first_example, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS stranded,
  (SELECT count(*) FROM customer WHERE c_custkey % 7 = 2) AS strays FROM p""")
_NAMES = "['subagents', 'tool-results', '.DS_Store', 'agent-x1.jsonl', 'notes.txt', 'memory', 'agent-y.meta.json']"


def _siblings(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    names = ["subagents", "tool-results", ".DS_Store", "agent-x1.jsonl", "notes.txt", "memory", "agent-y.meta.json"]
    return Z.keyed_events(s, d).select(
        F.col("uuid").alias("parent"), F.element_at(F.array(*[F.lit(n) for n in names]), (k % 7 + 1).cast("int")).alias("name"),
        (k % 7 < 2).alias("is_dir"), F.element_at(F.array(F.lit("session"), F.lit("subagents"), F.lit("project")), (F.col("u") % 3 + 1).cast("int")).alias("level"))


_add("p20_sibling_names", lambda s, d: G.sibling_names(_siblings(s, d)).groupBy("kind", "level", "name").agg(F.count(F.lit(1)).alias("n")), f"""WITH {_LOG},
x AS (SELECT {_NAMES}[1 + CAST(k % 7 AS INT)] AS name, k % 7 < 2 AS dir, ['session', 'subagents', 'project'][1 + CAST(u % 3 AS INT)] AS level FROM evs),
y AS (SELECT level, name, CASE WHEN name = '.DS_Store' THEN NULL WHEN level = 'session' AND name IN ('subagents', 'tool-results') THEN 'known' WHEN level = 'session' THEN 'unknown'
  WHEN level = 'subagents' AND name NOT IN ('agent-x1.jsonl', 'agent-y.meta.json') THEN 'unknown_inside_subagents'
  WHEN level = 'project' AND NOT dir AND name <> 'memory' AND name <> 'agent-x1.jsonl' THEN 'stray_file' END AS kind FROM x)
SELECT kind, level, name, count(*) AS n FROM y WHERE kind IS NOT NULL GROUP BY ALL""")


def _store_files(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    path = (
        F.when(k % 4 == 0, F.concat(F.lit("/h/file-history/"), "uuid", F.lit("/f"), "event_id"))
        .when(k % 4 == 1, F.concat(F.lit("/h/todos/"), "uuid", F.lit("-agent.json")))
        .when(k % 4 == 2, F.concat(F.lit("/h/todos/readme"), "event_id"))
        .otherwise(F.concat(F.lit("/h/other/"), "event_id")))
    return Z.keyed_events(s, d).select(path.alias("path"))


_add("s15_stores_by_session", lambda s, d: L.stores_by_session(_store_files(s, d)), f"""WITH {_LOG}
SELECT CASE WHEN k % 4 = 0 THEN 'file-history' ELSE 'todos' END AS store, uuid AS session_uuid, count(*) AS files FROM evs WHERE k % 4 < 2 GROUP BY 1, 2""")
_add("f42_unrouted_store_files", lambda s, d: L.unrouted_store_files(_store_files(s, d)), f"""WITH {_LOG}
SELECT '/h/todos/readme' || n AS path FROM evs WHERE k % 4 = 2""")
