"""Log state machines, loss detection and gap checks.

``records`` is what ``sources.logs.log_records`` returns. Log order is
``line_no``: the logs are append-only, so file order is write order. ``now`` is
always a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import variants as V

from threadline.operators.integrity import IGNORED_NAMES, PROJECT_KNOWN
from threadline.operators.ordered import previous_row, running_max, top_per_key

# Message prefixes of errors that name no lost session.
EXCLUDED_PREFIXES = [
    "repair: ", "companions: ", "post-archive-write failure at ", "could not read sidecar ",
    "refused sidecar ", "sweep: ", "build: ", "archive: ",
]
# Inputs of a session that said nothing.
EMPTY_INPUTS = ["/quit", "/exit"]
UUID_PATTERN = "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"

# Time limits in seconds.
ERROR_GRACE = 3600
LOG_WINDOW = 7 * 86400
COMPANIONS_GRACE = 300
DISPATCH_GRACE = 900
HOOK_GRACE = 120
OVERDUE = 86400
JOB_GRACE = 120
CONTINUITY = 3600
WARN_AFTER, ALERT_AFTER = 1800, 7200
# Width in microseconds of the time chunks an ordered pass over checks is cut into.
CHECK_CHUNK = 3_600_000_000


def _at(now: str) -> Column:
    return F.lit(now).cast("timestamp")


def _ago(now: str, seconds: int) -> Column:
    return _at(now) - F.make_interval(secs=F.lit(seconds))


# ---- losses -----------------------------------------------------------------


def identity(session_uuid: Column, message: Column) -> Column:
    """The session a record names: its own field, else the first id in the text."""
    return F.coalesce(
        F.nullif(session_uuid, F.lit("")), F.nullif(F.regexp_extract(message, UUID_PATTERN, 0), F.lit(""))
    )


def error_candidates(records: DataFrame, now: str, since: str | None = None) -> DataFrame:
    """Errors that may stand for a lost session: ``line_no, session_uuid, ts, message``."""
    excluded = F.lit(False)
    for prefix in EXCLUDED_PREFIXES:
        excluded = excluded | F.coalesce(F.col("message").startswith(prefix), F.lit(False))
    named = records.where((F.col("status") == "error") & ~excluded).select(
        "line_no",
        identity(F.col("session_uuid"), F.col("message")).alias("session_uuid"),
        "ts",
        F.coalesce("message", F.lit("(no detail)")).alias("message"),
    )
    aged = named.where(F.col("session_uuid").isNotNull() & (F.col("ts") <= _ago(now, ERROR_GRACE)))
    return aged.where(F.col("ts") >= _at(since)) if since else aged


def said_nothing(findings: DataFrame, history: DataFrame | None, environments: DataFrame) -> DataFrame:
    """Findings with ``is_empty``: proof that the session never held any input.

    Every doubt means not empty. Without history rows, the history must reach
    back before the finding and the session's environment folder must exist.
    """
    if history is None:
        return findings.withColumn("is_empty", F.lit(False))
    quiet = F.coalesce(V.strip(F.col("display")).isin(EMPTY_INPUTS), F.lit(False)) & (
        F.col("pasted").isNull() | (F.size("pasted") == 0)
    )
    inputs = history.groupBy("session_uuid").agg(F.min(quiet.cast("int")).alias("_quiet"))
    known = environments.select("session_uuid", F.lit(True).alias("_env")).distinct()
    oldest = history.agg(F.min("ts")).scalar()
    joined = findings.join(inputs, "session_uuid", "left").join(known, "session_uuid", "left")
    covered = F.coalesce(oldest < F.col("ts"), F.lit(False)) & F.coalesce("_env", F.lit(False))
    verdict = F.when(F.col("_quiet").isNull(), covered).otherwise(F.col("_quiet") == 1)
    return joined.withColumn("is_empty", verdict).drop("_quiet", "_env")


def unrecoverable(
    candidates: DataFrame, source: DataFrame, archived: DataFrame, versions: DataFrame,
    history: DataFrame | None, environments: DataFrame,
) -> DataFrame:
    """Candidates missing from source tree, archive AND catalogue, first per session, not provably empty.

    Candidates are few next to the three inventories, so they are reduced to
    one row per session before anything is joined.
    """
    first = top_per_key(candidates, ["session_uuid"], [F.col("line_no")])
    lost = first
    for held in (source, archived, versions):
        lost = lost.join(held.select("session_uuid"), "session_uuid", "left_anti")
    return said_nothing(lost, history, environments).where(~F.col("is_empty")).drop("is_empty")


def _after_last_close(records: DataFrame, closing: Column) -> DataFrame:
    """Records of each session that follow its last closing record."""
    ends = records.groupBy("session_uuid").agg(F.max(F.when(closing, F.col("line_no"))).alias("_end"))
    return records.join(ends, "session_uuid").where("_end is null or line_no > _end").drop("_end")


def on_record(records: DataFrame) -> DataFrame:
    """Sessions now on record as unrecoverable: ``session_uuid, newest_at``."""
    mine = records.where(
        F.col("session_uuid").isNotNull() & F.col("status").isin("unrecoverable", "unrecoverable-retracted")
    )
    still = _after_last_close(mine, F.col("status") == "unrecoverable-retracted")
    return still.where("status = 'unrecoverable'").groupBy("session_uuid").agg(F.max("at").alias("newest_at"))


def retractable(
    records: DataFrame, now: str, history: DataFrame | None, environments: DataFrame
) -> DataFrame:
    """Losses on record that are now provably empty, judged on their earliest error."""
    first = top_per_key(error_candidates(records, now), ["session_uuid"], [F.col("line_no")])
    listed = first.join(on_record(records).select("session_uuid"), "session_uuid", "left_semi")
    return said_nothing(listed, history, environments).where("is_empty").drop("is_empty")


def open_refusals(records: DataFrame) -> DataFrame:
    """Refused sessions not seen clean since: ``session_uuid, first_at, messages``."""
    opens = (F.col("status") == "repair-refused") | ((F.col("status") == "writer-held") & F.col("at").isNotNull())
    closes = F.col("status") == "repair-refusal-resolved"
    mine = records.where(F.col("session_uuid").isNotNull() & (opens | closes))
    return _after_last_close(mine, closes).where(opens).groupBy("session_uuid").agg(
        F.min_by(F.coalesce("at", F.lit("")), F.col("line_no")).alias("first_at"),
        F.sort_array(F.collect_set(F.when(F.col("status") == "repair-refused", F.col("message")))).alias("messages"),
    )


def known_losses(records: DataFrame) -> DataFrame:
    """Confirmed losses and the time of the newest one."""
    return on_record(records).agg(F.count(F.lit(1)).alias("losses"), F.max("newest_at").alias("newest_at"))


# ---- started without finished -----------------------------------------------


def stalled_companions(records: DataFrame, now: str) -> DataFrame:
    """Companion passes that started in the window, passed the grace and reported nothing."""
    recent = records.where(F.col("session").isNotNull() & (F.col("ts") >= _ago(now, LOG_WINDOW)))
    started = recent.where("status = 'companions-started'").groupBy("session").agg(
        F.max_by("ts", "line_no").alias("started_at")
    )
    ended = recent.where(
        (F.col("status") == "companions-done")
        | ((F.col("status") == "error") & F.coalesce(F.col("message").startswith("companions: "), F.lit(False)))
    ).select("session")
    aged = started.where(F.col("started_at") <= _ago(now, COMPANIONS_GRACE))
    return aged.join(ended, "session", "left_anti")


def job_states(records: DataFrame, now: str) -> DataFrame:
    """State of each scheduled job: finished, starting or unfinished, from its last start."""
    started = F.regexp_extract("status", "^(sweep|repair|archive)-started$", 1)
    closed = F.regexp_extract("message", "^(sweep|repair|archive): ", 1)
    lines = records.where(F.col("message").isNotNull()).select(
        F.coalesce(F.nullif(started, F.lit("")), F.nullif(closed, F.lit(""))).alias("job"),
        (started != "").alias("is_start"),
        "line_no",
        "ts",
    )
    begun = F.col("is_start") & F.col("ts").isNotNull()
    per = lines.where("job is not null").groupBy("job").agg(
        F.max_by(F.when(begun, F.col("ts")), F.when(begun, F.col("line_no"))).alias("last_start"),
        F.max(F.when(begun, F.col("line_no"))).alias("_start"),
        F.max(F.when(~F.col("is_start"), F.col("line_no"))).alias("_close"),
    )
    state = (
        F.when(F.col("_start").isNull(), "never_started")
        .when(F.col("_close") > F.col("_start"), "finished")
        .when(F.col("last_start") > _ago(now, JOB_GRACE), "starting")
        .otherwise("unfinished")
    )
    return per.select("job", "last_start", state.alias("state"))


def latest_sweep_outcome(records: DataFrame, running: bool = False) -> DataFrame:
    """``failed, items, finished_at`` of the last finished sweep, empty when a later start voids it."""
    is_start = F.col("status") == "sweep-started"
    is_end = ~is_start & F.coalesce(F.col("message").startswith("sweep: "), F.lit(False))
    lines = records.select("line_no", "at", "ts", "message", is_start.alias("s"), is_end.alias("e")).where("s or e")
    if running:
        # The run in progress does not count: look only at what came before its start.
        last_start = lines.agg(F.max(F.when(F.col("s"), F.col("line_no")))).scalar()
        last_end = lines.agg(F.max(F.when(F.col("e"), F.col("line_no")))).scalar()
        in_progress = F.coalesce(last_start, F.lit(-1)) > F.coalesce(last_end, F.lit(-1))
        lines = lines.where(~in_progress | (F.col("line_no") < last_start))
    last = lines.agg(
        F.max_by(F.struct("s", "message", "ts"), "line_no").alias("x")
    ).select("x.*")
    pattern = r"^sweep: (\d+) items, .*?(\d+) failed"
    good = last.where(
        ~F.col("s") & F.col("message").rlike(pattern) & F.col("ts").isNotNull() & ~F.col("message").contains("; stopped:")
    )
    number = lambda i: F.regexp_extract("message", pattern, i).cast("bigint")
    return good.select(number(2).alias("failed"), number(1).alias("items"), F.col("ts").alias("finished_at"))


def latest_repair_summary(records: DataFrame) -> DataFrame:
    last = records.where("status = 'repair-summary'").agg(
        F.max_by(F.struct("line_no", "at", "message"), "line_no").alias("x")
    )
    return last.where("x is not null").select("x.*")


def dead_hook_runs(
    hook_records: DataFrame, versions: DataFrame, capture_records: DataFrame, now: str, writer: str = "session-hook"
) -> DataFrame:
    """Hook runs that started and never ended, with a severity.

    A run whose session is catalogued is ``captured``; one that a completed
    sweep has missed since is ``blocking``; any other is a ``warning``. Records
    of another ``writer`` than the hook do not count; a record without one does.
    """
    mine = hook_records.where(
        (F.coalesce("source", F.lit(writer)) == writer)
        & F.col("session").isNotNull()
        & (F.col("ts") >= _ago(now, LOG_WINDOW))
        & (F.col("status").isNull() | (F.col("status") != "dispatched"))
    )
    last = mine.groupBy("session").agg(F.max_by(F.struct("status", "ts", "detail"), "line_no").alias("x"))
    dead = last.where((F.col("x.status") == "started") & (F.col("x.ts") <= _ago(now, HOOK_GRACE))).select(
        "session", F.col("x.ts").alias("started_at"), F.col("x.detail").alias("detail")
    )
    held = versions.select(F.col("session_uuid").alias("session"), F.lit(True).alias("_held")).where("session is not null").distinct()
    swept = capture_records.where(F.col("message").rlike(r"^sweep: \d+ items")).agg(F.max("ts")).scalar()
    joined = dead.join(held, "session", "left")
    severity = (
        F.when(F.col("_held"), "captured")
        .when(F.coalesce(swept > F.col("started_at"), F.lit(False)), "blocking")
        .otherwise("warning")
    )
    return joined.withColumn("severity", severity).drop("_held")


def pipeline_state(records: DataFrame, now: str) -> DataFrame:
    """Per session short key: whether its render is still on the way (``in_flight``)."""
    done = F.col("status") == "render-done"
    moving = F.col("status").isin("companions-started", "companions-done") | (
        (F.col("status") == "ok") & F.coalesce(F.col("message") == "captured", F.lit(False))
    )
    mine = records.where(F.col("session").isNotNull() & (done | moving) & (F.col("ts") >= _ago(now, LOG_WINDOW)))
    last = mine.groupBy("session").agg(F.max_by(F.struct(moving.alias("moving"), "ts"), "line_no").alias("x"))
    return last.select(
        F.col("session").alias("short"),
        (F.col("x.moving") & (F.col("x.ts") >= _ago(now, COMPANIONS_GRACE))).alias("in_flight"),
    )


# ---- gaps -------------------------------------------------------------------


def uncaptured(source: DataFrame, versions: DataFrame, archived_agents: DataFrame) -> DataFrame:
    """Source sessions with no catalogue row and sub-agents with no archive folder: ``kind, name``."""
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    named = source.select(stem.alias("name"), "is_subagent")
    sessions = named.where((F.col("is_subagent") == 0) & F.col("name").rlike(f"^{UUID_PATTERN}$")).join(
        versions.select(F.col("session_uuid").alias("name")), "name", "left_anti"
    )
    agents = named.where("is_subagent = 1").withColumn("agent_id", F.regexp_replace("name", "^[^-]*-", ""))
    open_agents = agents.join(archived_agents.select("agent_id"), "agent_id", "left_anti")
    return sessions.select(F.lit("session").alias("kind"), "name").unionByName(
        open_agents.select(F.lit("subagent").alias("kind"), "name")
    )


def dispatch_gap(activity: DataFrame, versions: DataFrame, hook_records: DataFrame, now: str) -> DataFrame:
    """Uncaptured sessions the hook never saw, last active inside the window but past the grace."""
    started = hook_records.where(
        (F.col("status") == "started") & F.col("session").isNotNull()
        & (F.col("ts").isNull() | (F.col("ts") >= _ago(now, LOG_WINDOW)))
    ).select(F.col("session").alias("session_uuid"))
    recent = activity.where(
        (F.col("last_ts") >= _ago(now, LOG_WINDOW)) & (F.col("last_ts") < _ago(now, DISPATCH_GRACE))
    )
    return recent.join(versions.select("session_uuid"), "session_uuid", "left_anti").join(
        started, "session_uuid", "left_anti"
    )


def overdue(activity: DataFrame, versions: DataFrame) -> DataFrame:
    """Uncaptured sessions a day behind the newest activity of the corpus.

    The anchor is payload time, never the clock: other sessions have moved on
    while this one stayed uncaptured.
    """
    left = activity.join(versions.select("session_uuid"), "session_uuid", "left_anti").join(
        versions.select("hash"), "hash", "left_anti"
    ).where("last_ts is not null")
    newest_left = left.agg(F.max("last_ts")).scalar()
    newest_held = versions.agg(F.max(F.col("first_ts").try_cast("timestamp"))).scalar()
    anchor = F.greatest(newest_left, newest_held)
    return left.where(F.col("last_ts") < anchor - F.make_interval(secs=F.lit(OVERDUE)))


def stranded(names: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """Side stores whose session has no transcript."""
    return names.join(sessions.select(key), key, "left_anti")


def orphans(objects: DataFrame, versions: DataFrame) -> DataFrame:
    """Stored objects with no catalogue row."""
    return objects.join(versions.select(F.col("hash").alias("address")), "address", "left_anti")


def verify_store(objects: DataFrame, versions: DataFrame) -> DataFrame:
    """Both directions of store against catalogue: ``address, action``, good pairs left out."""
    held = objects.select("address", "actual", F.lit(True).alias("_stored"))
    rows = versions.select(F.coalesce("hash", F.lit("<null>")).alias("address"), F.lit(True).alias("_row")).distinct()
    both = held.join(rows, "address", "full_outer")
    action = (
        F.when(F.col("_stored").isNull() & ~F.col("address").rlike("^[0-9a-f]{64}$"), "malformed")
        .when(F.col("_stored").isNull(), "missing")
        .when(F.col("actual").isNull(), "unreadable")
        .when(F.col("actual") != F.col("address"), "corrupted")
        .when(F.col("_row").isNull(), "orphan")
    )
    return both.withColumn("action", action).where("action is not null").select("address", "action")


def paste_presence(references: DataFrame, store: DataFrame) -> DataFrame:
    """Each referenced paste with whether its text is still in the store."""
    held = store.select("content_hash", F.lit(True).alias("_held")).distinct()
    return references.join(held, "content_hash", "left").select(
        "session_uuid", "content_hash", F.when(F.col("_held"), "present").otherwise("missing").alias("state")
    )


def known_prompts(history: DataFrame, versions: DataFrame) -> DataFrame:
    """Prompt rows of catalogued sessions."""
    return history.join(versions.select("session_uuid"), "session_uuid", "left_semi")


# ---- coverage and trends ----------------------------------------------------


def sidecar_coverage(notices: DataFrame) -> DataFrame:
    """Folders with uncopied names, and the first of them."""
    per = notices.groupBy("folder").agg(F.sort_array(F.collect_set("name")).alias("names"))
    return per.agg(
        F.count(F.lit(1)).alias("folders"),
        F.min_by(F.concat("folder", F.lit(": "), F.array_join("names", ", ")), "folder").alias("first_example"),
    )


def sidecar_gap(notices: DataFrame, beside: DataFrame) -> DataFrame:
    """What nothing copies, corpus-wide: ``folders, first_example, stranded, strays``.

    ``beside`` is every entry of the project folders, ``parent, name, is_dir``.
    Kept apart because they have different owners: archive folders whose notice
    names something uncopied; ``stranded`` folders with no transcript of their
    name beside them; ``strays``, files that are no transcript and have no
    expected name.
    """
    expected = [*IGNORED_NAMES, *PROJECT_KNOWN]
    names = beside.where(~F.col("name").isin(expected))
    transcripts = beside.where(~F.col("is_dir") & F.col("name").endswith(".jsonl")).select("parent", F.regexp_replace("name", r"\.jsonl$", "").alias("name"))
    stranded = names.where("is_dir").join(transcripts, ["parent", "name"], "left_anti").agg(F.count(F.lit(1)).alias("stranded"), F.lit(1).alias("_one"))
    strays = names.where(~F.col("is_dir") & ~F.col("name").endswith(".jsonl")).agg(F.count(F.lit(1)).alias("strays"), F.lit(1).alias("_one"))
    return sidecar_coverage(notices).withColumn("_one", F.lit(1)).join(stranded, "_one").join(strays, "_one").drop("_one")


def prompt_coverage(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("sessions_total"),
        F.count(F.when(F.col("has_prompts"), 1)).alias("with_prompts"),
        F.count(F.when(F.col("n_pastes") > 0, 1)).alias("with_pastes"),
    )


def stored_totals(versions: DataFrame) -> DataFrame:
    return versions.agg(F.count(F.lit(1)).alias("sessions"), F.sum("size_bytes").alias("stored_bytes"))


def outcome_counts(outcomes: DataFrame, column: str = "action") -> DataFrame:
    return outcomes.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def unchanged_event(outcomes: DataFrame, at: str) -> DataFrame:
    """One event for all unchanged items of a run, instead of one per item."""
    return outcomes.where(F.col("action") == "skipped_unchanged").agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(
        F.lit("sweep-unchanged").alias("action"), F.lit(None).cast("string").alias("session_hash"),
        F.concat(F.col("n"), F.lit(" unchanged")).alias("detail"), F.lit(at).alias("at"),
    )


def unreadable_heads(head: DataFrame, files: DataFrame) -> DataFrame:
    """Heads without a session id whose payload file is absent: counts and the first example."""
    bare = head.where("session_uuid is null")
    found = files.select("path", F.lit(True).alias("_found")).distinct()
    joined = bare.join(found, "path", "left")
    gone = F.col("_found").isNull()
    shown = gone & (F.col("hidden") == 0)
    return joined.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count(F.when(shown, 1)).alias("visible_missing"),
        F.count(F.when(gone & (F.col("hidden") != 0), 1)).alias("hidden_missing"),
        F.min(F.when(shown, F.col("path"))).alias("first_example"),
    )


def backlog_growth(checks: DataFrame, key: str = "monitor") -> DataFrame:
    """Items per hour since the previous check; NULL for the first and below about 36 seconds."""
    seen = previous_row(checks, [key], "order_us", ["ts", "backlog"], CHECK_CHUNK)
    hours = (F.unix_micros("ts") - F.unix_micros("prev_ts")) / F.lit(3.6e9)
    rate = F.when(hours > 0.01, (F.col("backlog") - F.col("prev_backlog")) / hours)
    return seen.select(*checks.columns, rate.alias("per_hour"))


def outages(checks: DataFrame, key: str = "monitor") -> DataFrame:
    """``broken_since`` of every failing check.

    A failing check carries the outage of the one before it if that failed too,
    no longer than the continuity limit ago.
    """
    seen = previous_row(checks, [key], "order_us", ["ts", "broken"], CHECK_CHUNK)
    gap = F.unix_micros("ts") - F.unix_micros("prev_ts")
    carried = F.coalesce(F.col("prev_broken") & (gap <= CONTINUITY * 1_000_000), F.lit(False))
    opened = seen.withColumn("_open", F.when(F.col("broken") & ~carried, F.col("ts")))
    tracked = running_max(opened, [key], "order_us", F.col("_open"), "_since", CHECK_CHUNK)
    since = F.coalesce("_open", "_since")
    failing = tracked.where("broken").withColumn("broken_since", since)
    seconds = (F.unix_micros("ts") - F.unix_micros("broken_since")) / F.lit(1e6)
    return failing.select(*checks.columns, "broken_since", severity_tier(seconds).alias("tier"))


def severity_tier(seconds: Column) -> Column:
    """0 mild, 1 warning after half an hour, 2 alert after two hours."""
    return F.when(seconds < WARN_AFTER, 0).when(seconds < ALERT_AFTER, 1).otherwise(2)


def recent_errors(records: DataFrame, limit: int) -> DataFrame:
    return records.where("status = 'error'").orderBy(F.desc("line_no")).limit(limit)


def recent_captures(versions: DataFrame, project: DataFrame, limit: int) -> DataFrame:
    """Latest captures with their label, ties by insertion; the limit is taken before the join."""
    top = versions.orderBy(F.desc("captured_at"), F.desc("id")).limit(limit)
    return top.join(project.select(F.col("id").alias("project_id"), "label"), "project_id", "left")


def recent_heads(head: DataFrame, limit: int, also: list[str]) -> DataFrame:
    """The most recently started heads, plus those named."""
    top = head.orderBy(F.desc_nulls_last("first_ts"), F.desc("id")).limit(limit)
    return top.unionByName(head.where(F.col("short").isin(also))).dropDuplicates(["id"]) if also else top


def last_capture(versions: DataFrame) -> DataFrame:
    return versions.agg(F.max("captured_at").alias("last_capture"))
