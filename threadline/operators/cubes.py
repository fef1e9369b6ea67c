"""Dashboard and day-wall cubes: dictionary-encoded fact rows, and the panels built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions import times
from threadline.functions.pricing import hours_sum, money, usd_sum
from threadline.operators.intervals import calendar
from threadline.operators.ordered import position
from threadline.operators.selection import Span, child_rows, real_sessions, session_kind

# Attribution kinds and session kinds in their encoded order.
ATTRIBUTION_ORDER = ["agent", "mcp_server", "mcp_tool", "plugin", "skill"]
KIND_ORDER = ["mine", "subagent", "automated"]


def dictionary(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Distinct values of a column with a dense id in first-seen order: ``value, id``.

    Rows are reduced to one per distinct value by ``min`` before anything is sorted.
    """
    first = df.groupBy(F.coalesce(column, F.lit("")).alias("value")).agg(F.min(F.struct(*order)).alias("_at"))
    return position(first, ["_at", "value"], "id").select("value", F.col("id").cast("bigint").alias("id"))


def dictionaries(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The dictionaries of several columns in one pass: ``column, value, id``."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(c, F.lit("")).alias("value")) for c in columns]))
    seen = df.select(F.struct(*order).alias("_at"), cells.alias("_c")).groupBy("_c.column", "_c.value").agg(F.min("_at").alias("_at"))
    placed = position(seen, ["column", "_at", "value"], "_id")
    # One row per column.
    begins = placed.groupBy("column").agg(F.min("_id").alias("_begin"))
    return placed.join(F.broadcast(begins), "column").select("column", "value", (F.col("_id") - F.col("_begin")).cast("bigint").alias("id"))


def _encode(df: DataFrame, column: str, ids: DataFrame, out: str) -> DataFrame:
    keys = ids.select(F.col("value").alias("_v"), F.col("id").alias(out))
    return df.join(keys, F.coalesce(F.col(column), F.lit("")) == F.col("_v"), "left").drop("_v")


def _ordered_sessions(session: DataFrame, span: Span) -> DataFrame:
    return position(real_sessions(session, span), FIRST_SEEN, "row_id")


def _kind_id() -> Column:
    kinds = F.array(*[F.lit(k) for k in KIND_ORDER])
    return F.array_position(kinds, session_kind(F.col("is_subagent"), F.col("entrypoint"))) - 1


FIRST_SEEN = ["local_date", "local_hour", "key"]


def cube_sessions(session: DataFrame, span: Span = Span()) -> DataFrame:
    """One encoded row per real session, in export order ``row_id``."""
    rows = _ordered_sessions(session, span)
    coded = {"project_label": "project", "repo_root": "repo", "cc_version": "version", "primary_model": "model"}
    ids = dictionaries(real_sessions(session, span), list(coded), FIRST_SEEN)
    for column, out in coded.items():
        rows = _encode(rows, column, ids.where(F.col("column") == column), f"{out}_id")
    return rows.select(
        "row_id", "local_date", "local_hour", "local_weekday", "project_id", "repo_id",
        F.col("is_worktree").alias("worktree"),
        F.round("engaged_seconds", 1).alias("engaged_sec"),
        F.round("cost_usd", 4).alias("cost"),
        "tok_input", "tok_output", "tok_cache_write", "tok_cache_read", "tok_thinking",
        "version_id", "model_id",
        F.round("wall_seconds", 1).alias("wall_sec"),
        F.round("active_seconds", 1).alias("active_sec"),
        F.col("n_user_prompts").alias("prompts"),
        F.col("n_tool_uses").alias("tool_uses"),
        F.col("n_assistant_turns").alias("turns"),
        _kind_id().alias("kind"),
    )


def cube_models(turn: DataFrame, session: DataFrame, span: Span = Span()) -> DataFrame:
    """Tokens and cost per session and model, for sessions of the cube."""
    rows = turn.where("model is not null and model <> ''").groupBy("session_key", "model").agg(
        F.round(F.sum(money(F.col("cost_usd"))), 4).cast("double").alias("cost"),
        F.sum("input_tokens").alias("tok_input"),
        F.sum("output_tokens").alias("tok_output"),
        (F.sum("cache_write_5m") + F.sum("cache_write_1h")).alias("tok_cache_write"),
        F.sum("cache_read").alias("tok_cache_read"),
        F.sum("thinking_tokens").alias("tok_thinking"),
    )
    return _of_real(rows, session, span)


def cube_tools(tool_call: DataFrame, session: DataFrame, span: Span = Span()) -> DataFrame:
    rows = tool_call.groupBy("session_key", "tool_name").agg(
        F.count(F.lit(1)).alias("count"), F.sum("is_error").alias("errors")
    )
    return _of_real(rows, session, span)


def cube_attribution(attribution: DataFrame, session: DataFrame, span: Span = Span()) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ATTRIBUTION_ORDER])
    rows = attribution.where(F.col("kind").isin(ATTRIBUTION_ORDER))
    return _of_real(rows, session, span).withColumn("kind_id", F.array_position(kinds, F.col("kind")) - 1)


def _of_real(rows: DataFrame, session: DataFrame, span: Span) -> DataFrame:
    keys = real_sessions(session, span).select("key")
    return rows.join(keys, F.col("session_key") == F.col("key"), "left_semi")


# ---- day wall ---------------------------------------------------------------


def wall_days(session: DataFrame, span: Span = Span()) -> DataFrame:
    """Every calendar day from the first to the last session, with its index."""
    days = calendar(real_sessions(session, span).where("local_date is not null"), "local_date")
    first = F.min("local_date").over(Window.partitionBy(F.lit(0)))
    return days.withColumn("day_id", F.datediff(F.col("local_date"), first).cast("bigint"))


def wall_sessions(session: DataFrame, span: Span = Span()) -> DataFrame:
    """One row of eight small values per session."""
    rows = real_sessions(session, span).where("local_date is not null")
    begin, end = times.parse_instant(F.col("first_ts")), times.parse_instant(F.col("last_ts"))
    order = ["local_date", "first_ts", "key"]
    ids = dictionaries(rows, ["project_label", "primary_model"], order)
    coded = _encode(rows, "project_label", ids.where("column = 'project_label'"), "project_id")
    coded = _encode(coded, "primary_model", ids.where("column = 'primary_model'"), "model_id")
    return coded.join(wall_days(session, span), "local_date").select(
        "key",
        "day_id",
        times.local_seconds_of_day(begin, F.col("tz_offset")).alias("start_sec"),
        times.duration_seconds(begin, end).alias("dur_sec"),
        F.round("engaged_seconds", 1).alias("engaged_sec"),
        "project_id",
        _kind_id().alias("kind"),
        "model_id",
        F.round(money(F.col("cost_usd")) * 1000, 0).cast("bigint").alias("cost_milli"),
    )


def parent_edges(session: DataFrame, span: Span = Span()) -> DataFrame:
    """Sub-agent to parent edges: ``child_key, parent_key``.

    A sub-agent carries its parent's session id, so only rows that are not
    sub-agents may stand on the parent side, one per id (the first in order).
    """
    rows = real_sessions(session, span)
    parents = (
        rows.where("is_subagent = 0 and session_uuid is not null")
        .groupBy(F.col("session_uuid").alias("parent_session_uuid"))
        .agg(F.min_by("key", F.struct("local_date", "first_ts", "key")).alias("parent_key"))
    )
    children = rows.where("is_subagent = 1 and parent_session_uuid is not null")
    return children.join(parents, "parent_session_uuid").select(F.col("key").alias("child_key"), "parent_key")


def clip_seconds(segments: DataFrame) -> DataFrame:
    """Cut ``day_id, start_sec, dur_sec`` rows into one row per day; no segment is shorter than a second."""
    dur = F.greatest(F.col("dur_sec"), F.lit(1))
    last = F.floor((F.col("start_sec") + dur - 1) / 86400).cast("int")
    spread = segments.withColumn("_n", F.explode(F.sequence(F.lit(0), last)))
    return spread.select(
        *[c for c in segments.columns if c not in ("day_id", "start_sec", "dur_sec")],
        (F.col("day_id") + F.col("_n")).alias("day_id"),
        F.when(F.col("_n") == 0, F.col("start_sec")).otherwise(0).cast("bigint").alias("start_sec"),
        F.least(F.col("start_sec") + dur - F.col("_n") * 86400, F.lit(86400)).cast("bigint").alias("end_sec"),
    )


# ---- panels -----------------------------------------------------------------


def model_families(turn: DataFrame, session: DataFrame, span: Span = Span()) -> DataFrame:
    """Cost and tokens per model family; the placeholder model is left out."""
    rows = child_rows(turn, session, span).where("model is not null and model <> '<synthetic>'")
    family = F.regexp_extract(F.lower("model"), "(opus|sonnet|haiku|fable)", 1)
    name = F.coalesce(F.nullif(family, F.lit("")), F.col("model"))
    return rows.groupBy(name.alias("family")).agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum("output_tokens").alias("tok_output"),
        usd_sum("cost_usd").alias("cost_usd"),
    )


def folded_project(label: Column) -> Column:
    """A label without the tail a throwaway worktree adds."""
    return F.regexp_replace(label, r"-\.worktrees?-.*$|-\.worktree-.*$", "")


def folded_projects(session: DataFrame, span: Span = Span()) -> DataFrame:
    label = F.coalesce("project_label", F.lit("(unknown)"))
    return real_sessions(session, span).groupBy(folded_project(label).alias("project")).agg(
        F.count(F.lit(1)).alias("sessions"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        usd_sum("cost_usd").alias("cost_usd"),
    )


def weekly_concurrency(overlap_day: DataFrame, span: Span = Span()) -> DataFrame:
    """Hours added up per week, the ratio recomputed from the sums, the peak of peaks."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(20,3)")).cast("double")
    rows = overlap_day.where(span.predicate()).groupBy(times.week_label(F.col("local_date")).alias("week")).agg(
        F.round(exact("summed_hours"), 3).alias("summed_hours"),
        F.round(exact("elapsed_hours"), 3).alias("elapsed_hours"),
        F.max("max_concurrent").alias("max_concurrent"),
    )
    return rows.withColumn("concurrency", F.round(F.col("summed_hours") / F.nullif(F.col("elapsed_hours"), F.lit(0.0)), 2))


def session_length(session: DataFrame, span: Span = Span()) -> DataFrame:
    """Exact median and mean engaged length of the operator's own sessions.

    The median is the mean of the one or two middle ranks of a distributed sort.
    """
    own = real_sessions(session, span).where("is_subagent = 0").select("key", "engaged_seconds")
    totals = own.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.round(F.sum(F.col("engaged_seconds").cast("decimal(20,3)")).cast("double") / F.count(F.lit(1)), 2).alias("mean_seconds"),
    )
    last = F.col("sessions") - 1
    middle = totals.select("*", F.explode(F.array(F.floor(last / 2), F.ceil(last / 2))).alias("_rank"))
    ranked = position(own, ["engaged_seconds", "key"], "_rank").select("_rank", "engaged_seconds")
    met = middle.join(ranked, "_rank", "left")
    return met.groupBy("sessions", "mean_seconds").agg(F.round(F.avg("engaged_seconds"), 2).alias("median_seconds")).select(
        "sessions", "median_seconds", "mean_seconds"
    )


def missing_days(session: DataFrame, span: Span = Span(), by: str | None = None) -> DataFrame:
    """Days between the first and the last session on which none started, over all or for each value of ``by``."""
    if by is not None:
        own = real_sessions(session, span).where(F.col(by).isNotNull() & F.col("local_date").isNotNull()).select(by, "local_date").distinct()
        day = F.to_date("local_date")
        ends = own.groupBy(by).agg(F.sequence(F.min(day), F.max(day)).alias("_days"))
        every = ends.select(by, F.explode("_days").alias("_d")).select(by, F.date_format("_d", "yyyy-MM-dd").alias("local_date"))
        return every.join(own, [by, "local_date"], "left_anti")
    active = real_sessions(session, span).where("local_date is not null").select("local_date").distinct()
    return calendar(active, "local_date").join(active, "local_date", "left_anti")


def engaged_by_day(session: DataFrame, span: Span = Span()) -> DataFrame:
    own = real_sessions(session, span).where("is_subagent = 0 and local_date is not null")
    return own.groupBy("local_date").agg(
        F.count(F.lit(1)).alias("sessions"), hours_sum("engaged_seconds").alias("engaged_hours")
    )


def population(session: DataFrame, span: Span = Span()) -> DataFrame:
    """Cost and tools over everyone; hours and session counts without sub-agents."""
    own = F.col("is_subagent") == 0
    return real_sessions(session, span).agg(
        usd_sum("cost_usd").alias("cost_usd"),
        F.sum("n_tool_uses").alias("tool_calls"),
        F.sum(F.when(own, 1).otherwise(0)).cast("bigint").alias("sessions"),
        F.round(
            F.sum(F.when(own, F.col("engaged_seconds")).cast("decimal(20,3)")).cast("double") / 3600.0, 2
        ).alias("engaged_hours"),
    )


def kind_counts(session: DataFrame, span: Span = Span()) -> DataFrame:
    kind = session_kind(F.col("is_subagent"), F.col("entrypoint"))
    return real_sessions(session, span).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("sessions"))


def top_per_kind(attribution: DataFrame, session: DataFrame, span: Span = Span(), k: int = 8) -> DataFrame:
    """The ``k`` most used names of each attribution kind."""
    uses = child_rows(attribution, session, span).groupBy("kind", "name").agg(F.sum("count").alias("uses"))
    # Rows are (kind, name) pairs by now.
    order = Window.partitionBy("kind").orderBy(F.desc("uses"), "name")
    return uses.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recent_projects(session: DataFrame) -> DataFrame:
    """Project checklist, most recently worked on first."""
    label = F.coalesce("project_label", F.lit("(unknown)"))
    return session.where("is_real = 1").groupBy(label.alias("project")).agg(
        F.max("local_date").alias("last_day"), F.count(F.lit(1)).alias("sessions")
    ).orderBy(F.desc("last_day"), "project")
