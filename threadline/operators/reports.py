"""Views and report tables over the published facts.

Every function takes fact DataFrames and returns one small report. Sums of
money and hours are exact decimals inside, so a figure does not depend on how
the rows were partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions import times
from threadline.functions.pricing import hours_sum, money, usd_sum
from threadline.operators.selection import Span, child_rows, real_sessions

UNKNOWN = "(unknown)"


def _n(alias: str) -> Column:
    return F.count(F.lit(1)).alias(alias)


def _sums(**names: str) -> list[Column]:
    return [F.sum(src).alias(out) for out, src in names.items()]


def _label() -> Column:
    return F.coalesce("project_label", F.lit(UNKNOWN))


# ---- views over all rows, real or not --------------------------------------


def view_project(session: DataFrame) -> DataFrame:
    return session.groupBy(
        F.coalesce("repo_root", "cwd", F.lit(UNKNOWN)).alias("repo_root"), _label().alias("project_label")
    ).agg(
        _n("files_total"),
        *_sums(sessions_real="is_real", subagent_files="is_subagent", worktree_files="is_worktree"),
        hours_sum("wall_seconds").alias("wall_hours"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        hours_sum("active_seconds").alias("active_hours"),
        *_sums(
            tok_input="tok_input", tok_output="tok_output", tok_cache_write="tok_cache_write",
            tok_cache_read="tok_cache_read", tok_billable_total="tok_billable_total",
        ),
        usd_sum("cost_usd").alias("cost_usd"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
    )


def view_daily(session: DataFrame) -> DataFrame:
    return session.where("local_date is not null").groupBy("local_date").agg(
        _n("files_total"),
        F.sum("is_real").alias("sessions_real"),
        F.countDistinct("repo_root").alias("projects_touched"),
        hours_sum("wall_seconds").alias("wall_hours"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        hours_sum("active_seconds").alias("active_hours"),
        *_sums(prompts="n_user_prompts", tool_calls="n_tool_uses"),
        F.sum(F.col("tok_input") + F.col("tok_output") + F.col("tok_cache_write")).alias("tok_billable"),
        F.sum("tok_cache_read").alias("tok_cache_read"),
        usd_sum("cost_usd").alias("cost_usd"),
    )


def view_hourly(session: DataFrame) -> DataFrame:
    return session.where("local_hour is not null").groupBy("local_weekday", "local_hour").agg(
        _n("files_total"),
        F.sum("is_real").alias("sessions_real"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        usd_sum("cost_usd").alias("cost_usd"),
    )


def view_model(turn: DataFrame) -> DataFrame:
    return turn.groupBy("model").agg(
        _n("turns"),
        F.countDistinct("session_key").alias("sessions"),
        *_sums(tok_input="input_tokens", tok_output="output_tokens", tok_thinking="thinking_tokens"),
        F.sum(F.col("cache_write_5m") + F.col("cache_write_1h")).alias("tok_cache_write"),
        F.sum("cache_read").alias("tok_cache_read"),
        usd_sum("cost_usd").alias("cost_usd"),
    )


def view_tool(tool_call: DataFrame) -> DataFrame:
    return tool_call.groupBy("tool_name").agg(
        _n("calls"), F.sum("is_error").alias("errors"), F.countDistinct("session_key").alias("sessions")
    )


def view_attribution(attribution: DataFrame) -> DataFrame:
    return attribution.groupBy("kind", "name").agg(
        F.sum("count").alias("uses"), F.countDistinct("session_key").alias("sessions")
    )


def long_form(one_row: DataFrame, name: str, value: str = "value") -> DataFrame:
    """A one-row frame as ``name, value`` rows of text."""
    text = one_row.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in one_row.columns])
    return text.unpivot([], [F.col(f"`{c}`") for c in text.columns], name, value)


# ---- report tables over real sessions in a window ---------------------------


def overview(session: DataFrame, overlap_day: DataFrame, span: Span = Span()) -> DataFrame:
    """Headline totals in long form: ``metric, value``."""
    inside = (F.col("is_real") == 1) & (span.predicate() if span.limits else F.lit(True))
    pick = lambda c: F.when(inside, F.col(c))
    hours = lambda c: F.round(
        F.coalesce(F.sum(pick(c).cast("decimal(20,3)")).cast("double"), F.lit(0.0)) / 3600.0, 1
    )
    totals = session.agg(
        F.concat(
            F.substring(F.min(pick("first_ts")), 1, 10), F.lit(" to "), F.substring(F.max(pick("last_ts")), 1, 10)
        ).alias("Date range"),
        F.countDistinct(pick("local_date")).alias("Days with activity"),
        F.count(F.when(inside, 1)).alias("Real sessions"),
        F.count(F.lit(1)).alias("Distinct transcripts"),
        F.sum(pick("is_subagent")).alias("Sub-agent sessions"),
        F.sum("is_subagent").alias("Sub-agent transcripts"),
        F.countDistinct(pick("repo_root")).alias("Projects (repositories)"),
        F.count(F.when(inside & (F.col("is_worktree") == 1), 1)).alias("Worktree sessions"),
        F.sum(pick("n_user_prompts")).alias("Prompts"),
        F.sum(pick("n_assistant_turns")).alias("Assistant turns"),
        F.sum(pick("n_tool_uses")).alias("Tool calls"),
        hours("engaged_seconds").alias("Engaged hours"),
        hours("active_seconds").alias("Turn-duration hours"),
        F.sum(pick("tok_input")).alias("Input tokens"),
        F.sum(pick("tok_output")).alias("Output tokens"),
        F.sum(pick("tok_thinking")).alias("of which thinking"),
        F.sum(pick("tok_cache_write")).alias("Cache write tokens"),
        F.sum(pick("tok_cache_read")).alias("Cache read tokens"),
        F.round(F.coalesce(F.sum(money(pick("cost_usd"))), F.lit(0)), 2).alias("Cost, API list price"),
    )
    # The windowed day rows, so that these two agree with their neighbours.
    clock = overlap_day.where(span.predicate()).agg(
        F.round(F.coalesce(F.sum(F.col("elapsed_hours").cast("decimal(20,3)")), F.lit(0)), 1).alias("Elapsed hours (real clock)"),
        F.round(F.coalesce(F.sum(F.col("summed_hours").cast("decimal(20,3)")), F.lit(0)), 1).alias("Summed hours"),
    )
    return long_form(totals, "metric").unionByName(long_form(clock, "metric"))


def daily(session: DataFrame, overlap_day: DataFrame, span: Span = Span()) -> DataFrame:
    rows = real_sessions(session, span).where("local_date is not null").groupBy("local_date").agg(
        _n("sessions"),
        F.countDistinct("repo_root").alias("projects_touched"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        hours_sum("active_seconds").alias("active_hours"),
        *_sums(
            prompts="n_user_prompts", tool_calls="n_tool_uses", tok_input="tok_input", tok_output="tok_output",
            tok_thinking="tok_thinking", tok_cache_write="tok_cache_write", tok_cache_read="tok_cache_read",
            tok_billable="tok_billable_total",
        ),
        usd_sum("cost_usd").alias("cost_usd"),
    )
    day = overlap_day.select("local_date", "elapsed_hours", "summed_hours", "max_concurrent", "concurrency")
    filled = {
        c: F.coalesce(c, F.lit(0)) for c in ("elapsed_hours", "summed_hours", "max_concurrent", "concurrency")
    }
    return rows.join(day, "local_date", "left").withColumns(filled).withColumnRenamed("local_date", "date")


def weekly(session: DataFrame, span: Span = Span()) -> DataFrame:
    dated = real_sessions(session, span).where("local_date is not null")
    return dated.groupBy(times.week_label(F.col("local_date")).alias("week")).agg(
        F.min("local_date").alias("week_starting"),
        _n("sessions"),
        F.countDistinct("repo_root").alias("projects_touched"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        hours_sum("active_seconds").alias("active_hours"),
        *_sums(
            prompts="n_user_prompts", tool_calls="n_tool_uses", tok_output="tok_output",
            tok_cache_read="tok_cache_read", tok_billable="tok_billable_total",
        ),
        usd_sum("cost_usd").alias("cost_usd"),
    )


def monthly(session: DataFrame, span: Span = Span()) -> DataFrame:
    """Per month; the first and last months are partial, and thinking counts from its first record on."""
    dated = real_sessions(session, span).where("local_date is not null")
    rows = dated.groupBy(F.substring("local_date", 1, 7).alias("month")).agg(
        _n("sessions"),
        F.countDistinct("repo_root").alias("projects_touched"),
        F.countDistinct("local_date").alias("active_days"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        hours_sum("active_seconds").alias("active_hours"),
        *_sums(
            prompts="n_user_prompts", tool_calls="n_tool_uses", assistant_turns="n_assistant_turns",
            tok_input="tok_input", tok_output="tok_output", tok_thinking="tok_thinking",
            tok_cache_write="tok_cache_write", tok_cache_read="tok_cache_read",
            tok_billable="tok_billable_total",
        ),
        usd_sum("cost_usd").alias("cost_usd"),
    )
    # The rows are months by now, so one window over all of them is tiny.
    every = Window.partitionBy(F.lit(0))
    first_thinking = F.min(F.when(F.col("tok_thinking") > 0, F.col("month"))).over(every)
    edge = F.col("month").isin(F.min("month").over(every), F.max("month").over(every))
    return rows.withColumns(
        {
            "is_partial": edge.cast("int"),
            "thinking_recorded": F.coalesce((F.col("month") >= first_thinking).cast("int"), F.lit(0)),
        }
    )


def projects(session: DataFrame, span: Span = Span()) -> DataFrame:
    return real_sessions(session, span).groupBy(_label().alias("project")).agg(
        _n("sessions"),
        F.sum("is_worktree").alias("is_worktree_sessions"),
        F.countDistinct("local_date").alias("active_days"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        hours_sum("active_seconds").alias("active_hours"),
        F.round(
            F.sum(F.col("engaged_seconds").cast("decimal(20,3)")).cast("double") / F.count("engaged_seconds") / 60.0, 1
        ).alias("avg_session_minutes"),
        *_sums(
            prompts="n_user_prompts", tool_calls="n_tool_uses", assistant_turns="n_assistant_turns",
            tok_input="tok_input", tok_output="tok_output", tok_cache_write="tok_cache_write",
            tok_cache_read="tok_cache_read", tok_billable="tok_billable_total",
        ),
        usd_sum("cost_usd").alias("cost_usd"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
    )


def top_labels(session: DataFrame, span: Span = Span(), k: int = 12) -> DataFrame:
    """The ``k`` most expensive labels, ties by name."""
    cost = real_sessions(session, span).groupBy(_label().alias("project")).agg(
        F.sum(money(F.col("cost_usd"))).alias("cost")
    )
    return cost.orderBy(F.desc("cost"), "project").limit(k).select("project", F.round("cost", 2).cast("double").alias("cost_usd"))


def project_month(session: DataFrame, span: Span = Span(), k: int = 12) -> DataFrame:
    """Month by project, with all but the top ``k`` projects folded into ``(other)``."""
    top = top_labels(session, span, k).select("project", F.lit(True).alias("_top"))
    rows = real_sessions(session, span).where("local_date is not null").withColumn("project", _label())
    # The build side holds at most k rows.
    folded = rows.join(F.broadcast(top), "project", "left")
    shown = F.when(F.col("_top"), F.col("project")).otherwise("(other)")
    return folded.groupBy(F.substring("local_date", 1, 7).alias("month"), shown.alias("project")).agg(
        _n("sessions"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        F.sum("tok_billable_total").alias("tok_billable"),
        usd_sum("cost_usd").alias("cost_usd"),
    )


def _weekday_name(c: str) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in times.WEEKDAY_NAMES]), F.col(c) + 1)


def hour_heatmap(session: DataFrame, span: Span = Span()) -> DataFrame:
    rows = real_sessions(session, span).where("local_hour is not null")
    return rows.groupBy(F.col("local_weekday").alias("weekday"), F.col("local_hour").alias("hour")).agg(
        _n("sessions"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        F.sum("n_user_prompts").alias("prompts"),
        usd_sum("cost_usd").alias("cost_usd"),
    ).withColumn("weekday_name", _weekday_name("weekday"))


def by_weekday(session: DataFrame, span: Span = Span()) -> DataFrame:
    rows = real_sessions(session, span).where("local_weekday is not null")
    total = F.sum(F.col("engaged_seconds").cast("decimal(20,3)")).cast("double") / 3600.0
    return rows.groupBy(F.col("local_weekday").alias("weekday")).agg(
        _n("sessions"),
        F.countDistinct("local_date").alias("active_days"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        F.round(total / F.countDistinct("local_date"), 2).alias("engaged_hours_per_active_day"),
        F.sum("n_user_prompts").alias("prompts"),
        usd_sum("cost_usd").alias("cost_usd"),
    ).withColumn("weekday_name", _weekday_name("weekday"))


def models(turn: DataFrame, session: DataFrame, span: Span = Span()) -> DataFrame:
    return child_rows(turn, session, span).groupBy("model").agg(
        _n("turns"),
        F.countDistinct("session_key").alias("sessions"),
        *_sums(tok_input="input_tokens", tok_output="output_tokens", tok_thinking="thinking_tokens"),
        F.sum(F.col("cache_write_5m") + F.col("cache_write_1h")).alias("tok_cache_write"),
        F.sum("cache_read").alias("tok_cache_read"),
        F.round(F.sum("output_tokens") / F.count(F.lit(1)).cast("double"), 1).alias("avg_out_per_turn"),
        usd_sum("cost_usd").alias("cost_usd"),
        F.min("ts").alias("first_used"),
        F.max("ts").alias("last_used"),
    )


def model_month(turn: DataFrame, session: DataFrame, span: Span = Span()) -> DataFrame:
    rows = child_rows(turn, session, span).where("ts is not null")
    return rows.groupBy(F.substring("ts", 1, 7).alias("month_utc"), "model").agg(
        _n("turns"),
        *_sums(tok_output="output_tokens", tok_cache_read="cache_read"),
        usd_sum("cost_usd").alias("cost_usd"),
    )


def tools(tool_call: DataFrame, session: DataFrame, span: Span = Span()) -> DataFrame:
    """Tool use with each tool's share of all calls."""
    rows = child_rows(tool_call, session, span).groupBy(F.col("tool_name").alias("tool")).agg(
        _n("calls"), F.sum("is_error").alias("error_results"), F.countDistinct("session_key").alias("sessions")
    )
    # One row per tool name here; the share needs their grand total.
    share = 100.0 * F.col("calls") / F.sum("calls").over(Window.partitionBy(F.lit(0)))
    return rows.withColumn("pct_of_calls", F.round(share, 2))


def skills_agents(attribution: DataFrame, session: DataFrame, span: Span = Span()) -> DataFrame:
    return view_attribution(child_rows(attribution, session, span))


def worktrees(session: DataFrame, span: Span = Span()) -> DataFrame:
    rows = real_sessions(session, span).where("is_worktree = 1")
    return rows.groupBy(
        F.coalesce("worktree_name", F.lit("(none)")).alias("worktree"), _label().alias("project")
    ).agg(
        _n("sessions"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        F.sum("tok_billable_total").alias("tok_billable"),
        usd_sum("cost_usd").alias("cost_usd"),
        F.min("first_ts").alias("first_seen"),
        F.max("last_ts").alias("last_seen"),
    )


def concurrency(overlap_day: DataFrame, span: Span = Span()) -> DataFrame:
    return overlap_day.where(span.predicate()).withColumnRenamed("local_date", "date")


# Upper bound in seconds and name of each session-size bucket.
SIZE_BUCKETS = [
    (60, "0 under 1 min"), (300, "1 to 5 min"), (900, "5 to 15 min"), (1800, "15 to 30 min"),
    (3600, "30 to 60 min"), (7200, "1 to 2 h"), (None, "over 2 h"),
]


def session_sizes(session: DataFrame, span: Span = Span()) -> DataFrame:
    name, rank = F.lit(SIZE_BUCKETS[-1][1]), F.lit(len(SIZE_BUCKETS))
    for i in range(len(SIZE_BUCKETS) - 2, -1, -1):
        under = F.col("engaged_seconds") < SIZE_BUCKETS[i][0]
        name = F.when(under, F.lit(SIZE_BUCKETS[i][1])).otherwise(name)
        rank = F.when(under, F.lit(i + 1)).otherwise(rank)
    return real_sessions(session, span).groupBy(rank.alias("sort"), name.alias("bucket")).agg(
        _n("sessions"),
        *_sums(prompts="n_user_prompts", tool_calls="n_tool_uses", tok_billable="tok_billable_total"),
        usd_sum("cost_usd").alias("cost_usd"),
    )


def versions(session: DataFrame, span: Span = Span()) -> DataFrame:
    """Assistant builds in the order they were first seen."""
    rows = real_sessions(session, span).where("cc_version is not null")
    return rows.groupBy(F.col("cc_version").alias("version")).agg(
        _n("sessions"),
        F.min("local_date").alias("first_day"),
        F.max("local_date").alias("last_day"),
        hours_sum("engaged_seconds").alias("engaged_hours"),
        usd_sum("cost_usd").alias("cost_usd"),
        F.min("first_ts").alias("first_seen"),
    ).orderBy("first_seen", "version")


def top_sessions(
    session: DataFrame, span: Span = Span(), k: int = 200, by: str = "cost_usd", keep_titles: bool = True
) -> DataFrame:
    """The ``k`` sessions with the largest ``by``, ties by key; titles only if they may be kept."""
    title = F.coalesce("custom_title", "ai_title", "slug_title", F.lit("")) if keep_titles else F.lit("")
    top = real_sessions(session, span).orderBy(F.desc(by), "key").limit(k)
    return top.select(
        "key",
        _label().alias("project"),
        F.col("local_date").alias("date"),
        F.round(F.col("engaged_seconds") / 60.0, 1).alias("engaged_minutes"),
        F.round(F.col("wall_seconds") / 3600.0, 2).alias("wall_hours"),
        F.col("n_user_prompts").alias("prompts"),
        F.col("n_tool_uses").alias("tool_calls"),
        F.col("n_assistant_turns").alias("assistant_turns"),
        "tok_output",
        "tok_cache_read",
        F.col("tok_billable_total").alias("tok_billable"),
        F.round(money(F.col("cost_usd")), 2).cast("double").alias("cost_usd"),
        F.col("primary_model").alias("model"),
        title.alias("title"),
    )


def data_coverage(session: DataFrame, span: Span = Span()) -> DataFrame:
    """From when to when each measure is recorded: ``measure, valid_from, valid_to``."""
    rows = real_sessions(session, span)
    lo, hi = F.substring(F.min("first_ts"), 1, 10), F.substring(F.max("last_ts"), 1, 10)
    last = F.max("local_date")
    facts = rows.agg(
        F.min(F.when(F.col("tok_thinking") > 0, F.col("local_date"))).alias("thinking"),
        lo.alias("lo"), hi.alias("hi"), last.alias("last"),
    )
    row = lambda name, a, b: F.struct(F.lit(name).alias("measure"), a.alias("valid_from"), b.alias("valid_to"))
    full = ["tok_input / tok_output / tok_cache_*", "cost_usd", "engaged_hours", "active_hours",
            "elapsed_hours / concurrency", "web_search / web_fetch counts"]
    listed = [row("tok_thinking", F.col("thinking"), F.col("hi"))]
    listed += [row(name, F.col("lo"), F.col("hi")) for name in full]
    listed.append(row("last month (all columns)", F.concat(F.substring("last", 1, 7), F.lit("-01")), F.col("last")))
    return facts.select(F.inline(F.array(*listed)))


# ---- build checks -----------------------------------------------------------


def self_checks(session: DataFrame, turn: DataFrame, overlap_day: DataFrame) -> DataFrame:
    """Invariants of a finished build as ``check_name, value``; most must be 0."""
    only_synthetic = F.col("models_json").rlike(r'^\{"<synthetic>": 1\}$')
    flag = lambda cond: F.count(F.when(cond, 1))
    s = session.agg(
        flag(F.col("tok_cache_write") != F.col("tok_cache_write_declared")).alias("cache_split_disagrees"),
        flag((F.col("has_usage") == 0) & (F.col("n_assistant_turns") > 0) & ~only_synthetic).alias(
            "real_turns_missing_usage"
        ),
        flag(only_synthetic).alias("synthetic_only_sessions"),
        F.size(F.collect_set(F.coalesce("tz_offset", F.lit("")))).alias("distinct_utc_offsets"),
    )
    t = turn.agg(flag(F.col("thinking_tokens") > F.col("output_tokens")).alias("thinking_exceeds_output"))
    d = overlap_day.agg(flag(F.col("elapsed_hours") > 24.001).alias("days_over_24h"))
    cost = money(F.col("cost_usd"))
    signed = session.select(cost.alias("c")).unionByName(turn.select((-cost).alias("c")))
    delta = signed.agg(F.round(F.coalesce(F.sum("c"), F.lit(0)), 4).cast("double").alias("session_vs_turn_cost_delta"))
    out = None
    for part in (s, t, d, delta):
        rows = part.select(*[F.col(c).cast("double").alias(c) for c in part.columns])
        rows = rows.unpivot([], rows.columns, "check_name", "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def unpriced_models(entries: DataFrame) -> DataFrame:
    """Models that have no price, with the number of their replies."""
    return entries.where("is_unpriced").groupBy("model").agg(_n("turns"))
