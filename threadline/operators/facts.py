"""The facts card: headline figures for a window and a project selection."""

from __future__ import annotations

import operator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions.pricing import money
from threadline.operators.intervals import overlap_by_day, overlap_of_edges, session_spans
from threadline.operators.reports import long_form
from threadline.operators.selection import Span, child_rows, real_sessions, select_projects

# Fixed value: the zone offset one figure counts over the whole corpus.
DST_OFFSET = "+1100"
# Fixed value: first assistant build that records thinking tokens.
THINKING_FIRST_VERSION = "2.1.228"


@dataclass(frozen=True)
class Scope:
    """What a card covers. ``labels`` None means every project; empty means none."""

    span: Span = Span()
    labels: DataFrame | None = None


def _windowed(session: DataFrame, scope: Scope) -> DataFrame:
    rows = session.where(scope.span.predicate()) if scope.span.limits else session
    return select_projects(rows, scope.labels)


def _hours(c: Column) -> Column:
    total = F.coalesce(F.sum(c.cast("decimal(20,3)")).cast("double"), F.lit(0.0))
    return F.round(total / 3600.0, 1)


def core_counts(session: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Totals in one pass; all but ``files_total`` and ``subagents`` are over real sessions."""
    real = lambda c: F.when(F.col("is_real") == 1, F.col(c))
    total = lambda c: F.sum(real(c))
    return _windowed(session, scope).agg(
        F.count(F.lit(1)).alias("files_total"),
        F.sum("is_real").alias("sessions_real"),
        F.sum("is_subagent").alias("subagents"),
        total("is_subagent").alias("subagents_real"),
        total("n_user_prompts").alias("prompts"),
        total("n_tool_uses").alias("tool_calls"),
        total("n_assistant_turns").alias("turns"),
        _hours(real("engaged_seconds")).alias("engaged_h"),
        _hours(real("active_seconds")).alias("active_h"),
        _hours(real("wall_seconds")).alias("wall_h"),
        total("tok_input").alias("tok_in"),
        total("tok_output").alias("tok_out"),
        total("tok_thinking").alias("tok_think"),
        total("tok_cache_write").alias("tok_cw"),
        total("tok_cache_read").alias("tok_cr"),
        F.round(F.coalesce(F.sum(money(real("cost_usd"))), F.lit(0)), 2).cast("double").alias("cost"),
        F.countDistinct(real("repo_root")).alias("repos"),
        F.countDistinct(real("project_label")).alias("labels"),
        total("is_worktree").alias("worktree_sessions"),
        F.countDistinct(real("local_date")).alias("active_days"),
        F.substring(F.min(real("first_ts")), 1, 10).alias("span_lo"),
        F.substring(F.max(real("last_ts")), 1, 10).alias("span_hi"),
    )


def derived_ratios(core: DataFrame) -> DataFrame:
    """Share of empty transcripts, transcripts per session, cache reads per output token."""
    shells = F.col("files_total") - F.coalesce("sessions_real", F.lit(0))
    guard = lambda n, d, digits: F.coalesce(
        F.round(n.cast("double") / F.nullif(d, F.lit(0)).cast("double"), digits), F.lit(0.0)
    )
    return core.select(
        guard(shells * 100, F.col("files_total"), 1).alias("shell_pct"),
        guard(F.col("files_total"), F.col("sessions_real"), 1).alias("inflate"),
        guard(F.col("tok_cr"), F.col("tok_out"), 0).cast("bigint").alias("cr_ratio"),
    )


def overlap_days(
    session: DataFrame, overlap_day: DataFrame, zone: str, scope: Scope = Scope(), edges: DataFrame | None = None
) -> DataFrame:
    """Day rows for the selection.

    Without a selection the stored day table answers. With one it is rebuilt
    from the selected sessions, and the window then filters the DAYS: a session
    that began before the window still counts on the days it reaches into.
    Given the stored signed ``edges``, only those of the selected labels and of
    the days in the window are read and swept, not the sessions.
    """
    if scope.labels is None:
        return overlap_day.where(scope.span.predicate())
    if edges is not None:
        return overlap_of_edges(select_projects(edges.where(scope.span.predicate()), scope.labels))
    rebuilt = overlap_by_day(session_spans(select_projects(session, scope.labels)), zone)
    return rebuilt.where(scope.span.predicate())


def hours_and_overlap(days: DataFrame) -> DataFrame:
    elapsed = F.coalesce("elapsed_hours", F.lit(0.0))
    exact = lambda c: F.coalesce(F.sum(c.cast("decimal(20,3)")).cast("double"), F.lit(0.0))
    return days.agg(
        F.round(exact(elapsed), 1).alias("elapsed_h"),
        F.round(exact(F.col("summed_hours")), 1).alias("summed_h"),
        F.round(F.coalesce(exact(elapsed) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 1).alias("mean_elapsed"),
        F.round(F.coalesce(F.max(elapsed), F.lit(0.0)), 1).alias("max_elapsed"),
        F.count(F.when(elapsed > 24.001, 1)).alias("days_over_24h"),
    )


def child_counts(turn: DataFrame, tool_call: DataFrame, session: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Rows of the child tables in scope, as ``fact, value``."""
    out = None
    for name, child in (("turn_rows", turn), ("tool_rows", tool_call)):
        part = child_rows(child, session, scope.span, scope.labels).agg(F.count(F.lit(1)).alias("value"))
        part = part.select(F.lit(name).alias("fact"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def real_days(session: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """One row per local day of the selection; the month and busiest-day figures read this."""
    rows = select_projects(real_sessions(session, scope.span), scope.labels)
    return rows.where("local_date is not null").groupBy("local_date").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("engaged_seconds").cast("decimal(20,3)")).alias("engaged"),
        F.max((F.col("tok_thinking") > 0).cast("int")).alias("thinking"),
    )


def month_boundaries(days: DataFrame) -> DataFrame:
    """First and last month and day, days seen in those months, first day with thinking tokens."""
    month = F.substring("local_date", 1, 7)
    # One row per calendar day: a window over all of them stays small.
    every = Window.partitionBy(F.lit(0))
    marked = days.withColumns(
        {
            "m": month,
            "first_m": F.min(month).over(every),
            "last_m": F.max(month).over(every),
        }
    )
    return marked.agg(
        F.min("m").alias("first_month"),
        F.min("local_date").alias("first_day"),
        F.count(F.when(F.col("m") == F.col("first_m"), 1)).alias("first_month_days"),
        F.max("m").alias("last_month"),
        F.max("local_date").alias("last_day"),
        F.count(F.when(F.col("m") == F.col("last_m"), 1)).alias("last_month_days"),
        F.min(F.when(F.col("thinking") == 1, F.col("local_date"))).alias("thinking_from"),
        F.lit(THINKING_FIRST_VERSION).alias("thinking_version"),
    )


def busiest_day(days: DataFrame, overlap: DataFrame) -> DataFrame:
    """The day with most sessions and the earliest day at the concurrency peak; zeros when empty."""
    top = days.agg(
        F.min_by(F.struct("local_date", "n", "engaged"), F.struct(-F.col("n"), F.col("local_date"))).alias("t")
    ).select(
        F.col("t.local_date").alias("busiest_day"),
        F.coalesce("t.n", F.lit(0)).alias("busiest_n"),
        F.round(F.col("t.engaged").cast("double") / 3600.0, 1).alias("busiest_engaged"),
    )
    elapsed = overlap.select(F.col("local_date").alias("busiest_day"), F.col("elapsed_hours").alias("busiest_elapsed"))
    peak = overlap.agg(
        F.max("max_concurrent").alias("peak_concurrent"),
        F.min_by("local_date", F.struct(-F.col("max_concurrent"), F.col("local_date"))).alias("peak_concurrent_day"),
        F.lit(1).alias("_one"),
    )
    one = top.join(elapsed, "busiest_day", "left").withColumn("_one", F.lit(1))
    return one.join(peak, "_one").drop("_one")


def label_spread(session: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Repositories known under several labels, the surplus labels, and worktree labels."""
    rows = select_projects(real_sessions(session, scope.span), scope.labels)
    per_repo = rows.groupBy("repo_root").agg(F.countDistinct("project_label").alias("n")).where("n > 1")
    repos = per_repo.agg(
        F.count(F.lit(1)).alias("multi_label_repos"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra_labels"),
    )
    trees = rows.where("is_worktree = 1").agg(F.countDistinct("project_label").alias("worktree_labels"))
    return repos.withColumn("_one", F.lit(1)).join(trees.withColumn("_one", F.lit(1)), "_one").drop("_one")


def offsets(session: DataFrame, scope: Scope = Scope()) -> DataFrame:
    """Sessions per UTC offset, and the corpus-wide count of one offset, which ignores the scope."""
    inside = (F.col("is_real") == 1) & (scope.span.predicate() if scope.span.limits else F.lit(True))
    rows = session.where("is_real = 1 and tz_offset is not null")
    if scope.labels is not None:
        chosen = scope.labels.select("project_label", F.lit(True).alias("_in")).distinct()
        rows = rows.join(chosen, "project_label", "left")
        inside = inside & F.coalesce("_in", F.lit(False))
    return rows.groupBy("tz_offset").agg(
        F.count(F.when(inside, 1)).alias("sessions"),
        F.count(F.when(F.col("tz_offset") == DST_OFFSET, 1)).alias("dst_sessions_all"),
    )


def card(
    session: DataFrame, turn: DataFrame, tool_call: DataFrame, overlap_day: DataFrame, zone: str,
    scope: Scope = Scope(),
) -> DataFrame:
    """Every figure of the card as ``fact, value`` text rows."""
    core = core_counts(session, scope)
    clock = overlap_days(session, overlap_day, zone, scope)
    days = real_days(session, scope)
    dst = offsets(session, scope).agg(
        F.coalesce(F.sum(F.when(F.col("tz_offset") == DST_OFFSET, F.col("sessions"))), F.lit(0)).alias("dst_sessions"),
        F.coalesce(F.sum("dst_sessions_all"), F.lit(0)).alias("dst_sessions_all"),
    )
    parts = [
        core, derived_ratios(core), hours_and_overlap(clock), month_boundaries(days),
        busiest_day(days, clock), label_spread(session, scope), dst,
    ]
    rows = child_counts(turn, tool_call, session, scope).withColumn("value", F.col("value").cast("string"))
    for part in parts:
        rows = rows.unionByName(long_form(part, "fact"))
    return rows


def header(meta: DataFrame, scope: Scope, rows: str) -> DataFrame:
    """The preamble every export carries, as one row."""
    base = meta.select(
        F.col("local_timezone").alias("timezone"),
        "prices_read_on",
        F.lit(scope.span.describe()).alias("window_desc"),
        F.lit(scope.span.limit(operator.ge)).alias("since"),
        F.lit(scope.span.limit(operator.le)).alias("until"),
        F.lit(rows).alias("rows"),
        F.lit(scope.labels is not None).alias("project_filter_applied"),
    )
    if scope.labels is None:
        return base.withColumns(
            {"projects": F.lit(None).cast("array<string>"), "project_count": F.lit(None).cast("bigint")}
        )
    listed = scope.labels.agg(
        F.sort_array(F.collect_set("project_label")).alias("projects"),
        F.countDistinct("project_label").alias("project_count"),
        F.lit(1).alias("_one"),
    )
    return base.withColumn("_one", F.lit(1)).join(listed, "_one").drop("_one")
