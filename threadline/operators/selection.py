"""Date windows and project selections, in every form the reports need."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import times


class Span:
    """Local days to keep, as a list of comparisons; a side that is left empty has none."""

    def __init__(self, since: str = "", until: str = ""):
        sides = ((operator.ge, since), (operator.le, until))
        self.limits = tuple((compare, day) for compare, day in sides if day)

    def limit(self, compare) -> str:
        """The day of one side, ``operator.ge`` or ``operator.le``; empty if that side is open."""
        return dict(self.limits).get(compare, "")

    def predicate(self, column: str = "local_date") -> Column:
        return reduce(operator.and_, (compare(F.col(column), day) for compare, day in self.limits), F.lit(True))

    def describe(self) -> str:
        """The heading of a report over these days."""
        alone = {operator.ge: "{} onward", operator.le: "up to {}"}
        if len(self.limits) == len(alone):
            return " to ".join(day for _, day in self.limits)
        return next((alone[compare].format(day) for compare, day in self.limits), "all time")


def real_sessions(sessions: DataFrame, span: Span = Span()) -> DataFrame:
    """Sessions with at least one assistant reply that start inside the span."""
    kept = sessions.where("is_real = 1")
    return kept.where(span.predicate()) if span.limits else kept


def child_rows(
    child: DataFrame, sessions: DataFrame, span: Span = Span(), labels: DataFrame | None = None
) -> DataFrame:
    """Rows of a child table whose session is in the span and the selection.

    With neither given, every row stays, including those of unreal sessions.
    """
    if not span.limits and labels is None:
        return child
    parents = select_projects(real_sessions(sessions, span), labels).select("key")
    return child.join(parents, F.col("session_key") == F.col("key"), "left_semi")


def select_projects(sessions: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Keep sessions whose label is in ``labels``; None keeps all, an empty frame keeps none."""
    if labels is None:
        return sessions
    return sessions.join(labels.select("project_label").distinct(), "project_label", "left_semi")


def in_instants(ts: Column, since: str, until: str, zone: str) -> Column:
    """Instant window: a bare date is the whole local day, an offset is honoured, undated rows fail."""
    bare = r"^\d{4}-\d{2}-\d{2}$"
    lo_raw, hi_raw = F.lit(since or None), F.lit(until or None)
    lo = F.when(lo_raw.rlike(bare), F.to_utc_timestamp(F.try_to_timestamp(lo_raw), zone)).otherwise(
        times.parse_instant(lo_raw)
    )
    next_day = F.to_utc_timestamp(F.try_to_timestamp(hi_raw) + F.expr("INTERVAL 1 DAY"), zone)
    out = ts.isNotNull()
    if since and until and since > until and len(since) == len(until) == 10:
        raise ValueError(f"since {since} is after until {until}")
    if since:
        out = out & (ts >= lo)
    if until:
        hi_day = len(until) == 10
        out = out & ((ts < next_day) if hi_day else (ts <= times.parse_instant(hi_raw)))
    return out


def matching(label: Column, patterns: list[str]) -> Column:
    """Every pattern found anywhere in the label, ignoring case."""
    if not patterns:
        return F.array().cast("array<string>")
    listed = F.array(*[F.lit(p) for p in patterns])
    return F.filter(listed, lambda p: F.contains(F.lower(label), F.lower(p)))


def session_kind(is_subagent: Column, entrypoint: Column) -> Column:
    return (
        F.when(is_subagent == 1, F.lit("subagent"))
        .when(entrypoint == "sdk-cli", F.lit("automated"))
        .otherwise(F.lit("mine"))
    )


def project_labels(sessions: DataFrame) -> DataFrame:
    """Labels of all real sessions, whatever the window."""
    return sessions.where("is_real = 1 and project_label is not null").select("project_label").distinct()


def ticked_projects(labels: DataFrame, include: list[str], exclude: list[str]) -> DataFrame:
    """``project_label, ticked``: in the include list if there is one, and not in the exclude list."""
    label = F.col("project_label")
    allowed = F.size(matching(label, include)) > 0 if include else F.lit(True)
    return labels.withColumn("ticked", allowed & (F.size(matching(label, exclude)) == 0))


def selected_labels(sessions: DataFrame, include: list[str], exclude: list[str]) -> DataFrame | None:
    """The selection as a frame of labels, or None when no pattern is set."""
    if not include and not exclude:
        return None
    return ticked_projects(project_labels(sessions), include, exclude).where("ticked").select("project_label")


def pattern_frame(df: DataFrame, patterns: list[str], name: str = "pattern") -> DataFrame:
    """The pattern list as rows (patterns are a short parameter)."""
    unique = list(dict.fromkeys(patterns))
    session = df.sparkSession
    return session.createDataFrame([(p,) for p in unique], f"{name} string")


def dead_patterns(labels: DataFrame, patterns: list[str]) -> DataFrame:
    """Patterns that match no label at all."""
    hit = labels.select(F.explode(matching(F.col("project_label"), list(dict.fromkeys(patterns)))).alias("pattern"))
    return pattern_frame(labels, patterns).join(hit, "pattern", "left_anti")


def review(
    sessions: DataFrame, keep: list[str], include: list[str], exclude: list[str], span: Span
) -> DataFrame:
    """Each label with its counts in the window and in all time, its bucket and the patterns that decided it."""
    inside = span.predicate() if span.limits else F.lit(True)
    counted = (
        sessions.where("is_real = 1 and project_label is not null")
        .groupBy("project_label")
        .agg(
            F.count(F.when(inside, 1)).alias("in_window"),
            F.count(F.lit(1)).alias("all_time"),
        )
    )
    ticked = ticked_projects(counted, include, exclude)
    held = matching(F.col("project_label"), keep)
    barred = matching(F.col("project_label"), exclude)
    why_off = F.when(F.size(barred) > 0, barred).otherwise(F.array(F.lit("not in the include allowlist")))
    return ticked.select(
        "project_label",
        "in_window",
        "all_time",
        F.when(~F.col("ticked"), "skipped")
        .when(F.size(held) > 0, "reviewed")
        .otherwise("unreviewed")
        .alias("bucket"),
        F.when(~F.col("ticked"), why_off).otherwise(held).alias("why"),
    )


def pattern_ownership(reviewed: DataFrame, patterns: list[str]) -> DataFrame:
    """Per pattern: sessions it holds, projects it holds, and projects it alone holds."""
    rows = reviewed.select(
        F.explode("why").alias("pattern"), "in_window", "all_time", (F.size("why") == 1).alias("alone")
    )
    held = rows.groupBy("pattern").agg(
        F.sum("in_window").alias("in_window"),
        F.sum("all_time").alias("all_time"),
        F.count(F.lit(1)).alias("projects"),
        F.count(F.when(F.col("alone"), 1)).alias("only"),
    )
    zero = F.lit(0).cast("bigint")
    return pattern_frame(reviewed, patterns).join(held, "pattern", "left").select(
        "pattern", *[F.coalesce(c, zero).alias(c) for c in ("in_window", "all_time", "projects", "only")]
    )


def redundancy(reviewed: DataFrame, patterns: list[str]) -> DataFrame:
    """Patterns that could go: ``verdict`` is ``alone`` or ``group``, with the covering group.

    A pattern that is the only match of no project is spare. A project whose
    matches are all spare needs one of them kept, so those form a group; only
    minimal groups count, and a spare pattern in no group is safe to drop.
    """
    unique = list(dict.fromkeys(patterns))
    known = F.array(*[F.lit(p) for p in unique])
    rows = reviewed.select(F.sort_array(F.array_distinct(F.array_intersect("why", known))).alias("m")).where(
        "size(m) > 0"
    )
    # Distinct match sets are at most the subsets of a short pattern list.
    sets = rows.distinct()
    listed = sets.select("m", F.explode("m").alias("pattern"))
    spare = listed.groupBy("pattern").agg(F.max(F.size("m") == 1).alias("sole")).where(~F.col("sole")).select("pattern")
    held = listed.join(spare.withColumn("_spare", F.lit(True)), "pattern", "left").groupBy("m")
    groups = held.agg(F.bool_and(F.coalesce("_spare", F.lit(False))).alias("all_spare")).where("all_spare").select(F.col("m").alias("grp"))
    member = groups.select("grp", F.explode("grp").alias("pattern"))
    # A group that holds all of a smaller one is not minimal.
    inner = member.select(F.col("grp").alias("part"), "pattern").where(F.size("part") > 0)
    larger = (
        member.join(inner, "pattern")
        .where(F.size("part") < F.size("grp"))
        .groupBy("grp", "part")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where(F.col("shared") == F.size("part"))
        .select("grp")
        .distinct()
    )
    joined = spare.join(member.join(larger, "grp", "left_anti"), "pattern", "left")
    return joined.select(
        "pattern",
        F.when(F.col("grp").isNull(), "alone").otherwise("group").alias("verdict"),
        F.array_join("grp", ",").alias("keep_one_of"),
    )


def unacknowledged(items: DataFrame, column: str, baseline: DataFrame) -> DataFrame:
    """Items absent from the acknowledged baseline."""
    return items.join(baseline.select(F.col("item").alias(column)).distinct(), column, "left_anti")
