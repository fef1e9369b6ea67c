"""Interval algebra over session spans: day clipping, merging, concurrency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions import times
from threadline.functions.times import MICROS_PER_HOUR, MICROS_PER_SECOND


def session_spans(sessions: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``begin, end`` instants of real sessions whose span is not backwards."""
    spans = sessions.where("is_real = 1").select(
        *(keep or []),
        times.parse_instant(F.col("first_ts")).alias("begin"),
        times.parse_instant(F.col("last_ts")).alias("end"),
    )
    return spans.where("begin is not null and end is not null and end >= begin")


def clip_to_days(spans: DataFrame, zone: str, begin: str = "begin", end: str = "end") -> DataFrame:
    """One row per local day a span touches: ``local_date, lo, hi`` in microseconds, ``is_start``.

    Days are cut at true local midnights of ``zone``. A span that ends exactly
    at midnight leaves nothing on the next day; a zero-length span keeps one row.
    """
    first_day = F.to_date(times.local_time(F.col(begin), zone))
    last_day = F.to_date(times.local_time(F.col(end), zone))
    day_start = lambda d: times.micros(F.to_utc_timestamp(d.cast("timestamp"), zone))
    days = spans.withColumn("_day", F.explode(F.sequence(first_day, last_day))).withColumn("_first", first_day)
    b, e = times.micros(F.col(begin)), times.micros(F.col(end))
    cut = days.withColumns(
        {
            "lo": F.greatest(b, day_start(F.col("_day"))),
            "hi": F.least(e, day_start(F.date_add("_day", 1))),
            "is_start": F.col("_day") == F.col("_first"),
        }
    ).where((F.col("lo") < F.col("hi")) | F.col("is_start"))
    kept = [c for c in spans.columns if c not in (begin, end)]
    return cut.select(*kept, F.date_format("_day", "yyyy-MM-dd").alias("local_date"), "lo", "hi", "is_start")


def live_edges(spans: DataFrame, day: str, lo: str, hi: str, slot: int) -> DataFrame:
    """Edges of the spans of each day: ``t, before, live, until`` and ``opened``.

    Edges are summed per instant before anything is ordered, so a busy day
    costs its number of distinct instants. Summing the edges of one instant is
    what makes an end come before a start there, and a zero-length span count
    for nothing.
    """
    edges = (
        spans.select(
            F.col(day),
            F.explode(
                F.array(
                    F.struct(F.col(lo).alias("t"), F.lit(1).alias("d")),
                    F.struct(F.col(hi).alias("t"), F.lit(-1).alias("d")),
                )
            ).alias("_e"),
        )
        .groupBy(day, F.col("_e.t").alias("t"))
        .agg(F.sum("_e.d").alias("net"), F.sum(F.greatest("_e.d", F.lit(0))).alias("opened"))
    )
    return sweep_instants(edges, day, slot)


def sweep_instants(edges: DataFrame, day: str, slot: int) -> DataFrame:
    """Running count over ``t, net`` of each day, one row per instant, as of ``live_edges``.

    The ordered pass runs per ``slot`` of the day, with the running count
    carried from slot to slot.
    """
    edges = edges.withColumn("_slot", F.floor(F.col("t") / F.lit(slot)))
    by_slot = Window.partitionBy(day).orderBy("_slot")
    carried = (
        edges.groupBy(day, "_slot")
        .agg(F.sum("net").alias("_net"), F.min("t").alias("_first"))
        .withColumns(
            {
                "_carry": F.coalesce(
                    F.sum("_net").over(by_slot.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
                ),
                "_after": F.lead("_first").over(by_slot),
            }
        )
        .drop("_net", "_first")
    )
    inside = Window.partitionBy(day, "_slot").orderBy("t")
    live = F.col("_carry") + F.sum("net").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    swept = edges.join(carried, [day, "_slot"]).withColumns(
        {"live": live, "until": F.coalesce(F.lead("t").over(inside), F.col("_after"), F.col("t"))}
    )
    return swept.select(day, "t", (F.col("live") - F.col("net")).alias("before"), "live", "until", "opened")


def day_edges(spans: DataFrame, zone: str, keep: list[str] | None = None) -> DataFrame:
    """Signed edges of spans per local day and instant: ``net``, and the sums of the spans that begin there.

    ``sign`` of a span is 1, or -1 to take an earlier one back. All columns add
    up, so edges of many runs can be kept together and summed when they are read.
    """
    keep = keep or []
    pieces = clip_to_days(spans.select(*keep, "sign", "begin", "end"), zone)
    sign, none = F.col("sign").cast("bigint"), F.lit(0).cast("bigint")
    ends = F.array(
        F.struct(
            F.col("lo").alias("t"), sign.alias("net"), sign.alias("active"),
            F.when(F.col("is_start"), sign).otherwise(none).alias("started"), (sign * (F.col("hi") - F.col("lo"))).alias("summed"),
        ),
        F.struct(F.col("hi").alias("t"), (-sign).alias("net"), none.alias("active"), none.alias("started"), none.alias("summed")),
    )
    rows = pieces.select(*keep, "local_date", F.inline(ends))
    return rows.groupBy(*keep, "local_date", "t").agg(*[F.sum(c).alias(c) for c in ("net", "active", "started", "summed")])


def overlap_of_edges(edges: DataFrame, slot_seconds: int = 900) -> DataFrame:
    """The day rows of ``overlap_by_day`` from ``day_edges`` of any number of runs; days without a session are left out."""
    instants = edges.groupBy("local_date", "t").agg(F.sum("net").alias("net")).withColumn("opened", F.lit(0))
    swept = sweep_instants(instants, "local_date", slot_seconds * MICROS_PER_SECOND)
    sums = edges.groupBy("local_date").agg(
        F.sum("active").alias("sessions_active"), F.sum("started").alias("sessions_started"), F.sum("summed").alias("summed_micros")
    )
    return _day_rows(sums.where("sessions_active > 0").join(_merged(swept), "local_date"))


def _merged(swept: DataFrame) -> DataFrame:
    return swept.groupBy("local_date").agg(
        F.sum(F.when(F.col("live") > 0, F.col("until") - F.col("t")).otherwise(0)).alias("merged_micros"),
        F.greatest(F.max("live"), F.lit(0)).alias("max_concurrent"),
    )


def sweep_days(pieces: DataFrame, slot_seconds: int = 900) -> DataFrame:
    """Merged length and peak overlap per day, in one sweep over span edges."""
    return _merged(live_edges(pieces, "local_date", "lo", "hi", slot_seconds * MICROS_PER_SECOND))


def overlap_by_day(spans: DataFrame, zone: str, slot_seconds: int = 900) -> DataFrame:
    """Per local day: sessions active and started, summed and merged hours, concurrency, peak."""
    pieces = clip_to_days(spans.select("begin", "end"), zone)
    sums = pieces.groupBy("local_date").agg(
        F.count(F.lit(1)).alias("sessions_active"),
        F.count(F.when(F.col("is_start"), 1)).alias("sessions_started"),
        F.sum(F.col("hi") - F.col("lo")).alias("summed_micros"),
    )
    return _day_rows(sums.join(sweep_days(pieces, slot_seconds), "local_date"))


def _day_rows(day: DataFrame) -> DataFrame:
    hours = lambda c: F.round(F.col(c) / F.lit(float(MICROS_PER_HOUR)), 3)
    ratio = F.col("summed_micros").cast("double") / F.nullif(F.col("merged_micros"), F.lit(0)).cast("double")
    return day.select(
        "local_date",
        "sessions_active",
        "sessions_started",
        hours("summed_micros").alias("summed_hours"),
        hours("merged_micros").alias("elapsed_hours"),
        F.round(ratio, 3).alias("concurrency"),
        F.col("max_concurrent").cast("bigint").alias("max_concurrent"),
    )


def day_segments(spans: DataFrame, zone: str, keep: list[str]) -> DataFrame:
    """Spans cut to days as ``day, start_second, end_second`` of the local day."""
    pieces = clip_to_days(spans.select(*keep, "begin", "end"), zone)
    midnight = times.micros(F.to_utc_timestamp(F.to_timestamp("local_date", "yyyy-MM-dd"), zone))
    return pieces.select(
        *keep,
        "local_date",
        ((F.col("lo") - midnight) / F.lit(float(MICROS_PER_SECOND))).alias("start_second"),
        ((F.col("hi") - midnight) / F.lit(float(MICROS_PER_SECOND))).alias("end_second"),
    )


def calendar(days: DataFrame, column: str) -> DataFrame:
    """Every day from the first to the last, gaps filled."""
    bounds = days.agg(F.min(F.to_date(column)).alias("lo"), F.max(F.to_date(column)).alias("hi"))
    spread = bounds.where("lo is not null").select(F.explode(F.sequence("lo", "hi")).alias("d"))
    return spread.select(F.date_format("d", "yyyy-MM-dd").alias("local_date"))




def pack_lanes(
    segments: DataFrame, day: str = "local_date", start: str = "start_second", end: str = "end_second",
    slot_seconds: int = 900,
) -> DataFrame:
    """Lane of every segment of a day: the lowest lane free at its start, in start order.

    A day is first cut where no segment is open, because the lanes of such
    stretches do not depend on each other. Inside a stretch each lane depends
    on all before it, so a stretch is one ordered pass; it runs over sorted,
    spilled partitions in Arrow batches and keeps only the open lanes in
    memory, never the stretch.
    """
    import heapq

    import pandas as pd

    swept = live_edges(segments, day, start, end, slot_seconds)
    # Distinct start instants are ordered, not segments; each slot gets the newest begin of those before it.
    instants = swept.where("opened > 0").select(
        F.col(day).alias("_day"),
        F.col("t").alias("_at"),
        F.floor(F.col("t") / F.lit(slot_seconds)).alias("_slot"),
        F.when(F.col("before") == 0, F.col("t")).alias("_begin"),
    )
    last = instants.groupBy("_day", "_slot").agg(F.max("_begin").alias("_seen"))
    earlier = Window.partitionBy("_day").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("_day", "_slot", F.max("_seen").over(earlier).alias("_carry"))
    inside = Window.partitionBy("_day", "_slot").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    stretches = instants.join(carried, ["_day", "_slot"]).select(
        "_day", "_at", F.coalesce(F.max("_begin").over(inside), F.col("_carry")).alias("_stretch")
    )
    names = segments.columns
    met = (F.col(day) == F.col("_day")) & (F.col(start) == F.col("_at"))
    kept = segments.join(stretches, met).select(*names, "_stretch")
    ordered = kept.repartition(day, "_stretch").sortWithinPartitions(day, "_stretch", start, end, *names)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in segments.schema.fields)

    def pack(batches):
        here, busy, free, used = None, [], [], 0
        for pdf in batches:
            lanes = []
            for d, stretch, s, e in zip(pdf[day], pdf["_stretch"], pdf[start], pdf[end], strict=True):
                if (d, stretch) != here:
                    here, busy, free, used = (d, stretch), [], [], 0
                while busy and busy[0][0] <= s:
                    heapq.heappush(free, heapq.heappop(busy)[1])
                if free:
                    lane = heapq.heappop(free)
                else:
                    lane, used = used, used + 1
                heapq.heappush(busy, (e, lane))
                lanes.append(lane)
            yield pdf[names].assign(lane=pd.Series(lanes, index=pdf.index, dtype="int32"))

    return ordered.mapInPandas(pack, f"{fields}, lane int")
