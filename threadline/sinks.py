"""Sinks: published tables, exports, logs and snapshots."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.operators import reports as R

COST_NOTE = "Costs are estimates at list price, not a bill"


class FindingsRefused(Exception):
    """A corpus with secret-shaped strings was not written."""

    def __init__(self, count: int):
        super().__init__(f"{count} secret-shaped strings found; nothing was written")
        self.count = count


def publish(tables: Mapping[str, DataFrame], root: str, run: str) -> str:
    """Write all tables into one run folder, then point readers at it.

    Readers follow the pointer, which is written last, so they see either the
    whole old run or the whole new one. Session rows are split by month.
    """
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if "local_date" in df.columns and "key" in df.columns:
            month = df.withColumn("month", F.coalesce(F.substring("local_date", 1, 7), F.lit("undated")))
            # Tasks are of a bounded size in bytes: a large month is split, small ones share no file.
            writer = month.hint("rebalance", "month").write.mode("overwrite").partitionBy("month")
        writer.parquet(f"{root}/{run}/{name}")
    spark = next(iter(tables.values())).sparkSession
    pointer = spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("at"))
    pointer.write.mode("append").json(f"{root}/_current")
    return f"{root}/{run}"


def published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the newest published run."""
    run = spark.read.json(f"{root}/_current").orderBy(F.desc("at")).first()["run"]
    return spark.read.parquet(f"{root}/{run}/{name}")


def export_csv(df: DataFrame, path: str, note: str = COST_NOTE, order: list | None = None) -> None:
    """One ordered CSV with a header; the note goes beside it, as Spark's CSV has no comment line.

    The order is a range sort, so rows are never gathered in one task: the part
    files follow each other in order.
    """
    ordered = df.orderBy(*order) if order else df
    ordered.write.mode("overwrite").option("header", "true").csv(path)
    df.sparkSession.range(1).select(F.lit(note).alias("value")).write.mode("overwrite").text(f"{path}_note")


def export_views(facts, path: str) -> list[str]:
    """The nine flat exports in their fixed order."""
    targets = {
        "sessions": (facts.session, ["first_ts", "key"]),
        "turns": (facts.turn, ["session_key", "ordinal"]),
        "projects": (R.view_project(facts.session), [F.desc("cost_usd"), "repo_root", "project_label"]),
        "daily": (R.view_daily(facts.session), ["local_date"]),
        "hourly": (R.view_hourly(facts.session), ["local_weekday", "local_hour"]),
        "models": (R.view_model(facts.turn), [F.desc("cost_usd"), "model"]),
        "tools": (R.view_tool(facts.tool_call), [F.desc("calls"), "tool_name"]),
        "attribution": (R.view_attribution(facts.attribution), [F.desc("uses"), "kind", "name"]),
        "overlap": (facts.overlap_day, ["local_date"]),
    }
    for name, (df, order) in targets.items():
        export_csv(df, f"{path}/{name}", order=order)
    return list(targets)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_cube(parts: Mapping[str, DataFrame], path: str) -> None:
    """The parts of a dashboard or wall export, one folder each."""
    for name, df in parts.items():
        write_json(df, f"{path}/{name}")


def build_report(facts) -> DataFrame:
    """Row counts, totals and checks of a build as ``item, value``."""
    counts = None
    for name in ("session", "turn", "tool_call", "attribution", "overlap_day"):
        part = getattr(facts, name).agg(F.count(F.lit(1)).cast("string").alias("value")).select(
            F.lit(f"rows:{name}").alias("item"), "value"
        )
        counts = part if counts is None else counts.unionByName(part)
    checks = R.self_checks(facts.session, facts.turn, facts.overlap_day).select(
        F.concat(F.lit("check:"), "check_name").alias("item"), F.col("value").cast("string").alias("value")
    )
    unpriced = R.unpriced_models(facts.entry).select(
        F.concat(F.lit("unpriced:"), "model").alias("item"), F.col("turns").cast("string").alias("value")
    )
    return counts.unionByName(checks).unionByName(unpriced)


def write_transcripts(pieces: DataFrame, path: str, key: str = "path", files: int | None = None) -> None:
    """Text pieces sorted by session and position.

    The range sort splits a very long session over several files and keeps
    its pieces in order across them.
    """
    plan = pieces.repartitionByRange(files, key, "seq") if files else pieces.repartitionByRange(key, "seq")
    plan.sortWithinPartitions(key, "seq").write.mode("overwrite").parquet(path)


def split_history(history: DataFrame, path: str) -> None:
    """Prompt-history lines of each session, byte for byte, in file order."""
    history.select("session_uuid", "line_no", "raw").repartitionByRange("session_uuid", "line_no").sortWithinPartitions(
        "session_uuid", "line_no"
    ).write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append-only events, store rows and snapshots."""
    df.write.mode("append").parquet(path)


def share(
    redacted: DataFrame, findings: DataFrame, report: DataFrame, path: str, allow_findings: bool = False
) -> int:
    """Write the redacted corpus and its reports, unless secrets were found and are not allowed.

    The findings are counted first: this action is the gate, and nothing is
    written before it passes.
    """
    found = findings.count()
    if found and not allow_findings:
        raise FindingsRefused(found)
    redacted.write.mode("overwrite").parquet(f"{path}/corpus")
    findings.write.mode("overwrite").parquet(f"{path}/findings")
    report.write.mode("overwrite").json(f"{path}/report")
    return found


def coverage_snapshot(sidecars: DataFrame, prompts: DataFrame, at: str) -> DataFrame:
    """The two coverage figures as one stamped row."""
    both = sidecars.withColumn("_one", F.lit(1)).join(prompts.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("at", F.lit(at))


def describe_scope(header: DataFrame) -> str:
    """The one-row export header as JSON text."""
    return json.dumps(header.first().asDict(recursive=True), default=str, sort_keys=True)
