"""Folder integrity: manifests against live files, record keeping, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import times

# Files a writer may replace without breaking a manifest.
REWRITABLE = ["prompts.jsonl", "custom-title.json"]
# File names the pipeline makes for every session.
GENERATED = ["transcript.md", "transcript.compact.md", "conversation.html", "conversation.compact.html", "manifest.json"]


def _both(recorded: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    old = recorded.select(*keys, F.col("sha256").alias("old_hash"), F.col("bytes").alias("old_bytes"), F.lit(True).alias("_old"))
    new = live.select(
        *keys, F.col("sha256").alias("new_hash"), F.col("bytes").alias("new_bytes"),
        *[c for c in live.columns if c == "head_hashes"], F.lit(True).alias("_new"),
    )
    return old.join(new, keys, "full_outer")


def child_problems(recorded: DataFrame, live: DataFrame, noun: str, report_unexpected: bool = False) -> DataFrame:
    """Children a manifest lists that are gone or altered: ``folder, name, problem``."""
    both = _both(recorded, live, ["folder", "name"])
    problem = (
        F.when(F.col("_new").isNull(), F.concat(F.lit(f"{noun} "), F.col("name"), F.lit(" is missing")))
        .when(
            F.col("_old").isNotNull() & (F.col("old_hash") != F.col("new_hash")),
            F.concat(F.lit(f"{noun} "), F.col("name"), F.lit(" does not match its hash")),
        )
    )
    if report_unexpected:
        problem = F.coalesce(
            problem,
            F.when(F.col("_old").isNull(), F.concat(F.col("name"), F.lit(" exists but the manifest says none"))),
        )
    return both.withColumn("problem", problem).where("problem is not null").select("folder", "name", "problem")


def kept_records(recorded: DataFrame, live: DataFrame, may_grow: bool) -> DataFrame:
    """The child records the next manifest carries.

    A child that vanished, or changed other than by growing, keeps its OLD
    record, because overwriting it would erase the only evidence. With
    ``may_grow`` the live frame carries ``grew`` per child.
    """
    old = recorded.select("folder", "name", F.col("sha256").alias("_os"), F.col("bytes").alias("_ob"), F.lit(True).alias("_old"))
    new = live.select(
        "folder", "name", F.col("sha256").alias("_ns"), F.col("bytes").alias("_nb"), F.lit(True).alias("_new"),
        (F.col("grew") if may_grow else F.lit(False)).alias("_grew"),
    )
    both = old.join(new, ["folder", "name"], "full_outer")
    changed = F.coalesce(F.col("_os") != F.col("_ns"), F.lit(False))
    keep_old = F.col("_new").isNull() | (F.col("_old").isNotNull() & changed & ~F.coalesce("_grew", F.lit(False)))
    return both.select(
        "folder",
        "name",
        F.when(keep_old, F.col("_os")).otherwise(F.col("_ns")).alias("sha256"),
        F.when(keep_old, F.col("_ob")).otherwise(F.col("_nb")).alias("bytes"),
        F.when(F.col("_old").isNull(), "added").when(keep_old & F.col("_new").isNull(), "vanished_kept")
        .when(keep_old, "changed_kept").when(changed, "grown").otherwise("same").alias("reason"),
    )


def missing_pages(folders: DataFrame, live: DataFrame) -> DataFrame:
    """Generated files a folder lacks."""
    wanted = folders.select("folder", F.explode(F.array(*[F.lit(n) for n in GENERATED])).alias("name"))
    gone = wanted.join(live.select("folder", "name"), ["folder", "name"], "left_anti")
    return gone.select("folder", "name", F.concat(F.lit("missing "), F.col("name")).alias("problem"))


def payload_problems(manifest: DataFrame, payload: DataFrame) -> DataFrame:
    """Folders whose session payload is not the one the manifest was made from."""
    both = manifest.select("folder", "source_hash").join(payload.select("folder", F.col("sha256").alias("_h")), "folder", "left")
    problem = F.when(F.col("_h").isNull(), "no session payload in the folder").when(
        F.col("_h") != F.col("source_hash"), "payload does not match its manifest"
    )
    return both.withColumn("problem", problem).where("problem is not null").select(
        "folder", F.lit("").alias("name"), "problem"
    )


def folder_name(first_ts: Column, session_uuid: Column, zone: str, fallback: Column) -> Column:
    """``<stamp>_<uuid>``; the stamp is the session's start in the archive's zone."""
    return F.concat(times.folder_stamp(first_ts, zone), F.lit("_"), F.coalesce(session_uuid, fallback))


def name_problems(folders: DataFrame, zone: str) -> DataFrame:
    """Folders whose name disagrees with the payload's start and id."""
    actual = F.regexp_extract("folder", "([^/]+)$", 1)
    fallback = F.regexp_replace(actual, "^[^_]*_", "")
    want = folder_name(F.col("first_at"), F.col("session_uuid"), zone, fallback)
    return folders.withColumn("_want", want).where(actual != F.col("_want")).select(
        "folder", F.lit("").alias("name"),
        F.concat(F.lit("folder name disagrees with its payload: want "), F.col("_want")).alias("problem"),
    )


def folder_report(*parts: DataFrame) -> DataFrame:
    """All problems of all folders in one frame."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def explain_problems(problems: DataFrame, head: DataFrame, pipeline: DataFrame) -> DataFrame:
    """Class of each folder with problems: pending, explained or unexplained.

    ``head`` gives ``folder, payload_is_head, grew, short``; ``pipeline`` gives
    ``short, in_flight``. A folder is pending only when EVERY problem is one
    that a render still on its way would cure; it is explained only when every
    problem has a known harmless cause.
    """
    joined = problems.join(head, "folder", "left").join(pipeline, "short", "left")
    absent = F.col("problem").startswith("missing ") & (F.col("name") != "manifest.json")
    recaptured = (F.col("problem") == "payload does not match its manifest") & F.coalesce("payload_is_head", F.lit(False))
    waiting = F.col("problem").startswith("missing ") | recaptured
    harmless = absent | recaptured | F.col("name").isin(REWRITABLE) | (
        F.col("problem").startswith("sub-agent") & F.col("problem").endswith("hash") & F.coalesce("grew", F.lit(False))
    )
    per = joined.groupBy("folder").agg(
        F.count(F.lit(1)).alias("problems"),
        F.min((waiting & F.coalesce("in_flight", F.lit(False))).cast("int")).alias("_pending"),
        F.min(harmless.cast("int")).alias("_explained"),
    )
    verdict = F.when(F.col("_pending") == 1, "pending").when(F.col("_explained") == 1, "explained").otherwise("unexplained")
    return per.select("folder", "problems", verdict.alias("verdict"))


def unvouched_copies(copies: DataFrame, sources: DataFrame) -> DataFrame:
    """Folders that hold a copied file equal to no source file, with how many."""
    bad = copies.join(sources.select("sha256"), "sha256", "left_anti")
    return bad.groupBy("folder").agg(F.count(F.lit(1)).alias("unvouched"))


def compare_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Recorded paths that vanished or changed (size, time or content), and trees whose file count shrank."""
    b = before.select("path", "tree", F.struct("size_bytes", "modified", "sha256").alias("_b"))
    a = after.select("path", F.struct("size_bytes", "modified", "sha256").alias("_a"))
    pair = b.join(a, "path", "left")
    failed = pair.where("_a is null or _a <> _b").select(
        F.col("path").alias("item"), F.when(F.col("_a").isNull(), "vanished").otherwise("changed").alias("failure")
    )
    counts = (
        before.groupBy("tree").agg(F.count(F.lit(1)).alias("_n0"))
        .join(after.groupBy("tree").agg(F.count(F.lit(1)).alias("_n1")), "tree", "left")
    )
    shrunk = counts.where(F.coalesce("_n1", F.lit(0)) < F.col("_n0")).select(
        F.col("tree").alias("item"), F.lit("shrank").alias("failure")
    )
    return failed.unionByName(shrunk)


def reconcile_statistics(session: DataFrame, versions: DataFrame) -> DataFrame:
    """Statistics rows against the fullest capture of the same session, in one row."""
    own = session.where("is_subagent = 0 and session_uuid is not null").select("session_uuid", "line_count", "first_ts", "last_ts")
    best = versions.where("session_uuid is not null").groupBy("session_uuid").agg(F.max("line_count").alias("_best"))
    lines = own.join(best, "session_uuid").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count(F.when(F.col("line_count") != F.col("_best"), 1)).alias("line_mismatches"),
        F.lit(1).alias("_one"),
    )
    c = versions.select("session_uuid", F.col("line_count").alias("_lines"), F.col("first_ts").alias("_f"), F.col("last_ts").alias("_l"))
    same = own.join(c, "session_uuid").where("line_count = _lines").agg(
        F.count(F.when(~F.col("first_ts").eqNullSafe(F.col("_f")) | ~F.col("last_ts").eqNullSafe(F.col("_l")), 1)).alias("ts_mismatches"),
        F.lit(1).alias("_one"),
    )
    return lines.join(same, "_one").drop("_one")


# Names expected beside a transcript and inside its folders.
KNOWN_SIDECARS = ["subagents", "tool-results", "workflows", "custom-title.json", "auto-mode-classifier-error.txt"]
PROJECT_KNOWN = ["memory"]
IGNORED_NAMES = [".DS_Store"]
SUBAGENT_CHILD = r"^agent-[A-Za-z0-9_.-]+\.(jsonl|meta\.json|prefix\.json|forked-skill(\.marker)?\.json)$|^workflows$"


def sibling_names(entries: DataFrame) -> DataFrame:
    """Class of every entry beside a transcript: known, unknown, unknown inside subagents, stray file.

    ``entries`` is ``parent, name, is_dir, level`` with level ``session``, ``subagents`` or ``project``.
    """
    level, name = F.col("level"), F.col("name")
    agent_file = name.rlike(SUBAGENT_CHILD)
    kind = (
        F.when(name.isin(IGNORED_NAMES), None)
        .when((level == "session") & name.isin(KNOWN_SIDECARS), "known")
        .when(level == "session", "unknown")
        .when((level == "subagents") & ~agent_file, "unknown_inside_subagents")
        .when((level == "project") & ~F.col("is_dir") & ~name.isin(PROJECT_KNOWN) & ~name.endswith(".jsonl"), "stray_file")
    )
    return entries.withColumn("kind", kind).where("kind is not null")
