"""Transcript sources: JSONL lines, whole documents, and the two folder layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions.once import computed_once

# Archive folders that hold no sessions.
RESERVED_FOLDERS = ["locks", "catalog.sqlite", "_orphaned-subagents", "_not-sessions"]

_LOCAL_INDEX_MASK = (1 << 33) - 1


def read_lines(spark: SparkSession, paths: str | list[str], glob: str = "*.jsonl") -> DataFrame:
    """One row per physical line: ``path, line_no, raw``.

    ``line_no`` orders the lines of a file and is unique in it, but is not
    dense: it is the byte offset of the file split plus the record's index in its task.
    A split starts at a later byte than the number of records any earlier
    split of that file can hold, so no shuffle is needed to number lines.
    ``dense_line_numbers`` gives 1, 2, 3 ... where a report needs them.
    """
    lines = (
        spark.read.option("lineSep", "\n")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(paths)
    )
    index = F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_INDEX_MASK))
    return lines.select(
        F.col("_metadata.file_path").alias("path"),
        (F.col("_metadata.file_block_start") + index).alias("line_no"),
        F.col("value").alias("raw"),
    )


def dense_line_numbers(lines: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Replace ``line_no`` by the 1-based number of the line in its file."""
    from threadline.operators.ordered import row_ordinal

    numbered = row_ordinal(lines, ["path"], "line_no", "_n", width)
    return numbered.drop("line_no").withColumnRenamed("_n", "line_no")


def parsed_line(raw: Column) -> Column:
    """VARIANT of a line holding exactly one JSON object, else NULL.

    The line is parsed inside brackets so that text after the object makes it
    malformed, which a bare parse would accept.
    """
    body = F.btrim(raw, F.lit(" \t\n\r\f\x0b﻿"))
    is_object = body.startswith("{") & body.endswith("}")
    boxed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    single = F.try_variant_get(boxed, "$[1]", "variant").isNull()
    return F.when(is_object & single, F.try_variant_get(boxed, "$[0]", "variant"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Non-blank lines with their VARIANT; a malformed line keeps its row with ``v`` NULL."""
    kept = lines.where(F.length(F.btrim(F.col("raw"), F.lit(" \t\n\r\f\x0b"))) > 0)
    return computed_once(kept, {"v": parsed_line(F.col("raw"))})


def read_documents(spark: SparkSession, paths: str | list[str], glob: str = "*.json") -> DataFrame:
    """Whole files as ``path, raw``."""
    return (
        spark.read.option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(paths)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    )


def explode_loglines(documents: DataFrame) -> DataFrame:
    """Entries of documents that carry a ``loglines`` array, in the shape of ``parse_lines``.

    A ``loglines`` that is not an array is one malformed entry, so that it can
    be told from an empty session.
    """
    doc = documents.withColumn("_doc", parsed_line(F.col("raw")))
    lines = F.try_variant_get("_doc", "$.loglines", "variant")
    array = F.try_variant_get("_doc", "$.loglines", "array<variant>")
    doc = doc.where(lines.isNotNull()).withColumn("_lines", array)
    listed = doc.where(F.col("_lines").isNotNull()).select("path", F.posexplode("_lines").alias("_p", "_v"))
    is_object = F.try_variant_get("_v", "$", "map<string,variant>").isNotNull()
    good = listed.select(
        "path",
        (F.col("_p") + 1).cast("bigint").alias("line_no"),
        F.to_json("_v").alias("raw"),
        F.when(is_object, F.col("_v")).alias("v"),
    )
    bad = doc.where(F.col("_lines").isNull()).select(
        "path", F.lit(1).cast("bigint").alias("line_no"), "raw", F.lit(None).cast("variant").alias("v")
    )
    return good.unionByName(bad)


def list_files(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """``path, size_bytes, modified`` of every file that is not empty; the content column is never read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(paths)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    )


def session_key(path: Column) -> Column:
    """The identity a transcript's path tells: its stem, marked for a sub-agent."""
    stem = F.regexp_extract(path, r"([^/]+)\.jsonl$", 1)
    bare = F.regexp_replace(stem, "^agent-", "")
    return F.when(path.contains("/subagents/"), F.concat(F.lit("agent:"), bare)).otherwise(stem)


def _describe(files: DataFrame, shape: str, tree: str, parent: Column, container: Column) -> DataFrame:
    nested = F.col("path").rlike("/subagents/")
    stem = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    return files.where(F.col("path").rlike(shape)).select(
        *files.columns,
        F.lit(tree).alias("source_tree"),
        container.alias("container_name"),
        nested.cast("int").alias("is_subagent"),
        F.when(nested, F.nullif(parent, F.lit(""))).alias("parent_session_uuid"),
        stem.alias("stem"),
        session_key(F.col("path")).alias("key"),
    )


def discover_archive(files: DataFrame) -> DataFrame:
    """Files laid out as ``<root>/<label>/<stamp>_<uuid>/*.jsonl`` with nested ``subagents/``."""
    shape = r"/[^/]+/[^/]+/([^/]+\.jsonl|subagents/.+\.jsonl)$"
    container = F.regexp_extract("path", r"/([^/]+)/[^/]+/(?:[^/]+|subagents/.+)\.jsonl$", 1)
    folder = F.regexp_extract("path", r"/([^/]+)/subagents/", 1)
    parent = F.when(folder.contains("_"), F.regexp_extract(folder, r"^[^_]*_(.*)$", 1))
    found = _describe(files, shape, "archive", parent, container)
    return found.where(
        ~F.col("container_name").isin(RESERVED_FOLDERS) & ~F.col("container_name").startswith("_")
    )


def discover_live(files: DataFrame) -> DataFrame:
    """Files laid out as ``<slug>/<uuid>.jsonl`` with ``<slug>/<session>/subagents/**``."""
    shape = r"/[^/]+/([^/]+\.jsonl|[^/]+/subagents/.+\.jsonl)$"
    container = F.when(
        F.col("path").rlike("/subagents/"), F.regexp_extract("path", r"/([^/]+)/[^/]+/subagents/", 1)
    ).otherwise(F.regexp_extract("path", r"/([^/]+)/[^/]+\.jsonl$", 1))
    parent = F.regexp_extract("path", r"/([^/]+)/subagents/", 1)
    return _describe(files, shape, "live", parent, container)


def _pruned_at(skip_dirs: list[str], root: str, skip_memory: bool) -> Column:
    """The branch of a file that the walk does not enter, NULL for a file it reaches.

    Only folders below the root count, so the root itself may have any name.
    A ``memory`` folder is pruned directly under a project, not deeper.
    """
    below = F.split(F.substr(F.col("path"), F.lit(len(root.rstrip("/")) + 2)), "/")
    folders = F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0)))
    skipped = F.array(*[F.lit(d) for d in skip_dirs]) if skip_dirs else F.array().cast("array<string>")
    memory = F.lit(skip_memory) & (F.get(folders, F.lit(1)) == "memory")
    depths = F.sequence(F.lit(1), F.size(folders))
    hit = F.get(F.filter(depths, lambda i: F.array_contains(skipped, F.get(folders, i - 1)) | ((i == 2) & memory)), F.lit(0))
    return F.when(F.size(folders) > 0, F.when(hit.isNotNull(), F.concat_ws("/", F.lit(root.rstrip("/")), F.array_join(F.slice(folders, 1, hit), "/"))))


def prune_tree(files: DataFrame, skip_dirs: list[str], root: str, skip_memory: bool = True) -> DataFrame:
    """Transcripts below ``root``, without those in a skipped directory at any depth or in a project's memory."""
    inside = files.where(F.col("path").startswith(root.rstrip("/") + "/") & F.col("path").endswith(".jsonl"))
    return inside.where(_pruned_at(skip_dirs, root, skip_memory).isNull())


def pruned_branches(files: DataFrame, skip_dirs: list[str], root: str, skip_memory: bool = True) -> DataFrame:
    """Each branch that the walk leaves out, and how many listed files it holds."""
    inside = files.where(F.col("path").startswith(root.rstrip("/") + "/"))
    branch = _pruned_at(skip_dirs, root, skip_memory).alias("branch")
    return inside.select(branch).where("branch is not null").groupBy("branch").agg(F.count(F.lit(1)).alias("n_files"))


def split_sessions(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark each listed transcript as session or sub-agent; optionally only the first ``limit`` paths."""
    marked = files.withColumn(
        "is_subagent",
        (F.col("path").rlike("/subagents/") | F.col("path").rlike(r"/agent-[^/]*\.jsonl$")).cast("int"),
    )
    return marked.orderBy("path").limit(limit) if limit is not None else marked


def sample_paths(files: DataFrame, per_tree: int, seed: int) -> DataFrame:
    """A repeatable sample: the ``per_tree`` paths of each tree with the smallest seeded hash.

    Each tree's sample is a bounded top-k over all of its paths, so it does not
    change when unrelated files appear.
    """
    ranked = files.withColumn("_rank", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("path")), 256))
    picks = None
    for tree in ("archive", "live"):
        part = ranked.where(F.col("source_tree") == tree).orderBy("_rank").limit(per_tree)
        picks = part if picks is None else picks.unionByName(part)
    return picks.drop("_rank")
