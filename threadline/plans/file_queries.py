"""Queries over real files: the lines of the events, laid down as a folder tree and read back."""

from __future__ import annotations

import contextlib
import os
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.operators import catalog as C
from threadline.plans import standins as X
from threadline.runtime import new_run_dir, prepare, stage
from threadline.sources import transcripts as S
from threadline.sources import tree as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Splits that the largest file is read in.
SPLITS = 4
_laid: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name], ORACLE[name] = run, sql


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder ``project=<p>/folder=<f>`` with one file of lines each, laid down once per session; its address."""
    prepare(spark)
    laid = _laid.setdefault(spark, {})
    if sf_dir not in laid:
        root = new_run_dir(spark, "tree")
        folder = F.when(F.col("user_id") % 7 == 0, "node_modules").otherwise(F.concat(F.lit("s"), F.col("user_id") % 3))
        raw = F.concat(F.lit('{"id":'), "event_id", F.lit(',"type":"'), "event_type", F.lit('"}'))
        rows = X.table(spark, sf_dir, "events").select("event_id", raw.alias("value"), (F.col("user_id") % 5).alias("project"), folder.alias("folder"))
        dealt = rows.repartition("project", "folder").sortWithinPartitions("project", "folder", "event_id")
        dealt.select("value", "project", "folder").write.partitionBy("project", "folder").text(root)
        laid[sf_dir] = root
    return laid[sf_dir]


_LINES = """l AS (SELECT event_id, user_id % 5 AS project, CASE WHEN user_id % 7 = 0 THEN 'node_modules' ELSE 's' || (user_id % 3) END AS folder,
  '{"id":' || event_id || ',"type":"' || event_type || '"}' AS raw FROM events)"""


@contextlib.contextmanager
def _small_splits(spark: SparkSession, root: str):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    largest = S.list_files(spark, root, "*.txt").agg(F.max("size_bytes")).first()[0] or 0
    spark.conf.set(key, str(largest // SPLITS + 1))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense line numbers over files that are read in many splits."""
    root = _tree(spark, sf_dir)
    with _small_splits(spark, root):
        lines = S.dense_line_numbers(S.read_lines(spark, root, "*.txt"), 1 << 14)
        place = [F.regexp_extract("path", f"{k}=([^/]+)", 1).alias(k) for k in ("project", "folder")]
        return stage(lines.select(*place, "line_no", F.sha2("raw", 256).alias("raw_sha256")), new_run_dir(spark, "numbered"))


_add("s01_lines_of_files", _numbered, f"""WITH {_LINES}
SELECT CAST(project AS VARCHAR) AS project, folder, row_number() OVER (PARTITION BY project, folder ORDER BY event_id) AS line_no, sha256(raw) AS raw_sha256 FROM l""")


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = S.list_files(spark, _tree(spark, sf_dir), "*.txt")
    return files.select(F.regexp_extract("path", "(project=[^/]+/folder=[^/]+)/", 1).alias("branch"), "size_bytes", F.col("modified").isNotNull().alias("dated"))


_add("s03_s04_files_listed", _listed, f"""WITH {_LINES}
SELECT 'project=' || project || '/folder=' || folder AS branch, CAST(sum(strlen(raw) + 1) AS BIGINT) AS size_bytes, true AS dated FROM l GROUP BY project, folder""")


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk of the tree with what an import would say of each branch; two entries of it cannot be read."""
    root = T.plain_path(_tree(spark, sf_dir))
    if not os.path.lexists(f"{root}/loop.txt"):
        os.symlink("loop.txt", f"{root}/loop.txt")
        # Folders deeper than a path may be long: the walk is refused on its way down.
        at = os.open(root, os.O_RDONLY)
        for _ in range(20):
            os.mkdir("d" * 250, dir_fd=at)
            at, above = os.open("d" * 250, os.O_RDONLY, dir_fd=at), at
            os.close(above)
        os.close(at)
    walked = T.walk_tree(spark, root, ["folder=node_modules"], suffix=".txt")
    branch = F.regexp_extract(F.substr("path", F.lit(len(root) + 2)), r"^(d+|project=[^/]+/folder=[^/]+|[^/]+)", 1)
    return C.import_report(walked).select("outcome", F.regexp_replace(branch, "^d+$", "deep").alias("branch"), "size_bytes", "detail")


_add("s05_k16_walked_tree", _walked, f"""WITH {_LINES}
SELECT CASE WHEN folder = 'node_modules' THEN 'pruned' ELSE 'read' END AS outcome, 'project=' || project || '/folder=' || folder AS branch,
  CASE WHEN folder <> 'node_modules' THEN CAST(sum(strlen(raw) + 1) AS BIGINT) END AS size_bytes, NULL AS detail FROM l GROUP BY project, folder
UNION ALL SELECT 'unreadable', 'deep', NULL, 'ENAMETOOLONG'
UNION ALL SELECT 'unreadable', 'loop.txt', NULL, 'ELOOP'""")


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = S.list_files(spark, _tree(spark, sf_dir), "*.txt").withColumn("source_tree", F.lit("archive"))
    sample = S.sample_paths(files, files.count(), 7)
    recorded = stage(T.fingerprint(sample), new_run_dir(spark, "fingerprint"))
    both = recorded.join(T.drift(recorded), "path")
    return both.select(F.regexp_extract("path", "(project=[^/]+/folder=[^/]+)/", 1).alias("branch"), "size_bytes", "sha256", (F.col("modified_ns") > 0).alias("dated"), "outcome")


_add("s16_j27_fingerprint", _fingerprints, f"""WITH {_LINES}
SELECT 'project=' || project || '/folder=' || folder AS branch, CAST(sum(strlen(raw) + 1) AS BIGINT) AS size_bytes,
  sha256(string_agg(raw || chr(10), '' ORDER BY event_id)) AS sha256, true AS dated, 'same' AS outcome FROM l GROUP BY project, folder""")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document file per conversation, read whole."""
    prepare(spark)
    root = new_run_dir(spark, "documents")
    turn = F.struct(F.col("turn"), F.col("role").alias("type"), F.col("text"))
    whole = X.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(turn)).alias("loglines"))).alias("value"))
    whole.write.partitionBy("conv_id").text(root)
    entries = S.explode_loglines(S.read_documents(spark, root, "*.txt"))
    return entries.select(
        F.regexp_extract("path", "conv_id=([^/]+)/", 1).cast("bigint").alias("conv_id"), "line_no",
        F.try_variant_get("v", "$.type", "string").alias("type"), F.sha2(F.try_variant_get("v", "$.text", "string"), 256).alias("text_sha256"),
    )


_add("s02_documents_of_files", _documents, """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS line_no, role AS type, sha256(text) AS text_sha256 FROM conversations""")
