"""Folder trees as Spark reads them: a walk that names what it leaves out, and content fingerprints.

Both open files by path in the tasks, so the folders have to be mounted on all
executors. Stores that only Spark reaches are listed by ``transcripts.list_files``.
"""

from __future__ import annotations

import errno
import hashlib
import os
from datetime import UTC, datetime
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a file that are held at once while it is hashed.
BLOCK_BYTES = 1 << 20
_SCHEMA = "kind string, path string, size_bytes bigint, modified timestamp, detail string"


def plain_path(path: str) -> str:
    """The path of a ``file:`` address; other stores cannot be opened by path."""
    if path.startswith("file:"):
        return "/" + unquote(path.removeprefix("file:")).lstrip("/")
    if ":/" in path:
        raise ValueError(f"{path} is not a mounted folder")
    return path


class Branch(InputPartition):
    def __init__(self, folder: str, deep: bool):
        super().__init__(folder)
        self.folder, self.deep = folder, deep


class TreeReader(DataSourceReader):
    """One partition per branch: a folder ``depth`` levels below the root with all below it, or one above it alone."""

    def __init__(self, options: dict):
        self.root = plain_path(options["path"]).rstrip("/") or "/"
        self.skip = frozenset(n for n in options.get("skip", "").split("/") if n)
        self.skip_memory = options.get("skipmemory", "true") == "true"
        self.suffix, self.depth = options.get("suffix", ".jsonl"), int(options.get("depth", "1"))

    def _pruned(self, folder: str, name: str) -> bool:
        # A memory folder belongs to the project right above it.
        in_project = os.path.dirname(folder) == self.root
        return name in self.skip or (self.skip_memory and name == "memory" and in_project)

    def partitions(self) -> list[Branch]:
        found, level = [], [self.root]
        for _ in range(self.depth):
            below = []
            for folder in level:
                found.append(Branch(folder, False))
                try:
                    with os.scandir(folder) as entries:
                        below += sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and not self._pruned(folder, e.name))
                except OSError:
                    pass  # the branch's own partition reports it
            level = below
        return found + [Branch(folder, True) for folder in level]

    def read(self, branch: Branch):
        todo = [branch.folder]
        while todo:
            folder = todo.pop()
            try:
                with os.scandir(folder) as listed:
                    entries = sorted(listed, key=lambda e: e.name)
            except OSError as refused:
                yield "unreadable", folder, None, None, errno.errorcode.get(refused.errno, str(refused.errno))
                continue
            for entry in entries:
                if entry.is_dir(follow_symlinks=False):
                    if self._pruned(folder, entry.name):
                        # Never entered; reported by the partition that lists its parent.
                        yield "pruned", entry.path, None, None, None
                    elif branch.deep:
                        todo.append(entry.path)
                elif entry.name.endswith(self.suffix):
                    yield self._file(entry)

    def _file(self, entry: os.DirEntry) -> tuple:
        try:
            if entry.is_file():
                known = entry.stat()
                return "file", entry.path, known.st_size, datetime.fromtimestamp(known.st_mtime, UTC), None
            return "not_a_file", entry.path, None, None, "symlink" if entry.is_symlink() else "special"
        except OSError as refused:
            return "unreadable", entry.path, None, None, errno.errorcode.get(refused.errno, str(refused.errno))


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "threadline_tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def walk_tree(
    spark: SparkSession, root: str, skip_dirs: list[str] | None = None, skip_memory: bool = True, suffix: str = ".jsonl", depth: int = 1
) -> DataFrame:
    """Everything below ``root`` that matters: ``kind, path, size_bytes, modified, detail``.

    Kinds: ``file`` (a transcript), ``pruned`` (a folder that is skipped by name,
    or a project's memory; it is not entered), ``unreadable`` (with the error's
    name; the rest is still walked) and ``not_a_file`` (a name like a transcript's
    that is a dangling link, pipe or device). Links to folders are not followed.
    The driver lists ``depth`` levels; each folder below is one task's branch.
    """
    spark.dataSource.register(TreeSource)
    options = {"skip": "/".join(skip_dirs or []), "skipMemory": str(skip_memory).lower(), "suffix": suffix, "depth": str(depth)}
    return spark.read.format("threadline_tree").options(**options).load(root)


def _hash_files(batches):
    schema = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("modified_ns", pa.int64()), ("sha256", pa.string())])
    for batch in batches:
        out = []
        for path in batch.column("path").to_pylist():
            try:
                with open(plain_path(path), "rb") as file:
                    digest = hashlib.sha256()
                    while block := file.read(BLOCK_BYTES):
                        digest.update(block)
                    known = os.fstat(file.fileno())
                out.append((path, known.st_size, known.st_mtime_ns, digest.hexdigest()))
            except OSError:
                out.append((path, None, None, None))
        yield pa.RecordBatch.from_pydict({f.name: [o[i] for o in out] for i, f in enumerate(schema)}, schema=schema)


def fingerprint(paths: DataFrame) -> DataFrame:
    """``path, size_bytes, modified_ns, sha256`` of a file list, dealt over the tasks and hashed block by block.

    A file that is not there any more has nulls. To compare a snapshot, pass its
    own paths: a fresh sample may hold others.
    """
    return paths.select("path").repartition("path").mapInArrow(_hash_files, "path string, size_bytes bigint, modified_ns bigint, sha256 string")


def drift(recorded: DataFrame) -> DataFrame:
    """What became of the recorded files: ``path, outcome`` (same, touched, changed, vanished)."""
    now = fingerprint(recorded).select("path", *[F.col(c).alias(f"_{c}") for c in ("size_bytes", "modified_ns", "sha256")])
    outcome = (
        F.when(F.col("_sha256").isNull(), "vanished")
        .when((F.col("_sha256") != F.col("sha256")) | (F.col("_size_bytes") != F.col("size_bytes")), "changed")
        .when(F.col("_modified_ns") != F.col("modified_ns"), "touched")
        .otherwise("same")
    )
    return recorded.join(now, "path").select("path", outcome.alias("outcome"))
