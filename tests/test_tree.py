"""Walks and fingerprints of real folders: what is read, and the names of what is not."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from threadline.operators.catalog import import_report
from threadline.plans import file_queries
from threadline.sources import transcripts as S
from threadline.sources import tree as T


def _write(path, text: str = "{}\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def _too_deep(root) -> None:
    """Folders below ``root/deep`` whose path gets too long to be listed, whoever asks."""
    (root / "deep").mkdir()
    at = os.open(root / "deep", os.O_RDONLY)
    for _ in range(18):
        os.mkdir("d" * 240, dir_fd=at)
        at, above = os.open("d" * 240, os.O_RDONLY, dir_fd=at), at
        os.close(above)
    os.close(at)


@pytest.mark.parametrize("depth", [0, 1, 2, 5])
def test_a_walk_names_what_it_leaves_out(spark, tmp_path, depth):
    root = tmp_path / "r"
    for name in ("p1/a.jsonl", "p1/s/subagents/agent-b.jsonl", "p1/memory/m.jsonl", "p1/s/memory/kept.jsonl", "p2/_DELETE/x/y.jsonl", "p2/c.jsonl", "top.jsonl", "p2/notes.txt"):
        _write(root / name, name)
    os.symlink("nowhere", root / "p2" / "gone.jsonl")
    os.symlink(root / "p1" / "a.jsonl", root / "p2" / "link.jsonl")
    os.symlink(root / "p1", root / "p2" / "again")
    os.mkfifo(root / "p2" / "pipe.jsonl")
    _too_deep(root)
    rows = T.walk_tree(spark, str(root), ["_DELETE"], depth=depth).collect()
    found = {}
    for r in rows:
        found.setdefault(r.kind, []).append(os.path.relpath(r.path, root))
    assert sorted(found["file"]) == sorted(["p1/a.jsonl", "p1/s/subagents/agent-b.jsonl", "p1/s/memory/kept.jsonl", "p2/c.jsonl", "p2/link.jsonl", "top.jsonl"])
    assert sorted(found["pruned"]) == ["p1/memory", "p2/_DELETE"]
    assert sorted(found["not_a_file"]) == ["p2/gone.jsonl", "p2/pipe.jsonl"]
    assert len(found["unreadable"]) == 1 and found["unreadable"][0].startswith("deep/ddd")
    assert {r.detail for r in rows if r.kind == "unreadable"} == {"ENAMETOOLONG"}
    sizes = {r.path: r.size_bytes for r in rows if r.kind == "file"}
    assert sizes[str(root / "top.jsonl")] == len("top.jsonl")
    report = import_report(T.walk_tree(spark, str(root), ["_DELETE"], depth=depth))
    assert {r[0]: r[1] for r in report.groupBy("outcome").count().collect()} == {"read": 6, "pruned": 2, "not_a_file": 2, "unreadable": 1}


def test_roots_that_cannot_be_walked(spark, tmp_path):
    missing = T.walk_tree(spark, str(tmp_path / "missing")).collect()
    assert {(r.kind, r.detail) for r in missing} == {("unreadable", "ENOENT")}
    with pytest.raises(Exception, match="not a mounted folder"):
        T.walk_tree(spark, "hdfs://far/away").count()
    assert T.plain_path("file:///a%20b/c") == "/a b/c" == T.plain_path("/a b/c")
    (tmp_path / "empty").mkdir()
    assert T.walk_tree(spark, f"file://{tmp_path}/empty").count() == 0
    # With the memory rule off, a project's memory is read.
    _write(tmp_path / "k" / "p" / "memory" / "m.jsonl")
    assert [r.kind for r in T.walk_tree(spark, str(tmp_path / "k"), skip_memory=False).collect()] == ["file"]


def test_the_walk_and_the_listing_agree(spark, tmp_path):
    for k in range(30):
        _write(tmp_path / f"p{k % 4}" / f"s{k % 3}" / f"{k}.jsonl", "x" * (k + 1))
    walked = T.walk_tree(spark, str(tmp_path)).select("path", "size_bytes", F.date_trunc("second", "modified").alias("at"))
    listed = S.list_files(spark, str(tmp_path), "*.jsonl")
    listed = listed.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "size_bytes", F.date_trunc("second", "modified").alias("at"))
    assert walked.exceptAll(listed).count() == listed.exceptAll(walked).count() == 0 and walked.count() == 30
    # Every project is a branch of its own.
    assert T.walk_tree(spark, str(tmp_path)).rdd.getNumPartitions() == 5


def test_a_changed_byte_shows(spark, tmp_path):
    for name in ("a", "b", "c", "d"):
        _write(tmp_path / name, name * (T.BLOCK_BYTES + 5) if name == "a" else name)
    paths = spark.createDataFrame([(str(tmp_path / n),) for n in ("a", "b", "c", "d")], "path string")
    recorded = spark.createDataFrame(T.fingerprint(paths).collect())
    assert {r.path[-1]: r.outcome for r in T.drift(recorded).collect()} == dict.fromkeys("abcd", "same")
    body = bytearray((tmp_path / "a").read_bytes())
    body[-1] ^= 1
    (tmp_path / "a").write_bytes(body)
    os.utime(tmp_path / "b", ns=(5, 5))
    (tmp_path / "c").unlink()
    # New files beside them change nothing: the recorded paths are looked up, not a fresh draw.
    _write(tmp_path / "e")
    assert {r.path[-1]: r.outcome for r in T.drift(recorded).collect()} == {"a": "changed", "b": "touched", "c": "vanished", "d": "same"}


def test_files_are_read_in_several_splits(spark, sf_dir):
    root = file_queries._tree(spark, sf_dir)
    with file_queries._small_splits(spark, root):
        lines = S.read_lines(spark, root, "*.txt")
        split = lines.select("path", F.spark_partition_id().alias("split")).distinct()
        files = {r[0]: r[1] for r in split.groupBy("path").count().collect()}
    assert max(files.values()) >= file_queries.SPLITS
