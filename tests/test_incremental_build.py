"""Builds that go on from the last one: what is read, written and left alone."""

from __future__ import annotations

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from threadline.operators import facts as K
from threadline.operators import session as S
from threadline.operators.intervals import day_edges, overlap_by_day, overlap_of_edges, session_spans
from threadline.plans import etl

ZONE = "Australia/Melbourne"
TABLES = ("entry", "session", "turn", "tool_call", "attribution", "overlap_day", "listing")


def _line(minute: int, day: int = 1, tokens: int = 5, label: str = "app") -> str:
    return json.dumps(
        {
            "type": "assistant", "timestamp": f"2026-06-{day:02d}T{minute // 60:02d}:{minute % 60:02d}:00Z", "cwd": f"/home/ann/projects/{label}",
            "sessionId": "s", "attributionSkill": "review",
            "message": {"role": "assistant", "model": "claude-opus-4-8", "content": [{"type": "tool_use", "name": "Read"}], "usage": {"input_tokens": tokens}},
        }
    )


def _inputs(spark, files: dict):
    rows = [(f"/live/p/{name}.jsonl", k, raw) for name, (raws, _) in files.items() for k, raw in enumerate(raws)]
    lines = spark.createDataFrame(rows, "path string, line_no bigint, raw string")
    listing = spark.createDataFrame(
        [(f"/live/p/{n}.jsonl", sum(len(r) + 1 for r in raws), at) for n, (raws, at) in files.items()], "path string, size_bytes bigint, modified string"
    )
    return lines, listing.withColumn("modified", F.col("modified").cast("timestamp"))


def _corpus() -> dict:
    return {f"f{k}": ([_line(m, 1 + k % 9, k, f"app{k % 3}") for m in range(7 * k, 7 * k + 60, 20)], "2026-06-10") for k in range(30)}


def _changed(files: dict) -> dict:
    """One file grows into another day, one shrinks, one goes, one comes; the rest stays."""
    new = dict(files)
    new["f3"] = (files["f3"][0] + [_line(1_300, 4), _line(30, 5)], "2026-06-11")
    new["f4"] = (files["f4"][0][:1], "2026-06-11")
    del new["f5"]
    new["g1"] = ([_line(5, 2, 9), _line(9, 2, 9)], "2026-06-11")
    return new


def _bag(df, drop=()) -> list:
    return sorted(str(sorted(r.asDict().items(), key=str)) for r in df.drop(*drop).collect())


def _same(a: etl.Facts, b: etl.Facts) -> None:
    for name in TABLES:
        columns = sorted(set(getattr(a, name).columns) - {"run"})
        assert _bag(getattr(a, name).select(columns)) == _bag(getattr(b, name).select(columns)), name


def _files(root: str) -> dict:
    base = root.removeprefix("file:")
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(base) for n in names}


@pytest.fixture(scope="module")
def builds(spark):
    files = _corpus()
    old = etl.build_facts(spark, *_inputs(spark, files), ZONE)
    before = _files(old.root)
    new_files = _changed(files)
    lines, listing = _inputs(spark, new_files)
    changed = ["/live/p/f3.jsonl", "/live/p/f4.jsonl", "/live/p/g1.jsonl"]
    new = etl.build_facts(spark, lines.where(F.col("path").isin(changed)), listing, ZONE, previous=old)
    whole = etl.build_facts(spark, lines, listing, ZONE)
    return files, old, before, new, whole


def test_equals_a_whole_build(builds):
    _, _, _, new, whole = builds
    assert new.root != whole.root and len(new.runs) == 2
    _same(new, whole)


def test_files_of_earlier_runs_keep_their_names_and_bytes(builds):
    _, old, before, new, _ = builds
    now = _files(new.root)
    assert new.root == old.root and before and all(now[f] == at for f, at in before.items())
    added = {f for f in now if f not in before}
    assert added and all(f"run={new.runs[-1]}" in f for f in added)
    # What was added is the changed files' rows, not a copy of the rest.
    assert {r.key for r in old.session.sparkSession.read.parquet(f"{new.root}/session/run={new.runs[-1]}").collect()} == {"f3", "f4", "g1"}


def test_earlier_facts_stay_readable(spark, builds):
    files, old, _, _, _ = builds
    assert old.session.count() == len(files)
    _same(old, etl.build_facts(spark, *_inputs(spark, files), ZONE))


def test_overlap_after_a_change_reads_touched_days_only(builds):
    _, _, _, new, whole = builds
    full = overlap_by_day(session_spans(whole.session), ZONE)
    assert _bag(new.overlap_day) == _bag(full) == _bag(overlap_of_edges(new.edges))
    plan = overlap_of_edges(new.edges.where(F.col("local_date").isin(["2026-06-04", "2026-06-05"])))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*local_date", plan)


def test_selected_overlap_from_edges(spark, builds):
    _, _, _, new, whole = builds
    from threadline.operators.selection import Span

    scope = K.Scope(span=Span("2026-06-02", "2026-06-08"), labels=spark.createDataFrame([("app1",), ("nobody",)], "project_label string"))
    by_edges = K.overlap_days(new.session, new.overlap_day, ZONE, scope, new.edges)
    assert _bag(by_edges) == _bag(K.overlap_days(whole.session, whole.overlap_day, ZONE, scope)) != []
    # The sessions are not read.
    assert by_edges._jdf.queryExecution().executedPlan().toString().count("first_ts") == 0


def test_edges_taken_back_leave_no_day(spark):
    spans = spark.createDataFrame([("2026-06-01T01:00:00", "2026-06-02T20:00:00", s) for s in (1, 1, -1)], "begin string, end string, sign int")
    spans = spans.select(F.col("begin").cast("timestamp").alias("begin"), F.col("end").cast("timestamp").alias("end"), "sign")
    once = overlap_by_day(spans.where("sign = -1"), ZONE)
    assert _bag(overlap_of_edges(day_edges(spans, ZONE))) == _bag(once)
    gone = day_edges(spans.limit(0).unionByName(spans.where("sign = -1")).unionByName(spans.where("sign = 1").limit(1)), ZONE)
    assert overlap_of_edges(gone).count() == 0


def test_the_fold_neither_shuffles_nor_sorts_the_entries(builds):
    _, old, _, _, _ = builds
    plan = S.fold(old.entry)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort [" not in plan and "SortAggregate" in plan
    whole = S.folded_sessions(old.entry)._jdf.queryExecution().executedPlan().toString()
    # A side that is small enough may be broadcast; nothing is dealt anew.
    assert "Exchange hashpartitioning" not in whole and "Exchange rangepartitioning" not in whole
    for df in (S.turns(old.entry, None), S.attribution(old.entry)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_large_transcripts_are_folded_across_tasks(spark, builds, monkeypatch):
    files, old, _, _, whole = builds
    sizes = sorted(sum(len(r) + 1 for r in raws) for raws, _ in files.values())
    monkeypatch.setattr(etl, "HOT_BYTES", sizes[5])
    hot = etl.build_facts(spark, *_inputs(spark, files), ZONE, line_chunk=2)
    assert hot.hot_runs and 0 < spark.read.parquet(f"{hot.root}/entry_hot/run={hot.runs[0]}").count() < hot.entry.count()
    _same(hot, old)
    new = etl.build_facts(spark, *_inputs(spark, _changed(files)), ZONE, line_chunk=2, previous=hot)
    _same(new, whole)


def test_many_replaced_keys_lead_to_new_tables(spark, builds, monkeypatch):
    files, old, before, _, whole = builds
    monkeypatch.setattr(etl, "REPLACED_KEYS", 1)
    new = etl.build_facts(spark, *_inputs(spark, _changed(files)), ZONE, previous=old)
    assert new.root != old.root and len(new.runs) == 1 and new.replaced is None
    _same(new, whole)
    again = _changed(files)
    again["f7"] = (again["f7"][0] + [_line(900, 8)], "2026-06-12")
    monkeypatch.undo()
    third = etl.build_facts(spark, *_inputs(spark, again), ZONE, previous=new)
    assert len(third.runs) == 2
    _same(third, etl.build_facts(spark, *_inputs(spark, again), ZONE))


def test_a_later_session_goes_on_from_a_recorded_build(spark, builds):
    files, _, _, new, whole = builds
    read = etl.open_facts(spark, new.root, new.runs[-1])
    _same(read, whole)
    again = _changed(files)
    again["f9"] = (again["f9"][0][:2], "2026-06-12")
    _same(etl.build_facts(spark, *_inputs(spark, again), ZONE, previous=read), etl.build_facts(spark, *_inputs(spark, again), ZONE))


def test_nothing_changed_and_nothing_there(spark, builds):
    files, old, _, _, _ = builds
    lines, listing = _inputs(spark, files)
    same = etl.build_facts(spark, lines.limit(0), listing, ZONE, previous=old)
    _same(same, old)
    none = etl.build_facts(spark, lines.limit(0), listing.limit(0), ZONE)
    assert none.session.count() == none.entry.count() == none.overlap_day.count() == 0
    first = etl.build_facts(spark, lines, listing, ZONE, previous=none)
    _same(first, old)
