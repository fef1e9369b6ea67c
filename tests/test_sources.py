from __future__ import annotations

import json

from builders import assistant, lines, user
from pyspark.sql import functions as F

from threadline.sources import logs as L
from threadline.sources import transcripts as T

MALFORMED = [
    "not json", "[1, 2]", '"text"', '{"a": 1} trailing', '{"a": 1} {"b": 2}', '{"a": 1}, {"b": 2}', '{"a": ',
]
GOOD = ['{"a": 1, "a": 2}', '  {"a": 1}  ', '﻿{"a": 1}', '{"text": "\\ud83d"}', '{"n": {"n": {"n": 1}}}', "{}"]


def test_malformed_lines_are_kept_and_counted(spark):
    rows = T.parse_lines(lines(spark, [*MALFORMED, "", "   ", *GOOD]))
    got = {r.raw: r.bad for r in rows.select("raw", F.col("v").isNull().alias("bad")).collect()}
    assert got == {**{m: True for m in MALFORMED}, **{g: False for g in GOOD}}


def test_a_repeated_key_takes_the_last_value(spark):
    rows = T.parse_lines(lines(spark, ['{"a": 1, "a": 2}']))
    assert rows.select(F.try_variant_get("v", "$.a", "int")).first()[0] == 2


def test_line_numbers_follow_file_order_over_many_splits(spark, tmp_path):
    for name, n in (("a.jsonl", 3000), ("b.jsonl", 7)):
        (tmp_path / name).write_text("\n".join(json.dumps({"i": i, "pad": "x" * (i % 50)}) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = T.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 4
        dense = T.dense_line_numbers(rows, width=1000).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for r in dense:
        assert json.loads(r.raw)["i"] == r.line_no - 1
    assert len(dense) == 3007


def test_loglines_documents(spark):
    docs = spark.createDataFrame(
        [("d1", '{"loglines": [{"type": "user"}, 7]}'), ("d2", '{"loglines": 3}'), ("d3", '{"type": "user"}'),
         ("d4", '﻿{"loglines": []}')],
        "path string, raw string",
    )
    got = T.explode_loglines(docs).select("path", "line_no", F.col("v").isNull().alias("bad")).collect()
    assert sorted(map(tuple, got)) == [("d1", 1, False), ("d1", 2, True), ("d2", 1, True)]


def test_discovery_of_both_layouts(spark):
    paths = [
        "/r/archive/lab/20260101-000000+0000_u1/u1.jsonl", "/r/archive/lab/20260101-000000+0000_u1/subagents/wf/agent-a.jsonl",
        "/r/archive/_orphaned-subagents/x_u2/u2.jsonl", "/r/archive/locks/x_u3/u3.jsonl",
    ]
    files = spark.createDataFrame([(p, 1) for p in paths], "path string, size_bytes bigint")
    got = {r.stem: (r.container_name, r.is_subagent, r.parent_session_uuid, r.key) for r in T.discover_archive(files).collect()}
    assert got == {"u1": ("lab", 0, None, "u1"), "agent-a": ("lab", 1, "u1", "agent:a")}
    live = spark.createDataFrame([("/r/live/slug/u1.jsonl", 1), ("/r/live/slug/u1/subagents/agent-b.jsonl", 1)], files.schema)
    got = {r.stem: (r.container_name, r.is_subagent, r.parent_session_uuid) for r in T.discover_live(live).collect()}
    assert got == {"u1": ("slug", 0, None), "agent-b": ("slug", 1, "u1")}


def test_listing_does_not_read_content(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("x" * 10)
    files = T.list_files(spark, str(tmp_path))
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "content#" not in plan.split("ReadSchema")[-1]
    assert files.first().size_bytes == 10


def test_history_and_pastes(spark):
    rows = [
        {"sessionId": "s1", "timestamp": 1000, "display": "hi", "pastedContents": {"1": {"contentHash": "h1"}, "2": {"content": "x"}}},
        {"sessionId": "s2", "timestamp": "1000", "display": "/quit"}, {"timestamp": 5}, "bad",
    ]
    history = L.history_rows(lines(spark, rows).drop("path"))
    got = {r.session_uuid: (r.ts is not None, r.display) for r in history.collect()}
    assert got == {"s1": (True, "hi"), "s2": (False, "/quit")}
    assert [tuple(r) for r in L.paste_references(history).collect()] == [("s1", "h1")]


def test_entries_survive_a_round_trip_through_files(spark, tmp_path):
    (tmp_path / "s1.jsonl").write_text("\n".join(json.dumps(e) for e in (user(), assistant())) + "\n\n")
    rows = T.parse_lines(T.read_lines(spark, str(tmp_path)))
    assert [r[0] for r in rows.orderBy("line_no").select(F.try_variant_get("v", "$.type", "string")).collect()] == ["user", "assistant"]


def test_hash_store_listing(spark):
    import hashlib

    good, other = hashlib.sha256(b"a").hexdigest(), hashlib.sha256(b"b").hexdigest()
    rows = [(f"/o/{good[:2]}/{good}.jsonl", b"a"), (f"/o/{other[:2]}/{other}.jsonl", b"x"), (f"/o/zz/{good}.jsonl", b"a"), ("/o/aa/readme.md", b"a")]
    got = L.stored_objects(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert {r.address: r.address == r.actual for r in got} == {good: True, other: False}
