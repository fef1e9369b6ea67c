from __future__ import annotations

import json

import pytest
from builders import assistant, lines, user
from pyspark.sql import functions as F

from threadline.operators import session as S
from threadline.operators.catalog import keep_largest
from threadline.plans import etl


def fold(spark, entries, zone="UTC", path="/archive/l/x_s1/s1.jsonl"):
    rows = lines(spark, entries, path)
    listing = rows.groupBy("path").agg(F.sum(F.octet_length("raw") + 1).alias("size_bytes"))
    return etl.build_facts(spark, rows, listing, zone)


def test_usage_rules(spark):
    usage = lambda **k: {"input_tokens": 10, "output_tokens": 20, **k}
    f = fold(spark, [
        assistant(usage=usage(cache_creation_input_tokens=9, cache_creation={"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 5})),
        assistant(usage=usage(cache_creation_input_tokens=9, cache_creation={"ephemeral_5m_input_tokens": 4, "ephemeral_1h_input_tokens": 4})),
        assistant(usage=usage(cache_creation_input_tokens=7)),
        assistant(usage=usage(output_tokens_details={"thinking_tokens": 99})),
        assistant(usage={"input_tokens": "5", "output_tokens": 2.9}),
        assistant(usage="none"),
    ])
    got = [tuple(r) for r in f.turn.orderBy("ordinal").select("input_tokens", "output_tokens", "cache_write_5m", "cache_write_1h", "thinking_tokens").collect()]
    assert got == [(10, 20, 4, 5, 0), (10, 20, 9, 0, 0), (10, 20, 7, 0, 0), (10, 20, 0, 0, 20), (0, 2, 0, 0, 0), (0, 0, 0, 0, 0)]


def test_cost_by_longest_prefix_and_speed(spark):
    use = {"input_tokens": 1_000_000, "output_tokens": 1_000_000}
    f = fold(spark, [
        assistant(model="claude-opus-4-8-20260101", usage=use), assistant(model="claude-opus-4-8", usage={**use, "speed": "fast"}),
        assistant(model="claude-haiku-4-5-20251001", usage={**use, "speed": "fast"}), assistant(model="mystery-1", usage=use),
        assistant(model="<synthetic>", usage=use),
        assistant(model="claude-opus-5", usage={"cache_creation_input_tokens": 2_000_000, "cache_read_input_tokens": 1_000_000,
                  "cache_creation": {"ephemeral_5m_input_tokens": 1_000_000, "ephemeral_1h_input_tokens": 1_000_000}}),
    ])
    assert [r.cost_usd for r in f.turn.orderBy("ordinal").collect()] == [30.0, 60.0, 6.0, 0.0, 0.0, 6.25 + 10.0 + 0.5]
    from threadline.operators.reports import unpriced_models

    assert [tuple(r) for r in unpriced_models(f.entry).collect()] == [("mystery-1", 1)]
    s = f.session.first()
    assert s.cost_usd == pytest.approx(sum(r.cost_usd for r in f.turn.collect()))


def test_first_and_last_values_follow_entry_order(spark):
    f = fold(spark, [
        {"type": "ai-title", "aiTitle": "one", "timestamp": "2026-06-01T12:00:00Z"},
        user("  [Request interrupted by user]", ts="2026-06-01T09:00:00Z", cwd=" "),
        user("real prompt ", cwd="/home/ann/projects/app", version="2", isMeta=False),
        user("ignored", isMeta=True, cwd="/other", version="1"),
        {"type": "ai-title", "aiTitle": "two"}, {"type": "ai-title", "aiTitle": "  "},
        assistant(model="b"), assistant(model="a"), assistant(model="a"), assistant(model="b"),
        "broken", user([{"type": "tool_result", "is_error": True}, {"type": "text", "text": "t"}, {"type": "tool_result", "is_error": False}]),
    ])
    s = f.session.first()
    assert (s.first_ts, s.ai_title, s.cwd, s.cc_version, s.primary_model) == ("2026-06-01T12:00:00Z", "two", "/home/ann/projects/app", "2", "b")
    assert (s.n_user_prompts, s.n_interrupts, s.n_tool_results, s.n_malformed_lines, s.line_count) == (2, 1, 2, 1, 12)
    assert s.first_prompt_preview == "real prompt"
    assert json.loads(s.models_json) == {"a": 2, "b": 2} and s.models_json == '{"a": 2, "b": 2}'
    assert s.project_label == "app" and s.wall_seconds < 0
    assert [tuple(r) for r in f.tool_call.select("tool_name", "is_error").collect()] == [("(error-result)", 1)]


def test_frequency_map_escapes_names(spark):
    f = fold(spark, [assistant(effort='a "quoted" \\ name'), assistant(effort="b")])
    assert json.loads(f.session.first().effort_json) == {'a "quoted" \\ name': 1, "b": 1}


@pytest.mark.parametrize("gaps", [[10, 300, 301, 5], [300, 300, 300], [0, 0, 1000], [299, 2, 299, 600, 1]])
def test_engaged_time_matches_a_plain_loop(spark, gaps):
    at = [1_780_000_000]
    for g in gaps:
        at.append(at[-1] + g)
    rows = spark.createDataFrame([("k", t) for t in at], "key string, t bigint").select("key", F.timestamp_seconds("t").alias("ts"))
    got = S.engaged_seconds(rows, "key", "ts").first().engaged_micros
    assert got == sum(g for g in gaps if g <= 300) * 1_000_000


def test_largest_file_wins_then_archive(spark):
    rows = [("k", "/a", 5, "live"), ("k", "/b", 5, "archive"), ("k", "/c", 4, "archive"), ("j", "/d", 9, "live"), ("j", "/e", 2, "archive")]
    listing = spark.createDataFrame(rows, "key string, path string, size_bytes bigint, source_tree string")
    assert {r.key: r.path for r in keep_largest(listing).collect()} == {"k": "/b", "j": "/d"}


def test_turn_numbers_do_not_depend_on_chunks(spark):
    rows = spark.createDataFrame(
        [("s", i, True, "t", "m", None, None, None, None, *[0] * 8, *[0] * 4) for i in range(1, 200, 3)],
        "key string, line_no bigint, is_reply boolean, ts_raw string, model string, effort string, service_tier string, speed string, stop_reason string, "
        "input_tokens bigint, output_tokens bigint, cache_write_5m bigint, cache_write_1h bigint, cache_read bigint, thinking_tokens bigint, "
        "web_search_requests bigint, web_fetch_requests bigint, pico_input bigint, pico_output bigint, pico_cache_write bigint, pico_cache_read bigint",
    )
    for width in (1, 7, 1000):
        assert [r.ordinal for r in S.turns(rows, width).orderBy("ordinal").collect()] == list(range(1, 68))


def test_a_listing_too_large_to_broadcast_gives_the_same_entries(spark, sf_dir, monkeypatch):
    from threadline.plans import etl, stats_queries

    def entries():
        return stats_queries._fresh(spark, sf_dir)

    few = entries()
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    small = sorted(map(str, few.collect()))
    monkeypatch.setattr(etl, "BROADCAST_FILES", 0)
    many = entries()
    assert sorted(map(str, many.select(few.columns).collect())) == small


def test_an_incremental_build_parses_changed_files_only(spark):
    from threadline.plans.etl import build_facts

    line = lambda n: '{"type":"assistant","timestamp":"2026-06-01T00:00:0%dZ","message":{"role":"assistant","model":"m","usage":{"input_tokens":%d}}}' % (n, n)
    lines = lambda rows: spark.createDataFrame(rows, "path string, line_no bigint, raw string")
    listing = lambda rows: spark.createDataFrame(rows, "path string, size_bytes bigint, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    old = build_facts(
        spark, lines([("/live/p/a.jsonl", 1, line(1)), ("/live/p/b.jsonl", 1, line(1)), ("/live/p/gone.jsonl", 1, line(1))]),
        listing([("/live/p/a.jsonl", 9, "2026-06-01"), ("/live/p/b.jsonl", 9, "2026-06-01"), ("/live/p/gone.jsonl", 9, "2026-06-01")]), "UTC",
    )
    # The lines of the unchanged file are not even given.
    grown = lines([("/live/p/b.jsonl", 1, line(1)), ("/live/p/b.jsonl", 2, line(2)), ("/live/p/c.jsonl", 1, line(3))])
    now = listing([("/live/p/a.jsonl", 9, "2026-06-01"), ("/live/p/b.jsonl", 18, "2026-06-02"), ("/live/p/c.jsonl", 9, "2026-06-02")])
    new = build_facts(spark, grown, now, "UTC", previous=old)
    assert {(r.key, r.line_count, r.tok_input) for r in new.session.collect()} == {("a", 1, 1), ("b", 2, 3), ("c", 1, 3)}
    assert (new.turn.count(), new.entry.count()) == (4, 4)
    # Other rules: nothing of the last run is used.
    assert {r.key for r in build_facts(spark, grown, now, "UTC", previous=new, fingerprint="2").session.collect()} == {"b", "c"}


def test_a_line_is_parsed_in_one_pass_and_trimmed_only_if_it_is_not_framed(spark):
    from threadline.operators.entries import extract_entries, parse_entries

    good = '{"type":"user","cwd":"/x"}'
    raws = [good, f" \t{good}\r", f"﻿{good}", f"{good}x", f"x{good}", f"{good},{good}", "{}", "{", "}", "", " \n\t", None, "[1]", "{'type':'user'}"]
    rows = spark.createDataFrame([("/live/p/a.jsonl", k, raw) for k, raw in enumerate(raws)], "path string, line_no bigint, raw string")
    got = {r.line_no: (r.is_bad, r.cwd) for r in extract_entries(rows).collect()}
    assert got == {0: (False, "/x"), 1: (False, "/x"), 2: (False, "/x"), 6: (False, None), **{k: (True, None) for k in (3, 4, 5, 7, 8, 12, 13)}}
    plan = parse_entries(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and plan.count("from_json") == 1


def test_frequency_maps_are_rendered_once_per_name(spark):
    rows = [("k", "effort", 'b "q" \\ é\n', 2, 1), ("k", "effort", "a", 10, 3), ("k", "model", "m1", 1, 9), ("k", "model", "m2", 1, 4), ("k", "prompt_id", "p", 3, 1), ("j", "prompt_id", "p", 1, 1)]
    facet = spark.createDataFrame(rows, "key string, kind string, name string, n bigint, first_line bigint")
    columns = S.facet_columns(facet)
    got = {r.key: r for r in columns.collect()}
    assert got["k"].effort_json == '{"a": 10, "b \\"q\\" \\\\ é\\n": 2}' and json.loads(got["k"].models_json) == {"m1": 1, "m2": 1}
    assert (got["k"].primary_model, got["k"].n_prompt_ids, got["j"].models_json, got["j"].n_prompt_ids) == ("m2", 1, "{}", 1)
    # No function of ours runs per name and map: sorting and joining are what the aggregate ends with.
    plan = columns._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and "regexp_replace" not in plan


@pytest.mark.parametrize("raw", ["2026-06-01T12:00:00Z", "2026-06-01T12:00:00+1030", "2026-06-01T12:00:00+10:30", "2026-06-01", "2026-06-01T1Z", "Z", "", None, "2026-06-01T12:00:00,5Z"])
def test_instants_of_texts_that_end_in_z_and_others(spark, raw):
    from threadline.functions import times

    rows = spark.createDataFrame([(raw,)], "raw string")
    whole = F.when(F.col("raw").rlike(times._ISO), F.try_to_timestamp(F.regexp_replace("raw", r"([+-]\d{2})(\d{2})$", "$1:$2")))
    assert rows.select(times.parse_instant(F.col("raw")).eqNullSafe(whole)).first()[0]
