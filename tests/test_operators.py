from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from threadline.functions import paths, times
from threadline.operators import catalog as C
from threadline.operators import cubes, health, integrity, intervals, ordered
from threadline.operators import selection as P

UTC = dt.timezone.utc


def spans(spark, pairs):
    rows = [(dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(b)) for a, b in pairs]
    return spark.createDataFrame(rows, "begin timestamp, end timestamp")


def days(df):
    return {r.local_date: r for r in df.collect()}


def test_overlap_cases(spark):
    got = days(intervals.overlap_by_day(spans(spark, [
        ("2026-06-01T10:00:00", "2026-06-01T12:00:00"), ("2026-06-01T10:30:00", "2026-06-01T12:00:00"),
        ("2026-06-02T01:00:00", "2026-06-02T02:00:00"), ("2026-06-02T02:00:00", "2026-06-02T03:00:00"),
        ("2026-06-03T23:00:00", "2026-06-04T01:00:00"), ("2026-06-05T05:00:00", "2026-06-05T05:00:00"),
        ("2026-06-06T22:00:00", "2026-06-07T00:00:00"),
    ]), "UTC", slot_seconds=3600))
    one = got["2026-06-01"]
    assert (one.elapsed_hours, one.summed_hours, one.max_concurrent, one.concurrency) == (2.0, 3.5, 2, 1.75)
    assert (got["2026-06-02"].elapsed_hours, got["2026-06-02"].max_concurrent) == (2.0, 1)
    assert (got["2026-06-03"].elapsed_hours, got["2026-06-04"].elapsed_hours) == (1.0, 1.0)
    assert (got["2026-06-04"].sessions_started, got["2026-06-04"].sessions_active) == (0, 1)
    zero = got["2026-06-05"]
    assert (zero.elapsed_hours, zero.concurrency, zero.max_concurrent, zero.sessions_active) == (0.0, None, 0, 1)
    assert "2026-06-07" not in got


def test_overlap_matches_a_plain_loop_for_any_slot(spark):
    rng = random.Random(7)
    base = dt.datetime(2026, 6, 1)
    pairs = []
    for _ in range(120):
        a = base + dt.timedelta(seconds=rng.randrange(0, 3 * 86400, 60))
        pairs.append((a.isoformat(), (a + dt.timedelta(seconds=rng.randrange(0, 90000, 60))).isoformat()))
    expect: dict[str, list] = {}
    for a, b in pairs:
        lo, hi = dt.datetime.fromisoformat(a), dt.datetime.fromisoformat(b)
        day = lo.replace(hour=0, minute=0, second=0)
        while True:
            end = day + dt.timedelta(days=1)
            s, e = max(lo, day), min(hi, end)
            if s < e or day <= lo < end:
                expect.setdefault(day.date().isoformat(), []).append((s, e))
            if hi <= end:
                break
            day = end
    want = {}
    for d, spans_ in expect.items():
        spans_.sort()
        merged, cur = dt.timedelta(), list(spans_[0])
        for s, e in spans_[1:]:
            if s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                merged, cur = merged + (cur[1] - cur[0]), [s, e]
        merged += cur[1] - cur[0]
        live = peak = 0
        for _, delta in sorted([(s, 1) for s, _ in spans_] + [(e, -1) for _, e in spans_]):
            live += delta
            peak = max(peak, live)
        want[d] = (len(spans_), round(merged.total_seconds() / 3600, 3), peak)
    for slot in (60, 900, 86400):
        got = days(intervals.overlap_by_day(spans(spark, pairs), "UTC", slot))
        assert {d: (r.sessions_active, r.elapsed_hours, r.max_concurrent) for d, r in got.items()} == want


def test_days_are_cut_at_true_local_midnights(spark):
    # Clocks go back in this zone on 5 April 2026: that local day has 25 hours.
    got = days(intervals.overlap_by_day(spans(spark, [("2026-04-03T13:00:00", "2026-04-06T14:00:00")]), "Australia/Melbourne"))
    assert {d: r.elapsed_hours for d, r in got.items()} == {"2026-04-04": 24.0, "2026-04-05": 25.0, "2026-04-06": 24.0}


def test_lanes(spark):
    rows = [("d", 0.0, 100.0), ("d", 50.0, 150.0), ("d", 100.0, 200.0), ("d", 500.0, 600.0), ("e", 10.0, 20.0)]
    segs = spark.createDataFrame(rows, "local_date string, start_second double, end_second double")
    got = {(r.local_date, r.start_second): r.lane for r in intervals.pack_lanes(segs, slot_seconds=60).collect()}
    assert got == {("d", 0.0): 0, ("d", 50.0): 1, ("d", 100.0): 0, ("d", 500.0): 0, ("e", 10.0): 0}


def test_lanes_match_a_plain_loop(spark):
    rng = random.Random(3)
    rows = sorted({("d", float(rng.randrange(0, 20000)), float(rng.randrange(1, 3000))) for _ in range(150)})
    rows = [(d, s, s + n) for d, s, n in rows]
    want, ends = {}, []
    for d, s, e in sorted(rows):
        lane = next((i for i, end in enumerate(ends) if end <= s), len(ends))
        ends[lane:lane + 1] = [e]
        want[(s, e)] = lane
    segs = spark.createDataFrame(rows, "local_date string, start_second double, end_second double")
    assert {(r.start_second, r.end_second): r.lane for r in intervals.pack_lanes(segs).collect()} == want


def test_clip_seconds(spark):
    rows = spark.createDataFrame([(0, 82800, 93600), (5, 100, 0), (0, 0, 33 * 86400)], "day_id int, start_sec int, dur_sec int")
    got = sorted(map(tuple, cubes.clip_seconds(rows).collect()))
    assert (5, 100, 101) in got and len(got) == 3 + 1 + 33
    assert [g for g in got if g[0] == 0 and g[1] == 82800] == [(0, 82800, 86400)] and (2, 0, 3600) in got


@pytest.mark.parametrize("width", [1, 3, 50])
def test_ordered_helpers_match_plain_loops(spark, width):
    rng = random.Random(width)
    rows = [(k, i, rng.randrange(5)) for k in ("a", "b") for i in sorted(rng.sample(range(200), 60))]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    want_sum, want_prev, want_max, state = {}, {}, {}, {}
    for k, i, v in rows:
        total, prev, top = state.get(k, (0, None, None))
        want_prev[(k, i)], want_max[(k, i)] = prev, top
        want_sum[(k, i)] = total + v
        state[k] = (total + v, v, v if top is None else max(top, v))
    get = lambda d, c: {(r.k, r.i): r[c] for r in d.collect()}
    assert get(ordered.running_sum(df, ["k"], "i", "v", "o", width), "o") == want_sum
    assert get(ordered.previous_row(df, ["k"], "i", ["v"], width), "prev_v") == want_prev
    assert get(ordered.running_max(df, ["k"], "i", F.col("v"), "o", width), "o") == want_max


def test_position_is_the_rank_of_a_total_order(spark):
    rows = [(random.Random(i).randrange(4), i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = {(r.a, r.b): r.at for r in ordered.position(df, ["a", "b"], "at").collect()}
    assert got == {ab: i for i, ab in enumerate(sorted(rows))}


LABELS = [
    ("/home/ann/projects/app", "app"), ("/home/ann/code/x/y", "x-y"), ("/mnt/c/users/bob/work/z", "z"), ("/srv/lib", "srv-lib"),
    ("/home/projects", "projects"), ("/", "/"), ("/Users/ann/solo", "ann-solo"),
]


def test_project_labels(spark):
    df = spark.createDataFrame([(p,) for p, _ in LABELS], "p string")
    assert [tuple(r) for r in df.select("p", paths.project_label(F.col("p"))).collect()] == LABELS


def test_worktrees(spark):
    cases = [
        ("/r/app/.worktree/b1/src", "/r/app", 1, "b1"), ("/r/app/.worktrees/x", "/r/app", 1, "x"), ("/r/app/.worktree-fix", "/r/app", 1, "fix"),
        ("/r/app/.worktree", "/r/app", 1, ".worktree"), ("/r/app", "/r/app", 0, None), ("/r/app/.worktree-", "/r/app", 1, ".worktree-"),
    ]
    c = F.col("p")
    df = spark.createDataFrame([(p[0],) for p in cases], "p string")
    assert [tuple(r) for r in df.select(c, paths.repo_root(c), paths.is_worktree(c), paths.worktree_name(c)).collect()] == cases


def test_timestamps(spark):
    cases = {
        "2026-06-01T10:00:00Z": dt.datetime(2026, 6, 1, 10), "2026-06-01T10:00:00.123456+10:00": dt.datetime(2026, 6, 1, 0, 0, 0, 123456),
        "2026-06-01 10:00": dt.datetime(2026, 6, 1, 10), "2026-06-01": dt.datetime(2026, 6, 1), "2026-06-01T10:00:00+0200": dt.datetime(2026, 6, 1, 8),
        "yesterday": None, "2026-13-01T00:00:00Z": None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.us for r in df.select("raw", F.unix_micros(times.parse_instant(F.col("raw"))).alias("us")).collect()}
    epoch = dt.datetime(1970, 1, 1)
    assert got == {k: None if v is None else (v - epoch) // dt.timedelta(microseconds=1) for k, v in cases.items()}


def test_offsets_and_weeks(spark):
    df = spark.createDataFrame([("2026-01-15T00:00:00Z",), ("2026-06-15T00:00:00Z",)], "raw string")
    ts = times.parse_instant(F.col("raw"))
    assert [r[0] for r in df.select(times.offset_text(ts, "Australia/Melbourne")).collect()] == ["+1100", "+1000"]
    day = spark.createDataFrame([(dt.date(2026, 1, 1) + dt.timedelta(days=i),) for i in range(0, 800, 3)], "d date")
    for r in day.select("d", times.week_label(F.date_format("d", "yyyy-MM-dd")).alias("w")).collect():
        assert r.w == r.d.strftime("%Y-W%W")


def test_move_and_merge_refuse_conflicts(spark):
    alias = spark.createDataFrame([(1, "/a", "cwd", "x", "x"), (2, "/b", "cwd", "x", "x"), (2, "-c-d", "encoded_dir", "x", "x")],
                                  "project_id bigint, path string, kind string, first_seen string, last_seen string")
    with pytest.raises(ValueError, match="already a claim"):
        C.move_project(alias, 1, "/a", "/b", "now")
    with pytest.raises(ValueError, match="already a claim"):
        C.move_project(alias, 1, "/a", "/c/d", "now")
    with pytest.raises(ValueError, match="not a cwd claim"):
        C.move_project(alias, 1, "/b", "/z", "now")
    moved = {(r.path, r.kind): (r.project_id, r.last_seen) for r in C.move_project(alias, 1, "/a", "/new.x", "now").collect()}
    assert moved[("/new.x", "cwd")] == (1, "now") and moved[("-new-x", "encoded_dir")] == (1, "now") and moved[("/a", "cwd")] == (1, "now")
    project = spark.createDataFrame([(1, "a", 0), (2, "b", 1)], "id bigint, label string, retired int")
    with pytest.raises(ValueError, match="retired"):
        C.merge_projects(project, alias, alias, 2, 1)
    with pytest.raises(ValueError, match="itself"):
        C.merge_projects(project, alias, alias, 1, 1)


def test_selection_of_none_differs_from_empty(spark):
    s = spark.createDataFrame([("k1", "app", 1, "2026-01-01"), ("k2", "lib", 1, "2026-01-01")], "key string, project_label string, is_real int, local_date string")
    assert P.selected_labels(s, [], []) is None
    assert P.select_projects(s, None).count() == 2
    assert P.select_projects(s, P.selected_labels(s, ["zzz"], [])).count() == 0
    assert [r.key for r in P.select_projects(s, P.selected_labels(s, ["APP", "lib"], ["Li"])).collect()] == ["k1"]
    with pytest.raises(ValueError):
        P.in_instants(F.lit(None), "2026-02-01", "2026-01-01", "UTC")


def test_redundant_patterns_warn_about_groups(spark):
    s = spark.createDataFrame([(f"k{i}", l, 1, "2026-01-01") for i, l in enumerate(["infra-vault", "solo-x", "both-solo-y"])],
                              "key string, project_label string, is_real int, local_date string")
    rv = P.review(s, ["infra", "vault", "solo", "both"], [], [], P.Span())
    got = {r.pattern: (r.verdict, r.keep_one_of) for r in P.redundancy(rv, ["infra", "vault", "solo", "both"]).collect()}
    assert got == {"infra": ("group", "infra,vault"), "vault": ("group", "infra,vault"), "both": ("alone", None)}


def test_said_nothing_fails_towards_alerting(spark):
    t = lambda h: dt.datetime(2026, 6, 1, h)
    f = spark.createDataFrame([(1, "quit", t(5), "m"), (2, "spoke", t(5), "m"), (3, "bare", t(5), "m"), (4, "early", t(1), "m"), (5, "noenv", t(5), "m")],
                              "line_no bigint, session_uuid string, ts timestamp, message string")
    h = spark.createDataFrame([("quit", t(2), " /quit "), ("spoke", t(3), "/quit"), ("spoke", t(3), "hello")], "session_uuid string, ts timestamp, display string")
    h = h.withColumn("pasted", F.lit(None).cast("map<string,variant>"))
    env = spark.createDataFrame([("bare",), ("early",)], "session_uuid string")
    got = {r.session_uuid: r.is_empty for r in health.said_nothing(f, h, env).collect()}
    assert got == {"quit": True, "spoke": False, "bare": True, "early": False, "noenv": False}
    assert not any(r.is_empty for r in health.said_nothing(f, None, env).collect())


def test_sweep_outcome_is_void_after_a_later_start(spark):
    cols = "line_no bigint, status string, at string, ts timestamp, message string"
    at = dt.datetime(2026, 6, 1)
    rows = [(1, "sweep-started", "t", at, "sweep started (pid 1)"), (2, "info", "t", at, "sweep: 10 items, 1 stored, 2 failed")]
    done = spark.createDataFrame(rows, cols)
    assert [tuple(r)[:2] for r in health.latest_sweep_outcome(done).collect()] == [(2, 10)]
    again = spark.createDataFrame([*rows, (3, "sweep-started", "t", at, "sweep started (pid 2)")], cols)
    assert health.latest_sweep_outcome(again).count() == 0
    assert [tuple(r)[:2] for r in health.latest_sweep_outcome(again, running=True).collect()] == [(2, 10)]


def test_kept_records_hold_on_to_evidence(spark):
    old = spark.createDataFrame([("f", "same", "h1", 1), ("f", "grown", "h2", 1), ("f", "rewritten", "h3", 1), ("f", "gone", "h4", 1)],
                                "folder string, name string, sha256 string, bytes bigint")
    new = spark.createDataFrame([("f", "same", "h1", 1, False), ("f", "grown", "n2", 2, True), ("f", "rewritten", "n3", 2, False), ("f", "new", "n5", 1, False)],
                                "folder string, name string, sha256 string, bytes bigint, grew boolean")
    got = {r.name: (r.sha256, r.reason) for r in integrity.kept_records(old, new, True).collect()}
    assert got == {"same": ("h1", "same"), "grown": ("n2", "grown"), "rewritten": ("h3", "changed_kept"), "gone": ("h4", "vanished_kept"), "new": ("n5", "added")}
    strict = {r.name: r.sha256 for r in integrity.kept_records(old, new, False).collect()}
    assert strict["grown"] == "h2"
