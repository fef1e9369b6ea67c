"""Steps whose largest task or plan must not grow with the input."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from threadline import sinks
from threadline.plans import more_queries, stats_queries
from threadline.runtime import scratch_root


def _events(spark, folder):
    rows = spark.range(60).select(
        F.col("id").alias("event_id"), F.expr("timestamp '2024-01-03' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT))").alias("ts"),
        (F.col("id") % 7).alias("user_id"), F.element_at(F.array(*[F.lit(t) for t in ("view", "click", "error", "signup")]), (F.col("id") % 4 + 1).cast("int")).alias("event_type"),
        F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 50, F.lit("}")).alias("props"),
    )
    rows.write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_the_census_reads_lines_that_were_laid_down(spark, tmp_path):
    sf = _events(spark, tmp_path)
    entries = stats_queries._fresh(spark, sf)
    assert all("/lines-" in f for f in entries.inputFiles())
    # The lines are made once, not once more for each side that needs the listing.
    assert "to_json" not in entries._jdf.queryExecution().optimizedPlan().toString()
    census = {r.etype: r.entries for r in stats_queries._s01(spark, sf).collect()}
    assert sum(census.values()) == 60 and census["user"] == 30 and census["assistant"] == 15


def test_a_large_month_is_published_by_several_tasks(spark, tmp_path):
    rows = spark.range(0, 20_000, 1, 8).select(
        F.sha2(F.col("id").cast("string"), 256).alias("key"), F.when(F.col("id") != 7, "2024-01-05").alias("local_date")
    )
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128k")
    try:
        sinks.publish({"session": rows}, str(tmp_path / "p"), "run-1")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "p/run-1/session/month=2024-01").glob("*.parquet"))) > 2
    got = {r.month: r.n for r in sinks.published(spark, str(tmp_path / "p"), "session").groupBy("month").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"2024-01": 19_999, "undated": 1}


def test_arriving_files_stay_bounded_and_give_the_same_heads(spark, tmp_path, monkeypatch):
    docs = spark.range(60).select(
        F.col("id").alias("doc_id"), F.repeat(F.col("id").cast("string"), 50).alias("text"),
        F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"),
    )
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    folder = lambda: set(Path(scratch_root(spark).removeprefix("file:")).glob("t05-*"))

    def heads():
        seen = folder()
        rows = sorted(map(tuple, more_queries.QUERIES["t05_stream_heads"](spark, str(tmp_path)).collect()))
        (run,) = folder() - seen
        return rows, len(list(run.glob("in/part=*/*.parquet")))

    whole, files = heads()
    assert len(whole) == 6 and files <= 6
    monkeypatch.setattr(more_queries, "ARRIVING_BYTES", 600)
    again, files = heads()
    assert again == whole and files > 6


def test_a_line_is_made_once_for_both_trees(spark, tmp_path):
    from threadline.plans import standins

    lines = standins.transcript_lines(spark, _events(spark, tmp_path))
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("events.parquet") + plan.count("Relation [") == 1
    laid = {(r.path.split("/")[1], r.line_no) for r in lines.select("path", "line_no").collect()}
    # Users 0 and 6 of seven lie in the archive and, as their counters are below 80, in the live tree too.
    both = {n for tree, n in laid if tree == "archive"} & {n for tree, n in laid if tree == "live"}
    assert both == {i for i in range(60) if i % 7 in (0, 6)} and {n for _, n in laid} == set(range(60))


def test_a_listing_too_large_to_broadcast_deals_the_entries_once(spark, tmp_path, monkeypatch):
    from threadline.plans import etl

    sf = _events(spark, tmp_path)
    monkeypatch.setattr(etl, "BROADCAST_FILES", 0)
    lines, sizes = stats_queries._files(spark, sf)
    winners = etl.keep_largest(etl.discover(sizes.select("path", "size_bytes")))
    entries = etl.entries_of(lines.drop("part"), winners, small=False, buckets=6).repartition(6, "key")
    assert entries.count() == 60
    plan = entries._jdf.queryExecution().executedPlan().toString()
    # The typed entries are dealt by key and by nothing else.
    wide = [x for x in plan.splitlines() if "Exchange" in x and "key" in x and "REPARTITION_BY" in x]
    assert len(wide) == 1 and not any("Exchange hashpartitioning(path" in x for x in plan.splitlines()), plan


def test_the_day_sweep_does_not_fold_the_entries_again(spark, tmp_path, monkeypatch):
    from threadline.plans import etl

    seen = []
    sweep = etl._sweep
    monkeypatch.setattr(etl, "_sweep", lambda s, root, run, spans, *rest: (seen.append(spans.inputFiles()), sweep(s, root, run, spans, *rest))[1])
    stats_queries.facts_for(spark, _events(spark, tmp_path))
    assert seen and all("/session/" in f for f in seen[0])


def test_a_path_is_split_once_for_its_label(spark):
    from threadline.functions import paths

    rows = spark.createDataFrame(
        [("/home/ann/projects/app/.worktree/b1",), ("/mnt/c/Users/ann/code/x",), ("/srv/.worktree-y/z",), ("/",), ("",), ("a",), ("/home/src",), (None,)], "p string"
    )
    p = F.col("p")
    out = rows.select(paths.project_label(p).alias("label"), paths.repo_root(p).alias("root"), paths.is_worktree(p).alias("is"), paths.worktree_name(p).alias("name"))
    assert [tuple(r) for r in out.collect()] == [
        ("app-.worktree-b1", "/home/ann/projects/app", 1, "b1"), ("x", "/mnt/c/Users/ann/code/x", 0, None), ("srv-.worktree-y-z", "/srv", 1, "y"),
        ("/", "/", 0, None), ("", "", 0, None), ("a", "a", 0, None), ("src", "/home/src", 0, None), (None, None, 0, None),
    ]
    assert out._jdf.queryExecution().analyzed().toString().count("split(") == 4
