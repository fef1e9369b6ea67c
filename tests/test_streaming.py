from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from threadline.streaming import jobs as J

BASE = dt.datetime(2026, 6, 1)


def batches(spark, tmp_path, frames, schema):
    """A file stream that delivers the frames one batch at a time."""
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_repeats_extend_the_window_across_batches(spark, tmp_path):
    at = lambda s: BASE + dt.timedelta(seconds=s)
    stream = batches(spark, tmp_path, [[(1, "h", at(0)), (2, "h", at(8))], [(3, "h", at(16)), (4, "h", at(40)), (5, "g", at(40))]], "id bigint, hash string, at timestamp")
    J.event_actions(stream, str(tmp_path / "cp"), str(tmp_path / "out"))
    got = {r.id: r.action for r in spark.read.parquet(str(tmp_path / "out" / "actions")).collect()}
    assert got == {1: "stored", 2: "duplicate-invocation", 3: "duplicate-invocation", 4: "skipped_unchanged", 5: "stored"}


def test_heads_follow_payload_time_not_arrival(spark, tmp_path):
    schema = "id bigint, hash string, session_uuid string, last_ts string, captured_at string"
    stream = batches(spark, tmp_path, [[(1, "new", "s", "2026-05-02", "x")], [(2, "old", "s", "2026-05-01", "y"), (3, "other", "t", None, "2026-01-01")]], schema)
    assert J.maintain_heads(stream, str(tmp_path / "cp"), str(tmp_path / "heads")) == 1
    got = {r.session_uuid: (r.hash, r.n_versions) for r in J.latest_heads(spark, str(tmp_path / "heads"), 1, schema).collect()}
    assert got == {"s": ("new", 2), "t": ("other", 1)}


def test_unfinished_runs_surface_after_the_grace(spark, tmp_path):
    at = lambda m: BASE + dt.timedelta(minutes=m)
    a = batches(spark, tmp_path / "a", [[("x", at(0)), ("y", at(1))], [("z", at(60))], [("w", at(120))]], "session string, started_at timestamp")
    b = batches(spark, tmp_path / "b", [[("x", at(3))], [("q", at(60))], [("q", at(120))]], "session string, finished_at timestamp")
    J.run_to_end(J.unfinished(a, b), str(tmp_path / "cp"), str(tmp_path / "out"))
    got = {r.session for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert "y" in got and "x" not in got


def test_ingest_writes_each_line_once(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.jsonl").write_text('{"a": 1}\nbad\n\n')
    run = lambda: J.ingest(J.transcript_stream(spark, str(tmp_path / "src")), str(tmp_path / "cp"), str(tmp_path / "out"))
    run()
    (tmp_path / "src" / "b.jsonl").write_text('{"a": 2}\n')
    run()
    got = sorted((r.raw, r.is_bad) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("bad", True), ('{"a": 1}', False), ('{"a": 2}', False)]


def test_changed_files_are_scanned_again(spark):
    cols = "path string, size_bytes bigint, modified timestamp"
    now = spark.createDataFrame([("a", 1, BASE), ("b", 2, BASE), ("c", 1, BASE)], cols)
    seen = spark.createDataFrame([("a", 1, BASE), ("b", 1, BASE)], cols).withColumn("fingerprint", F.lit("v1"))
    assert {r.path for r in J.changed_files(now, seen, "v1").collect()} == {"b", "c"}
    assert J.changed_files(now, seen, "v2").count() == 3


def test_a_later_run_knows_the_hashes_of_an_earlier_one(spark, tmp_path):
    at = lambda s: BASE + dt.timedelta(seconds=s)
    schema = "id bigint, hash string, at timestamp"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([(1, "h", at(0))], [(2, "h", at(5)), (3, "g", at(5))], [(4, "h", at(60)), (5, "g", at(14))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        J.event_actions(spark.readStream.schema(schema).parquet(source), str(tmp_path / "cp"), out)
    got = {r.id: r.action for r in spark.read.parquet(f"{out}/actions").collect()}
    assert got == {1: "stored", 2: "duplicate-invocation", 3: "stored", 4: "skipped_unchanged", 5: "duplicate-invocation"}


def _folders(path, below: str) -> dict:
    """bucket folders with rows -> time of their newest file."""
    found = {}
    for f in (path / below).rglob("*.parquet"):
        found[str(f.parent.relative_to(path / below))] = max(found.get(str(f.parent.relative_to(path / below)), 0), f.stat().st_mtime_ns)
    return found


def test_a_batch_rewrites_the_buckets_of_its_chains_only(spark, tmp_path):
    schema = "id bigint, hash string, session_uuid string, last_ts string, captured_at string"
    first = [(k, f"h{k}", f"s{k % 40}", f"2026-05-{1 + k % 28:02d}", "x") for k in range(200)]
    later = [[(200 + b, "new", f"s{b}", "2026-06-01", "x")] for b in range(5)]
    source, out = str(tmp_path / "in"), tmp_path / "heads"
    seen = []
    for rows in [first, *later]:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        last = J.maintain_heads(spark.readStream.schema(schema).parquet(source), str(tmp_path / "cp"), str(out), buckets=16)
        seen.append(_folders(out, "rows"))
    assert last == 5
    # One changed chain: one new folder a batch, and every folder that is left keeps its file.
    for n in range(1, 6):
        added = set(seen[n]) - set(seen[n - 1])
        assert len(added) == 1 and next(iter(added)).startswith(f"v={n}/")
        assert all(seen[n][f] == seen[n - 1][f] for f in seen[n] if f in seen[n - 1])
    # Versions expire: at most one older one per bucket touched by the last batches.
    assert len(seen[5]) <= len(seen[0]) + 2
    every = spark.createDataFrame(first + [r for rows in later for r in rows], schema)
    from threadline.operators.catalog import heads

    got = J.latest_heads(spark, str(out), last, schema, buckets=16)
    assert sorted(map(str, got.select("id", "session_uuid", "n_versions").collect())) == sorted(map(str, heads(every).select("id", "session_uuid", "n_versions").collect()))


def test_a_retried_batch_finds_what_it_found_before(spark, tmp_path):
    from threadline.streaming.buckets import BucketTable

    schema = "hash string, id bigint"
    t = BucketTable(spark, str(tmp_path / "t"), schema, 4)
    rows = lambda ids: spark.createDataFrame([(f"h{k % 9}", k) for k in ids], schema)
    t.write(0, rows(range(9)), F.col("hash"), {0, 1, 2, 3})
    held = {r.hash: r.id for r in t.rows(0).collect()}
    assert len(held) == 9
    touched = {r[0] for r in rows([9]).select(t.bucket(F.col("hash"))).collect()}
    for _ in range(2):
        mine = t.rows(0, touched).where("hash <> 'h0'").unionByName(rows([9]))
        t.write(1, mine, F.col("hash"), touched)
        assert {r.hash: r.id for r in t.rows(1).collect()} == {**held, "h0": 9}
        assert {r.hash: r.id for r in t.rows(0).collect()} == held
    files = t.rows(1, touched).inputFiles()
    assert len(files) <= len(touched) and all("v=1/" in f for f in files)
    assert t.rows(-1).count() == 0


def test_an_event_looks_up_its_own_buckets(spark, tmp_path):
    """Six batches; the history grows, what a batch reads and writes does not."""
    at = lambda s: BASE + dt.timedelta(seconds=s)
    schema = "id bigint, hash string, at timestamp"
    source, out = str(tmp_path / "in"), tmp_path / "out"
    frames = [[(k, f"g{k}", at(k)) for k in range(300)], *[[(1_000 + b, "g7", at(1_000 + 6 * b))] for b in range(5)]]
    sizes = []
    for rows in frames:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        J.event_actions(spark.readStream.schema(schema).parquet(source), str(tmp_path / "cp"), str(out), buckets=32)
        sizes.append(len(_folders(out / "seen", "rows")))
    new = [f for f in _folders(out / "seen", "rows") if not f.startswith("v=0/")]
    assert len(new) <= 2 and max(sizes) <= sizes[0] + 2
    got = {r.id: r.action for r in spark.read.parquet(str(out / "actions")).collect()}
    assert got[1_000] == "skipped_unchanged" and all(got[1_000 + b] == "duplicate-invocation" for b in range(1, 5))
    assert all(got[k] == "stored" for k in range(300))
