"""The statistics ETL: lines to published fact tables."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions.pricing import PRICES_READ_ON, PriceList
from threadline.operators import session as S
from threadline.operators.catalog import keep_largest
from threadline.operators.entries import extract_entries, priced_entries
from threadline.operators.intervals import day_edges, overlap_of_edges, session_spans
from threadline.runtime import new_run_dir, read_note, stage, stage_bucketed, write_note
from threadline.sources import transcripts as T

#: Winning files that may be broadcast; at some 200 bytes each that is at most 50 MB.
BROADCAST_FILES = 250_000
#: Bytes of transcripts whose entries go to one bucket.
BUCKET_BYTES = 256 << 20
#: A larger transcript is folded across tasks, not in a bucket.
HOT_BYTES = 4 << 30
#: Rows of earlier runs are left out by key up to so many keys; beyond it the tables are written anew.
REPLACED_KEYS = 250_000

_EDGES = "project_label string, t bigint, net bigint, active bigint, started bigint, summed bigint, local_date string"


@dataclass(frozen=True)
class Facts:
    """The published tables; every report reads these and nothing else.

    A table is the rows of its ``runs``, each in a folder of its own that no
    later run touches, without the (key, run) pairs in ``replaced``. So the
    facts of an earlier build stay readable after the next one.
    """

    entry: DataFrame
    session: DataFrame
    turn: DataFrame
    tool_call: DataFrame
    attribution: DataFrame
    overlap_day: DataFrame
    meta: DataFrame
    listing: DataFrame
    root: str
    edges: DataFrame
    runs: tuple[str, ...]
    hot_runs: tuple[str, ...] = ()
    replaced: DataFrame | None = None
    fingerprint: str = "1"


def discover(listing: DataFrame, archive_at: str = "/archive/", live_at: str = "/live/") -> DataFrame:
    """Both source trees as one listing, before duplicates are dropped."""
    archived = T.discover_archive(listing.where(F.col("path").contains(archive_at)))
    live = T.discover_live(listing.where(F.col("path").contains(live_at)))
    return archived.unionByName(live)


def entries_of(
    lines: DataFrame, winners: DataFrame, prices: PriceList | None = None, small: bool | None = None, buckets: int | None = None,
) -> DataFrame:
    """Priced, typed entries of the winning files only.

    Raw lines are never shuffled: a listing of checked size is broadcast and
    losers go before they are parsed; a larger one meets the typed entries,
    which are far narrower than the lines. They are dealt once, by the key that
    their path tells (to ``buckets`` parts, if given), and meet the one winner
    of a key where they lie. ``small``: whether the listing fits, if that is known.
    """
    chosen = winners.select("path", "key")
    if small is None:
        small = chosen.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    if small:
        return priced_entries(extract_entries(lines.join(F.broadcast(chosen), "path")), prices)
    typed = priced_entries(extract_entries(lines.where("path is not null")), prices).withColumn("key", T.session_key(F.col("path")))
    dealt = typed.repartition(buckets, "key") if buckets else typed.repartition("key")
    won = chosen.select("key", F.col("path").alias("_winner")).hint("shuffle_hash")
    # Not an equality: as a second join key it would ask for another shuffle, by both.
    is_winner = (F.col("path") >= F.col("_winner")) & (F.col("path") <= F.col("_winner"))
    return dealt.join(won, "key").where(is_winner).drop("_winner")


def _listing_state(winners: DataFrame, previous: Facts | None, run: str, fingerprint: str, path: str) -> DataFrame:
    """Winning files with ``state`` (new, changed, kept, gone), the ``run`` that holds their rows and, as ``was``, the one that held them.

    A file is kept if path, size and time are those of the last build; one
    without a known time counts as changed.
    """
    winners = winners.withColumn("fingerprint", F.lit(fingerprint))
    if previous is None:
        return stage(winners.withColumns({"state": F.lit("new"), "run": F.lit(run), "was": F.lit(None).cast("string")}), path)
    old = previous.listing.select("key", *[F.col(c).alias(f"_{c}") for c in ("path", "size_bytes", "modified", "run")])
    same = F.lit(True)
    for c in ("path", "size_bytes", "modified"):
        same = same & F.coalesce(F.col(c) == F.col(f"_{c}"), F.lit(False))
    state = F.when(F.col("path").isNull(), "gone").when(F.col("_path").isNull(), "new").when(same, "kept").otherwise("changed")
    both = winners.join(old, "key", "full_outer").withColumn("state", state)
    both = both.withColumns({"run": F.when(F.col("state") == "kept", F.col("_run")).otherwise(F.lit(run)), "was": F.col("_run")})
    return stage(both.drop("_path", "_size_bytes", "_modified", "_run"), path)


def _rows(spark: SparkSession, root: str, name: str, runs: tuple[str, ...], replaced: DataFrame | None, schema, key: str = "session_key") -> DataFrame:
    """A table as its runs left it: what a later run replaced is left out, what it did not touch is read where it lies."""
    folder = f"{root}/{name}"
    if replaced is None:
        return spark.read.schema(schema).parquet(*[f"{folder}/run={r}" for r in runs])
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), "run string"])
    rows = spark.read.schema(fields).option("basePath", folder).parquet(*[f"{folder}/run={r}" for r in runs])
    return rows.join(F.broadcast(replaced.withColumnRenamed("key", key)), [key, "run"], "left_anti").drop("run")


def _edges(spark: SparkSession, root: str, runs: tuple[str, ...]) -> DataFrame:
    """Signed day edges of some runs; a filter on ``local_date`` opens the folders of those days only."""
    folder = f"{root}/overlap_edge"
    paths = [f"{folder}/run={r}" for r in runs]
    return spark.read.schema(f"{_EDGES}, run string").option("basePath", folder).parquet(*paths).drop("run")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def build_facts(
    spark: SparkSession, lines: DataFrame, listing: DataFrame, zone: str,
    prices: PriceList | None = None, line_chunk: int = S.LINE_CHUNK,
    idle_gap: int = S.IDLE_GAP_SECONDS, previous: Facts | None = None, fingerprint: str = "1",
) -> Facts:
    """Parse once into an entry table bucketed by session, then derive every fact table from it.

    With the facts of the last run as ``previous``, only files that are new, or
    of another size or time (``modified``), are parsed and folded. Their rows
    go to new folders; nothing is copied or rewritten. Rows of changed and
    vanished files are left out when the tables are read, and the days they
    touch are swept again from signed edges. Once more than ``REPLACED_KEYS``
    keys, or half of all, are left out, the tables are written anew.
    ``fingerprint`` names the rules of a build (zone, prices, idle gap): facts
    made under another one are not used. A file without a known time counts as
    changed. ``lines`` need to hold no more than the files to parse.

    Entries are shuffled once, to buckets by key; folds, maps, engaged time and
    turn numbers then stay in their bucket. Transcripts above ``HOT_BYTES`` are
    folded by partial aggregates and chunks across all tasks instead.
    """
    if previous is not None and previous.fingerprint != fingerprint:
        previous = None
    root = new_run_dir(spark, "facts") if previous is None else previous.root
    run = f"r{uuid.uuid4().hex[:12]}"
    at = lambda name: f"{root}/{name}/run={run}"
    if "modified" not in listing.columns:
        listing = listing.withColumn("modified", F.lit(None).cast("timestamp"))
    files = _listing_state(keep_largest(discover(listing)), previous, run, fingerprint, at("listing"))
    current = files.where("state <> 'gone'").drop("state", "was")
    fresh = files.where("state in ('new', 'changed')").drop("state", "was", "run")
    lost = files.where("state in ('changed', 'gone')").select("key", F.col("was").alias("run"))

    size, largest, n_fresh, n_lost, n_files = files.agg(
        F.coalesce(F.sum(F.when(F.col("state").isin("new", "changed"), F.col("size_bytes"))), F.lit(0)),
        F.coalesce(F.max(F.when(F.col("state").isin("new", "changed"), F.col("size_bytes"))), F.lit(0)),
        F.count_if(F.col("state").isin("new", "changed")),
        F.count_if(F.col("state").isin("changed", "gone")),
        F.count_if(F.col("state") != "gone"),
    ).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET_BYTES))
    small = n_fresh <= BROADCAST_FILES
    usual = fresh if largest <= HOT_BYTES else fresh.where(F.col("size_bytes") <= HOT_BYTES)
    bucketed = stage_bucketed(entries_of(lines, usual, prices, small, buckets), at("entry"), "key", "line_no", buckets)
    parts = [(bucketed, None)]
    if largest > HOT_BYTES:
        # These are few, at HOT_BYTES each, and their lines stay in the tasks that read them.
        parts.append((stage(entries_of(lines, fresh.where(F.col("size_bytes") > HOT_BYTES), prices, True), at("entry_hot")), line_chunk))

    # Everything below reads only the staged entries; independent writes are
    # submitted together so that small jobs fill each other's gaps.
    def sweep(folded: DataFrame) -> tuple[DataFrame, DataFrame]:
        spans = session_spans(folded, ["project_label"]).withColumn("sign", F.lit(1))
        if previous is not None:
            gone = session_spans(previous.session.join(lost.select("key"), "key", "left_semi"), ["project_label"])
            spans = spans.unionByName(gone.withColumn("sign", F.lit(-1)))
        return _sweep(spark, root, run, spans, zone, previous)

    runs = (run,) if previous is None else (*previous.runs, run)
    with ThreadPoolExecutor(5) as pool:
        folded = pool.submit(lambda: stage(_union([S.sessions(e, fresh, zone, idle_gap) for e, _ in parts]), at("session")))
        # The spans stand in the session table; the entries are not folded once more for them.
        swept = pool.submit(lambda: sweep(folded.result()))
        turns = pool.submit(lambda: stage(_union([S.turns(e, chunk) for e, chunk in parts]), at("turn")))
        calls = pool.submit(lambda: stage(_union([S.tool_calls(e) for e, _ in parts]), at("tool_call")))
        uses = pool.submit(lambda: stage(_union([S.attribution(e) for e, _ in parts]), at("attribution")))
        replaced = None
        if previous is not None:
            rows = lost if previous.replaced is None else previous.replaced.unionByName(lost)
            replaced = stage(rows, at("replaced"))
        session, turn, call, use = folded.result(), turns.result(), calls.result(), uses.result()
        edges, overlap = swept.result()
    meta = spark.range(1).select(
        F.lit(zone).alias("local_timezone"), F.lit(PRICES_READ_ON).alias("prices_read_on")
    )
    hot_runs = ((run,) if len(parts) > 1 else ()) if previous is None else (*previous.hot_runs, *((run,) if len(parts) > 1 else ()))
    entry = bucketed if previous is None else _rows(spark, root, "entry", runs, replaced, bucketed.schema, "key")
    if hot_runs:
        entry = entry.unionByName(_rows(spark, root, "entry_hot", hot_runs, replaced, bucketed.schema, "key"))
    table = lambda name, df, key="session_key": df if previous is None else _rows(spark, root, name, runs, replaced, df.schema, key)
    facts = Facts(
        entry, table("session", session, "key"), table("turn", turn), table("tool_call", call), table("attribution", use),
        overlap, meta, current, root, edges, runs, hot_runs, replaced, fingerprint,
    )
    if replaced is not None:
        n_replaced = n_lost if previous.replaced is None else replaced.count()
        if n_replaced > REPLACED_KEYS or 2 * n_replaced > n_files:
            facts = compacted(spark, facts)
    return _recorded(spark, facts, zone)


def _sweep(spark: SparkSession, root: str, run: str, spans: DataFrame, zone: str, previous: Facts | None) -> tuple[DataFrame, DataFrame]:
    """(signed day edges of all runs, day rows): edges of this run are added, and only the days they touch are swept."""
    path = f"{root}/overlap_edge/run={run}"
    delta = day_edges(spans, zone, ["project_label"]).hint("rebalance", "local_date")
    delta.write.mode("overwrite").partitionBy("local_date").parquet(path)
    runs = (run,) if previous is None else (*previous.runs, run)
    edges = _edges(spark, root, runs)
    if previous is None:
        return edges, stage(overlap_of_edges(edges), f"{root}/overlap_day/run={run}")
    # One value per calendar day that a changed session reaches into.
    touched = [r[0] for r in _edges(spark, root, (run,)).select("local_date").distinct().collect()]
    again = overlap_of_edges(edges.where(F.col("local_date").isin(touched)))
    whole = previous.overlap_day.where(~F.col("local_date").isin(touched)).unionByName(again)
    return edges, stage(whole, f"{root}/overlap_day/run={run}")


def compacted(spark: SparkSession, facts: Facts) -> Facts:
    """The same facts as one run in a new root, with nothing left to leave out."""
    root, run = new_run_dir(spark, "facts"), f"r{uuid.uuid4().hex[:12]}"
    at = lambda name: f"{root}/{name}/run={run}"
    names = ("session", "turn", "tool_call", "attribution", "overlap_day")
    with ThreadPoolExecutor(4) as pool:
        entry = pool.submit(lambda: stage(facts.entry, at("entry")))
        tables = dict(zip(names, pool.map(lambda name: stage(getattr(facts, name), at(name)), names), strict=True))
    sums = [F.sum(c).alias(c) for c in ("net", "active", "started", "summed")]
    edges = facts.edges.groupBy("project_label", "local_date", "t").agg(*sums).hint("rebalance", "local_date")
    edges.write.mode("overwrite").partitionBy("local_date").parquet(at("overlap_edge"))
    listing = stage(facts.listing.withColumn("run", F.lit(run)), at("listing"))
    edges = _edges(spark, root, (run,))
    return replace(facts, entry=entry.result(), **tables, listing=listing, root=root, edges=edges, runs=(run,), hot_runs=(), replaced=None)


def _recorded(spark: SparkSession, facts: Facts, zone: str) -> Facts:
    """Written last: a build without this note never happened, and its folders are not read."""
    note = {"runs": facts.runs, "hot_runs": facts.hot_runs, "replaced": facts.replaced is not None, "fingerprint": facts.fingerprint, "zone": zone}
    write_note(spark, f"{facts.root}/lineage/run={facts.runs[-1]}.json", note)
    return facts


def open_facts(spark: SparkSession, root: str, run: str) -> Facts:
    """The facts that the build ``run`` recorded in ``root``, for a later session to read or go on from."""
    line = read_note(spark, f"{root}/lineage/run={run}.json")
    at = lambda name: spark.read.parquet(f"{root}/{name}/run={run}")
    replaced = at("replaced") if line["replaced"] else None
    runs, hot_runs = tuple(line["runs"]), tuple(line["hot_runs"])
    read = lambda name, key="session_key": _rows(spark, root, name, runs, replaced, at(name).schema, key)
    entry = read("entry", "key")
    if hot_runs:
        entry = entry.unionByName(_rows(spark, root, "entry_hot", hot_runs, replaced, entry.schema, "key"))
    listing = at("listing")
    if "state" in listing.columns:
        listing = listing.where("state <> 'gone'").drop("state", "was")
    meta = spark.range(1).select(F.lit(line["zone"]).alias("local_timezone"), F.lit(PRICES_READ_ON).alias("prices_read_on"))
    edges = _edges(spark, root, runs)
    return Facts(
        entry, read("session", "key"), read("turn"), read("tool_call"), read("attribution"),
        at("overlap_day"), meta, listing, root, edges, runs, hot_runs, replaced, line["fingerprint"],
    )
