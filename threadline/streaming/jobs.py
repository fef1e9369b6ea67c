"""The same operators on streams: ingest, duplicate suppression, pairing, sessions, heads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from threadline.operators.catalog import ID_CHUNK, chain_of, heads
from threadline.operators.ordered import previous_row
from threadline.sources.transcripts import parse_lines
from threadline.streaming.buckets import BUCKETS, BucketTable


def transcript_stream(spark: SparkSession, path: str, glob: str = "*.jsonl") -> DataFrame:
    """New transcript files as ``path, raw``; a file stream sees each path once."""
    lines = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))


def changed_files(listing: DataFrame, seen: DataFrame, fingerprint: str) -> DataFrame:
    """Files to scan again: new, of another size or time, or scanned under another fingerprint.

    A transcript grows while its session lives, which a file stream cannot see;
    this anti join on listing metadata covers that side.
    """
    keyed = listing.withColumn("fingerprint", F.lit(fingerprint))
    seen = seen.select("path", "size_bytes", "modified", "fingerprint")
    return keyed.join(seen, ["path", "size_bytes", "modified", "fingerprint"], "left_anti")


def run_to_end(
    stream: DataFrame, checkpoint: str, path: str | None = None, each: Callable[[DataFrame, int], None] | None = None
) -> None:
    """Process what is there and stop: into Parquet at ``path``, or through ``each``."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query: StreamingQuery
    if each is not None:
        query = writer.foreachBatch(each).start()
    else:
        query = writer.format("parquet").option("path", path).start()
    query.awaitTermination()


def ingest(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Parse arriving lines and append them, one output folder per batch.

    A batch that is retried after a failure overwrites its own folder, so no
    line is ever stored twice.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        parse_lines(batch).select(*batch.columns, F.col("v").isNull().alias("is_bad")).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    run_to_end(stream, checkpoint, each=store)


def drop_repeats(stream: DataFrame, ts: str = "at", key: str = "hash", window: str = "10 seconds") -> DataFrame:
    """The simple rule: one event per hash while the first one is inside the watermark."""
    return stream.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])


def _touched(rows: DataFrame) -> set[int]:
    """The buckets of a batch; at most as many as the table has."""
    return {r[0] for r in rows.select("_bucket").distinct().collect()}


def event_actions(
    stream: DataFrame, checkpoint: str, path: str, window_seconds: int = 10, chunk: int = ID_CHUNK, buckets: int = BUCKETS
) -> None:
    """The exact rule: an event is a repeat of the LATEST event of its hash, so repeats extend the window.

    Input columns: ``hash, id, at``; ids grow from batch to batch. ``path/actions``
    gets ``id, hash, action``, one folder per batch. ``path/seen`` holds the last
    event of every hash ever stored, in hash buckets: a batch reads and rewrites
    the buckets of its own hashes and no others, so its cost does not grow with
    the history. A retried batch starts from the same versions. A hash with most
    events of a batch is cut into chunks of ids.
    """

    def decide(batch: DataFrame, batch_id: int) -> None:
        seen = BucketTable(batch.sparkSession, f"{path}/seen", "hash string, id bigint, at timestamp", buckets)
        read = batch.select("id", "hash", "at").withColumn("_bucket", seen.bucket(F.col("hash"))).persist()
        touched, rows = _touched(read), read.drop("_bucket")
        held = seen.rows(batch_id - 1, touched)
        before = held.select("hash", F.col("at").alias("held_at"))
        known = previous_row(rows, ["hash"], "id", ["at"], chunk).join(before, "hash", "left")
        last_at = F.coalesce("prev_at", "held_at")
        gap = F.unix_micros("at") - F.unix_micros(last_at)
        action = (
            F.when(last_at.isNull(), "stored")
            .when(gap <= window_seconds * 1_000_000, "duplicate-invocation")
            .otherwise("skipped_unchanged")
        )
        known.select("id", "hash", action.alias("action")).write.mode("overwrite").parquet(f"{path}/actions/batch={batch_id}")
        newest = rows.unionByName(held).groupBy("hash").agg(F.max_by(F.struct("id", "at"), "id").alias("e")).select("hash", "e.id", "e.at")
        seen.write(batch_id, newest, F.col("hash"), touched)
        read.unpersist()

    run_to_end(stream, checkpoint, each=decide)


def unfinished(started: DataFrame, finished: DataFrame, grace: str = "5 minutes") -> DataFrame:
    """Starts with no finish of the same session within the grace, once the watermark has passed it.

    Inputs: ``session, started_at`` and ``session, finished_at``.
    """
    left = started.withWatermark("started_at", "1 minute").alias("s")
    right = finished.withWatermark("finished_at", "1 minute").alias("f")
    paired = left.join(
        right,
        F.expr(
            f"s.session = f.session AND f.finished_at >= s.started_at AND f.finished_at <= s.started_at + INTERVAL {grace}"
        ),
        "left_outer",
    )
    return paired.where("f.session is null").select("s.session", "s.started_at")


def activity_sessions(stream: DataFrame, key: str, ts: str = "ts", gap: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of activity per key closed by ``gap`` of silence: start, last event, active seconds.

    A run is emitted once the watermark has passed its silence, and its state
    goes. Active time is last minus first event, without the trailing gap of the
    window. A silence of exactly ``gap`` splits here and does not in the batch figure.
    """
    runs = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(
        F.min(ts).alias("first_at"), F.max(ts).alias("last_at"), F.count(F.lit(1)).alias("events")
    )
    active = (F.unix_micros("last_at") - F.unix_micros("first_at")) / F.lit(1e6)
    return runs.select(key, "first_at", "last_at", "events", F.round(active, 3).alias("active_seconds"))


def daily_counts(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Events per UTC day, each day once the watermark has passed its end."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("events")).select(
        F.date_format("window.start", "yyyy-MM-dd").alias("day"), "events"
    )


def maintain_heads(stream: DataFrame, checkpoint: str, path: str, buckets: int = BUCKETS) -> int:
    """Keep the head of every version chain as versions arrive in any order; the last batch's number.

    Payload time decides, not arrival. Heads lie in buckets of their chains: a
    batch reads the buckets of its own chains, writes their next version and
    leaves all others where they are; versions that nothing reads any more go.
    A head carries how many versions its chain has had, and a batch adds its
    own; an id repeated inside a batch counts once. The returned number is that
    of the newest table, -1 if no batch came.
    """
    last = [-1]

    def merge(batch: DataFrame, batch_id: int) -> None:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema.fields)
        table = BucketTable(batch.sparkSession, path, f"{fields}, n_versions bigint", buckets)
        read = batch.dropDuplicates(["id"]).withColumn("_bucket", table.bucket(chain_of())).persist()
        touched = _touched(read)
        held = table.rows(batch_id - 1, touched).withColumnRenamed("n_versions", "_n")
        rows = read.drop("_bucket").withColumn("_n", F.lit(1).cast("bigint")).unionByName(held)
        table.write(batch_id, heads(rows, weight="_n"), chain_of(), touched)
        read.unpersist()
        last[0] = batch_id

    run_to_end(stream, checkpoint, each=merge)
    return last[0]


def latest_heads(spark: SparkSession, path: str, last_batch: int, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """The heads as a batch left them; ``schema`` is that of the versions."""
    return BucketTable(spark, path, f"{schema}, n_versions bigint", buckets).rows(last_batch)
