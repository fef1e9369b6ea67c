"""Catalogue, log and folder shapes derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions.once import computed_once
from threadline.plans.standins import BLOCK_SECONDS, table

NOW = "2024-01-25 00:00:00"


def _text(s: str) -> Column:
    return F.lit(s).cast("string")


# ---- payloads and versions from documents ------------------------------------


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a payload: ``id, hash, size_bytes`` and catalogue columns."""
    d = F.col("doc_id")
    day = lambda c: F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), c.cast("int")), "yyyy-MM-dd")
    return table(spark, sf_dir, "documents").select(
        d.alias("id"),
        F.sha2(F.col("text"), 256).alias("hash"),
        F.when(d % 10 != 9, F.concat("source", F.lit("-"), "lang", F.lit("-"), d % 7)).alias("session_uuid"),
        F.regexp_extract("source", r"(\d+)$", 1).cast("bigint").alias("project_id"),
        day(d * 37 % 200 - d % 5 + 5).alias("first_ts"),
        F.when(d % 13 != 0, day(d * 37 % 200 + 5)).alias("last_ts"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + d * 61), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"),
        F.octet_length("text").cast("bigint").alias("size_bytes"),
        (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("bigint").alias("line_count"),
        (d % 8 == 0).cast("int").alias("hidden"),
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows: the first payload of every hash."""
    from threadline.operators.catalog import put_new

    rows = payloads(spark, sf_dir)
    return put_new(rows, rows.select("hash").limit(0))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.regexp_extract("source", r"(\d+)$", 1).cast("bigint").alias("id"), F.col("source").alias("label")
    ).distinct().withColumn("retired", F.lit(0))


# ---- captures and registry from events ---------------------------------------


def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    block = F.floor(F.unix_micros(ts) / F.lit(BLOCK_SECONDS * 1_000_000))
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("event_type").alias("et"),
        F.col("user_id").alias("u"),
        block.alias("b"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        ts.alias("ts"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"),
        F.format_string("%08x-0000-4000-8000-%012d", block, F.col("user_id")).alias("uuid"),
    )


def _lines(rows: DataFrame, raw: Column) -> DataFrame:
    return computed_once(rows.withColumn("line_no", F.col("event_id")), {"raw": raw}).select("line_no", "raw")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.col("u"), F.col("k")
    cwd = F.concat(_text("/home/ann/projects/app."), u)
    return keyed_events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.when(k % 5 == 0, cwd).when(k % 5 == 4, _text(" ")).alias("payload_cwd"),
        F.when(k % 5 == 1, cwd).alias("jsonl_cwd"),
        F.when(k % 11 == 10, _text("")).otherwise(F.regexp_replace(cwd, "[/_.]", "-")).alias("encoded_dir"),
    )


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on record: a cwd for every tenth user and a folder name for the next."""
    u = F.col("u")
    cwd = F.concat(_text("/home/ann/projects/app."), u)
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("u")).distinct()
    own = users.where("u % 10 in (0, 1)").select(
        (u + 1).alias("project_id"),
        F.when(u % 10 == 0, cwd).otherwise(F.regexp_replace(cwd, "[/_.]", "-")).alias("path"),
        F.when(u % 10 == 0, _text("cwd")).otherwise(_text("encoded_dir")).alias("kind"),
    )
    both = users.where("u % 10 = 0").select(
        (u + 1).alias("project_id"), F.regexp_replace(cwd, "[/_.]", "-").alias("path"), _text("encoded_dir").alias("kind")
    )
    stamps = {"first_seen": _text("2023-12-01"), "last_seen": _text("2023-12-31")}
    return own.unionByName(both).withColumns(stamps)


# ---- logs and history from events --------------------------------------------


def capture_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``line_no, raw`` of a capture log whose records follow the event types."""
    k, u = F.col("k"), F.col("u")
    et = F.col("et")
    click = et == "click"
    at = F.when(k != 50, F.col("iso"))
    status = (
        F.when(et == "error", _text("error"))
        .when(et == "signup", _text("companions-started"))
        .when(et == "purchase", _text("companions-done"))
        .when((et == "view") & (k % 3 == 0), _text("unrecoverable"))
        .when((et == "view") & (k % 3 == 1), _text("unrecoverable-retracted"))
        .when(et == "view", _text("repair-refused"))
        .when(click & (k % 6 == 0), _text("repair-refusal-resolved"))
        .when(click & (k % 6 == 1), _text("sweep-started"))
        .when(click & (k % 6 == 2), _text("info"))
        .when(click & (k % 6 == 3), _text("repair-summary"))
        .otherwise(_text("writer-held"))
    )
    message = (
        F.when((et == "error") & (k % 7 == 0), _text("repair: could not"))
        .when((et == "error") & (k % 7 == 1), _text("companions: lost"))
        .when(et == "error", F.concat(_text("unreadable transcript "), F.col("uuid")))
        .when((et == "view") & (k % 3 == 2), F.concat(_text("m"), k % 4))
        .when(click & (k % 6 == 1), F.concat(_text("sweep started (pid "), k, _text(")")))
        .when(
            click & (k % 6 == 2),
            F.concat(_text("sweep: "), k, _text(" items, 3 stored, "), k % 5, _text(" failed"),
                     F.when(k % 4 == 3, _text("; stopped: disk")).otherwise(_text(""))),
        )
        .when(click & (k % 6 == 3), F.concat(_text("refused "), k))
    )
    names_session = (et == "view") | ((et == "error") & (k % 2 == 0)) | (click & (k % 6).isin(0, 4))
    record = F.to_json(
        F.struct(
            status.alias("status"), at.alias("at"), F.concat(_text("c"), u).alias("session"),
            F.when(names_session, F.col("uuid")).alias("session_uuid"), message.alias("message"),
        )
    )
    broken = F.concat(_text('{"status": "sweep-started", "cut": '), k)
    rows = keyed_events(spark, sf_dir)
    raw = F.when(click & (k % 6 == 5), broken).otherwise(record)
    return _lines(rows, raw)


def hook_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    et = F.col("et")
    status = (
        F.when(et == "view", _text("started")).when(et == "click", _text("ok"))
        .when(et == "purchase", _text("dispatched")).when(et == "error", _text("capture-error")).otherwise(_text("ok"))
    )
    record = F.to_json(
        F.struct(
            status.alias("status"), F.col("iso").alias("ts"), F.col("uuid").alias("session"),
            F.when(et == "signup", _text("other")).otherwise(_text("session-hook")).alias("source"),
            F.concat(_text("/live/"), F.col("uuid")).alias("detail"),
        )
    )
    return _lines(keyed_events(spark, sf_dir), record)


def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt history: one row per view event; some paste text inline, some by hash."""
    k = F.col("k")
    entry = F.struct(
        F.lit(1).alias("id"), _text("text").alias("type"),
        F.when(k % 12 == 6, _text("inline")).alias("content"),
        F.when(k % 12 == 0, F.concat(_text("h"), k)).alias("contentHash"),
    )
    record = F.to_json(
        F.struct(
            F.col("uuid").alias("sessionId"), F.unix_millis("ts").alias("timestamp"),
            F.when(k % 2 == 0, _text("/quit")).when(k % 4 == 1, _text(" /exit ")).otherwise(_text("hello")).alias("display"),
            F.when(k % 6 == 0, F.create_map(_text("1"), entry)).alias("pastedContents"),
        )
    )
    return _lines(keyed_events(spark, sf_dir).where("et = 'view'"), record)


def session_ids(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return keyed_events(spark, sf_dir).where(condition).select(F.col("uuid").alias("session_uuid")).distinct()


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last activity of every session of the source tree."""
    return keyed_events(spark, sf_dir).groupBy(F.col("uuid").alias("session_uuid"), "u", "b").agg(
        F.max("ts").alias("last_ts")
    ).withColumn("hash", F.sha2(F.col("session_uuid"), 256))


def event_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows of a quarter of the event sessions."""
    rows = activity(spark, sf_dir).where("(u + b) % 4 = 0")
    return rows.select(
        "session_uuid", "hash", F.date_format("last_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("first_ts")
    )


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health checks per monitor: time, backlog and verdict."""
    return keyed_events(spark, sf_dir).select(
        F.col("u").alias("monitor"), "ts", F.unix_micros("ts").alias("order_us"), F.col("k").alias("backlog"),
        F.col("et").isin("error", "view", "click").alias("broken"),
    )


# ---- folders from documents --------------------------------------------------


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("d"),
        F.concat(_text("/archive/label"), F.floor(d / 20) % 9, _text("/20240101-000000+0000_f"), F.floor(d / 20)).alias("folder"),
        F.concat(_text("c"), d).alias("name"),
        "text",
    )


def manifest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest per folder of twenty documents; every seventh folder's is unreadable."""
    rows = _children(spark, sf_dir).where("d % 5 <> 0")
    child = F.struct(
        F.col("d").alias("o"), F.col("name").alias("agent_id"), F.sha2("text", 256).alias("sha256"),
        F.octet_length("text").alias("bytes"),
    )
    # At most twenty children meet in a folder.
    per = rows.groupBy("folder").agg(F.sort_array(F.collect_list(child)).alias("subagents"), F.min("d").alias("d"))
    body = F.to_json(
        F.struct(
            F.sha2("folder", 256).alias("source_hash"), "subagents",
            F.struct((F.col("d") % 3 == 0).alias("present")).alias("prompts"),
            F.when(F.col("d") % 2 == 0, F.array(F.struct(F.lit("p").alias("name")))).alias("pastes"),
        )
    )
    raw = F.when(F.floor(F.col("d") / 20) % 7 == 6, F.concat(_text("{broken "), "folder")).otherwise(body)
    return per.select(F.concat("folder", _text("/manifest.json")).alias("path"), raw.alias("raw"))


def live_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files now in the folders: some gone, some grown, some rewritten, some new."""
    text = F.when(F.col("d") % 9 == 0, F.concat("text", _text("more"))).when(
        F.col("d") % 11 == 0, F.concat(_text("x"), "text")
    ).otherwise(F.col("text"))
    live = _children(spark, sf_dir).where("d % 7 <> 0").withColumn("content", text.cast("binary"))
    from threadline.operators.catalog import grew_by_append

    grew = grew_by_append(F.col("content"), F.octet_length("text"), F.sha2("text", 256))
    return live.select(
        "folder", "name", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("bytes"),
        grew.alias("grew"),
    )
