"""Transcript-shaped input derived from the driver's tables.

The driver's data holds no transcripts, so every event becomes one JSONL entry
of a session made of a user's events in a three-day block. The JSON lines then
run through the same jobs as real files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.functions.once import computed_once

ZONE = "Australia/Melbourne"
BLOCK_SECONDS = 259_200
# Model ids the stand-in entries cycle through.
MODELS = [
    "claude-opus-5-20260101", "claude-opus-4-8", "claude-sonnet-4-5-20250929",
    "claude-haiku-4-5-20251001", "claude-fable-5", "unlisted-model-1", "<synthetic>", None,
]
TOOLS = ["Bash", "Read", "Edit", "Grep", "Write"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key, so that the generated lines, far wider than the rows, are made on every core."""
    return df.repartition(*keys)


def _pick(index: Column, values: list) -> Column:
    out = F.lit(None).cast("string")
    for i, value in enumerate(values):
        out = F.when(index == i, F.lit(value).cast("string")).otherwise(out)
    return out


def shaped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the session identity and the small integer ``k`` every field derives from."""
    ts = F.col("ts").cast("timestamp")
    block = F.floor(F.unix_micros(ts) / F.lit(BLOCK_SECONDS * 1_000_000))
    user = F.col("user_id")
    return spread(table(spark, sf_dir, "events"), "event_id").select(
        "event_id",
        "event_type",
        user.alias("u"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        ts.alias("ts"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("iso"),
        (user % 5 == 4).alias("sub"),
        F.concat(F.lit("s"), user, F.lit("-"), block).alias("stem"),
        F.concat(F.lit("s"), user - F.when(user % 5 == 4, 1).otherwise(0), F.lit("-"), block).alias("uuid"),
    )


def working_directory(u: Column) -> Column:
    app = F.concat(F.lit("/home/ann/projects/app"), u % 13)
    return (
        F.when(u % 11 == 0, F.lit(None).cast("string"))
        .when(u % 4 == 1, F.concat(app, F.lit("/.worktree/b"), u % 3))
        .when(u % 9 == 2, F.concat(F.lit("/srv/code/lib"), u % 3))
        .otherwise(app)
    )


def transcript_path(tree: str, u: Column, stem: Column, uuid: Column, sub: Column) -> Column:
    if tree == "archive":
        folder = F.concat(F.lit("/archive/label"), u % 13, F.lit("/20240101-000000+1100_"), uuid)
    else:
        folder = F.concat(F.lit("/live/slug"), u % 13, F.lit("/"), uuid)
    main = F.concat(F.lit("/live/slug"), u % 13, F.lit("/"), stem, F.lit(".jsonl"))
    if tree == "archive":
        main = F.concat(folder, F.lit("/"), stem, F.lit(".jsonl"))
    return F.when(sub, F.concat(folder, F.lit("/subagents/agent-"), stem, F.lit(".jsonl"))).otherwise(main)


def _entry_json(e: DataFrame) -> Column:
    k, u = F.col("k"), F.col("u")
    none = F.lit(None).cast("string")
    at = lambda cond, value: F.when(cond, value)
    is_view, is_error = F.col("event_type") == "view", F.col("event_type") == "error"
    is_click, is_buy = F.col("event_type") == "click", F.col("event_type") == "purchase"
    is_signup = F.col("event_type") == "signup"
    text = lambda s: F.lit(s).cast("string")
    common = {
        "type": F.when(is_view | is_error, text("user"))
        .when(is_click | is_buy, text("assistant"))
        .otherwise(_pick(k % 5, ["ai-title", "custom-title", "attachment", "system", "mystery"])),
        "timestamp": at(k != 50, F.col("iso")),
        "sessionId": F.col("uuid"),
        "cwd": working_directory(u),
        "gitBranch": at(k % 3 == 0, F.concat(text("br"), k % 4)),
        "slug": at(k % 7 == 1, F.concat(text(" slug "), k)),
        "version": F.concat(text("2.1."), k % 4),
        "entrypoint": F.when(u % 7 == 3, text("sdk-py")).otherwise(text("cli")),
        "userType": text("external"),
        "agentId": at(F.col("sub"), F.concat(text("ag"), u)),
        "permissionMode": at(is_view, _pick(k % 3, ["default", "plan", None])),
        "promptSource": at(is_view & (k % 2 == 0), text("typed")),
        "promptId": at(is_view, F.concat(text("p"), k % 20)),
        "effort": at(is_click, _pick(k % 3, ["low", "high", None])),
        "apiRefusalCategory": at(is_buy & (k % 25 == 7), text("policy")),
        "attributionSkill": at(is_click & (k % 4 == 0), F.concat(text("skill"), k % 3)),
        "attributionMcpServer": at(is_click & (k % 5 == 1), F.concat(text("mcp"), k % 2)),
        "attributionAgent": at(is_buy & (k % 6 == 2), text("reviewer")),
        "isSidechain": at(F.col("sub"), F.lit(True)),
        "interruptedByShutdown": at(is_error & (k == 3), F.lit(True)),
        "isApiErrorMessage": at(is_click & (k % 20 == 9), F.lit(True)),
        "isMeta": at(is_view & (k % 10 == 0), F.lit(True)),
        "aiTitle": at(is_signup & (k % 5 == 0), F.concat(text("Title "), k)),
        "customTitle": at(is_signup & (k % 15 == 1), F.concat(text("Named "), k)),
        "subtype": at(is_signup & (k % 5 == 3), text("turn_duration")),
        "durationMs": at(is_signup & (k % 5 == 3), k * 100),
        "filename": none,
    }
    prompt = F.when(k % 33 == 5, F.concat(text("[Request interrupted by user] "), k)).otherwise(
        F.concat(text("  please look at item "), k, text(" "))
    )
    block = lambda **cols: F.struct(
        *[cols.get(c, none).alias(c) for c in ("type", "text", "thinking", "name")],
        cols.get("is_error", F.lit(None).cast("boolean")).alias("is_error"),
    )
    no_block = F.lit(None).cast(
        "struct<type:string,text:string,thinking:string,name:string,is_error:boolean>"
    )
    items = lambda *blocks: F.filter(F.array(*blocks), lambda b: b.isNotNull())
    when = lambda cond, b: F.when(cond, b).otherwise(no_block)
    reply = items(
        when(is_click, block(type=text("text"), text=F.concat(text("answer "), k))),
        when(k % 4 == 0, block(type=text("thinking"), thinking=text("hm"))),
        when(is_click, block(type=text("tool_use"), name=_pick(k % 5, TOOLS))),
        when(is_buy & (k % 3 == 0), block(type=text("tool_use"), name=text("WebFetch"))),
        when(is_buy & (k % 12 == 1), block(type=text("tool_use"))),
    )
    result = items(
        block(type=text("tool_result"), text=text("out"), is_error=(k % 2 == 1)),
        when(k % 10 == 4, block(type=text("tool_result"), text=text("err"), is_error=F.lit(True))),
        when(k % 5 == 0, block(type=text("text"), text=text("note"))),
    )
    buy = F.when(is_buy, 1).otherwise(0)
    long_write = k + F.when(k % 17 == 0, 1).otherwise(0)
    usage = F.struct(
        (100 + k * 10).alias("input_tokens"),
        (50 + k * 7).alias("output_tokens"),
        (k * 4).alias("cache_creation_input_tokens"),
        (1000 + k).alias("cache_read_input_tokens"),
        F.when(
            k % 6 != 5,
            F.struct((k * 3).alias("ephemeral_5m_input_tokens"), long_write.alias("ephemeral_1h_input_tokens")),
        ).alias("cache_creation"),
        F.when(k % 9 == 0, text("priority")).otherwise(text("standard")).alias("service_tier"),
        F.when(k % 8 == 0, text("fast")).alias("speed"),
        F.struct((k * 8).alias("thinking_tokens")).alias("output_tokens_details"),
        F.when(
            k % 10 == 1,
            F.struct((k % 3).alias("web_search_requests"), buy.alias("web_fetch_requests")),
        ).alias("server_tool_use"),
    )
    model = _pick(F.pmod(u * 3 + k, F.lit(8)), MODELS)
    # A synthetic reply reports no usage at all.
    usage = F.when(F.coalesce(model, text("")) != "<synthetic>", usage)
    stop = F.when(is_buy & (k % 30 == 2), text("refusal")).otherwise(text("end_turn"))
    as_text = F.struct(*[c.alias(n) for n, c in common.items()], F.struct(text("user").alias("role"), prompt.alias("content")).alias("message"))
    as_reply = F.struct(
        *[c.alias(n) for n, c in common.items()],
        F.struct(
            text("assistant").alias("role"), model.alias("model"), usage.alias("usage"), reply.alias("content"),
            stop.alias("stop_reason"),
            F.when(stop == "refusal", F.struct(text("cyber").alias("category"))).alias("stop_details"),
        ).alias("message"),
    )
    as_result = F.struct(*[c.alias(n) for n, c in common.items()], F.struct(text("user").alias("role"), result.alias("content")).alias("message"))
    bare = F.struct(*[c.alias(n) for n, c in common.items()])
    return (
        F.when(is_error & (k == 99), F.concat(text("{not json "), F.col("event_id").cast("string")))
        .when(is_view, F.to_json(as_text))
        .when(is_click | is_buy, F.to_json(as_reply))
        .when(is_error, F.to_json(as_result))
        .otherwise(F.to_json(bare))
    )


def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, line_no, raw`` lines of two source trees.

    Odd users live in one tree and even users in the other; every sixth user
    also has a shorter copy in the live tree, which the pre-parse duplicate
    rule must drop.
    """
    e = shaped_events(spark, sf_dir)
    keyed = computed_once(e, {"raw": _entry_json(e)})
    lines = keyed.select("u", "k", "stem", "uuid", "sub", F.col("event_id").alias("line_no"), "raw")
    at = lambda tree: transcript_path(tree, F.col("u"), F.col("stem"), F.col("uuid"), F.col("sub"))
    own = F.struct(F.when(F.col("u") % 2 == 0, at("archive")).otherwise(at("live")).alias("path"))
    copy = F.when(F.expr("u % 6 = 0 and k < 80"), F.struct(at("live").alias("path")))
    # A line is made once, also where a copy of it lies in the other tree.
    laid = lines.select(F.explode(F.array(own, copy)).alias("_at"), "line_no", "raw").where("_at is not null")
    return laid.select("_at.path", "line_no", "raw")
