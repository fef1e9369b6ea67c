"""Typed columns of a transcript entry, read once out of the VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import times
from threadline.functions import variants as V
from threadline.functions.once import bound, computed_once
from threadline.functions.pricing import PriceList, cost_columns

# Attribution fields and the kind each one counts under.
ATTRIBUTION_KINDS = {
    "attributionSkill": "skill",
    "attributionPlugin": "plugin",
    "attributionAgent": "agent",
    "attributionMcpServer": "mcp_server",
    "attributionMcpTool": "mcp_tool",
}
# Text that marks an interrupted request.
INTERRUPT_MARKERS = ["[Request interrupted by user", "[Request interrupted by"]

# Fields read as VARIANT so that their JSON type can still be told, and token counters.
_TEXTS = [
    "type", "timestamp", "sessionId", "cwd", "gitBranch", "slug", "version", "entrypoint", "userType", "agentId",
    "agentName", "effort", "permissionMode", "promptSource", "promptId", "apiRefusalCategory", "aiTitle",
    "customTitle", "subtype", "durationMs", "isSidechain", "interruptedByShutdown", "isApiErrorMessage", "isMeta",
    *ATTRIBUTION_KINDS,
]
_COUNTERS = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]
ENTRY_SCHEMA = (
    "array<struct<" + ", ".join(f"{f}: variant" for f in _TEXTS)
    + ", message: struct<model: variant, stop_reason: variant, content: variant, stop_details: struct<category: variant>, usage: struct<"
    + ", ".join(f"{f}: double" for f in _COUNTERS)
    + ", cache_creation: struct<ephemeral_5m_input_tokens: double, ephemeral_1h_input_tokens: double>"
    + ", output_tokens_details: struct<thinking_tokens: double>"
    + ", server_tool_use: struct<web_search_requests: double, web_fetch_requests: double>"
    + ", service_tier: variant, speed: variant>>>>"
)


def parse_entries(lines: DataFrame) -> DataFrame:
    """Non-blank lines with ``e``, the fields the fold reads, NULL for a malformed line.

    One typed pass instead of a path lookup per field. The line is parsed inside
    brackets, so text after the object makes it malformed; a field of another
    type than expected is NULL and leaves the rest of the line intact.
    """
    raw, blank = F.col("raw"), F.lit(V.WHITESPACE)
    # A trim walks the whole line, so a line that begins and ends with its braces is not trimmed.
    kept = lines.where(raw.startswith("{") | (F.length(F.btrim(raw, blank)) > 0))
    body = F.when(raw.startswith("{") & raw.endswith("}"), raw).otherwise(F.btrim(raw, F.lit(V.WHITESPACE + "\ufeff")))
    framed = body.startswith("{") & body.endswith("}")
    boxed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), ENTRY_SCHEMA, {"allowSingleQuotes": "false"})
    single = lambda found: F.when(framed & F.coalesce(F.size(found) == 1, F.lit(False)), F.get(found, F.lit(0)))
    return computed_once(kept, {"e": bound(boxed, single)}, keep=[c for c in lines.columns if c != "raw"])


def usage_columns(u: str) -> dict[str, Column]:
    """Token counters of an assistant message, normalised.

    The 5-minute/1-hour cache split must add up to the declared total, else the
    whole write counts as 5-minute; thinking is part of the output and never more.
    """
    n = lambda path: F.coalesce(F.col(f"{u}.{path}").try_cast("bigint"), F.lit(0).cast("bigint"))
    declared = n("cache_creation_input_tokens")
    short, long = n("cache_creation.ephemeral_5m_input_tokens"), n("cache_creation.ephemeral_1h_input_tokens")
    agrees = short + long == declared
    output = n("output_tokens")
    return {
        "input_tokens": n("input_tokens"),
        "output_tokens": output,
        "cache_write_5m": F.when(agrees, short).otherwise(declared),
        "cache_write_1h": F.when(agrees, long).otherwise(F.lit(0).cast("bigint")),
        "cache_write_declared": declared,
        "cache_read": n("cache_read_input_tokens"),
        "thinking_tokens": F.least(n("output_tokens_details.thinking_tokens"), output),
        "web_search_requests": n("server_tool_use.web_search_requests"),
        "web_fetch_requests": n("server_tool_use.web_fetch_requests"),
        "service_tier": V.leaf_word(F.col(f"{u}.service_tier")),
        "speed": V.leaf_word(F.col(f"{u}.speed")),
    }


def _of_type(blocks: Column, name: str) -> Column:
    return F.filter(blocks, lambda b: F.coalesce(V.text(b, "$.type") == name, F.lit(False)))


def _count_of(blocks: Column, name: str) -> Column:
    return F.coalesce(F.size(_of_type(blocks, name)), F.lit(0)).cast("bigint")


def extract_entries(lines: DataFrame) -> DataFrame:
    """Fact columns of every non-blank line; ``is_bad`` marks malformed ones."""
    parsed = parse_entries(lines)
    keep = [c for c in parsed.columns if c != "e"]
    content = F.col("e.message.content")
    head = {
        "is_bad": F.col("e").isNull(),
        "etype": F.when(F.col("e").isNotNull(), F.coalesce(V.leaf_word(F.col("e.type")), F.lit("(none)"))),
        "has_message": F.col("e.message").isNotNull(),
        "content_text": V.union_text(content, "$"),
        "content_items": V.items(content, "$"),
        "ts_raw": V.leaf_word(F.col("e.timestamp")),
    }
    first = computed_once(parsed, head)
    word = lambda name: V.leaf_word(F.col(f"e.{name}"))
    etype = F.col("etype")
    is_reply = F.coalesce((etype == "assistant") & F.col("has_message"), F.lit(False))
    is_user = F.coalesce((etype == "user") & F.col("has_message"), F.lit(False))
    blocks = F.col("content_items")
    texts = F.transform(_of_type(blocks, "text"), lambda b: F.coalesce(V.text(b, "$.text"), F.lit("")))
    turn_event = (etype == "system") & F.coalesce(word("subtype") == "turn_duration", F.lit(False))
    # User text is read once; the marker tests below then look at a plain string.
    second = computed_once(
        first,
        {
            "is_reply": is_reply,
            "is_user": is_user,
            "user_text": F.when(is_user, F.coalesce(F.col("content_text"), F.array_join(texts, ""), F.lit(""))),
            "has_text": is_user & (F.col("content_text").isNotNull() | F.coalesce(F.size(texts) > 0, F.lit(False))),
            "is_turn_event": F.coalesce(turn_event, F.lit(False)),
        },
    )
    is_reply, is_user, user_text = F.col("is_reply"), F.col("is_user"), F.col("user_text")
    interrupted = F.lit(False)
    for marker in INTERRUPT_MARKERS:
        interrupted = interrupted | user_text.contains(marker)
    interrupted = F.coalesce(interrupted, F.lit(False))
    results = _of_type(blocks, "tool_result")
    zero = F.lit(0).cast("bigint")
    usage = usage_columns("e.message.usage")
    return second.select(
        *keep,
        "is_bad",
        "etype",
        "ts_raw",
        times.parse_instant(F.col("ts_raw")).alias("ts"),
        "is_reply",
        word("sessionId").alias("session_uuid"),
        word("cwd").alias("cwd"),
        word("gitBranch").alias("git_branch"),
        word("slug").alias("slug"),
        word("version").alias("version"),
        word("entrypoint").alias("entrypoint"),
        word("userType").alias("user_type"),
        word("agentId").alias("agent_id"),
        word("agentName").alias("agent_name"),
        word("effort").alias("effort"),
        word("permissionMode").alias("permission_mode"),
        word("promptSource").alias("prompt_source"),
        word("promptId").alias("prompt_id"),
        word("apiRefusalCategory").alias("api_refusal"),
        V.leaf_true(F.col("e.isSidechain")).alias("is_sidechain"),
        V.leaf_true(F.col("e.interruptedByShutdown")).alias("is_shutdown"),
        V.leaf_true(F.col("e.isApiErrorMessage")).alias("is_api_error"),
        *[word(f).alias(f"attr_{kind}") for f, kind in ATTRIBUTION_KINDS.items()],
        F.when(etype == "ai-title", word("aiTitle")).alias("ai_title"),
        F.when(etype == "custom-title", word("customTitle")).alias("custom_title"),
        (etype == "attachment").alias("is_attachment"),
        "is_turn_event",
        F.when(F.col("is_turn_event"), V.leaf_integer(F.col("e.durationMs"))).alias("duration_ms"),
        F.when(is_reply, word("message.model")).alias("model"),
        F.when(is_reply, word("message.stop_reason")).alias("stop_reason"),
        F.when(is_reply, word("message.stop_details.category")).alias("stop_category"),
        *[
            F.when(is_reply, c).otherwise(None if k in ("service_tier", "speed") else zero).alias(k)
            for k, c in usage.items()
        ],
        F.when(is_reply, _count_of(blocks, "thinking")).otherwise(zero).alias("n_thinking"),
        F.when(
            is_reply,
            F.transform(_of_type(blocks, "tool_use"), lambda b: F.coalesce(V.word(b, "$.name"), F.lit("(unnamed)"))),
        ).alias("tool_names"),
        F.when(is_user, _count_of(blocks, "tool_result")).otherwise(zero).alias("n_tool_results"),
        F.when(
            is_user,
            F.coalesce(F.size(F.filter(results, lambda b: V.is_true(b, "$.is_error"))), F.lit(0)).cast("bigint"),
        ).otherwise(zero).alias("n_error_results"),
        (is_user & interrupted).alias("is_interrupt"),
        (F.col("has_text") & ~interrupted & ~V.leaf_true(F.col("e.isMeta"))).alias("is_prompt"),
        F.when(is_user, F.nullif(F.substring(V.strip(user_text), 1, 300), F.lit(""))).alias("prompt_text"),
    )


def priced_entries(entries: DataFrame, prices: PriceList | None = None) -> DataFrame:
    return cost_columns(entries, prices or PriceList())
