"""The session fold: entries to turn, tool-call, attribution and session facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.functions import paths, pricing, times
from threadline.operators.entries import ATTRIBUTION_KINDS
from threadline.operators.ordered import row_ordinal

IDLE_GAP_SECONDS = 300
# Lines per chunk in ordered operators; line numbers of a file read are byte based.
LINE_CHUNK = 1 << 22

# Frequency-map column of the session table -> facet kind it is built from.
FREQUENCY_MAPS = {
    "models_json": "model",
    "cc_versions_json": "version",
    "effort_json": "effort",
    "service_tiers_json": "service_tier",
    "speeds_json": "speed",
    "permission_modes_json": "permission_mode",
    "prompt_sources_json": "prompt_source",
    "entry_types_json": "etype",
    "refusal_categories_json": "refusal",
}

# The published columns of a session, in their order.
SESSION_COLUMNS = [
    "key", "session_uuid", "source_tree", "source_path", "container_name", "size_bytes", "line_count", "is_subagent",
    "parent_session_uuid", "agent_id", "agent_name", "cwd", "project_label", "repo_root", "is_worktree",
    "worktree_name", "git_branch", "first_ts", "last_ts", "wall_seconds", "active_seconds", "engaged_seconds",
    "idle_seconds", "local_date", "local_hour", "local_weekday", "tz_offset", "n_user_prompts", "n_prompt_ids",
    "n_assistant_turns", "n_tool_uses", "n_tool_results", "n_thinking_blocks", "n_attachments",
    "n_turn_duration_events", "tok_input", "tok_output", "tok_cache_write_5m", "tok_cache_write_1h",
    "tok_cache_write", "tok_cache_write_declared", "tok_cache_read", "tok_thinking", "tok_billable_total",
    "tok_context_total", "cost_input_usd", "cost_output_usd", "cost_cache_write_usd", "cost_cache_read_usd",
    "cost_usd", "primary_model", "models_json", "cc_versions_json", "effort_json", "service_tiers_json",
    "speeds_json", "permission_modes_json", "prompt_sources_json", "entry_types_json", "entrypoint", "user_type",
    "is_sidechain", "cc_version", "is_real", "has_usage", "n_api_errors", "n_interrupts", "n_refusals",
    "refusal_categories_json", "interrupted_by_shutdown", "n_malformed_lines", "web_search_requests",
    "web_fetch_requests", "ai_title", "custom_title", "slug_title", "first_prompt_preview",
]


def first_value(value: Column, order: str = "line_no") -> Column:
    """First non-NULL value in entry order."""
    return F.min_by(value, F.when(value.isNotNull(), F.col(order)))


def last_value(value: Column, order: str = "line_no") -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col(order)))


def any_true(flag: str) -> Column:
    return F.coalesce(F.max(F.col(flag).cast("int")), F.lit(0))


def turns(entries: DataFrame, line_chunk: int | None = LINE_CHUNK) -> DataFrame:
    """One row per assistant reply, numbered in its session; None numbers a session in one pass, without chunks."""
    replies = entries.where("is_reply").select(
        "key", "line_no", "ts_raw", "model", "effort", "service_tier", "speed", "stop_reason",
        "input_tokens", "output_tokens", "cache_write_5m", "cache_write_1h", "cache_read",
        "thinking_tokens", "web_search_requests", "web_fetch_requests",
        (F.col("pico_input") + F.col("pico_output") + F.col("pico_cache_write") + F.col("pico_cache_read")).alias("pico"),
    )
    if line_chunk is None:
        numbered = replies.withColumn("ordinal", F.row_number().over(Window.partitionBy("key").orderBy("line_no")).cast("bigint"))
    else:
        numbered = row_ordinal(replies, ["key"], "line_no", "ordinal", line_chunk)
    return numbered.select(
        F.col("key").alias("session_key"), "ordinal", F.col("ts_raw").alias("ts"), "model", "effort",
        "service_tier", "speed", "stop_reason", "input_tokens", "output_tokens", "cache_write_5m",
        "cache_write_1h", "cache_read", "thinking_tokens", "web_search_requests", "web_fetch_requests",
        pricing.to_usd(F.col("pico")).alias("cost_usd"),
    )


def tool_calls(entries: DataFrame) -> DataFrame:
    """One row per tool use, and one ``(error-result)`` row per failed result."""
    used = entries.where(F.size("tool_names") > 0).select(
        F.col("key").alias("session_key"), F.col("ts_raw").alias("ts"),
        F.explode("tool_names").alias("tool_name"), F.lit(0).alias("is_error"),
    )
    failed = entries.where("n_error_results > 0").select(
        F.col("key").alias("session_key"), F.col("ts_raw").alias("ts"),
        F.explode(F.array_repeat(F.lit("(error-result)"), F.col("n_error_results").cast("int"))).alias("tool_name"),
        F.lit(1).alias("is_error"),
    )
    return used.unionByName(failed)


def _counted(entries: DataFrame, cells: list[Column]) -> DataFrame:
    spread = entries.select("key", "line_no", F.explode(F.array(*cells)).alias("_c")).where("_c.name is not null")
    return spread.groupBy("key", F.col("_c.kind").alias("kind"), F.col("_c.name").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line")
    )


def _cell(kind: str, name: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def facets(entries: DataFrame) -> DataFrame:
    """Counts of every categorical value per session: ``key, kind, name, n, first_line``.

    One unpivot and one aggregate feed the frequency maps, the primary model
    and the distinct prompt ids.
    """
    kinds = ("model", "version", "effort", "service_tier", "speed", "permission_mode", "prompt_source", "prompt_id", "etype")
    refusal = F.when(F.col("stop_reason") == "refusal", F.col("stop_category"))
    cells = [_cell(k, F.col(k)) for k in kinds] + [_cell("refusal", F.col("api_refusal")), _cell("refusal", refusal)]
    return _counted(entries, cells)


def attribution(entries: DataFrame) -> DataFrame:
    """Uses of every skill, agent, plugin and server per session."""
    counts = _counted(entries, [_cell(kind, F.col(f"attr_{kind}")) for kind in ATTRIBUTION_KINDS.values()])
    return counts.select(F.col("key").alias("session_key"), "kind", "name", F.col("n").alias("count"))


def _cell_json() -> Column:
    """``"name": count`` of a facet row; to_json of a one-element array gives the quoted, escaped name inside brackets."""
    boxed = F.to_json(F.array("name"))
    return F.concat(F.substr(boxed, F.lit(2), F.length(boxed) - 2), F.lit(": "), F.col("n").cast("string"))


def frequency_json(kind: str) -> Column:
    """``{"name": count, ...}`` with sorted keys, ``{}`` when nothing was seen; over facet rows with their ``cell``."""
    # The text of a cell is made once per row of the facets; here it is only sorted by name and joined.
    cells = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "cell"))))
    return F.concat(F.lit("{"), F.array_join(cells["cell"], ", "), F.lit("}"))


def facet_columns(facet_counts: DataFrame) -> DataFrame:
    """One row per session: frequency maps, primary model, number of prompt ids."""
    is_model = F.col("kind") == "model"
    return facet_counts.withColumn("cell", F.when(F.col("kind") != "prompt_id", _cell_json())).groupBy("key").agg(
        *[frequency_json(kind).alias(name) for name, kind in FREQUENCY_MAPS.items()],
        # Most frequent, ties to the one seen first.
        F.max_by(
            F.when(is_model, F.col("name")), F.when(is_model, F.struct(F.col("n"), -F.col("first_line")))
        ).alias("primary_model"),
        F.count(F.when(F.col("kind") == "prompt_id", 1)).alias("n_prompt_ids"),
    )


def engaged_seconds(stamps: DataFrame, key: str, ts: str, idle_gap: int = IDLE_GAP_SECONDS) -> DataFrame:
    """Per key, the sum of gaps between neighbouring stamps that are at most ``idle_gap``.

    Stamps are first reduced to (min, max) per idle-gap-wide bucket. No gap
    inside a bucket can exceed the limit, so its gaps add up to max - min, and
    only the gap from one bucket to the next needs an ordered pass. Rows of a
    busy key therefore never meet in one sort.
    """
    us = times.micros(F.col(ts))
    limit = idle_gap * times.MICROS_PER_SECOND
    buckets = (
        stamps.where(F.col(ts).isNotNull())
        .groupBy(key, F.floor(us / F.lit(limit)).alias("_b"))
        .agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    )
    bridge = F.col("_lo") - F.lag("_hi").over(Window.partitionBy(key).orderBy("_b"))
    kept = F.when(bridge <= limit, bridge).otherwise(F.lit(0).cast("bigint"))
    return (
        buckets.withColumn("_gap", F.col("_hi") - F.col("_lo") + F.coalesce(kept, F.lit(0).cast("bigint")))
        .groupBy(key)
        .agg(F.sum("_gap").alias("engaged_micros"))
    )


def _pico(name: str) -> Column:
    return F.sum(F.col(name).cast("decimal(20,0)"))


def fold(entries: DataFrame) -> DataFrame:
    """Sums, first and last values per session: one partial aggregate, one shuffle."""
    count = lambda flag: F.count(F.when(F.col(flag), 1))
    return entries.groupBy("key").agg(
        F.count(F.lit(1)).alias("line_count"),
        count("is_bad").alias("n_malformed_lines"),
        *[
            first_value(F.col(c)).alias(c)
            for c in ("session_uuid", "cwd", "git_branch", "slug", "version", "entrypoint",
                      "user_type", "agent_id", "agent_name")
        ],
        first_value(F.col("ts_raw")).alias("first_ts"),
        last_value(F.col("ts_raw")).alias("last_ts"),
        last_value(F.col("ai_title")).alias("ai_title"),
        last_value(F.col("custom_title")).alias("custom_title"),
        first_value(F.when(F.col("is_prompt"), F.col("prompt_text"))).alias("first_prompt_preview"),
        any_true("is_sidechain").alias("is_sidechain"),
        any_true("is_shutdown").alias("interrupted_by_shutdown"),
        count("is_api_error").alias("n_api_errors"),
        count("is_attachment").alias("n_attachments"),
        count("is_turn_event").alias("n_turn_duration_events"),
        F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("active_ms"),
        count("is_prompt").alias("n_user_prompts"),
        count("is_interrupt").alias("n_interrupts"),
        count("is_reply").alias("n_assistant_turns"),
        F.count(F.when(F.col("is_reply") & (F.col("stop_reason") == "refusal"), 1)).alias("n_refusals"),
        F.coalesce(F.sum(F.when(F.size("tool_names") > 0, F.size("tool_names"))), F.lit(0)).alias("n_tool_uses"),
        F.sum("n_tool_results").alias("n_tool_results"),
        F.sum("n_thinking").alias("n_thinking_blocks"),
        F.sum("input_tokens").alias("tok_input"),
        F.sum("output_tokens").alias("tok_output"),
        F.sum("cache_write_5m").alias("tok_cache_write_5m"),
        F.sum("cache_write_1h").alias("tok_cache_write_1h"),
        F.sum("cache_write_declared").alias("tok_cache_write_declared"),
        F.sum("cache_read").alias("tok_cache_read"),
        F.sum("thinking_tokens").alias("tok_thinking"),
        F.sum("web_search_requests").alias("web_search_requests"),
        F.sum("web_fetch_requests").alias("web_fetch_requests"),
        _pico("pico_input").alias("_in"),
        _pico("pico_output").alias("_out"),
        _pico("pico_cache_write").alias("_cw"),
        _pico("pico_cache_read").alias("_cr"),
    )


def folded_sessions(entries: DataFrame, idle_gap: int = IDLE_GAP_SECONDS) -> DataFrame:
    """Everything the entries tell about their session; over entries bucketed by key it needs no shuffle."""
    return (
        fold(entries)
        .join(facet_columns(facets(entries)), "key", "left")
        .join(engaged_seconds(entries, "key", "ts", idle_gap), "key", "left")
    )


def sessions(entries: DataFrame, listing: DataFrame, zone: str, idle_gap: int = IDLE_GAP_SECONDS) -> DataFrame:
    """The 77-column session table.

    ``listing`` describes each transcript: ``key, path, stem, size_bytes,
    source_tree, container_name, is_subagent, parent_session_uuid``.
    """
    folded = (
        folded_sessions(entries, idle_gap)
        .join(
            listing.select(
                "key", F.col("path").alias("source_path"), "stem", "size_bytes", "source_tree",
                "container_name", "is_subagent", "parent_session_uuid",
            ),
            "key",
        )
    )
    begin, end = times.parse_instant(F.col("first_ts")), times.parse_instant(F.col("last_ts"))
    wall_us = F.coalesce(times.micros(end) - times.micros(begin), F.lit(0).cast("bigint"))
    engaged_us = F.coalesce(F.col("engaged_micros"), F.lit(0).cast("bigint"))
    seconds = lambda us: F.round(us / F.lit(float(times.MICROS_PER_SECOND)), 3)
    local = times.local_time(begin, zone)
    write = F.col("tok_cache_write_5m") + F.col("tok_cache_write_1h")
    total = F.col("_in") + F.col("_out") + F.col("_cw") + F.col("_cr")
    derived = folded.withColumns(
        {
            "agent_id": F.coalesce("agent_id", F.when(F.col("is_subagent") == 1, F.col("stem"))),
            "project_label": paths.project_label(F.col("cwd")),
            "repo_root": paths.repo_root(F.col("cwd")),
            "is_worktree": paths.is_worktree(F.col("cwd")),
            "worktree_name": paths.worktree_name(F.col("cwd")),
            "wall_seconds": seconds(wall_us),
            "active_seconds": F.round(F.col("active_ms") / F.lit(1000.0), 3),
            "engaged_seconds": seconds(engaged_us),
            "idle_seconds": seconds(F.greatest(wall_us - engaged_us, F.lit(0).cast("bigint"))),
            "local_date": F.date_format(local, "yyyy-MM-dd"),
            "local_hour": F.hour(local),
            "local_weekday": F.weekday(local),
            "tz_offset": times.offset_text(begin, zone),
            "tok_cache_write": write,
            "tok_billable_total": F.col("tok_input") + F.col("tok_output") + write,
            "tok_context_total": F.col("tok_input") + F.col("tok_cache_read") + write,
            "cost_input_usd": pricing.to_usd(F.col("_in")),
            "cost_output_usd": pricing.to_usd(F.col("_out")),
            "cost_cache_write_usd": pricing.to_usd(F.col("_cw")),
            "cost_cache_read_usd": pricing.to_usd(F.col("_cr")),
            "cost_usd": pricing.to_usd(total),
            "is_real": (F.col("n_assistant_turns") > 0).cast("int"),
            "cc_version": F.col("version"),
            "slug_title": F.col("slug"),
            "n_prompt_ids": F.coalesce("n_prompt_ids", F.lit(0)),
            **{name: F.coalesce(name, F.lit("{}")) for name in FREQUENCY_MAPS},
        }
    )
    used = F.col("tok_billable_total") + F.col("tok_cache_read")
    return derived.withColumn("has_usage", (used > 0).cast("int")).select(*SESSION_COLUMNS)
