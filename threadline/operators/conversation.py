"""The conversation model: entries to turns, blocks and phases.

Text keeps its surrounding spaces here (the statistics fold strips it). Blocks
are ordered by ``line_no, block_no``; ``seq`` is one long that carries both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions import times
from threadline.functions import variants as V
from threadline.functions.once import computed_once
from threadline.operators.ordered import previous_row, running_sum

# The entry types the model knows, by what it does with them.
CONVERSATION_TYPES = ["user", "assistant", "attachment", "system"]
EXTRA_TYPES = ["bridge-session", "queue-operation", "last-prompt", "agent-name"]
METADATA_TYPES = ["summary", "ai-title", "custom-title"]
MACHINERY_TYPES = ["permission-mode", "mode", "file-history-snapshot", "file-history-delta", "started"]
KNOWN_TYPES = CONVERSATION_TYPES + EXTRA_TYPES + METADATA_TYPES + MACHINERY_TYPES + ["result", "frame-link"]
# Block types and attachment kinds with their own handling.
MEDIA_BLOCKS = ["image", "document"]
CONTENT_ATTACHMENTS = [
    "file", "edited_text_file", "already_read_file", "queued_command", "plan_mode", "plan_mode_exit", "opened_file_in_ide",
]
# Keys shown for informational entries.
EXTRA_KEYS = ["operation", "content", "lastPrompt", "agentName", "bridgeSessionId", "leafUuid", "lastSequenceNum"]
# Patterns and markers of machine-made text.
REMINDER = r"(?s)<system-reminder>(.*?)</system-reminder>"
NOTIFICATION = r"(?s)<task-notification>(.*?)</task-notification>"
STOP_HOOK = "Stop hook feedback:"
COMMIT = r"\[[\w\-/]+ ([a-f0-9]{7,})\] (.+?)(?:\n|$)"
GITHUB_REPO = r"github\.com/([a-zA-Z0-9_-]+/[a-zA-Z0-9_-]+)/pull/new/"
# Tools that change files.
FILE_TOOLS = ["Edit", "Write", "NotebookEdit", "MultiEdit"]
SUMMARY_LENGTH = 200
CAPTION_LENGTH = 72
BLOCK_BITS = 20


def strip(c: Column) -> Column:
    return V.strip(c)


def one_line(text: Column, limit: int = 200) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))


def text_items(items: Column) -> Column:
    """Texts of the text blocks of a content array."""
    kept = F.filter(items, lambda b: F.coalesce(V.text(b, "$.type") == "text", F.lit(False)))
    texts = F.transform(kept, lambda b: V.present(b, "$.text"))
    return F.filter(texts, lambda t: t.isNotNull())


def content_text(text: Column, items: Column) -> Column:
    """Visible text of a content field: the string, or its text blocks joined by a space."""
    return F.coalesce(strip(F.coalesce(text, F.array_join(text_items(items), " "))), F.lit(""))


def commits(text: Column) -> Column:
    """Commits named in a tool result, as ``sha, message`` structs."""
    hits = F.regexp_extract_all(text, F.lit(COMMIT), F.lit(0))
    return F.transform(
        hits, lambda h: F.struct(F.regexp_extract(h, COMMIT, 1).alias("sha"), F.regexp_extract(h, COMMIT, 2).alias("message"))
    )


def github_repo(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, GITHUB_REPO, 1), F.lit(""))


def visible_text(text: Column) -> Column:
    return strip(F.regexp_replace(text, REMINDER, ""))


def reminders(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(REMINDER), F.lit(1)), strip)
    return F.filter(found, lambda r: r != "")


def media_marker(block: Column) -> Column:
    """Type and decoded size of an inline medium; its data is never copied."""
    data = V.text(block, "$.source.data")
    size = F.floor(F.length(data) * 3 / 4).cast("bigint")
    shown = F.when(size > 0, F.concat(F.format_number(size, 0), F.lit(" bytes")))
    detail = F.concat_ws(" · ", V.present(block, "$.source.media_type"), shown)
    head = F.concat(F.lit("attachment ("), V.text(block, "$.type"), F.lit(")"))
    return F.when(detail != "", F.concat(head, F.lit(": "), detail)).otherwise(head)


def substantive(text: Column, items: Column) -> Column:
    """Real work in a reply: visible text or a tool call."""
    in_items = F.exists(
        items,
        lambda b: (V.text(b, "$.type") == "tool_use")
        | ((V.text(b, "$.type") == "text") & (strip(V.text(b, "$.text")) != "")),
    )
    return F.coalesce(strip(text) != "", F.lit(False)) | F.coalesce(in_items, F.lit(False))


# ---- catalogue parse fold ---------------------------------------------------


def lone_surrogates(raw: Column) -> Column:
    """Escaped surrogates of a JSON text that have no partner; an escaped backslash starts no escape.

    Few lines hold any escape of a surrogate, and only those are searched.
    """
    escapes = F.replace(raw, F.lit("\\\\"), F.lit(" "))
    alone = F.regexp_replace(escapes, r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}", " ")
    possible = raw.contains("\\ud") | raw.contains("\\uD")
    return F.when(possible, F.regexp_count(alone, F.lit(r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}"))).otherwise(0)


def conversation_entries(parsed: DataFrame) -> DataFrame:
    """Columns of every line the conversation model reads; ``v`` stays for the block step."""
    v = F.col("v")
    typed = {
        "etype": V.text(v, "$.type"),
        "text": V.union_text(v, "$.message.content"),
        "items": V.items(v, "$.message.content"),
        "stamp": V.present(v, "$.timestamp"),
        "is_meta": V.is_true(v, "$.isMeta"),
        "is_sidechain": V.is_true(v, "$.isSidechain"),
        "is_compact": V.is_true(v, "$.isCompactSummary"),
        "agent_id": V.present(v, "$.agentId"),
        "unencodable": lone_surrogates(F.col("raw")),
    }
    kept = [c for c in parsed.columns if c != "raw"]
    return computed_once(parsed, typed, keep=kept)


def parse_fold(entries: DataFrame, key: str = "path") -> DataFrame:
    """Catalogue columns of every payload: ids, titles, first and last stamp, summary, hidden flag."""
    v = F.col("v")
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("line_no")))
    last = lambda c: F.max_by(c, F.when(c.isNotNull(), F.col("line_no")))
    visible = content_text(F.col("text"), F.col("items"))
    is_candidate = (F.col("etype") == "user") & ~F.col("is_meta") & (visible != "") & ~visible.startswith("<")
    summary = F.when(F.col("etype") == "summary", V.present(v, "$.summary"))
    real = F.when((F.col("etype") == "assistant") & substantive(F.col("text"), F.col("items")), 1)
    typed = computed_once(
        entries,
        {
            "session_uuid": V.present(v, "$.sessionId"), "cwd": V.present(v, "$.cwd"), "slug": V.present(v, "$.slug"),
            "git_branch": V.present(v, "$.gitBranch"), "version": V.present(v, "$.version"),
            "model": V.present(v, "$.message.model"),
            "ai_title": F.when(F.col("etype") == "ai-title", V.present(v, "$.aiTitle")),
            "custom_title": F.when(F.col("etype") == "custom-title", V.present(v, "$.customTitle")),
            "summary_line": F.when(strip(summary) != "", summary),
            "prompt_line": F.when(is_candidate, visible),
            "real": real,
            "bad": v.isNull(),
        },
        keep=[key, "line_no", "stamp", "unencodable"],
    )
    named = ["session_uuid", "cwd", "slug", "git_branch", "version", "model"]
    folded = typed.groupBy(key).agg(
        *[first(F.col(c)).alias(c) for c in named],
        first(F.col("stamp")).alias("first_ts"),
        last(F.col("stamp")).alias("last_ts"),
        last(F.col("ai_title")).alias("ai_title"),
        last(F.col("custom_title")).alias("custom_title"),
        F.count(F.lit(1)).alias("line_count"),
        F.count(F.when(F.col("bad"), 1)).alias("skipped_lines"),
        F.sum("unencodable").alias("unencodable_chars"),
        first(F.col("summary_line")).alias("_summary"),
        first(F.col("prompt_line")).alias("_prompt"),
        F.count("real").alias("_replies"),
    )
    candidate = strip(F.coalesce("_summary", "_prompt"))
    cut = F.when(
        F.length(candidate) > SUMMARY_LENGTH, F.concat(F.substring(candidate, 1, SUMMARY_LENGTH - 3), F.lit("..."))
    ).otherwise(candidate)
    hidden = F.when(candidate.isNull(), F.col("_replies") < 2).otherwise(F.lower(candidate) == "warmup")
    return folded.withColumns(
        {"summary": F.coalesce(cut, F.lit("(no summary)")), "hidden": hidden}
    ).drop("_summary", "_prompt", "_replies")


def title(custom: Column, ai: Column, slug: Column, summary: Column) -> Column:
    """Document title: the operator's, the generated one, the slug, the summary's first line without reminders."""
    line = F.nullif(strip(F.element_at(F.split(visible_text(summary), "\n"), 1)), F.lit(""))
    return F.coalesce(
        F.nullif(custom, F.lit("")), F.nullif(ai, F.lit("")), F.nullif(slug, F.lit("")),
        F.when(summary != "(no summary)", line), F.lit("session"),
    )


# ---- blocks -----------------------------------------------------------------

_BLOCK = "array<struct<kind:string,text:string,tool_name:string,payload:variant,unknown:string>>"


def _block(kind: Column, text: Column, tool: Column | None = None, payload: Column | None = None,
           unknown: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        kind.alias("kind"), text.alias("text"), (none if tool is None else tool).alias("tool_name"),
        (F.lit(None).cast("variant") if payload is None else payload).alias("payload"),
        (none if unknown is None else unknown).alias("unknown"),
    )


def _named(kind: str, text: Column) -> Column:
    return F.array(_block(F.lit(kind), text))


def _assistant_block(b: Column) -> Column:
    t = V.text(b, "$.type")
    thought = strip(V.text(b, "$.thinking"))
    said = strip(V.text(b, "$.text"))
    fallback = F.concat(
        F.lit("model fallback: "), F.coalesce(V.present(b, "$.from.model"), F.lit("?")), F.lit(" -> "),
        F.coalesce(V.present(b, "$.to.model"), F.lit("?")),
    )
    name = F.concat(F.lit("block:"), F.coalesce(F.nullif(t, F.lit("")), F.lit("(untyped)")))
    blank = F.coalesce(thought, F.lit("")) == ""
    return (
        F.when((t == "thinking") & blank, _block(F.lit("thinking_withheld"), F.lit("")))
        .when(t == "thinking", _block(F.lit("thinking"), thought))
        .when((t == "text") & (said != ""), _block(F.lit("assistant_text"), said))
        .when(t == "text", F.lit(None))
        .when(t == "tool_use", _block(F.lit("tool_use"), F.lit(""), V.text(b, "$.name"), V.get(b, "$.input")))
        .when(t == "fallback", _block(F.lit("machinery"), fallback))
        .when(t.isin(MEDIA_BLOCKS), _block(F.lit("attachment"), media_marker(b)))
        .otherwise(_block(F.lit("machinery"), name, unknown=name))
    )


def _user_block(b: Column, outcome: Column | None = None) -> Column:
    """A block of a user message; a tool result carries the entry's structured ``outcome``."""
    t = V.text(b, "$.type")
    said = strip(V.text(b, "$.text"))
    result = F.coalesce(V.union_text(b, "$.content"), content_text(F.lit(None).cast("string"), V.items(b, "$.content")))
    name = F.concat(F.lit("block:"), F.coalesce(F.nullif(t, F.lit("")), F.lit("(untyped)")))
    return (
        F.when(t == "tool_result", _block(F.lit("tool_result"), result, payload=outcome))
        .when((t == "text") & (said != ""), _block(F.lit("assistant_text"), said))
        .when(t == "text", F.lit(None))
        .when(t.isin(MEDIA_BLOCKS), _block(F.lit("attachment"), media_marker(b)))
        .otherwise(_block(F.lit("machinery"), name, unknown=name))
    )


def _is_object(b: Column) -> Column:
    return V.fields(b, "$").isNotNull()


def _listed(items: Column, make) -> Column:
    made = F.transform(F.filter(items, _is_object), make)
    return F.filter(made, lambda b: b.isNotNull())


def _subagent_lines(etype: Column, text: Column, items: Column) -> Column:
    """One scannable line per unit of a sub-agent's exchange."""
    visible = content_text(text, items)
    results = F.transform(
        F.filter(items, lambda b: F.coalesce(V.text(b, "$.type") == "tool_result", F.lit(False))), lambda b: F.lit("tool result")
    )
    prompt = F.when(visible != "", F.array(F.concat(F.lit("prompt: "), one_line(visible)))).otherwise(F.array().cast("array<string>"))
    user = F.concat(F.coalesce(results, F.array().cast("array<string>")), prompt)
    said = F.when(strip(text) != "", F.array(one_line(strip(text))))
    spoken = F.transform(
        _listed(items, _assistant_block),
        lambda b: F.when(b["kind"] == "thinking", F.concat(F.lit("thinking: "), one_line(b["text"])))
        .when(b["kind"] == "assistant_text", one_line(b["text"]))
        .when(b["kind"] == "tool_use", F.concat(F.lit("tool: "), F.coalesce(b["tool_name"], F.lit("tool")))),
    )
    reply = F.filter(F.coalesce(said, spoken, F.array().cast("array<string>")), lambda x: x.isNotNull())
    lines = F.when(etype == "user", user).otherwise(reply)
    return F.transform(lines, lambda x: _block(F.lit("subagent"), x))


def _attachment(v: Column) -> Column:
    a = lambda path: V.present(v, f"$.attachment.{path}")
    kind = F.coalesce(a("type"), F.lit("attachment"))
    name = a("filename")
    body = F.coalesce(
        a("snippet"), a("content.file.content"), a("content.content"), a("planFilePath"), a("command"), a("content")
    )
    marker = F.concat(F.lit("attachment:"), kind, F.coalesce(F.concat(F.lit(" "), name), F.lit("")))
    shown = F.concat(
        F.lit("attachment ("), kind, F.lit(")"), F.coalesce(F.concat(F.lit(": "), name), F.lit("")),
        F.coalesce(F.concat(F.lit("\n\n"), body), F.lit("")),
    )
    block = F.when(kind.isin(CONTENT_ATTACHMENTS), _block(F.lit("attachment"), shown)).otherwise(
        _block(F.lit("machinery"), marker)
    )
    return F.when(V.fields(v, "$.attachment").isNotNull(), F.array(block))


def _machinery(v: Column, etype: Column) -> Column:
    say = lambda label, path: F.concat(F.lit(label), F.coalesce(V.present(v, path), F.lit("?")))
    tracked = F.coalesce(F.size(V.fields(v, "$.snapshot.trackedFileBackups")), F.lit(0))
    snapshot = F.concat(
        F.lit("file-history-snapshot: "), tracked.cast("string"), F.lit(" tracked file(s)"),
        F.when(V.is_true(v, "$.isSnapshotUpdate"), F.lit(" (update)")).otherwise(F.lit("")),
    )
    return (
        F.when(etype == "permission-mode", say("permission-mode: ", "$.permissionMode"))
        .when(etype == "mode", say("mode: ", "$.mode"))
        .when(etype == "started", say("sub-agent started: ", "$.agentId"))
        .when(etype == "file-history-delta", say("file-history-delta: ", "$.trackingPath"))
        .otherwise(snapshot)
    )


def _value_summary(v: Column) -> Column:
    cells = []
    for key in EXTRA_KEYS:
        value = F.try_variant_get(v, f"$.{key}", "string")
        cells.append(F.when(value.isNotNull() & ~value.isin("", "[]", "{}"), F.concat(F.lit(f"{key}="), one_line(value))))
    return F.concat_ws(" ", *cells)


def _system(v: Column) -> Column:
    subtype, text = V.present(v, "$.subtype"), V.present(v, "$.content")
    label = F.trim(F.concat(F.lit("system:"), F.coalesce(subtype, F.lit("system")), F.lit(" "), F.coalesce(text, F.lit(""))))
    return F.when((subtype == "local_command") & text.isNotNull(), _named("command", text)).when(
        text.isNotNull() | subtype.isNotNull(), _named("machinery", label)
    )


def _agent_result(v: Column) -> Column:
    agent = F.coalesce(V.present(v, "$.agentId"), F.lit("sub-agent"))
    plain = V.text(v, "$.result")
    fields = V.fields(v, "$.result")
    # The summary is the block's text; whatever else the agent returned travels beside it.
    rest = F.map_filter(fields, lambda k, _: k != "summary")
    has_fields = fields.isNotNull()
    return (
        F.when(has_fields, F.array(_block(F.lit("agent_result"), F.coalesce(V.present(v, "$.result.summary"), F.lit("")), payload=F.when(F.size(rest) > 0, F.to_variant_object(rest)))))
        .when(plain.isNotNull(), _named("agent_result", strip(plain)))
        .otherwise(_named("machinery", F.concat(F.lit("sub-agent result: "), agent, F.lit(" (empty)"))))
    )


def _frame_link(v: Column) -> Column:
    parts = F.concat_ws(" ", V.present(v, "$.title"), V.present(v, "$.frameUrl"), V.present(v, "$.path"))
    return F.when(parts != "", F.concat(F.lit("frame-link: "), parts)).otherwise(F.lit("frame-link"))


def prompt_class(etype: Column, text: Column, is_meta: Column, is_compact: Column, is_sidechain: Column) -> Column:
    """What a string user message is: a prompt, or machine text that never opens a turn."""
    visible = visible_text(text)
    is_text = (etype == "user") & text.isNotNull() & ~is_sidechain & ~is_compact
    return F.when(is_text, (
        F.when(strip(text).startswith("<task-notification>"), "task_notification")
        .when(visible.startswith(STOP_HOOK), "stop_hook")
        .when(is_meta | (visible == ""), "machinery")
        .otherwise("prompt")
    ))


def model_entries(entries: DataFrame) -> DataFrame:
    """Entries with their blocks and the flag ``opens_turn``."""
    v, etype = F.col("v"), F.col("etype")
    text, items = F.col("text"), F.col("items")
    known = F.coalesce(etype.isin(KNOWN_TYPES), F.lit(False))
    name = F.concat(F.lit("entry:"), F.coalesce(F.nullif(etype, F.lit("")), F.lit("(untyped)")))
    visible = visible_text(text)
    notice = strip(F.coalesce(F.nullif(F.regexp_extract(text, NOTIFICATION, 1), F.lit("")), visible))
    hints = F.transform(reminders(text), lambda r: _block(F.lit("reminder"), r))
    meta_blocks = F.concat(
        F.when(visible != "", _named("machinery", visible)).otherwise(F.array().cast(_BLOCK)), F.coalesce(hints, F.array().cast(_BLOCK))
    )
    summary = _value_summary(v)
    side = F.col("is_sidechain") & etype.isin("user", "assistant")
    said = strip(text)
    blocks = (
        F.when(~known, F.array(_block(F.lit("machinery"), name, unknown=name)))
        .when(side, _subagent_lines(etype, text, items))
        .when(etype == "attachment", _attachment(v))
        .when(etype == "system", _system(v))
        .when(etype.isin(EXTRA_TYPES), F.when(summary != "", _named("extra", F.concat(etype, F.lit(": "), summary))))
        .when(etype.isin(MACHINERY_TYPES), _named("machinery", _machinery(v, etype)))
        .when(etype == "result", _agent_result(v))
        .when(etype == "frame-link", _named("extra", _frame_link(v)))
        .when(etype.isin(METADATA_TYPES), F.lit(None))
        .when((etype == "assistant") & text.isNotNull(), F.when(said != "", _named("assistant_text", said)))
        .when(etype == "assistant", _listed(items, _assistant_block))
        .when(F.col("is_compact"), _named("continuation", content_text(text, items)))
        .when(items.isNotNull(), _listed(items, lambda b: _user_block(b, F.when(V.fields(v, "$.toolUseResult").isNotNull(), V.get(v, "$.toolUseResult")))))
        .when(F.col("class") == "task_notification", _named("task_notification", notice))
        .when(F.col("class") == "stop_hook", _named("stop_hook", visible))
        .when(F.col("class") == "machinery", meta_blocks)
    )
    classed = entries.where("v is not null").withColumn(
        "class", prompt_class(etype, text, F.col("is_meta"), F.col("is_compact"), F.col("is_sidechain"))
    )
    is_prompt = F.coalesce(F.col("class") == "prompt", F.lit(False))
    kept = [c for c in entries.columns if c not in ("v", "items", "text")]
    return computed_once(
        classed,
        {
            "opens_turn": is_prompt.cast("bigint"),
            "prompt": F.when(is_prompt, visible),
            "prompt_reminders": F.when(is_prompt, reminders(text)),
            "blocks": F.coalesce(blocks.cast(_BLOCK), F.array().cast(_BLOCK)),
        },
        keep=kept,
    )


# ---- turns, blocks, phases ---------------------------------------------------


def number_turns(modelled: DataFrame, key: str = "path", width: int = 1 << 22) -> DataFrame:
    """Entries with ``turn``: the number of prompts up to here; 0 is what precedes the first prompt."""
    return running_sum(modelled, [key], "line_no", "opens_turn", "turn", width)


def turn_table(numbered: DataFrame, key: str = "path") -> DataFrame:
    """One row per turn; a turn 0 without blocks does not exist."""
    per = numbered.groupBy(key, "turn").agg(
        F.min_by("prompt", F.when(F.col("opens_turn") == 1, F.col("line_no"))).alias("prompt"),
        F.min_by("prompt_reminders", F.when(F.col("opens_turn") == 1, F.col("line_no"))).alias("reminders"),
        F.min_by("stamp", F.when(F.col("stamp").isNotNull(), F.col("line_no"))).alias("first_ts"),
        F.max_by("stamp", F.when(F.col("stamp").isNotNull(), F.col("line_no"))).alias("last_ts"),
        F.min_by("stamp", "line_no").alias("_opening"),
        F.sum(F.size("blocks")).alias("n_blocks"),
        F.min("line_no").alias("first_line"),
    )
    # A prompt entry sets the opening stamp even when it has none.
    opened = F.when(F.col("turn") > 0, F.coalesce("_opening", "first_ts")).otherwise(F.col("first_ts"))
    return per.where("turn > 0 or n_blocks > 0").select(
        key, "turn", (F.col("turn") == 0).alias("synthetic"), F.coalesce("prompt", F.lit("")).alias("prompt"),
        "reminders", opened.alias("first_ts"), "last_ts", "n_blocks", "first_line",
    )


def block_table(numbered: DataFrame, key: str = "path") -> DataFrame:
    """One row per block: ``turn, line_no, block_no, kind, text, tool_name, payload``, ordered by ``seq``."""
    spread = numbered.select(key, "turn", "line_no", "agent_id", F.posexplode("blocks").alias("block_no", "_b"))
    seq = F.shiftleft("line_no", BLOCK_BITS) + F.col("block_no")
    return spread.select(
        key, "turn", "line_no", "block_no", "agent_id", seq.alias("seq"), F.col("_b.kind").alias("kind"), F.col("_b.text").alias("text"),
        F.col("_b.tool_name").alias("tool_name"), F.col("_b.payload").alias("payload"), F.col("_b.unknown").alias("unknown"),
    )


def category(kind: Column) -> Column:
    """The phase a block folds into; replies stand alone."""
    return (
        F.when(kind == "assistant_text", "reply")
        .when(kind.isin("subagent", "agent_result"), "subagent")
        .when(kind.isin("command", "attachment", "extra"), kind)
        .otherwise("research")
    )


def phases(blocks: DataFrame, key: str = "path", width: int = (1 << 22) << BLOCK_BITS) -> DataFrame:
    """Blocks with ``category`` and ``segment``: runs of one category fold, a reply is its own segment."""
    marked = blocks.withColumn("category", category(F.col("kind")))
    seen = previous_row(marked, [key, "turn"], "seq", ["category"], width)
    fresh = (~F.col("prev_exists")) | (F.col("category") == "reply") | (F.col("category") != F.col("prev_category"))
    flagged = seen.withColumn("_new", fresh.cast("bigint")).drop("prev_exists", "prev_category")
    return running_sum(flagged, [key, "turn"], "seq", "_new", "segment", width).drop("_new")


def caption(text: Column) -> Column:
    """The first usable line of a thought, without markup, cut to one clause."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda s: strip(F.translate(strip(F.ltrim(strip(s), F.lit("#>-*+ "))), "<>`", "")),
    )
    first = F.try_element_at(F.filter(lines, lambda s: s != ""), F.lit(1))
    short = F.concat(F.rtrim(F.substring(first, 1, CAPTION_LENGTH - 3)), F.lit("..."))
    return F.when(F.length(first) > CAPTION_LENGTH, short).otherwise(first)


def looks_failed(text: Column) -> Column:
    """A result that reads as an error; results carry no error flag."""
    head = F.lower(F.substring(strip(text), 1, 200))
    return F.coalesce(head.rlike("^(error|traceback)") | head.contains("<tool_use_error>"), F.lit(False))


# Captions of phases that hold only one kind of background block.
KIND_CAPTIONS = [
    ("attachment", "attachments"), ("command", "commands"), ("extra", "session events"), ("machinery", "background"),
]


def phase_statistics(phased: DataFrame, key: str = "path") -> DataFrame:
    """Counts, error flag and caption of every phase.

    The caption is the last thought, else the first three tools used, else the
    sub-agent, else a word for the only kind of block there is.
    """
    kind, tool = F.col("kind"), F.col("tool_name")
    n = lambda cond: F.count(F.when(cond, 1))
    is_tool = kind == "tool_use"
    thought = F.when((kind == "thinking") & (F.trim("text") != ""), caption(F.col("text")))
    agent = F.when(kind == "subagent", F.coalesce("agent_id", F.lit("sub-agent")))
    keys = [key, "turn", "segment"]
    per = phased.where("category <> 'reply'").groupBy(*keys, "category").agg(
        F.count(F.lit(1)).alias("n_blocks"),
        n(is_tool & (tool == "WebSearch")).alias("searches"),
        n(is_tool & (tool == "WebFetch")).alias("fetches"),
        n(is_tool & ~F.coalesce(tool.isin("WebSearch", "WebFetch"), F.lit(False))).alias("other_tools"),
        n(kind == "thinking").alias("thoughts"),
        n(kind == "thinking_withheld").alias("withheld"),
        n(kind == "subagent").alias("subagent_steps"),
        F.max(((kind == "tool_result") & looks_failed(F.col("text"))).cast("int")).alias("any_error"),
        F.max_by(thought, F.when(thought.isNotNull(), F.col("seq"))).alias("_thought"),
        F.min(agent).alias("_agent"),
        F.max(agent).alias("_agent_hi"),
        *[F.max((kind == k).cast("int")).alias(f"_{k}") for k, _ in KIND_CAPTIONS],
    )
    # First use of each distinct tool; only those few names are gathered.
    used = phased.where(is_tool & (F.coalesce(tool, F.lit("")) != "")).groupBy(*keys, "tool_name").agg(F.min("seq").alias("_at"))
    listed = used.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "tool_name"))).alias("_t"))
    names = F.array_join(F.transform(F.slice("_t", 1, 3), lambda t: t["tool_name"]), ", ")
    tools = listed.select(*keys, F.concat(names, F.when(F.size("_t") > 3, ", ...").otherwise("")).alias("_tools"))
    words = F.lit(None).cast("string")
    for k, word in reversed(KIND_CAPTIONS):
        words = F.when(F.col(f"_{k}") == 1, F.lit(word)).otherwise(words)
    one_agent = F.when(F.col("_agent") == F.col("_agent_hi"), F.concat(F.lit("sub-agent: "), "_agent"))
    who = F.when(F.col("_agent").isNotNull(), F.coalesce(one_agent, F.lit("sub-agent")))
    joined = per.join(tools, keys, "left")
    captioned = joined.withColumn("caption", F.coalesce("_thought", "_tools", who, words, F.lit("Worked")))
    return captioned.drop("_thought", "_tools", "_agent", "_agent_hi", *[f"_{k}" for k, _ in KIND_CAPTIONS])


def turn_elapsed(turns: DataFrame, key: str = "path", width: int = 4096) -> DataFrame:
    """Seconds and label from the previous turn's end to this turn's start; the first is ``0``."""
    seen = previous_row(turns, [key], "turn", ["first_ts", "last_ts"], width)
    start = times.parse_instant(F.col("first_ts"))
    earlier = F.coalesce(times.parse_instant(F.col("prev_last_ts")), times.parse_instant(F.col("prev_first_ts")))
    gap = (F.unix_micros(start) - F.unix_micros(earlier)) / F.lit(1e6)
    label = F.when(start.isNull(), F.lit(None).cast("string")).when(~F.col("prev_exists"), "0").otherwise(times.elapsed_label(gap))
    return seen.select(key, "turn", F.round(gap, 3).alias("elapsed_seconds"), label.alias("elapsed"))


def file_index(blocks: DataFrame, key: str = "path") -> DataFrame:
    """Files a session created or edited, by first mention."""
    used = blocks.where(F.col("kind") == "tool_use").where(F.col("tool_name").isin(FILE_TOOLS))
    named = used.select(key, "seq", "tool_name", V.present(F.col("payload"), "$.file_path").alias("file_path")).where(
        "file_path is not null"
    )
    first = named.groupBy(key, "file_path").agg(F.min_by("tool_name", "seq").alias("_tool"), F.min("seq").alias("first_seq"))
    return first.withColumn("verb", F.when(F.col("_tool") == "Write", "created").otherwise("edited")).drop("_tool")


def session_commits(blocks: DataFrame, key: str = "path") -> DataFrame:
    """Commits of a session with a link when its first pushed repository is known."""
    results = blocks.where("kind = 'tool_result'")
    found = results.select(key, "seq", F.posexplode(commits(F.col("text"))).alias("i", "_c"))
    repo = results.select(key, "seq", github_repo(F.col("text")).alias("repo")).where("repo is not null")
    first_repo = repo.groupBy(key).agg(F.min_by("repo", "seq").alias("repo"))
    linked = found.join(first_repo, key, "left")
    url = F.concat(F.lit("https://github.com/"), F.col("repo"), F.lit("/commit/"), F.col("_c.sha"))
    return linked.select(key, "seq", "i", F.col("_c.sha").alias("sha"), F.col("_c.message").alias("message"), "repo", url.alias("url"))


def conversation_counts(turns: DataFrame, blocks: DataFrame, key: str = "path") -> DataFrame:
    """Prompts, tool calls, withheld thoughts and unrecognised types of every session."""
    t = turns.groupBy(key).agg(
        F.count(F.when(~F.col("synthetic"), 1)).alias("prompts"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    b = blocks.groupBy(key).agg(
        F.count(F.when(F.col("kind") == "tool_use", 1)).alias("tool_calls"),
        F.count(F.when(F.col("kind") == "thinking", 1)).alias("thoughts"),
        F.count(F.when(F.col("kind") == "thinking_withheld", 1)).alias("withheld_thinking"),
        F.count(F.when(F.col("kind") == "assistant_text", 1)).alias("replies"),
        F.count("unknown").alias("unrecognised_count"),
        F.sort_array(F.collect_set("unknown")).alias("unrecognised"),
        F.sum(F.when(F.col("kind") == "assistant_text", word_count(F.col("text"))).otherwise(0)).alias("reply_words"),
    )
    zero = F.lit(0).cast("bigint")
    counted = ["tool_calls", "thoughts", "withheld_thinking", "replies", "unrecognised_count", "reply_words"]
    both = t.join(b, key, "full_outer")
    return both.withColumns(
        {**{c: F.coalesce(c, zero) for c in counted}, "prompts": F.coalesce("prompts", zero),
         "unrecognised": F.coalesce("unrecognised", F.array().cast("array<string>"))}
    )


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def session_card(counts: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """The session header: words, tool calls, files touched, replies, span."""
    touched = files.groupBy(key).agg(F.count(F.lit(1)).alias("files_touched"))
    span = times.duration_seconds(times.parse_instant(F.col("first_ts")), times.parse_instant(F.col("last_ts")))
    return counts.join(touched, key, "left").withColumns(
        {"files_touched": F.coalesce("files_touched", F.lit(0).cast("bigint")), "span_seconds": span}
    )


def truncated(text: Column, cap: int) -> Column:
    """``kept, omitted``: text cut at the last line boundary below ``cap`` characters."""
    head = F.substring(text, 1, cap)
    at = F.regexp_extract(head, r"(?s)^(.*)\n", 1)
    kept = F.when((F.lit(cap) <= 0) | (F.length(text) <= cap), text).when(at != "", at).otherwise(head)
    return F.struct(kept.alias("kept"), (F.length(text) - F.length(kept)).cast("bigint").alias("omitted"))


def truncation_loss(blocks: DataFrame, cap: int, key: str = "path") -> DataFrame:
    """Tool results cut at ``cap`` and characters left out."""
    cut = blocks.where("kind = 'tool_result'").withColumn("_t", truncated(F.col("text"), cap))
    return cut.groupBy(key).agg(
        F.count(F.when(F.col("_t.omitted") > 0, 1)).alias("blocks_cut"), F.sum("_t.omitted").alias("chars_omitted")
    )


# ---- documents ----------------------------------------------------------------


def tool_text(tool: Column, payload: Column) -> Column:
    """Readable form of a tool call: command, diff, todo list, or its input as JSON."""
    p = lambda path: V.text(payload, path)
    todos = F.transform(
        V.items(payload, "$.todos"),
        lambda t: F.concat(
            F.when(V.text(t, "$.status") == "completed", F.lit("[x] "))
            .when(V.text(t, "$.status") == "in_progress", F.lit("[~] ")).otherwise(F.lit("[ ] ")),
            F.coalesce(V.text(t, "$.content"), F.lit("")),
        ),
    )
    diff = F.concat_ws("\n", F.concat(F.lit("- "), p("$.old_string")), F.concat(F.lit("+ "), p("$.new_string")))
    body = (
        F.when(tool == "Bash", p("$.command"))
        .when(tool == "Edit", diff)
        .when(tool == "TodoWrite", F.array_join(todos, "\n"))
        .otherwise(F.to_json(payload))
    )
    return F.concat(F.coalesce(tool, F.lit("tool")), F.coalesce(F.concat(F.lit(": "), body), F.lit("")))


def structured_result(payload: Column, cap: int = 0) -> Column:
    """Output streams and interruption of a structured tool result; NULL when it has none of them."""
    stream = lambda name: F.concat(F.lit(f"{name}:\n"), F.nullif(truncated(V.text(payload, f"$.{name}"), cap)["kept"], F.lit("")))
    parts = F.concat_ws("\n", stream("stdout"), stream("stderr"), F.when(V.is_true(payload, "$.interrupted"), F.lit("(interrupted)")))
    return F.nullif(parts, F.lit(""))


def block_line(prose_only: bool, cap: int) -> Column:
    """Text of one block in the transcript; NULL leaves it out."""
    kind, text = F.col("kind"), F.col("text")
    shown = F.when(kind == "assistant_text", text)
    if prose_only:
        return shown
    cut = truncated(text, cap)
    result = F.concat(
        cut["kept"],
        F.when(cut["omitted"] > 0, F.concat(F.lit("\n["), cut["omitted"].cast("string"), F.lit(" characters omitted]"))).otherwise(F.lit("")),
    )
    return (
        shown
        .when(kind == "tool_use", F.concat(F.lit("> "), tool_text(F.col("tool_name"), F.col("payload"))))
        .when(kind == "tool_result", F.concat(F.lit("< "), F.coalesce(structured_result(F.col("payload"), cap), result)))
        .when(kind == "agent_result", F.concat_ws("\n", F.concat(F.lit("(agent_result) "), text), F.to_json("payload")))
        .when(kind == "thinking_withheld", F.lit(None))
        .otherwise(F.concat(F.lit("("), kind, F.lit(") "), text))
    )


def transcript_documents(
    turns: DataFrame, blocks: DataFrame, prose_only: bool = False, cap: int = 2000, key: str = "path"
) -> DataFrame:
    """Ordered text pieces of every session: ``seq, piece``.

    The pieces of one session are written in ``seq`` order and are never
    gathered into one value, so a session of any size stays spread over rows.
    """
    heads = turns.select(
        key, (F.shiftleft("first_line", BLOCK_BITS) - 1).alias("seq"),
        F.when(F.col("synthetic"), F.lit("## (before the first prompt)")).otherwise(
            F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit("\n"), F.col("prompt"))
        ).alias("piece"),
    )
    lines = blocks.select(key, "seq", block_line(prose_only, cap).alias("piece")).where("piece is not null")
    return heads.unionByName(lines)


def session_manifests(
    folded: DataFrame, counts: DataFrame, loss: DataFrame, payload: DataFrame, key: str = "path"
) -> DataFrame:
    """One manifest per session as JSON: hash, counts, loss, unrecognised, withheld."""
    joined = folded.join(counts.drop("first_ts", "last_ts"), key, "left").join(loss, key, "left").join(
        payload.select(key, F.col("hash").alias("source_hash")), key, "left"
    )
    zero = F.lit(0).cast("bigint")
    body = F.struct(
        "source_hash",
        F.struct("prompts", "tool_calls", "replies").alias("counts"),
        F.struct(
            F.col("skipped_lines").alias("skipped_lines"), "unencodable_chars",
            F.coalesce("blocks_cut", zero).alias("blocks_cut"), F.coalesce("chars_omitted", zero).alias("chars_omitted"),
        ).alias("loss"),
        F.struct(F.col("unrecognised_count").alias("count"), F.col("unrecognised").alias("types")).alias("unrecognised"),
        F.struct(F.col("withheld_thinking").alias("thinking")).alias("withheld"),
    )
    return joined.select(key, F.to_json(body).alias("manifest"))


def type_census(entries: DataFrame) -> DataFrame:
    """Entry types with whether the model knows them; unknown ones are counted, never dropped."""
    name = F.coalesce(F.nullif(F.col("etype"), F.lit("")), F.lit("(untyped)"))
    rows = entries.where("v is not null").groupBy(name.alias("etype")).agg(F.count(F.lit(1)).alias("entries"))
    return rows.withColumn("known", F.col("etype").isin(KNOWN_TYPES))
