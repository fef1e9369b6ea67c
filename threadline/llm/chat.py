"""Chat formatting in Spark expressions only.

Turns are collected as structs and sorted, adjacent turns of one role are merged
by an array aggregate, and blocks are concatenated::

    <s>role\\n[INST]text[/INST]text</s><s>role\\n[INST]text</s>

A block lists the texts it merged, so every turn can be read back. Control
strings start with ``<`` or ``[``; inside roles and texts each of these is
followed by an inserted backslash, which no control string has there, so a text
can hold ``</s>`` or ``[INST]`` and comes back as it was.

The loss mask lists (start, length) in code points of every assistant text,
as it stands in the formatted string.

A conversation is one output row, so its turns meet in one row by definition;
nothing larger than a conversation is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions.once import computed_once

#: Turns whose offsets are summed one by one; sums of whole chunks are added to them.
PREFIX_CHUNK = 256
OPEN, BODY, NEXT, CLOSE = "<s>", "\n[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("[\\"), F.lit("[")), F.lit("<\\"), F.lit("<"))


def format_chat(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id``, ``formatted``, ``loss_spans`` (array of start, length) per conversation.

    Turns sort by ``turn``, then role and text (nulls first), so ties and
    repeated rows have one order; every row is a turn. Null role or text is
    empty; rows with a null ``conv_id`` are one conversation. A conversation is one
    output row, so it has to fit a task as a whole; its cost is in proportion to it.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # Every step stands behind a generator, so that an array is made once and only read by the lambdas after it.
    n = F.size("turns")
    role = lambda i: F.get("turns", i)["role"]
    first, last = lambda i: (i == 0) | (role(i) != role(i - 1)), lambda i: (i == n - 1) | (role(i) != role(i + 1))
    head = lambda r: F.concat(F.lit(OPEN), escape(r), F.lit(BODY))

    def part(i):
        said = F.length(escape(F.get("turns", i)["text"]))
        before = F.when(first(i), F.length(head(role(i)))).otherwise(0)
        after = F.when(last(i), len(CLOSE)).otherwise(len(NEXT))
        return F.struct(before.alias("before"), said.alias("length"), (before + said + after).alias("step"), (role(i) == loss_role).alias("learnt"))

    each = F.sequence(F.lit(0), n - 1)
    marked = computed_once(chats, {"starts": F.filter(each, first), "parts": F.transform(each, part)})
    end = lambda j: F.coalesce(F.get("starts", j + 1), n)

    def block(j):
        own = F.slice("turns", F.get("starts", j) + 1, end(j) - F.get("starts", j))
        texts = F.array_join(F.transform(own, lambda t: escape(t["text"])), NEXT)
        return F.concat(head(role(F.get("starts", j))), texts, F.lit(CLOSE))

    chunk = lambda j: F.slice("parts", j * PREFIX_CHUNK + 1, F.lit(PREFIX_CHUNK))
    n_chunks = F.floor((n - 1) / PREFIX_CHUNK).cast("int")
    made = computed_once(
        marked,
        {
            "formatted": F.array_join(F.transform(F.sequence(F.lit(0), F.size("starts") - 1), block), ""),
            "chunks": F.transform(F.sequence(F.lit(0), n_chunks), chunk),
        },
        ["conv_id"],
    )
    # Where a text starts is a prefix sum over the turns: over chunks first, then within each.
    whole = F.transform("chunks", lambda c: F.aggregate(c, F.lit(0), lambda at, p: at + p["step"]))
    begun = F.aggregate(whole, F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))
    placed = computed_once(made, {"begun": begun})
    span = "struct<start:int,length:int>"

    def spans(c, j):
        def next_span(state, p):
            here = F.array(F.struct((state["at"] + p["before"]).alias("start"), p["length"].alias("length")).cast(span))
            return F.struct((state["at"] + p["step"]).alias("at"), F.when(p["learnt"], F.concat(state["spans"], here)).otherwise(state["spans"]).alias("spans"))

        empty = F.struct(F.get("begun", j).alias("at"), F.array().cast(f"array<{span}>").alias("spans"))
        return F.aggregate(c, empty, next_span, lambda s: s["spans"])

    return placed.select("conv_id", "formatted", F.flatten(F.transform("chunks", spans)).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), one per original turn."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")

    def turns(block):
        cut = F.instr(block, BODY)
        role = unescape(F.substring(block, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1))
        body = F.substring(block, cut + len(BODY), F.length(block))
        return F.transform(F.split(body, r"\[/INST\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
