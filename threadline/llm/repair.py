"""Conversation structure repair: cheapest edits by a cost DP, the least audit by prefix-doubling ranks.

A conversation should have the role initials ``(s?(ua)+)?``: at most one system
turn, then user and assistant in turn, ending with the assistant. Faults are
found and edits chosen so that the sum of their costs is least:

    Keep 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or
    assistant turn) 5; a truncated turn that is not deleted costs 5 more. Blank
    and duplicate turns have to be deleted.

The audit is the string of edit initials. Among the cheapest, the ASCII-least
audit is taken: over the graph of (turns read, grammar state) the DP marks the
arcs that lie on cheapest paths; its nodes are ranked by the first 1, 2, 4, ...
letters of their least audit, while their pointers are doubled along. An arc is
chosen by (letter, rank of its target), and the path from the start is read out
through the doubled pointers, in log2(length) steps for all conversations of a
batch at once.

Two passes. The first sends slim rows (no texts) to their conversation, sorted,
and streams them; a task holds whole conversations of about 50,000 rows at a
time. The second streams the texts, sorted behind their audit, and applies the
edits row by row; it holds one audit and one batch. An audit and a digest are
sequential by nature, so a conversation is read by one task, however long, at
some 200 bytes a row in the first pass.

Defined results: null role or text is one space. Rows are taken by turn (null
first), then role, then a hash of role and text. Rows without a conversation id
are one conversation, with a null id. Only the initials s, u and a can be kept;
an empty role has none. No rows: no result. Columns other than the four are not
looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of whole conversations that are worked on at once.
BATCH_ROWS = 50_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar states: nothing read, after system, after user (assistant must follow), after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Edit letters by ASCII; 0 is the end of an audit.
LETTERS = b"\0DIKR"
#: Where a rerole or an insert leads from each state.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Where keeping a row leads, by state and initial (other, s, u, a); -1 is not allowed.
KEPT = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
#: First faults.
SOUND, BLANK, DUPLICATE, CUT = range(4)

_FAR = 1 << 60
_SLIM = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
_SLIM_ARROW = pa.schema([(c, pa.string() if c == "audit" else pa.int64()) for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")])


def _distances(start: np.ndarray, length: np.ndarray, initial: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """The least cost from (conversation, turns read, state) to the end, for all nodes; from the last turn to the first."""
    first = 4 * (start + np.arange(len(start)))  # the node of a conversation's start
    dist = np.full((int(length.sum()) + len(length)) * 4, _FAR, np.int64)
    order = np.argsort(-length, kind="stable")
    longest = int(length.max())
    # At the end an unfinished conversation needs inserts.
    end = first + 4 * length
    for s, cost in ((START, 0), (SYSTEM, 2 * INSERT), (USER, INSERT), (ASSISTANT, 0)):
        dist[end + s] = cost
    active = np.searchsorted(-length[order], -np.arange(1, longest + 1), side="right")
    for back in range(1, longest + 1):
        conv = order[: active[back - 1]]
        row = start[conv] + length[conv] - back
        node = first[conv] + 4 * (length[conv] - back)
        after = dist[node[:, None] + 4 + np.arange(4)]
        own = after + DELETE
        sound = (fault[row] == SOUND) | (fault[row] == CUT)
        more = np.where(fault[row] == CUT, TRUNCATED, 0)
        rerole = after[:, NEXT] + REROLE + more[:, None]
        target = KEPT[:, initial[row]].T
        keep = np.where(target >= 0, np.take_along_axis(after, np.maximum(target, 0), 1) + KEEP + more[:, None], _FAR)
        own = np.where(sound[:, None], np.minimum(own, np.minimum(rerole, keep)), own)
        user, done = own[:, USER], own[:, ASSISTANT]
        best = own.copy()
        best[:, USER] = np.minimum(user, done + INSERT)
        best[:, ASSISTANT] = np.minimum(done, user + INSERT)
        best[:, START] = np.minimum(own[:, START], best[:, USER] + INSERT)
        best[:, SYSTEM] = np.minimum(own[:, SYSTEM], best[:, USER] + INSERT)
        dist[node[:, None] + np.arange(4)] = best
    return dist


def _optimal_arcs(start, length, initial, fault, dist) -> tuple[np.ndarray, np.ndarray]:
    """(target, optimal) of every node by letter: the arcs on cheapest paths; column 0 is the end."""
    nodes = len(dist)
    state = np.arange(nodes) % 4
    step = np.arange(nodes) // 4
    conv = np.repeat(np.arange(len(start)), length + 1)[step]
    row = step - conv
    last = row == (start + length)[conv]
    row = np.where(last, 0, row) if len(initial) else np.zeros(nodes, np.int64)
    kind = initial[row] if len(initial) else np.zeros(nodes, np.int64)
    flaw = np.where(last, SOUND, fault[row]) if len(initial) else np.zeros(nodes, np.int64)
    here = np.arange(nodes)
    after = np.where(last, here, here + 4) - state
    more = np.where(flaw == CUT, TRUNCATED, 0)
    kept = KEPT[state, kind]
    gone = (flaw == BLANK) | (flaw == DUPLICATE)
    target = np.stack([here, after + state, here - state + NEXT[state], after + np.maximum(kept, 0), after + NEXT[state]], 1)
    cost = np.stack([np.zeros(nodes, np.int64), np.full(nodes, DELETE), np.full(nodes, INSERT), KEEP + more, REROLE + more], 1)
    allowed = np.stack([last & (dist == 0), ~last, np.ones(nodes, bool), ~last & ~gone & (kept >= 0), ~last & ~gone], 1)
    allowed[:, 1:] &= ~allowed[:, :1]
    return target, allowed & (cost + dist[target] == dist[:, None])


def _ranks(target: np.ndarray, optimal: np.ndarray) -> np.ndarray:
    """Ranks of the nodes by their whole least audit, found by doubling the letters that are compared.

    The grammar forces the role of a rerole or an insert, so optimal arcs of a
    node differ in their letters and the first pointer is never in doubt.
    """
    letter = optimal.argmax(1)
    jump = target[np.arange(len(target)), letter]
    rank = letter.astype(np.int64)
    while True:
        both = rank * (int(rank.max()) + 1) + rank[jump]
        rank = np.unique(both, return_inverse=True)[1].reshape(-1)
        further = jump[jump]
        if np.array_equal(further, jump):
            return rank
        jump = further


def _audits(start, length, initial, fault) -> tuple[np.ndarray, list[str]]:
    """(cost, audit) of each conversation of a batch."""
    dist = _distances(start, length, initial, fault)
    target, optimal = _optimal_arcs(start, length, initial, fault, dist)
    rank = _ranks(target, optimal)
    # Of the optimal arcs, the least by (letter, rank of what follows).
    order = np.where(optimal, np.arange(5) * (int(rank.max()) + 1) + rank[target], _FAR)
    letter = order.argmin(1)
    jumps = [target[np.arange(len(target)), letter]]
    steps = (letter > 0).astype(np.int64)
    while True:
        steps = steps + steps[jumps[-1]]
        further = jumps[-1][jumps[-1]]
        if np.array_equal(further, jumps[-1]):
            break
        jumps.append(further)
    begin = 4 * (start + np.arange(len(start)))
    size = steps[begin]
    audits = [""] * len(start)
    # Conversations of similar length are read out together: 2^k steps from k doubled pointers.
    width = np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)
    codes = np.frombuffer(LETTERS, np.uint8)
    for k in np.unique(width).tolist():
        chosen = np.flatnonzero(width == k)
        path = begin[chosen][:, None]
        for level in reversed(range(k)):
            jump = jumps[min(level, len(jumps) - 1)]
            path = np.stack([path, jump[path]], 2).reshape(len(chosen), -1)
        # Every other entry of a level lies 2^level steps after the one before.
        text = codes[letter[path]].tobytes()
        for i, c in enumerate(chosen.tolist()):
            audits[c] = text[i << k : (i << k) + int(size[c])].decode()
    return dist[begin], audits


def _faults(conv: np.ndarray, key: np.ndarray, blank: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The first fault of each row: blank, duplicate (key seen earlier in its conversation), truncated."""
    order = np.lexsort((np.arange(len(conv)), key[:, 1], key[:, 0], conv))
    again = np.zeros(len(conv), bool)
    if len(conv) > 1:
        a, b = order[1:], order[:-1]
        again[a] = (conv[a] == conv[b]) & (key[a] == key[b]).all(1)
    return np.select([blank, again, cut], [BLANK, DUPLICATE, CUT], SOUND)


def _measure(rows: pa.Table) -> pa.RecordBatch:
    """All of the first pass for whole conversations, sorted."""
    rows = rows.combine_chunks()
    n = rows.num_rows
    known, ids = rows["conv_id"].is_valid().to_numpy(), rows["conv_id"].fill_null(0).to_numpy()
    timed, turn = rows["turn"].is_valid().to_numpy(), rows["turn"].fill_null(0).to_numpy()
    initial = rows["initial"].to_numpy().astype(np.int64)
    key = np.frombuffer(b"".join(rows["key"].to_pylist()), np.int64).reshape(n, 2)
    new = np.ones(n, bool)
    new[1:] = (ids[1:] != ids[:-1]) | (known[1:] != known[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, n))
    conv = np.cumsum(new) - 1
    fault = _faults(conv, key, rows["blank"].to_numpy(zero_copy_only=False), rows["cut"].to_numpy(zero_copy_only=False))
    count = lambda flags: np.add.reduceat(flags.astype(np.int64), start)
    untimed = count(~timed)
    other = timed.copy()
    other[1:] &= new[1:] | ~timed[:-1] | (turn[1:] != turn[:-1])
    least = turn[np.minimum(start + untimed, n - 1)]
    gaps = np.where(untimed < length, turn[start + length - 1] - least + 1 - count(other), 0)
    pair = np.zeros(n, np.int64)
    pair[1:] = 4 * initial[:-1] + initial[1:]
    legal = np.isin(pair, [4 * 1 + 2, 4 * 2 + 3, 4 * 3 + 2])
    cost, audits = _audits(start, length, initial, fault)
    faults = [count(fault == f) for f in (BLANK, DUPLICATE, CUT)]
    names = pa.array(ids[start], mask=~known[start])
    numbers = [gaps, *faults, count(~new & ~legal), cost]
    return pa.RecordBatch.from_arrays([names, *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(audits)], schema=_SLIM_ARROW)


def _stream(batches):
    """Whole conversations, about BATCH_ROWS rows at a time; the last, maybe unfinished one waits."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < BATCH_ROWS:
            continue
        rows = pa.Table.from_batches(held)
        ids = rows["conv_id"]
        final = ids[-1].as_py()
        same = ids.is_null() if final is None else pc.equal(ids, final).fill_null(False)
        whole = rows.num_rows - pc.sum(same).as_py()
        if whole:
            yield _measure(rows.slice(0, whole))
            rows = rows.slice(whole)
        # One table again, so that a long conversation is not copied for every batch that belongs to it.
        held, size = rows.to_batches(), rows.num_rows if whole else 0
    if held:
        yield _measure(pa.Table.from_batches(held))


def _slim(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    first = F.substring(role, 1, 1)
    end = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("key"),
        F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0).alias("initial"),
        (end == "").alias("blank"),
        (~end.isin(".", "!", "?")).alias("cut"),
        text.alias("text"),
    )


def audits(rows: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit).

    ``gaps`` counts turn numbers missing between the first and the last turn,
    ``blank``, ``duplicate`` and ``truncated`` rows by their first fault,
    ``illegal`` neighbouring rows whose role initials are not su, ua or au.
    """
    slim = _slim(rows).drop("text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "key")
    return slim.select("conv_id", "turn", "key", "initial", "blank", "cut").mapInArrow(_stream, _SLIM)


def _apply(batches):
    """Edited rows of sorted (audit, then its rows): a row at a time, so a conversation of any length passes through."""
    schema = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    names = {USER: "user", ASSISTANT: "assistant"}
    conv, audit, at, pos, state, out = None, "", 0, 0, START, []

    def put(edit: str, role: str | None, text: str) -> None:
        nonlocal at, pos, state
        state = int(NEXT[state]) if role is None else {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        out.append((conv, pos, edit, names[state] if role is None else role, text))
        at, pos = at + 1, pos + 1

    def inserts() -> None:
        while audit[at : at + 1] == "I":
            put("I", None, "")

    def batch_of() -> pa.RecordBatch:
        done = pa.RecordBatch.from_pydict({f.name: [o[i] for o in out] for i, f in enumerate(schema)}, schema=schema)
        out.clear()
        return done

    for batch in batches:
        for c, role, text, new in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text", "audit")), strict=True):
            inserts()
            if new is not None:
                conv, audit, at, pos, state = c, new, 0, 0, START
            elif audit[at] == "D":
                at += 1
            else:
                put(audit[at], None if audit[at] == "R" else role, text)
        yield batch_of()
    inserts()
    yield batch_of()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired turns (conv_id, pos, edit, role, text) by ``audits``; each conversation in order within a partition."""
    slim = _slim(rows).select("conv_id", "turn", "role", "key", "text", F.lit(None).cast("string").alias("audit"), F.lit(True).alias("row"))
    heads = found.select(
        "conv_id",
        F.lit(None).cast("bigint").alias("turn"),
        F.lit("").alias("role"),
        F.lit(None).cast("binary").alias("key"),
        F.lit("").alias("text"),
        "audit",
        F.lit(False).alias("row"),
    )
    merged = slim.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "row", "turn", "role", "key")
    return merged.select("conv_id", "role", "text", "audit").mapInArrow(_apply, "conv_id bigint, pos bigint, edit string, role string, text string")


def _digest(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv, running = None, None
    for batch in batches:
        done = []
        for c, pos, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "pos", "role", "text")), strict=True):
            if pos == 0:
                if running is not None:
                    done.append((conv, running.hexdigest()))
                conv, running = c, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pydict({"conv_id": [d[0] for d in done], "repaired_sha256": [d[1] for d in done]}, schema=schema)
    if running is not None:
        yield pa.RecordBatch.from_pydict({"conv_id": [conv], "repaired_sha256": [running.hexdigest()]}, schema=schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired`` turns, ``role:text`` joined by line feeds, in the order they stream."""
    return turns.mapInArrow(_digest, "conv_id bigint, repaired_sha256 string")
