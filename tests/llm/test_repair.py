"""Structure repair against a search over all edit strings, and its repaired turns against the grammar."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from threadline.llm import queries, repair

ROWS = "conv_id bigint, turn bigint, role string, text string"


def _plain_faults(rows: list) -> list:
    seen, out = set(), []
    for role, text in rows:
        tail = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "" if tail in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _search(rows: list) -> tuple:
    """Cheapest (cost, audit, repaired turns) by Dijkstra over (cost, audit) with the grammar as a regular expression's states."""
    import heapq

    faults = _plain_faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in done:
            continue
        done.add((i, last))
        expected = "a" if last == "u" else "u"
        full = {"u": "user", "a": "assistant"}[expected]
        heapq.heappush(heap, (cost + 5, audit + "I", i, expected, (*out, f"{full}:")))
        if i == len(rows):
            continue
        role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
        if faults[i] in ("blank", "duplicate"):
            continue
        more = 5 if faults[i] == "truncated" else 0
        heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, expected, (*out, f"{full}:{text}")))
        initial = role[:1]
        if initial == expected or (initial == "s" and last == "" and not out):
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, initial, (*out, f"{role}:{text}")))
    raise AssertionError("no way to the end")


def _random_rows(rng: random.Random, n: int) -> list:
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "annotator"]
    texts = ["yes.", "no!", "cut off", " \n", "", "why?", "é.", "x. \t"]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"line {rng.random()}.") for _ in range(n)]


def _frame(spark, convs: dict):
    return spark.createDataFrame([(c, t, *row) for c, rows in convs.items() for t, row in enumerate(rows)], ROWS)


def test_repairs_equal_a_search(spark):
    rng = random.Random(3)
    convs = {c: _random_rows(rng, rng.randint(1, 14)) for c in range(400)}
    # Ties of a turn go by role, then by a hash; turns are different here.
    rows = _frame(spark, convs)
    found = repair.audits(rows)
    turns = repair.repaired(rows, found)
    sums = {r["conv_id"]: r["repaired_sha256"] for r in repair.digests(turns).collect()}
    texts = {}
    for r in turns.collect():
        texts.setdefault(r["conv_id"], []).append((r["pos"], r["role"], r["text"], r["edit"]))
    for r in found.collect():
        c = r["conv_id"]
        cost, audit, out = _search(convs[c])
        assert (r["cost"], r["audit"]) == (cost, audit), convs[c]
        assert [f"{role}:{text}" for _, role, text, _ in sorted(texts.get(c, []))] == list(out)
        assert [e for *_, e in sorted(texts.get(c, []))] == [x for x in audit if x != "D"]
        assert sums.get(c, hashlib.sha256(b"").hexdigest()) == hashlib.sha256("\n".join(out).encode()).hexdigest()
        faults = _plain_faults(convs[c])
        assert [r[f] for f in ("blank", "duplicate", "truncated")] == [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        initials = [role[:1] for role, _ in convs[c]]
        assert r["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        assert re.fullmatch("(s?(ua)+)?", "".join(t.split(":")[0][:1] for t in out))


@pytest.mark.parametrize("batch_rows", [1, 7])
def test_batches_end_between_conversations(monkeypatch, batch_rows):
    import pyarrow as pa

    rng = random.Random(8)
    lengths = [1, 9, 3, 30, 2, 2, 12]
    ids = [c for c, n in enumerate(lengths) for _ in range(n)]
    n = len(ids)
    keys = [rng.randbytes(16) if rng.random() < 0.7 else b"k" * 16 for _ in ids]
    columns = {"conv_id": [None if c == 0 else c for c in ids], "turn": [None if rng.random() < 0.1 else k for k in range(n)], "key": keys}
    columns |= {"initial": [rng.randrange(4) for _ in ids], "blank": [rng.random() < 0.1 for _ in ids], "cut": [rng.random() < 0.2 for _ in ids]}
    types = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.bool_()]
    whole = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], names=list(columns))
    at_once = [r for b in repair._stream([whole]) for r in b.to_pylist()]
    monkeypatch.setattr(repair, "BATCH_ROWS", batch_rows)
    pieces = [whole.slice(k, 4) for k in range(0, n, 4)]
    assert [r for b in repair._stream(pieces) for r in b.to_pylist()] == at_once
    assert len(at_once) == len(lengths)


def test_ranks_order_whole_audits():
    rng = random.Random(11)
    length = np.array([5, 1, 17, 8])
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    n = int(length.sum())
    initial, fault = (np.array([rng.randrange(4) for _ in range(n)]) for _ in range(2))
    dist = repair._distances(start, length, initial, fault)
    target, optimal = repair._optimal_arcs(start, length, initial, fault, dist)
    rank = repair._ranks(target, optimal)

    def audit(v: int) -> str:
        out = ""
        while not optimal[v, 0]:
            letter = int(optimal[v].argmax())
            out += "\0DIKR"[letter]
            v = int(target[v, letter])
        return out

    names = [audit(v) for v in range(len(dist))]
    for a, b in itertools.pairwise(sorted(range(len(names)), key=lambda v: rank[v])):
        assert names[a] <= names[b] and (names[a] == names[b]) == (rank[a] == rank[b])


def test_odd_rows(spark):
    long = "word " * 60_000
    rows = [
        (1, None, "user", "first."), (1, 2, "assistant", long + "."), (1, 2, "assistant", long + "."), (1, 9, None, None),
        (None, None, None, None), (2, 5, "user", "Alone?"), (3, 1, "", "none."), (4, 1, "system", "only."),
    ]
    odd = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS + ", audit string, initial int")
    found = {r["conv_id"]: r for r in repair.audits(odd).collect()}
    one = found[1]
    assert (one["gaps"], one["blank"], one["duplicate"], one["audit"], one["cost"]) == (6, 1, 1, "KKDD", 4)
    assert (found[None]["gaps"], found[None]["blank"], found[None]["audit"]) == (0, 1, "D")
    assert (found[2]["audit"], found[3]["audit"], found[4]["audit"]) == ("D", "D", "D")
    assert repair.audits(odd.limit(0)).count() == 0 and repair.repaired(odd.limit(0), repair.audits(odd.limit(0))).count() == 0


def test_a_long_conversation(spark):
    n = 20_000
    rows = [("user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(n)]
    rows[77] = ("user", "turn 77.")
    got = repair.audits(_frame(spark, {5: rows})).first()
    assert got["audit"] == "K" * 77 + "R" + "K" * (n - 78) and got["cost"] == 1


def test_damage_keeps_every_conversation(spark):
    rows = spark.createDataFrame([(c, t, "user", "said.") for c in (*range(60), None) for t in (0, None)], ROWS)
    got = queries.damaged(rows).collect()
    assert {r["kind"] for r in rows.selectExpr("crc32(concat_ws(':', coalesce(cast(conv_id as string), ' '), coalesce(cast(turn as string), ' '))) % 20 as kind").collect()} >= {0, 1, 2, 3, 4}
    assert {r["text"] for r in got} == {"", "said", "said."}
