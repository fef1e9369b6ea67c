"""The conversation trie against a plain dictionary of prefixes, with shards small enough that prefixes are cut."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from threadline.llm import prefix_trie as P
from threadline.llm import queries

ROWS = "conv_id bigint, turn bigint, role string, text string"


def _plain(convs: dict) -> set:
    members = {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), set()).add(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[k] for k in below)
    out = set()
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in who if len(convs[c]) == len(node)))
        up = min(members[node[:-1]]) if node else None
        out.add((min(who), len(node), up, len(who), len(kids.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _got(nodes) -> list:
    return [tuple(r) for r in nodes.drop("turn_key").collect()]


def _rows(convs: dict) -> list:
    return [(c, t, role, text) for c, path in convs.items() for t, (role, text) in enumerate(path)]


def _random_convs(seed: int, n: int = 160) -> dict:
    rng = random.Random(seed)
    said = [("user", w) for w in ("hi", "höi", "", "go on")] + [("assistant", "yes"), ("", "hi")]
    convs = {}
    for c in range(-20, n):
        # A third starts alike for nine turns, a tenth is one conversation, the rest is short.
        if c % 3 == 0:
            convs[c] = [("user", "the same")] * 9 + rng.choices(said, k=rng.randint(0, 4))
        elif c % 10 == 1:
            convs[c] = [("system", "copy"), ("user", "copy")]
        else:
            convs[c] = rng.choices(said, k=rng.randint(1, 12))
    return convs


@pytest.mark.parametrize("shard_turns", [4, 60, P.SHARD_TURNS])
def test_nodes_equal_a_plain_trie(spark, shard_turns):
    convs = _random_convs(shard_turns)
    got = _got(P.conversation_trie(spark.createDataFrame(_rows(convs), ROWS), shard_turns))
    assert len(got) == len(set(got))
    assert set(got) == _plain(convs)


def test_turnless_members_end_at_the_root(spark):
    key = F.expr("unhex('00112233445566778899aabbccddeeff')")
    one = F.array(F.struct(key.alias("key"), F.lit(5).alias("size")))
    turns = spark.range(4).select(F.col("id").alias("conv_id"), F.when(F.col("id") < 2, one).otherwise(F.slice(one, 1, 0)).alias("turns"))
    got = {(r["conv_id"], r["depth"]): r for r in P.prefix_trie(turns).collect()}
    assert set(got) == {(0, 0), (0, 1)}
    root, top = got[(0, 0)], got[(0, 1)]
    assert (root["n_convs"], root["n_children"], root["n_leaves"], root["saved_tokens"], root["turn_key"]) == (4, 1, 1, 5, None)
    assert root["ends_sha256"] == hashlib.sha256(b"2,3").hexdigest() and top["ends_sha256"] == hashlib.sha256(b"0,1").hexdigest()
    assert bytes(top["turn_key"]).hex() == "00112233445566778899aabbccddeeff"


def test_odd_rows(spark):
    long = "é" * 200_000
    rows = [
        (1, None, None, "first"), (1, 0, "user", None), (1, 0, "user", None),
        (2, None, "", "first"), (2, 0, "user", ""), (2, 3, "user", long),
        (None, 0, "user", "of nobody"), (9_000_000_000, 1, "user", "far"),
    ]
    odd = spark.createDataFrame([(*r, "x", 1, None) for r in rows], ROWS + ", node string, cut int, path string")
    convs = {1: [("", "first"), ("user", ""), ("user", "")], 2: [("", "first"), ("user", ""), ("user", long)], 9_000_000_000: [("user", "far")]}
    assert set(_got(P.conversation_trie(odd))) == _plain(convs)
    assert P.conversation_trie(odd.limit(0)).count() == 0


def test_a_path_with_many_members_is_hashed_in_parts(spark):
    n = 3 * 4096 + 7
    rows = spark.range(n).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    top = P.conversation_trie(rows).where("depth = 1").first()
    assert top["ends_sha256"] == hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()
    assert (top["n_convs"], top["saved_tokens"]) == (n, (n - 1) * 4)


def test_double_array_walks_to_every_prefix():
    rng = random.Random(5)
    keys = [bytes([k]) * P.KEY for k in range(40)]
    paths = sorted({b"".join(rng.choices(keys, k=rng.randint(0, 6))) for _ in range(500)})
    base, check, ids, names = P.pack(paths)
    reached = {0}
    for path in paths:
        s = 0
        for i in range(0, len(path), P.KEY):
            t = base[s] + ids[path[i : i + P.KEY]]
            assert check[t] == s
            s = t
            reached.add(s)
    prefixes = {p[: i * P.KEY] for p in paths for i in range(len(p) // P.KEY + 1)}
    assert len(reached) == len(prefixes) == len(names) == sum(c != -1 for c in check)


def test_rebuilt_conversations_take_their_base(spark):
    import zlib

    convs = {c: [("user", f"{c}-{t}") for t in range(1 + c % 4)] for c in [*range(-6, 40), 52, 53]}
    got = {r["conv_id"]: [bytes(t["key"]) for t in r["turns"]] for r in queries.rebuilt_paths(spark.createDataFrame(_rows(convs), ROWS)).collect()}
    key = lambda turn: hashlib.sha256(f"{len(turn[0])}:{turn[0]}{turn[1]}".encode()).digest()[: P.KEY]
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = convs.get(c - int(c - 5 * int(c / 5)), [])
        assert got[c] == [key(t) for t in base[:h] + own[h:]]
