"""Prefix trie of conversations: double arrays per prefix shard, shared upper nodes merged globally.

A conversation is a path of turn keys (128 bits of role and text), 20 bytes a
turn; texts never travel. Equal paths are counted before anything else, so a
conversation that a third of all rows repeat is one path with a weight.

Shards are cut by path prefixes. All paths of a prefix go to one shard while
they have at most ``shard_turns`` turns; heavier prefixes are lengthened (1, 2,
4, ... turns) until they are light, and light ones are dealt to buckets, whose
number follows from the counted turns. Within a bucket the turn keys get dense
ids by first visit, the trie is packed in the two arrays BASE and CHECK, and
every path is walked through them to count its nodes.

A node at least as deep as its prefix is in one bucket only and final there.
Nodes above (the root, and what heavy prefixes share) come from many buckets as
weighted paths and are merged by joins: a node's subtree sums are sums over the
paths through it, if every node counts for one path, the one with its smallest
member, and those nodes are the lower end of that path.

Defined results: null role or text is empty. Rows with the same turn are taken
by role, then by key (a hash of role and text); repeated rows are turns of their
own. Rows without a conversation id belong to no conversation and are left out.
No conversations: no nodes. Columns other than the four are not looked at. A
conversation itself is one record and has to fit a task at 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.llm.frames import maybe_broadcast
from threadline.runtime import new_run_dir, stage

#: Bytes of a turn key.
KEY = 16
#: Turns of distinct paths that one shard may hold.
SHARD_TURNS = 32_768
#: Member ids that are joined to one string at a time.
CHUNK_BITS = 12

_ROOT = bytes(KEY)
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_NODES = pa.schema(
    [
        ("own", pa.bool_()),
        ("node", pa.binary()),
        ("parent", pa.binary()),
        ("turn_key", pa.binary()),
        ("depth", pa.int64()),
        ("size", pa.int64()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("ends_sha256", pa.string()),
    ]
)
_NODES_DDL = (
    "own boolean, node binary, parent binary, turn_key binary, depth bigint, size bigint, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)


def turn_key(role: Column, text: Column) -> Column:
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * KEY))


def keyed_turns(conversations: DataFrame, near: Column | None = None) -> DataFrame:
    """(conv_id, turns): per conversation its turns in order, each a struct (key, size); size is the text's UTF-8 bytes.

    ``near``: an expression over ``conv_id`` by whose values the result is
    partitioned, for callers that go on with neighbouring conversations.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), role.alias("role"), turn_key(role, text).alias("key"), F.octet_length(text).alias("size")).alias("t"),
    )
    by = ["conv_id"]
    if near is not None:
        rows = rows.withColumn("near", near).repartition("near")
        by = ["near", "conv_id"]
    whole = rows.groupBy(*by).agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select(*by, F.transform("t", lambda t: F.struct(t["key"], t["size"])).alias("turns"))


def _fit(check: list, ids: list, state: dict) -> int:
    """A BASE for the children ``ids``: free slots for all of them; a few holes are tried, then the end is taken."""
    free, first = state["free"], ids[0]
    while free < len(check) and check[free] != -1:
        free += 1
    state["free"] = free
    top = max(ids)
    slot = free
    for _ in range(1 if len(ids) == 1 else 16):
        base = slot - first
        if base + min(ids) > 0 and all(base + a >= len(check) or check[base + a] == -1 for a in ids):
            break
        slot += 1
        while slot < len(check) and check[slot] != -1:
            slot += 1
    else:
        base = len(check) - min(ids)
    if base + top >= len(check):
        check.extend([-1] * (base + top + 1 - len(check)))
    return base


def pack(paths: list[bytes]) -> tuple[list[int], list[int], dict[bytes, int], dict[int, bytes]]:
    """(BASE, CHECK, dense ids, path hash of each state) of the trie of different sorted ``paths``.

    State 0 is the root. The child of state s by turn id a is BASE[s] + a where
    CHECK of it is s; CHECK is -1 in free slots.
    """
    base, check, ids, names = [0], [-2], {}, {0: _ROOT}
    state = {"free": 1}
    todo = deque([(0, 0, len(paths), 0)])
    while todo:
        s, low, high, depth = todo.popleft()
        at = depth * KEY
        if low < high and len(paths[low]) == at:
            low += 1
        runs = []
        while low < high:
            key, end = paths[low][at : at + KEY], low + 1
            while end < high and paths[end].startswith(key, at):
                end += 1
            runs.append((ids.setdefault(key, len(ids) + 1), key, low, end))
            low = end
        if not runs:
            continue
        b = _fit(check, [r[0] for r in runs], state)
        base.extend([0] * (len(check) - len(base)))
        base[s] = b
        for a, key, start, end in runs:
            check[b + a] = s
            names[b + a] = hashlib.blake2b(names[s] + key, digest_size=KEY).digest()
            todo.append((b + a, start, end, depth + 1))
    return base, check, ids, names


def _shard(table: pa.Table) -> pa.Table:
    rows = sorted(table.select(["packed", "sizes", "n", "conv_id", "cut", "ends_sha256"]).to_pylist(), key=lambda r: r["packed"])
    base, check, ids, names = pack([r["packed"] for r in rows])
    length = len(check)
    depth, size, n, cut = (np.zeros(length, np.int64) for _ in range(4))
    conv = np.full(length, np.iinfo(np.int64).max)
    # Of upper states: the paths that leave the upper nodes here.
    out_n, out_conv = np.zeros(length, np.int64), np.full(length, np.iinfo(np.int64).max)
    key_of, ends = {0: b""}, {}
    for r in rows:
        s, packed, last = 0, r["packed"], 0
        for d in range(len(r["sizes"]) + 1):
            if d:
                key = packed[(d - 1) * KEY : d * KEY]
                t = base[s] + ids[key]
                if check[t] != s:
                    raise AssertionError("a path left its trie")
                s = t
                depth[s], size[s], key_of[s] = d, r["sizes"][d - 1], key
            n[s] += r["n"]
            conv[s] = min(conv[s], r["conv_id"])
            cut[s] = r["cut"]
            if d < r["cut"]:
                last = s
        ends[s] = r["ends_sha256"]
        out_n[last] += r["n"]
        out_conv[last] = min(out_conv[last], r["conv_id"])
    states = np.array(sorted(names, key=lambda s: depth[s], reverse=True), np.int64)
    own = depth >= cut
    children, leaves, saved = (np.zeros(length, np.int64) for _ in range(3))
    for s in states.tolist():
        if own[s]:
            if not children[s]:
                leaves[s] = 1
            saved[s] += (n[s] - 1) * size[s]
            up = check[s]
            children[up] += 1
            leaves[up] += leaves[s]
            saved[up] += saved[s]
    found = []
    for s in states.tolist():
        up = check[s]
        if own[s]:
            above = int(conv[up]) if own[up] else None
            found.append((True, names[s], names[up], key_of[s], int(depth[s]), int(size[s]), int(conv[s]), above, int(n[s]), int(children[s]), int(leaves[s]), int(saved[s]), ends.get(s)))
        elif out_n[s]:
            # A weighted path: one row per node from here up to the root.
            path, k, total = int(out_conv[s]), int(children[s]), (int(leaves[s]), int(saved[s]))
            t = s
            while t >= 0:
                found.append((False, names[t], names[check[t]] if t else None, key_of[t], int(depth[t]), int(size[t]), path, None, int(out_n[s]), k, *total, ends.get(s) if t == s else None))
                t, k = check[t], 0
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _NODES, strict=True)], schema=_NODES)


def _cuts(paths: DataFrame, shard_turns: int) -> DataFrame:
    """``paths`` with ``cut``, the turns of its shard's prefix, and ``prefix``, a hash of it."""
    prefix = lambda cut: F.sha2(F.substring(F.col("packed"), F.lit(1), cut * KEY), 256)
    paths = paths.withColumn("cut", F.lit(1)).withColumn("prefix", prefix(F.col("cut")))
    cut = 1
    while True:
        weight = paths.where(F.col("cut") == cut).groupBy("prefix").agg(F.sum(F.size("sizes")).alias("turns"), F.count("*").alias("paths"))
        # One path alone cannot be divided by a longer prefix.
        heavy = weight.where((F.col("turns") > shard_turns) & (F.col("paths") > 1)).select("prefix", F.lit(True).alias("heavy"), F.lit(cut).alias("cut"))
        heavy = stage(heavy, new_run_dir(paths.sparkSession, "trie-heavy"))
        if heavy.isEmpty():
            return paths
        longer = paths.join(maybe_broadcast(heavy), ["prefix", "cut"], "left")
        longer = longer.withColumn("cut", F.when(F.col("heavy"), 2 * cut).otherwise(F.col("cut"))).drop("heavy")
        paths = stage(longer.withColumn("prefix", prefix(F.col("cut"))), new_run_dir(paths.sparkSession, "trie-cuts"))
        cut *= 2


def _hash_parts(batches):
    """The parts of a path come one after the other, in order; only a hash state is kept."""
    schema = pa.schema([("path", pa.string()), ("ends_sha256", pa.string())])
    path, running = None, None
    for batch in batches:
        done = []
        for key, part in zip(batch.column("path").to_pylist(), batch.column("part").to_pylist(), strict=True):
            if key != path:
                if path is not None:
                    done.append((path, running.hexdigest()))
                path, running = key, hashlib.sha256(part.encode())
            else:
                running.update(b"," + part.encode())
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "ends_sha256": [d[1] for d in done]}, schema=schema)
    if path is not None:
        yield pa.RecordBatch.from_pydict({"path": [path], "ends_sha256": [running.hexdigest()]}, schema=schema)


def _ends(members: DataFrame) -> DataFrame:
    """(path, ends_sha256): the digest of its conversations' ids, numerically ascending, comma-joined.

    Ids are joined to strings in parallel, up to 4,096 neighbouring ids at a
    time; a digest is sequential, so one task then streams a path's strings.
    """
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    parts = members.groupBy("path", chunk.alias("chunk")).agg(F.sort_array(F.collect_set("conv_id")).alias("ids"))
    parts = parts.select("path", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("part"))
    return parts.repartition("path").sortWithinPartitions("path", "chunk").select("path", "part").mapInArrow(_hash_parts, "path string, ends_sha256 string")


def _merge_upper(found: DataFrame) -> DataFrame:
    """The upper nodes of all buckets, whole: found rows are (weighted path, node)."""
    up = found.where(~F.col("own"))
    nodes = up.groupBy("node").agg(
        F.max("parent").alias("parent"),
        F.max("turn_key").alias("turn_key"),
        F.max("depth").alias("depth"),
        F.max("size").alias("size"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("tops"),
        F.max("ends_sha256").alias("ends_sha256"),
    )
    nodes = stage(nodes, new_run_dir(found.sparkSession, "trie-upper"))
    small = maybe_broadcast(nodes)
    below = nodes.where("parent is not null").groupBy("parent").agg(F.count("*").alias("ups")).withColumnRenamed("parent", "node")
    nodes = nodes.join(below, "node", "left").withColumn("n_children", F.col("tops") + F.coalesce("ups", F.lit(0)))
    above = small.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = stage(nodes.join(above, "parent", "left"), new_run_dir(found.sparkSession, "trie-upper"))
    worth = nodes.select(
        "node",
        F.col("conv_id").alias("owner"),
        (F.col("n_children") == 0).cast("bigint").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("worth"),
    )
    rows = up.select("node", "depth", "conv_id", "n_leaves", "saved_tokens").join(maybe_broadcast(worth), "node")
    mine = F.col("conv_id") == F.col("owner")
    # Down to this node: everything on the path from here on, and what hangs below its end.
    lower = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    rows = rows.select(
        "node",
        (F.col("n_leaves") + F.sum(F.when(mine, F.col("leaf")).otherwise(0)).over(lower)).alias("n_leaves"),
        (F.col("saved_tokens") + F.sum(F.when(mine, F.col("worth")).otherwise(0)).over(lower)).alias("saved_tokens"),
    )
    sums = rows.groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    return nodes.join(sums, "node")


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, turns as of ``keyed_turns``).

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, turn_key): a node is named by its smallest member and its depth,
    ``turn_key`` is the key of its last turn (null at the root). ``n_leaves`` counts
    the childless nodes of its subtree, itself included; ``saved_tokens`` sums
    (members - 1) x bytes of the last text over it.
    """
    spark = turns.sparkSession
    packed = F.unhex(F.array_join(F.transform("turns", lambda t: F.lower(F.hex(t["key"]))), ""))
    members = turns.select("conv_id", packed.alias("packed"), F.col("turns.size").alias("sizes"))
    members = stage(members.withColumn("path", F.sha2("packed", 256)), new_run_dir(spark, "trie-members"))
    paths = members.groupBy("path").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.any_value("packed").alias("packed"), F.any_value("sizes").alias("sizes")
    )
    paths = stage(paths.join(_ends(members), "path"), new_run_dir(spark, "trie-paths"))
    total = paths.agg(F.coalesce(F.sum(F.size("sizes")), F.lit(0))).first()[0]
    buckets = 1 + 2 * total // shard_turns
    dealt = _cuts(paths, shard_turns).withColumn("bucket", F.pmod(F.xxhash64("prefix"), F.lit(buckets)))
    found = stage(dealt.groupBy("bucket").applyInArrow(_shard, _NODES_DDL), new_run_dir(spark, "trie-found"))
    upper = stage(_merge_upper(found), new_run_dir(spark, "trie-merged"))
    above = maybe_broadcast(upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("upper_conv_id")))
    own = found.where("own").join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "upper_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "turn_key"]
    done = own.select(*columns).unionByName(upper.withColumn("turn_key", F.when(F.col("depth") > 0, F.col("turn_key"))).select(*columns))
    return done.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)))


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie of rows (conv_id, turn, role, text) as they are."""
    return prefix_trie(keyed_turns(conversations), shard_turns)
