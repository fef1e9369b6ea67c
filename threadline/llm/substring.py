"""Substring dedup with prefix-partitioned suffix trees.

A window of ``WINDOW`` words that also starts earlier in the corpus is a node
at that depth of the suffix tree with an earlier leaf. Only the part of the
tree above that depth is needed, and only of suffixes that can repeat:

1. Sampled prefixes. Every window has one anchor, its smallest-hashed sequence
   of ``PREFIX`` words; equal windows have equal anchors. About one position in
   seven is an anchor. A task sends each distinct anchor once (with one place),
   packed by bucket; anchors that come from two places anywhere are repeats.
2. Suffixes. Texts meet their repeated anchors, and a task sends for each the
   words around it, which hold all windows with that anchor. The group key is
   the anchor: a prefix of ``PREFIX`` words. An anchor that makes up at least
   ``HEAVY`` of all anchors would make a group too large for a task, so its
   windows travel one by one under a prefix of all their words. A task sends
   equal surroundings once and marks its later copies itself, so a passage that
   a third of all documents share arrives as one row per task.
3. Subtrees. A task takes whole groups up to a fixed size in memory, numbers
   the nodes at depth 1, 2, 4, 8, 16 by the actual words and joins them to the
   nodes at window depth. In every deep node with two leaves or more, all but
   the first leaf are repeats.
4. Words covered by a repeated window go.

Hashes only route and sieve; equality is decided on words.

Defined results: null or empty texts have no words. A null id is the smallest.
Rows equal in id and text are one document and share the result. Of rows with
one id and different texts a shared passage stays in one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.frames import bare_id, keyed
from threadline.llm.scan import SPACED, chunks, ints, mix, scan, words_of
from threadline.runtime import new_run_dir, stage

WINDOW = 20
PREFIX = 8
#: Share of all anchors from which one is heavy; there are at most 1 / HEAVY such.
HEAVY = 1e-5
#: Anchors a task holds before it sends them, bytes of suffixes it takes at once.
HELD = 1 << 21
GROUP_BYTES = 1 << 23

_PLACES = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary()), ("ids", pa.binary()), ("at", pa.binary())])
_PLACES_DDL = "bucket int, known boolean, keys binary, counts binary, ids binary, at binary"


def anchored(words, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, word where its anchor starts, anchor hash per word)."""
    n, span = len(words.doc) - window + 1, window - prefix + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.view(np.uint64)
    at, grams = words.grams(words.hashes(), prefix)
    value = np.full(len(words.doc) - prefix + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    value[at] = mix(grams)
    lowest = np.lib.stride_tricks.sliding_window_view(value, span).argmin(axis=1)
    first = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
    return first, first + lowest[first], value


def _packed(keys, ids, at, buckets: int):
    """One row per bucket of distinct keys; further places of a key go on unasked."""
    order = np.argsort(keys, kind="stable")
    keys, ids, at = keys[order], ids[order], at[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[begin, len(keys)]).astype(np.int32)
    out = {name: [] for name in _PLACES.names}

    def put(bucket, known, k, c, i, a):
        for name, value in zip(_PLACES.names, (bucket, known, k.tobytes(), c.tobytes(), i.tobytes(), a.tobytes()), strict=True):
            out[name].append(value)

    bucket = (keys[begin] % np.uint64(buckets)).astype(np.int32)
    # By bucket, then by document, so that ids of a row ascend and compress.
    by = np.lexsort((at[begin], ids[begin], bucket))
    cuts = np.flatnonzero(np.r_[True, np.diff(bucket[by]) != 0])
    for low, high in zip(cuts, np.r_[cuts[1:], len(by)], strict=True):
        own = begin[by[low:high]]
        put(int(bucket[by[low]]), False, keys[own], size[by[low:high]], ids[own], at[own])
    more = np.ones(len(keys), dtype=bool)
    more[begin] = False
    rest_ids, rest_at = ids[more], at[more]
    none = np.zeros(0, dtype=np.int32)
    for low in range(0, len(rest_ids), 4096):
        own = slice(low, low + 4096)
        put(int(abs(hash((int(rest_ids[low]), low))) % buckets), True, none, none, rest_ids[own], rest_at[own])
    return pa.RecordBatch.from_pydict(out, schema=_PLACES)


def _anchors(window: int, prefix: int, buckets: int):
    def run(batches):
        held, size = [], 0
        for rows, words in scan(batches, "_text", SPACED):
            _, anchor, value = anchored(words, window, prefix)
            if not len(anchor):
                continue
            # Anchors ascend with their windows.
            anchor = anchor[np.r_[True, anchor[1:] != anchor[:-1]]]
            held.append((value[anchor], ints(rows, "_id")[words.doc[anchor]], words.ordinal()[anchor].astype(np.int32)))
            size += len(anchor)
            if size >= HELD:
                yield _packed(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)
                held, size = [], 0
        if size:
            yield _packed(*(np.concatenate(x) for x in zip(*held, strict=True)), buckets)

    return run


#: Rows of step 1: a repeated place, or (id null) a key with its total, or (both null) the number of anchors seen.
_REPEATS = ["_id", "pos", "key", "total"]


def _repeats(batches):
    def rows(ids=None, pos=None, key=None, total=None):
        n = max(len(x) for x in (ids, pos, key, total) if x is not None)
        cell = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array(x, type=kind)
        return pa.RecordBatch.from_arrays([cell(ids, pa.int64()), cell(pos, pa.int32()), cell(key, pa.int64()), cell(total, pa.int64())], _REPEATS)

    def settled(parts):
        keys, counts, ids, at = (np.concatenate([np.frombuffer(p[i], dtype=t) for p in parts]) for i, t in enumerate((np.uint64, np.int32, np.int64, np.int32)))
        order = np.argsort(keys, kind="stable")
        keys, counts, ids, at = keys[order], counts[order].astype(np.int64), ids[order], at[order]
        begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        totals = np.add.reduceat(counts, begin)
        twice = np.repeat(totals > 1, np.diff(np.r_[begin, len(keys)]))
        yield rows(ids[twice], at[twice])
        # A key under this many places is never heavy enough to matter for a task.
        large = totals >= 1024
        yield rows(key=keys[begin][large].view(np.int64), total=totals[large])
        yield rows(total=[int(totals.sum())])

    bucket, parts = None, []
    for batch in batches:
        for b, known, *cells in zip(*(batch.column(n).to_pylist() for n in _PLACES.names), strict=True):
            if known:
                yield rows(np.frombuffer(cells[2], dtype=np.int64), np.frombuffer(cells[3], dtype=np.int32))
                continue
            if b != bucket and parts:
                yield from settled(parts)
                parts = []
            bucket = b
            parts.append(cells)
    if parts:
        yield from settled(parts)


_SUFFIXES = pa.schema([("key", pa.int64()), ("_id", pa.int64()), ("_h", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("around", pa.binary())])
_SUFFIXES_DDL = "key bigint, _id bigint, _h bigint, first int, last int, around binary"


def _suffixes(window: int, prefix: int, heavy: np.ndarray):
    """Rows to the groups; a row without ``around`` is a range of windows already known to repeat.

    The texts of a task come in the order of their ids, so the first of equal
    surroundings is the earliest of the task.
    """

    def run(batches):
        seen, held = set(), 0
        current, marks = None, set()
        for rows, data, offsets in chunks(batches, "_text"):
            words = words_of(data, offsets, SPACED)
            first, anchor, value = anchored(words, window, prefix)
            ids, hs = ints(rows, "_id"), ints(rows, "_h")
            # Rows of an id are neighbours; one equal to an earlier row is skipped.
            fresh = np.ones(len(ids), dtype=bool)
            for i, (x, h) in enumerate(zip(ids.tolist(), hs.tolist(), strict=True)):
                if x != current:
                    current, marks = x, set()
                fresh[i] = h not in marks
                marks.add(h)
            if not len(first):
                continue
            column = rows.column("places")
            lengths = np.diff(column.offsets.to_numpy())
            place = column.flatten().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(ids)), lengths)
            inside = place < words.counts[doc]
            repeated = np.zeros(len(words.doc), dtype=bool)
            repeated[words.first[doc[inside]] + place[inside]] = True
            use = repeated[anchor] & fresh[words.doc[first]]
            first, anchor = first[use], anchor[use]
            if not len(first):
                continue
            key = value[anchor]
            # Windows of one anchor are neighbours; those of a heavy one stand alone.
            alone = np.isin(key, heavy)
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)] | alone
            begin = np.flatnonzero(new)
            stop = np.r_[begin[1:], len(first)] - 1
            low, high = first[begin], first[stop]
            key = key[begin]
            if alone.any():
                single = np.flatnonzero(alone[begin])
                at, grams = words.grams(words.hashes(), window)
                key[single] = mix(grams[np.searchsorted(at, low[single])] ^ np.uint64(window))
            flat = data.tobytes()
            ordinal = words.ordinal()
            spans = zip(words.start[low].tolist(), words.end[high + window - 1].tolist(), strict=True)
            around = [flat[a:b] for a, b in spans]
            repeat = np.zeros(len(around), dtype=bool)
            for i, text in enumerate(around):
                if text in seen:
                    repeat[i] = True
                else:
                    seen.add(text)
                    held += len(text)
            if held > 1 << 25:  # combining is only a saving; begin anew before it takes much memory
                seen, held = set(), 0
            start, stop, doc = ordinal[low].astype(np.int32), ordinal[high].astype(np.int32), words.doc[low]
            sent = np.flatnonzero(~repeat)
            if len(sent):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[sent].view(np.int64)),
                        pa.array(ids[doc[sent]]),
                        pa.array(hs[doc[sent]]),
                        pa.array(start[sent]),
                        pa.array(stop[sent]),
                        pa.array([around[i] for i in sent.tolist()], type=pa.binary()),
                    ],
                    schema=_SUFFIXES,
                )
            again = np.flatnonzero(repeat)
            if len(again):
                # Ranges that go on in each other are one; they travel by document, for no group waits for them.
                new = np.r_[True, (doc[again[1:]] != doc[again[:-1]]) | (start[again[1:]] != stop[again[:-1]] + 1)]
                begin = np.flatnonzero(new)
                end = np.r_[begin[1:], len(again)] - 1
                a, b = again[begin], again[end]
                route = mix(ids[doc[a]].view(np.uint64) ^ mix(start[a].astype(np.uint64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(route.view(np.int64)),
                        pa.array(ids[doc[a]]),
                        pa.array(hs[doc[a]]),
                        pa.array(start[a]),
                        pa.array(stop[b]),
                        pa.nulls(len(a), pa.binary()),
                    ],
                    schema=_SUFFIXES,
                )

    return run


def later_leaves(around: list[bytes], ids, hs, first, last, window: int):
    """(row, window start) of every window that has an earlier equal one; all windows of the rows form the subtree.

    Rows of one document may come from several tasks: one place is one leaf, however often it was sent.
    """
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in around])])
    flat = b"".join(around)
    words = words_of(np.frombuffer(flat, dtype=np.uint8), offsets, SPACED)
    numbers: dict[bytes, int] = {}
    spans = zip(words.start.tolist(), words.end.tolist(), strict=True)
    node = np.array([numbers.setdefault(flat[a:b], len(numbers)) for a, b in spans], dtype=np.int64)
    size = (last - first + 1).astype(np.int64)
    row = np.repeat(np.arange(len(around)), size)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    at = words.first[row] + inner
    start = first[row] + inner

    def joined(a, b):
        return pd.factorize(a * (int(b.max()) + 1) + b)[0].astype(np.int64)

    # Node of the next 1, 2, 4, ... words at every word; a window never leaves its row.
    depth, nodes = 1, {1: node}
    while 2 * depth <= window:
        nodes[2 * depth] = joined(nodes[depth][:-depth], nodes[depth][depth:])
        depth *= 2
    deep, reach = nodes[depth][at], depth
    while reach < window:
        step = max(d for d in nodes if reach + d <= window)
        deep = joined(deep, nodes[step][at + reach])
        reach += step
    order = np.lexsort((start, hs[row], ids[row], deep))
    sorted_deep = deep[order]
    opens = np.r_[True, sorted_deep[1:] != sorted_deep[:-1]]
    leader = order[np.maximum.accumulate(np.where(opens, np.arange(len(order)), 0))]
    own, first_of = row[order], row[leader]
    same_place = (ids[own] == ids[first_of]) & (hs[own] == hs[first_of]) & (start[order] == start[leader])
    later = np.zeros(len(row), dtype=bool)
    later[order] = ~same_place
    return row, start, later


def _subtrees(window: int):
    names = ["_id", "_h", "first", "last"]

    def run(batches):
        held, size = [], 0

        def grown(final: bool):
            nonlocal held, size
            table = pa.Table.from_batches(held)
            keys = table.column("key").to_numpy()
            # The last group may go on in the next batch.
            cut = len(keys) if final else int(np.searchsorted(keys, keys[-1]))
            held, size = table.slice(cut).to_batches(), 0
            table = table.slice(0, cut)
            if not cut:
                return
            row, start, later = later_leaves(
                table.column("around").to_pylist(), *(table.column(n).to_numpy() for n in names), window
            )
            row, start = row[later], start[later]
            if len(row):
                new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]
                begin = np.flatnonzero(new)
                end = np.r_[begin[1:], len(row)] - 1
                own = row[begin]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(table.column("_id").to_numpy()[own]),
                        pa.array(table.column("_h").to_numpy()[own]),
                        pa.array(start[begin].astype(np.int32)),
                        pa.array(start[end].astype(np.int32)),
                    ],
                    names,
                )

        for batch in batches:
            known = batch.filter(batch.column("around").is_null())
            if known.num_rows:
                yield known.select(names)
            batch = batch.filter(batch.column("around").is_valid())
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= GROUP_BYTES:
                yield from grown(False)
        if held:
            yield from grown(True)

    return run


def _kept(window: int):
    def run(batches):
        for rows, data, offsets in chunks(batches, "_text"):
            words = words_of(data, offsets, SPACED)
            column = rows.column("ranges")
            lengths = np.diff(column.offsets.to_numpy())
            inner = column.flatten()
            doc = np.repeat(np.arange(rows.num_rows), lengths)
            own = inner.field("_h").to_numpy() == ints(rows, "_h")[doc]
            edge = np.zeros(len(words.doc) + 1, dtype=np.int64)
            base = words.first[doc[own]]
            np.add.at(edge, base + inner.field("first").to_numpy()[own], 1)
            np.add.at(edge, base + inner.field("last").to_numpy()[own] + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.bincount(words.doc[gone], minlength=rows.num_rows)
            flat, counts, begins = data.tobytes(), words.counts, words.first
            texts = []
            for i in range(rows.num_rows):
                parts = flat[offsets[i] : offsets[i + 1]].split()
                if removed[i]:
                    away = gone[begins[i] : begins[i] + counts[i]].tolist()
                    parts = [w for w, x in zip(parts, away, strict=True) if not x]
                texts.append(b" ".join(parts).decode())
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(texts, type=pa.string())],
                ["_id", "n_words", "n_removed", "text"],
            )

    return run


def repeated_substrings(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> tuple[DataFrame, DataFrame]:
    """(texts by key, ranges of window starts that repeat by key)."""
    spark = docs.sparkSession
    texts = keyed(docs).select("_id", "_h", "_text")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    places = texts.select("_id", "_text").mapInArrow(_anchors(window, prefix, buckets), _PLACES_DDL)
    dealt = places.repartition("bucket").sortWithinPartitions("bucket")
    found = stage(dealt.mapInArrow(_repeats, "_id bigint, pos int, key bigint, total bigint"), new_run_dir(spark, "anchors"))
    seen = found.where("key is null and total is not null").agg(F.sum("total")).first()[0] or 0
    # At most 1 / HEAVY rows, whatever the input.
    rows = found.where(F.col("key").isNotNull() & (F.col("total") >= HEAVY * seen)).select("key").collect()
    heavy = np.sort(np.array([r["key"] for r in rows], dtype=np.int64).view(np.uint64))
    asked = found.where("pos is not null").groupBy("_id").agg(F.collect_list("pos").alias("places"))
    # No second sort where the join has merged sorted sides; a broadcast join leaves the order of the files.
    by_id = texts.join(asked, "_id").sortWithinPartitions("_id")
    suffixes = by_id.mapInArrow(_suffixes(window, prefix, heavy), _SUFFIXES_DDL)
    grouped = suffixes.repartition("key").sortWithinPartitions("key")
    return texts, grouped.mapInArrow(_subtrees(window), "_id bigint, _h bigint, first int, last int")


def substring_dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed`` and ``text``, the kept words joined by a space.

    A word goes if a window of ``window`` words covers it whose words also start
    earlier: in a smaller id, or in the same text before it.
    """
    texts, ranges = repeated_substrings(docs, window, prefix)
    gathered = ranges.groupBy("_id").agg(F.collect_list(F.struct("_h", "first", "last")).alias("ranges"))
    none = F.array().cast("array<struct<_h:bigint,first:int,last:int>>")
    joined = texts.join(gathered, "_id", "left").withColumn("ranges", F.coalesce("ranges", none))
    done = joined.mapInArrow(_kept(window), "_id bigint, n_words bigint, n_removed bigint, text string")
    return done.select(bare_id(F.col("_id")).alias("doc_id"), "n_words", "n_removed", "text")
