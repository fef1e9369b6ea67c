"""Cross-entropy difference scores from matched n-gram models.

A background bigram model over all documents and a target model over the
documents marked as target share one vocabulary: every word that occurs twice or
more, the others being one unknown word. Every pair that occurs twice or more has
its own estimate; the others back off to the single word in both models alike. A
document's score is the mean over its words of target loss minus background
loss: the lower, the more it reads like the target.

Both tables are written and grow with the input. Tasks hold their head only, the
words that make up ``HEAD_WORDS`` of all words and the pairs that make up
``HEAD_PAIRS``, at most 1 / share rows each. A document's words and
pairs beyond the head meet the rest of the tables in a shuffle, packed by slice of the
key space; no key of it is hotter than the head's share. A word that occurs once is read from one row of the
counts, which keeps its neighbours, so pairs with the unknown word need no
further pass over the texts.

Losses are sums: a document has the unknown word's loss for each word beyond the
head, and a row of the tables has what it changes in that sum.

Defined results: words are case folded for A-Z. A text without words has no
score (null). With no target documents the target model is uniform. Several
marks for one id count once; null ids are never marked.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.llm.frames import bare_id, fits_broadcast, keyed
from threadline.llm.scan import SPACED, Words, ints, mix, scan, signed
from threadline.runtime import discard, new_run_dir, stage, stage_alone

#: Share of all words below which a word that occurs twice is unknown, and a pair backs off: none.
WORD_SHARE = 0.0
PAIR_SHARE = 0.0
#: Shares that make up the head, which every task holds.
HEAD_WORDS = 1e-5
HEAD_PAIRS = 1e-6
#: Weight of the pair estimate against the single word.
LAMBDA = 0.7
#: Distinct counts a task holds before it sends them.
HELD = 1 << 19
#: Pairs of one slice that a task counts, and words and pairs of one slice that it looks up.
PAIRS_HELD, KEYS_HELD = 1 << 20, 1 << 22
#: The texts are scored in so many shares, one after the other, each of at least so many words.
SHARES, SHARE_WORDS = 4, 8_000_000
#: Bits of the filter of keys that are in the tables, and of one block of it; the filter never grows.
FILTER_BITS, BLOCK_BITS = 27, 16


def _summed(keys: np.ndarray, counts: np.ndarray, target: np.ndarray, *more: np.ndarray):
    """Sums per key; of ``more`` the first value."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[begin], np.add.reduceat(counts[order], begin), np.add.reduceat(target[order], begin), *(x[order[begin]] for x in more)


def _pair_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + mix(after))


def _held(events):
    """``events`` yields keys, rows and what else a word or pair has; these are sums of them, as many as a task holds at once."""

    def run(batches):
        parts, size = [], 0
        for rows, words in scan(batches, "_text", SPACED, lower=True):
            keys, doc, *more = events(rows, words)
            if not len(keys):
                continue
            target = ints(rows, "target").astype(np.int64)[doc]
            parts.append(_summed(keys, np.ones(len(keys), dtype=np.int64), target, *more))
            size += len(parts[-1][0])
            if size >= HELD:
                merged = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts, size = [merged], len(merged[0])
                if size >= HELD // 2:
                    yield merged
                    parts, size = [], 0
        if parts:
            yield _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return run


def _counted(events, names: tuple[str, ...]):
    """Batches of (key, n, n_target, *names), combined in the task; ``names`` are null where it counts more than one."""

    def run(batches):
        for keys, n, t, *more in _held(events)(batches):
            arrays = [pa.array(signed(keys)), pa.array(n), pa.array(t), *(pa.array(signed(x), mask=n > 1) for x in more)]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "n", "n_target", *names])

    return run


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    """The slice of the key space, of ``parts`` equal ones, that a key lies in."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _slices(part: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    return list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))


def _sliced(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row per slice, its columns packed; rows come in the order of ``part``."""
    cuts = _slices(part)
    packed = [pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary()) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in cuts], pa.int64()), *packed], ["part", *columns])


def _unpacked(rows: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in rows.column(name).to_pylist() if x is not None), dtype=kind)


_PAIRS = {"before": np.uint64, "after": np.uint64, "n": np.int32, "n_target": np.int32}


def _packed_pairs(parts: int):
    """Pairs that a task has counted, a row per slice of the key space: rows of their own would be twice as large."""

    def run(batches):
        for keys, n, t, before, after in _held(_pairs)(batches):
            yield _sliced(_part(keys, parts), {"before": before, "after": after, "n": n.astype(np.int32), "n_target": t.astype(np.int32)})

    return run


def _recurring(rows: pa.Table) -> pa.Table:
    """The pairs of one slice that occur twice or more."""
    before, after, n, t = (_unpacked(rows, name, kind) for name, kind in _PAIRS.items())
    keys, n, t, before, after = _summed(_pair_keys(before, after), n.astype(np.int64), t.astype(np.int64), before, after)
    twice = n > 1
    return pa.table({"key": signed(keys[twice]), "before": signed(before[twice]), "after": signed(after[twice]), "n": n[twice], "n_target": t[twice]})


#: Neighbour of a word at the edge of its text.
NOTHING = np.uint64(0)


def _words(rows, words: Words):
    """Every word with its neighbours and its row's key."""
    hashes = words.hashes()
    if not len(hashes):
        return hashes, words.doc
    same = words.doc[1:] == words.doc[:-1]
    before, after = np.full(len(hashes), NOTHING), np.full(len(hashes), NOTHING)
    before[1:][same], after[:-1][same] = hashes[:-1][same], hashes[1:][same]
    return hashes, words.doc, before, after, ints(rows, "_id")[words.doc].view(np.uint64), ints(rows, "_h")[words.doc].view(np.uint64)


def _pairs(rows, words: Words):
    hashes = words.hashes()
    at = np.flatnonzero(words.doc[1:] == words.doc[:-1])
    return _pair_keys(hashes[at], hashes[at + 1]), words.doc[at], hashes[at], hashes[at + 1]


def _cells(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _blocks(batches):
    """(block, bits) of a filter from keys that come block by block."""
    number, bits = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["block", "bits"])
    for batch in batches:
        cells = _cells(ints(batch, "key").view(np.uint64))
        blocks = cells >> BLOCK_BITS
        for cut in np.split(np.arange(len(cells)), np.flatnonzero(blocks[1:] != blocks[:-1]) + 1):
            if not len(cut):
                continue
            if number != int(blocks[cut[0]]):
                if number is not None:
                    yield row()
                number, bits = int(blocks[cut[0]]), np.zeros(1 << BLOCK_BITS, dtype=np.uint8)
            bits[cells[cut] & (1 << BLOCK_BITS) - 1] = 1
    if number is not None:
        yield row()


def _filter(keys: DataFrame) -> np.ndarray:
    """Bits of a fixed size (16 MB) that are set where ``keys`` fall; clear ones spare a row the shuffle."""
    block = F.shiftrightunsigned("key", 64 - FILTER_BITS + BLOCK_BITS)
    dealt = keys.select("key").repartition(block).sortWithinPartitions(block)
    out = np.zeros((1 << FILTER_BITS - BLOCK_BITS, (1 << BLOCK_BITS) // 8), dtype=np.uint8)
    got = dealt.mapInArrow(_blocks, "block bigint, bits binary").toArrow()
    for number, bits in zip(got.column("block").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[number] |= np.frombuffer(bits, dtype=np.uint8)
    return out.ravel()


@dataclass
class Head:
    """Losses (target, background) of the frequent words, what frequent pairs change in them, and a filter of the other keys."""

    words: np.ndarray
    single: np.ndarray
    unknown: np.ndarray
    pairs: np.ndarray
    change: np.ndarray
    more: np.ndarray


@dataclass
class Model:
    """``rest`` has the words and pairs beyond the head, packed by slice of the key space, ``once`` (_id, _h, t, b) of words that occur once."""

    head: Head
    rest: DataFrame
    once: DataFrame
    n_words: int


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted keys, whether it is there) of each wanted key."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


_PARTS_DDL = "part bigint, _id binary, _h binary, n_words binary, t binary, b binary, lengths binary, keys binary"
_PARTS = ["part", "_id", "_h", "n_words", "t", "b", "lengths", "keys"]


def _parts(head: Head, parts: int):
    """Packed rows: the texts of a batch (``n_words`` set) with their losses by the head, and, slice by slice, their words and pairs beyond it.

    ``lengths`` has the number of ``keys`` of each text in the slice; a word that recurs in a text stands there as often.
    """

    def run(batches):
        for at_batch, (rows, words) in enumerate(scan(batches, "_text", SPACED, lower=True)):
            n = rows.num_rows
            _id, _h = ints(rows, "_id").astype(np.int64), ints(rows, "_h").astype(np.int64)
            loss = np.zeros((n, 2))
            counts = words.counts.astype(np.int64)
            hashes = words.hashes()
            if len(hashes):
                at, known = _found(head.words, hashes)
                each = np.broadcast_to(head.unknown, (len(hashes), 2)).copy()
                each[known] = head.single[at[known]]
                first = np.flatnonzero(words.doc[1:] == words.doc[:-1])
                keys = _pair_keys(hashes[first], hashes[first + 1])
                # Inside a text a word without its pair keeps the single word's part only.
                each[first + 1] -= np.log(1 - LAMBDA)
                at, paired = _found(head.pairs, keys)
                each[first[paired] + 1] += head.change[at[paired]]
                begin = np.flatnonzero(np.r_[True, words.doc[1:] != words.doc[:-1]])
                loss[words.doc[begin]] = np.add.reduceat(each, begin, axis=0)
                key = np.concatenate([hashes[~known], keys[~paired]])
                doc = np.concatenate([words.doc[~known], words.doc[first[~paired]]])
                cell = _cells(key)
                maybe = (head.more[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)
                key, doc = key[maybe], doc[maybe]
                part = _part(key, parts)
                order = np.lexsort((doc, part))
                key, doc, part = key[order], doc[order], part[order]
                if len(key):
                    cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])
                    lengths, of, part_of = np.diff(np.r_[cut, len(key)]).astype(np.int32), doc[cut], part[cut]
                    texts = _sliced(part_of, {"_id": _id[of], "_h": _h[of], "lengths": lengths})
                    none = pa.nulls(texts.num_rows, pa.binary())
                    packed = _sliced(part, {"keys": key})
                    yield pa.RecordBatch.from_arrays(
                        [texts.column("part"), texts.column("_id"), texts.column("_h"), none, none, none, texts.column("lengths"), packed.column("keys")], _PARTS
                    )
            if n:
                none = pa.nulls(1, pa.binary())
                own = [pa.array([x.tobytes()], pa.binary()) for x in (_id, _h, counts, np.ascontiguousarray(loss[:, 0]), np.ascontiguousarray(loss[:, 1]))]
                yield pa.RecordBatch.from_arrays([pa.array([at_batch % parts], pa.int64()), *own, none, none], _PARTS)

    return run


def _packed_rest(parts: int):
    """Packed (key, t, b) rows of the tables, by slice."""

    def run(batches):
        held, size = [], 0

        def sent():
            keys, t, b = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(keys)
            return _sliced(_part(keys[order], parts), {"keys": keys[order], "t": t[order], "b": b[order]})

        for batch in batches:
            held.append((ints(batch, "key").view(np.uint64), *(batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in "tb")))
            size += batch.num_rows
            if size >= HELD:
                yield sent()
                held, size = [], 0
        if size:
            yield sent()

    return run


def _looked_up(texts: pa.Table, rest: pa.Table) -> pa.Table:
    """Rows of one slice per text: its own row as it came, and what the tables change for its words and pairs there."""
    keys = _unpacked(rest, "keys", np.uint64)
    order = np.argsort(keys)
    keys, change = keys[order], np.stack([_unpacked(rest, k, float)[order] for k in "tb"], axis=1)
    out = []
    for row in texts.select(_PARTS[1:]).to_pylist():
        _id, _h = np.frombuffer(row["_id"], np.int64), np.frombuffer(row["_h"], np.int64)
        if row["n_words"] is not None:
            out.append((_id, _h, pa.array(np.frombuffer(row["n_words"], np.int64)), np.frombuffer(row["t"]), np.frombuffer(row["b"])))
            continue
        begin = np.r_[0, np.cumsum(np.frombuffer(row["lengths"], np.int32))[:-1]]
        at, found = _found(keys, np.frombuffer(row["keys"], np.uint64))
        if not found.any():
            continue
        sums = np.add.reduceat(np.where(found[:, None], change[at], 0.0), begin, axis=0)
        hit = np.add.reduceat(found, begin) > 0
        out.append((_id[hit], _h[hit], pa.nulls(int(hit.sum()), pa.int64()), sums[hit, 0], sums[hit, 1]))
    names = ["_id", "_h", "n_words", "t", "b"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    return pa.table({name: pa.chunked_array([pa.array(x[i]) for x in out], kind) for i, (name, kind) in enumerate(zip(names, kinds, strict=True))})


def _bounded(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order and their (t, b); the caller has bounded the rows."""
    got = rows.select("key", "t", "b").toArrow()
    keys = got.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.stack([got.column("t").to_numpy()[order], got.column("b").to_numpy()[order]], axis=1).astype(float)


def _n_parts(n_words: int, held: int) -> int:
    """Slices of the key space, so that a task holds about ``held`` of the corpus's words or pairs."""
    return 1 + n_words // held


def _split_join(rows: DataFrame, key: str, head: DataFrame, tail: DataFrame) -> DataFrame:
    """Inner join on ``key``: a bounded ``head`` with all hot keys is broadcast, only the other rows are shuffled."""
    hot = rows.join(F.broadcast(head), key)
    return hot.unionByName(rows.join(F.broadcast(head.select(key)), key, "left_anti").join(tail, key))


def fit(marked: DataFrame) -> Model:
    """The models of (``_id``, ``_h``, ``_text``, ``target``) rows."""
    spark = marked.sparkSession

    names = ("before", "after", "_id", "_h")
    counted = marked.mapInArrow(_counted(_words, names), ", ".join(f"{c} bigint" for c in ("key", "n", "n_target", *names)))
    words = counted.groupBy("key").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"), *(F.max(c).alias(c) for c in names))
    words = stage_alone(words, new_run_dir(spark, "words"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    size = words.agg(
        zero(F.sum("n")).alias("b"),
        zero(F.sum("n_target")).alias("t"),
        F.count_if(F.col("n") > 1).alias("known"),
        zero(F.sum(F.when(F.col("n") == 1, 1))).alias("once_b"),
        zero(F.sum(F.when(F.col("n") == 1, F.col("n_target")))).alias("once_t"),
    ).first()
    all_of, once_of = {"t": size["t"], "b": size["b"]}, {"t": size["once_t"], "b": size["once_b"]}
    norm = {k: float(all_of[k] + size["known"] + 1) for k in "tb"}
    unknown = {k: -float(np.log((once_of[k] + 1) / norm[k])) for k in "tb"}

    known = words.where("n > 1").select("key", F.col("n").alias("b"), F.col("n_target").alias("t"))
    is_head = F.col("b") >= HEAD_WORDS * all_of["b"]
    single = lambda k: -F.log((F.col(k) + 1.0) / norm[k])
    vocabulary, losses = _bounded(known.where(is_head).select("key", *(single(k).alias(k) for k in "tb")))
    rest = known.where(~is_head).select("key", *((single(k) - unknown[k]).alias(k) for k in "tb"))

    def change(pair: Column, before: Column, word: Column, k: str) -> Column:
        """What a pair changes in the loss of its second word, from the counts of the pair, its first and its second word."""
        share = F.when(before > 0, pair / before).otherwise(0.0)
        return -F.log1p(LAMBDA * share / ((1 - LAMBDA) * (word + 1.0) / norm[k]))

    parts = _n_parts(all_of["b"], PAIRS_HELD)
    packed = marked.mapInArrow(_packed_pairs(parts), ", ".join(["part bigint", *(f"{c} binary" for c in _PAIRS)]))
    pairs = packed.groupBy("part").applyInArrow(_recurring, ", ".join(f"{c} bigint" for c in ("key", *_PAIRS)))
    counted_at = new_run_dir(spark, "pairs")
    pairs = stage_alone(pairs, counted_at)
    for name in ("before", "after"):
        of = known.select(F.col("key").alias(name), *(F.col(k).alias(f"{name}_{k}") for k in "tb"))
        hot = F.col(f"{name}_b") >= HEAD_WORDS * all_of["b"]
        pairs = _split_join(pairs, name, of.where(hot), of.where(~hot))
    amount = {"t": F.col("n_target"), "b": F.col("n")}
    changes_at = new_run_dir(spark, "pair_changes")
    pairs = stage_alone(pairs.select("key", "n", *(change(amount[k], F.col(f"before_{k}"), F.col(f"after_{k}"), k).alias(k) for k in "tb")), changes_at)
    discard(spark, counted_at)
    is_head = F.col("n") >= HEAD_PAIRS * all_of["b"]
    pair_keys, changes = _bounded(pairs.where(is_head))
    rest = rest.unionByName(pairs.where(~is_head).select("key", "t", "b"))
    more = _filter(rest)
    packed = rest.mapInArrow(_packed_rest(_n_parts(all_of["b"], KEYS_HELD)), "part bigint, keys binary, t binary, b binary")
    rest = stage(packed, new_run_dir(spark, "rest"))
    discard(spark, changes_at)

    # Pairs with the unknown word: each word that occurs once has one neighbour on either side.
    once = words.where("n = 1").select("before", "after", "_id", "_h", "n_target")
    share_of_once = HEAD_WORDS * once_of["b"]
    spoken = words.select("key", F.col("n").alias("word_b"), F.col("n_target").alias("word_t"))
    changed = []
    for name in ("after", "before"):
        beside = once.where(F.col(name) != 0).groupBy(F.col(name).alias("key")).agg(F.count("*").alias("n"), F.sum("n_target").alias("n_target")).join(spoken, "key")
        beside = stage_alone(beside, new_run_dir(spark, f"once_{name}"))
        lone = beside.where("word_b = 1")
        if name == "after":
            both = lone.agg(zero(F.sum("n")).alias("b"), zero(F.sum("n_target")).alias("t")).first()
            of = lambda k: change(amount[k], F.lit(once_of[k]), F.col(f"word_{k}"), k)
        else:
            of = lambda k: change(amount[k], F.col(f"word_{k}"), F.lit(once_of[k]), k)
        table = beside.where("word_b > 1 and n > 1").select("key", "n", *(of(k).alias(k) for k in "tb"))
        if name == "after" and both["b"] > 1:
            twice = [change(F.lit(both[k]), F.lit(once_of[k]), F.lit(once_of[k]), k).alias(k) for k in "tb"]
            table = table.unionByName(lone.select("key", "n", *twice))
        table = table.withColumnRenamed("key", name)
        hot = F.col("n") >= share_of_once
        changed.append(_split_join(once, name, table.where(hot).drop("n"), table.where(~hot).drop("n")).select("_id", "_h", "t", "b"))
    head = Head(vocabulary, losses, np.array([unknown["t"], unknown["b"]]), pair_keys, changes, more)
    return Model(head, rest, changed[0].unionByName(changed[1]), all_of["b"])


def cross_entropy_difference(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``target_loss``, ``background_loss``, ``score``.

    ``targets`` has the ``doc_id`` of the target documents.
    """
    spark = docs.sparkSession
    ids = targets.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("_target")).distinct()
    texts = keyed(docs).select("_id", "_h", "_text")
    small = fits_broadcast(ids)
    marked = texts.join(F.broadcast(ids) if small else ids, F.col("_id") == F.col("_target"), "left")
    marked = marked.select("_id", "_h", "_text", F.col("_target").isNotNull().alias("target"))
    if not small:  # else three passes would each shuffle the texts
        marked = stage(marked, new_run_dir(spark, "marked"))
    model = fit(marked)
    head = spark.sparkContext.broadcast(model.head)
    parts = _n_parts(model.n_words, KEYS_HELD)
    run = lambda batches: _parts(head.value, parts)(batches)
    # What meets the tables is larger than the texts, so one share of them is on the disks at a time.
    shares = min(SHARES, 1 + model.n_words // SHARE_WORDS)
    summed = []
    for share in range(shares):
        asked = texts.where(F.pmod("_h", F.lit(shares)) == share).mapInArrow(run, _PARTS_DDL)
        met = asked.groupBy("part").cogroup(model.rest.groupBy("part")).applyInArrow(_looked_up, "_id bigint, _h bigint, n_words bigint, t double, b double")
        sums = met.groupBy("_id", "_h").agg(F.count("n_words").alias("copies"), F.max("n_words").alias("n_words"), *(F.sum(k).alias(k) for k in "tb"))
        summed.append(stage_alone(sums, new_run_dir(spark, "scored")))
    found = reduce(DataFrame.unionByName, summed).unionByName(
        model.once.select("_id", "_h", F.lit(0).cast("bigint").alias("copies"), F.lit(None).cast("bigint").alias("n_words"), "t", "b")
    )
    # Rows equal in id and text are one group and come back as often as they were.
    summed = found.groupBy("_id", "_h").agg(F.sum("copies").alias("copies"), F.max("n_words").alias("n_words"), *(F.sum(k).alias(k) for k in "tb"))
    mean = lambda k: F.when(F.col("n_words") > 0, F.col(k) / F.col("copies") / F.col("n_words"))
    scored = summed.select("_id", "n_words", mean("t").alias("target_loss"), mean("b").alias("background_loss"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return scored.select(
        bare_id(F.col("_id")).alias("doc_id"), "n_words", "target_loss", "background_loss", (F.col("target_loss") - F.col("background_loss")).alias("score")
    )
