"""SimHash near-dedup with multi-index hashing.

A fingerprint is cut into segments. Two fingerprints within ``max_bits`` differ
in at most ``max_bits // segments`` bits in one segment at least, so it is
enough to look up, for every segment, its own value and the values in the small
Hamming ball around it, and to verify the complete distance of what is found.

Only distinct fingerprints are looked up; copies never meet each other. Of two
values that differ in a bit one has it clear, so flipping clear bits only finds
every pair and halves the ball. A bucket never emits its pairs: a task verifies
them in blocks and passes on one link per fingerprint that connects what the
pairs connect.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm import overlap
from threadline.llm.components import components, forest
from threadline.llm.frames import bare_id, keyed
from threadline.llm.scan import LOWER, SPACED, chunks, ints, signed, words_of
from threadline.runtime import discard, new_run_dir, stage

#: Pairs of a bucket that a task verifies at once.
BLOCK = 1 << 20


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, XXH64 seed 42) of every shingle of k words; a shorter text is one shingle."""
    words = words_of(LOWER[data], offsets, SPACED)
    if not len(words.doc):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    # One space between words: the byte after each word is kept as a space, other gaps go.
    keep = SPACED[words.data]
    after = words.end[words.end < len(keep)]
    gap = after[~keep[after]]
    body = words.data.copy()
    body[gap] = 32
    keep[gap] = True
    place = np.cumsum(keep) - 1
    flat = body[keep].tobytes()
    start, end = place[words.start], place[words.end - 1] + 1
    counts, first = words.counts, words.first
    n = len(start) - k + 1
    full = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    s = np.concatenate([start[full], start[first[short]]])
    e = np.concatenate([end[full + k - 1], end[first[short] + counts[short] - 1]])
    doc = np.concatenate([words.doc[full], short])
    digest = partial(xxhash.xxh64_intdigest, seed=42)
    hashes = np.array([digest(flat[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)], dtype=np.uint64)
    order = np.argsort(doc, kind="stable")
    return doc[order], hashes[order]


def fingerprints(docs: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """A bit is set where more than half of a row's hashes have it; no hash gives zero."""
    out = np.zeros(rows, dtype=np.uint64)
    if len(docs):
        begin = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        size = np.diff(np.r_[begin, len(docs)])
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin, axis=0, dtype=np.int32)
        packed = np.packbits(2 * ones > size[:, None], axis=1, bitorder="little")
        out[docs[begin]] = np.ascontiguousarray(packed).view(np.uint64).ravel()
    return out


def _fingerprint(k: int, key: tuple[str, ...] = ("_id",)):
    def run(batches):
        for rows, data, offsets in chunks(batches, "_text"):
            doc, hashes = shingle_hashes(data, offsets, k)
            found = fingerprints(doc, hashes, rows.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in key), pa.array(found)], [*key, "fp"])

    return run


def segment_bounds(segments: int) -> list[tuple[int, int]]:
    cuts = [64 * i // segments for i in range(segments + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _postings(segments: int, radius: int):
    def run(batches):
        for batch in batches:
            fps = ints(batch, "fp").view(np.uint64)
            for number, (low, high) in enumerate(segment_bounds(segments)):
                value = (fps >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
                for flips in range(radius + 1):
                    for bits in combinations(range(high - low), flips):
                        flip = np.uint64(sum(1 << b for b in bits))
                        clear = (value & flip) == 0 if radius == 1 else np.ones(len(fps), dtype=bool)
                        key = (value[clear] | flip if radius == 1 else value ^ flip).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(key), number, dtype=np.int32)),
                                pa.array(key),
                                pa.array(fps[clear].view(np.int64)),
                                pa.array(np.full(len(key), flips == 0)),
                            ],
                            ["seg", "key", "fp", "home"],
                        )

    return run


def _linked(fps: np.ndarray, home: np.ndarray, begin: np.ndarray, size: np.ndarray, max_bits: int):
    """Links of each bucket: every home entry against its bucket, in blocks of pairs."""
    bucket = np.repeat(np.arange(len(begin)), size)
    rows = np.flatnonzero(home & (size[bucket] > 1))
    width = size[bucket[rows]]
    ends = np.cumsum(width)
    at = 0
    while at < len(rows):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK, side="right")))
        own, span = rows[at:stop], width[at:stop]
        left = np.repeat(own, span)
        inner = np.arange(len(left)) - np.repeat(np.cumsum(span) - span, span)
        right = begin[bucket[left]] + inner
        a, b = fps[left], fps[right]
        near = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
        if near.any():
            yield forest(a[near], b[near])
        at = stop


def _verify(max_bits: int):
    def run(batches):
        seg, key, fp, home = [], [], [], []
        held = 0

        def links(final: bool):
            nonlocal seg, key, fp, home, held
            s, k, f, h = (np.concatenate(x) for x in (seg, key, fp, home))
            begin = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (k[1:] != k[:-1])])
            # The last bucket may go on in the next batch.
            cut = len(s) if final else begin[-1]
            seg, key, fp, home, held = [s[cut:]], [k[cut:]], [f[cut:]], [h[cut:]], len(s) - cut
            begin = begin[begin < cut]
            if len(begin):
                for a, b in _linked(f[:cut].view(np.uint64), h[:cut], begin, np.diff(np.r_[begin, cut]), max_bits):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            for into, name in ((seg, "seg"), (key, "key"), (fp, "fp"), (home, "home")):
                into.append(ints(batch, name))
            held += batch.num_rows
            if held >= 1 << 18:
                yield from links(False)
        if held:
            yield from links(True)

    return run


def near_links(prints: DataFrame, max_bits: int = 4, segments: int = 3) -> DataFrame:
    """(a, b): links that connect every two distinct fingerprints within ``max_bits``."""
    radius = max_bits // segments
    table = prints.select("fp").distinct().mapInArrow(_postings(segments, radius), "seg int, key bigint, fp bigint, home boolean")
    dealt = table.repartition("seg", "key").sortWithinPartitions("seg", "key")
    return dealt.mapInArrow(_verify(max_bits), "a bigint, b bigint")


def simhash(docs: DataFrame, k: int = 4, max_bits: int = 4, segments: int = 3) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``fp`` (BIGINT) and ``component_id``.

    ``component_id`` is the smallest ``doc_id`` reachable over links, itself
    included. Null or empty text has fingerprint zero and links like any other;
    a null id is the smallest id and gives a null component. Repeated rows and
    equal texts share a fingerprint and so a component.
    """
    spark = docs.sparkSession
    prints = stage(
        keyed(docs).select("_id", "_text").mapInArrow(_fingerprint(k), "_id bigint, fp bigint"), new_run_dir(spark, "fingerprints")
    )
    roots = components(near_links(prints, max_bits, segments))
    least = prints.groupBy(F.col("fp").alias("node")).agg(F.min("_id").alias("least"))
    placed = least.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    ids = placed.groupBy("root").agg(F.min("least").alias("component"))
    where = placed.join(ids, "root").select(F.col("node").alias("fp"), "component")
    return prints.join(where, "fp").select(bare_id(F.col("_id")).alias("doc_id"), "fp", bare_id(F.col("component")).alias("component_id"))


def _sketch(k: int):
    def run(batches):
        for rows, data, offsets in chunks(batches, "_text"):
            doc, hashes = shingle_hashes(data, offsets, k)
            n = rows.num_rows
            found = fingerprints(doc, hashes, n)
            node, size, keys, seen = overlap.sketches(doc, hashes, n)
            binary = lambda table: pa.array([x.tobytes() for x in table], type=pa.binary())
            yield pa.RecordBatch.from_arrays(
                [rows.column("_id"), rows.column("_h"), pa.array(signed(found)), pa.array(signed(node)), pa.array(size), binary(keys), binary(seen)],
                ["_id", "_h", "fp", "node", "size", "keys", "seen"],
            )

    return run


def _sets(k: int):
    def run(batches):
        for rows, data, offsets in chunks(batches, "_text"):
            doc, hashes = overlap.distinct_shingles(*shingle_hashes(data, offsets, k))
            cuts = np.searchsorted(doc, np.arange(rows.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cuts), pa.array(signed(hashes)))
            yield pa.RecordBatch.from_arrays([rows.column("node"), lists], ["node", "shingles"])

    return run


def representatives(docs: DataFrame, k: int = 5, share: float = 0.8, max_bits: int = 4, segments: int = 3) -> DataFrame:
    """One row of ``docs`` per component, that with the smallest id and then text hash, all columns as they are.

    Two documents are linked if their fingerprints over shingles of ``k`` words
    differ in at most ``max_bits``, or if their sets of shingles have a Jaccard
    similarity of ``share`` or more; the second kind lies far outside any
    fingerprint ball and is found by ``overlap``. Texts without words are
    copies of each other. Documents are told apart by id and text, so null and
    repeated ids with different texts are as many documents.
    """
    spark = docs.sparkSession
    folders = {name: new_run_dir(spark, name) for name in ("sketches", "nodes", "candidates", "sets", "near")}
    prints = keyed(docs).select("_id", "_h", "_text").mapInArrow(_sketch(k), "_id bigint, _h bigint, fp bigint, node bigint, size bigint, keys binary, seen binary")
    prints = stage(prints, folders["sketches"])
    # Equal sets have equal sketches.
    same = [F.first(c).alias(c) for c in ("fp", "size", "keys", "seen")]
    nodes = stage(prints.groupBy("node").agg(F.min(F.struct("_id", "_h")).alias("least"), *same), folders["nodes"])
    pairs = stage(overlap.candidates(nodes, share), folders["candidates"])
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = overlap.texts_of(docs, nodes.join(met, "node").select("node", "least._id", "least._h"))
    sets = stage(texts.mapInArrow(_sets(k), "node bigint, shingles array<bigint>").dropDuplicates(["node"]), folders["sets"])
    # A fingerprint stands for its smallest node.
    anchors = nodes.groupBy("fp").agg(F.min("node").alias("anchor"))
    close = near_links(nodes, max_bits, segments)
    for end in ("a", "b"):
        close = close.join(anchors.select(F.col("fp").alias(end), F.col("anchor").alias(f"{end}_node")), end)
    alike = nodes.select("fp", "node").join(anchors, "fp").where("node <> anchor").select("node", "anchor")
    links = overlap.checked(pairs, sets, share).union(close.select("a_node", "b_node")).union(alike)
    roots = components(stage(links, folders["near"]))
    first = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node")).agg(F.min("least").alias("least"))
    kept = stage(first.select("least._id", "least._h"), new_run_dir(spark, "kept"))
    for path in folders.values():
        discard(spark, path)
    return keyed(docs).select("row", "_id", "_h").join(kept, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"]).select("row.*")
