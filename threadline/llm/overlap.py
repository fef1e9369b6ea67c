"""Links between texts whose sets of word shingles overlap by a given share, checked on the sets themselves.

A 64-bit fingerprint cannot find such texts: at a Jaccard similarity of 0.8 two
of them differ in about ten bits, and a Hamming ball that wide has no selective
segments. Candidates come from MinHash bands instead: ``BANDS`` keys of
``ROWS`` minima each, of which two texts at 0.8 share one with probability
1 - (1 - 0.8 ** 5) ** 20 = 0.9997.

A text is a node, named by a hash of its shingle set, so copies are one node.
In a bucket of equal keys the node with the smallest name leads: whoever looks
like it by the bytes of the minima is joined to it and leaves the bucket, the
others lead in their turn and meet the whole bucket. So a group of copies that
are clearly alike costs a few links per member; members near the share lead on
and are compared with all. Tasks do this to their own postings before these are
shuffled, and a hot group arrives as a few leaders per task. Every link that
comes out is then checked by intersecting the two shingle sets in Spark
expressions; links below the share are dropped.

What may be missed: a pair that shares no band, a pair estimated 0.12 too low (three
standard deviations of 100 minima), and a pair whose two members both left
every bucket they share for different leaders. A bucket of texts that share
minima but are not alike takes time in proportion to its leaders times its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.frames import fits_broadcast, keyed
from threadline.llm.scan import ints, mix, signed

BANDS, ROWS = 20, 5
HASHES = BANDS * ROWS
#: How far an estimate may lie below the share for a pair to be checked, and above it for a node to leave its bucket.
SLACK, SURE = 0.12, 0.02
_odd = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_turn = mix(np.arange(1001, 1001 + HASHES, dtype=np.uint64))


def distinct_shingles(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct hashes of each row, ascending."""
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    if len(docs):
        first = np.r_[True, (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])]
        docs, hashes = docs[first], hashes[first]
    return docs, hashes


def sketches(docs: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: its node, the size of its set, its band keys and a byte of each of its minima."""
    docs, hashes = distinct_shingles(docs, hashes)
    node, size = np.zeros(rows, dtype=np.uint64), np.zeros(rows, dtype=np.int64)
    keys, seen = np.zeros((rows, BANDS), dtype=np.uint64), np.zeros((rows, HASHES), dtype=np.uint8)
    if not len(docs):
        return node, size, keys, seen
    begin = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
    own = docs[begin]
    size[own] = np.diff(np.r_[begin, len(docs)])
    node[own] = mix(np.add.reduceat(mix(hashes), begin) + size[own].astype(np.uint64))
    band = np.zeros(len(own), dtype=np.uint64)
    for i in range(HASHES):
        least = np.minimum.reduceat((hashes ^ _turn[i]) * _odd[i], begin)
        seen[own, i] = (least >> np.uint64(20)).astype(np.uint8)
        band = mix(least + (np.uint64(i) if i % ROWS == 0 else band))
        if i % ROWS == ROWS - 1:
            keys[own, i // ROWS] = band
    return node, size, keys, seen


def _clustered(node: np.ndarray, size: np.ndarray, seen: np.ndarray, share: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(which nodes of a bucket still lead, its links); nodes ascend."""
    leads = np.zeros(len(node), dtype=bool)
    waiting = np.ones(len(node), dtype=bool)
    links = []
    for i in range(len(node)):
        if not waiting[i]:
            continue
        waiting[i], leads[i] = False, True
        alike = (seen == seen[i]).mean(axis=1)
        near = (alike >= share - SLACK) & ~leads & (np.minimum(size, size[i]) >= share * np.maximum(size, size[i]))
        if near.any():
            links.append((np.full(int(near.sum()), node[i]), node[near]))
            waiting &= ~(near & (alike >= share + SURE))
    return leads, links


_POSTING = ["key", "node", "size", "seen", "other"]
_POSTING_DDL = "key bigint, node bigint, size bigint, seen binary, other bigint"


def _rows(key, node, size, seen) -> pa.RecordBatch:
    body = pa.array([x.tobytes() for x in seen], type=pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(node)), pa.array(size), body, pa.nulls(len(key), pa.int64())], _POSTING)


def _links(key, node, other) -> pa.RecordBatch:
    n = len(node)
    return pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(node)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(signed(other))], _POSTING)


def _buckets(key, node, size, seen, share: float):
    """Leaders (indices) and links of postings sorted by key and node; a node stands in a bucket once."""
    first = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
    leads = first.copy()
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    links = []
    for a, b in zip(begin.tolist(), np.r_[begin[1:], len(key)].tolist(), strict=True):
        if b - a > 1:
            at = a + np.flatnonzero(first[a:b])
            lead, found = _clustered(node[at], size[at], seen[at], share)
            leads[at] = lead
            links += [(np.full(len(x), key[a]), x, y) for x, y in found]
    return np.flatnonzero(leads), [np.concatenate(x) for x in zip(*links, strict=True)] if links else None


def _sent(share: float):
    """Postings of nodes, after the buckets inside a batch were led."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n = batch.num_rows
                key = np.frombuffer(b"".join(batch.column("keys").to_pylist()), dtype=np.uint64)
                seen = np.frombuffer(b"".join(batch.column("seen").to_pylist()), dtype=np.uint8).reshape(n, HASHES)
                row = np.repeat(np.arange(n), BANDS)
                node, size = ints(batch, "node").view(np.uint64), ints(batch, "size")
                order = np.lexsort((node[row], key))
                key, row = key[order], row[order]
                left, links = _buckets(key, node[row], size[row], seen[row], share)
                yield _rows(key[left], node[row[left]], size[row[left]], seen[row[left]])
                if links:
                    yield _links(*links)

    return run


def _met(share: float):
    """Links of whole buckets; postings come by key, and by batch only leaders of the open bucket are kept."""

    def run(batches):
        held = None
        for whole in batches:
            told = whole.column("other").is_valid()
            ready = whole.filter(told)
            if ready.num_rows:
                yield pa.RecordBatch.from_arrays([ready.column("node"), ready.column("other")], ["a", "b"])
            batch = whole.filter(pc.invert(told))
            if not batch.num_rows:
                continue
            seen = np.frombuffer(b"".join(batch.column("seen").to_pylist()), dtype=np.uint8).reshape(-1, HASHES)
            new = [ints(batch, "key").view(np.uint64), ints(batch, "node").view(np.uint64), ints(batch, "size").astype(np.int64), seen]
            key, node, size, seen = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            # Spark sorts signed keys: equal ones stand together, their order among others does not matter.
            run_of = np.cumsum(np.r_[False, key[1:] != key[:-1]])
            order = np.lexsort((node, run_of))
            key, node, size, seen = key[order], node[order], size[order], seen[order]
            left, links = _buckets(key, node, size, seen, share)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(signed(links[1])), pa.array(signed(links[2]))], ["a", "b"])
            left = left[key[left] == key[-1]]
            held = [key[left], node[left], size[left], seen[left]]

    return run


def candidates(nodes: DataFrame, share: float) -> DataFrame:
    """Distinct (a, b) that may overlap by ``share``, of (``node``, ``size``, ``keys``, ``seen``) rows with distinct nodes."""
    postings = nodes.where("size > 0").mapInArrow(_sent(share), _POSTING_DDL)
    dealt = postings.repartition("key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_met(share), "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def checked(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The (a, b) whose sets, (``node``, ``shingles``) with distinct elements, overlap by ``share`` of their union."""
    of = lambda c: sets.select(F.col("node").alias(c), F.col("shingles").alias(f"of_{c}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    common = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - common
    return both.where(common >= F.lit(share) * union - 1e-9).select("a", "b")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(``node``, ``_text``), one row for each of the (``node``, ``_id``, ``_h``) in ``wanted``."""
    texts = keyed(docs).select("_id", "_h", "_text")
    side = F.broadcast(wanted) if fits_broadcast(wanted) else wanted
    return texts.join(side, ["_id", "_h"]).select("node", "_text")
