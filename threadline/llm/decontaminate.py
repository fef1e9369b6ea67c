"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so a question asked again
with other values keeps its template. Windows of canonical words of every text
are hash-joined with those of the benchmark. Every text has three readings:
names only where they are capitalised inside a sentence; every capitalised word
a name, wherever it stands, and numbers cut from their units; and plain words.
A document and an item are compared in one reading at a time.

Hits of a document and an item are cut into places, by gaps and also by
diagonals, so each of two copies in a row is a place of its own. A place counts
if it covers enough of the item and its slots are consistent: one name (by gaps:
one value) of the item always stands for the same one of the document.

A window of placeholders needs at least half its words to be literal; plain
windows have no such rule. Items shorter than a window are matched by windows of
their own length, down to ``MIN_WORDS`` words, as plain words of any length.
Items below ``LEAST_WORDS`` words (an answer like "Yes") stand in texts that have
nothing to do with them: they are reported as 'short' and nothing is removed.

Defined results: null texts have no windows; rows with the same id are one
document or item; null ids come back as null. Hits are aggregated per document
and item, so a passage that a third of all documents share makes small groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadline.llm.frames import bare_id, fits_broadcast, keyed
from threadline.llm.scan import ALNUM, DIGIT, LOWER, byte_class, chunks, ints, signed, span_hashes, words_of
from threadline.runtime import new_run_dir, stage

WINDOW = 8
MIN_WORDS = 5
#: Words of an item whose occurrence is held against a document.
LEAST_WORDS = 3
#: Units of measure that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs oz pound pounds "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks "
    "month months year years c f k degrees percent usd eur dollar dollars cent cents euro euros"
).split()

_NUMERAL = DIGIT | byte_class(b".,")
_SENTENCE_END = byte_class(b".!?:;\n\"")
_UPPER = byte_class(bytes(range(65, 91)))
_SMALL = byte_class(bytes(range(97, 123)))
_SLOT = {"number": np.uint64(1), "unit": np.uint64(2), "name": np.uint64(3)}
_WINDOWS = pa.schema(
    [("_id", pa.int64()), ("_h", pa.int64()), ("pos", pa.int32()), ("reading", pa.int32()), ("k", pa.int32()), ("key", pa.int64()), ("slots", pa.list_(pa.int64()))]
)
#: Readings of a text, in the order in which they are believed.
INSIDE, CAPITALS, PLAIN = range(3)
#: Diagonals this close are one place.
BAND = 2


def _plain_hashes(words):
    return type(words)(LOWER[words.data], words.offsets, words.doc, words.start, words.end).hashes()


def _unit_hashes() -> np.ndarray:
    text = np.frombuffer(" ".join(UNITS).encode(), dtype=np.uint8)
    return _plain_hashes(words_of(text, np.array([0, len(text)]), ALNUM))


def _capital(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words start with a capital of any script and go on with a small letter or one beyond ASCII."""
    out = _UPPER[data[start]]
    beyond = np.flatnonzero(data[start] >= 192)
    if len(beyond):
        wide = np.concatenate([data, np.zeros(4, dtype=np.uint8)])
        heads, which = np.unique(wide[start[beyond, None] + np.arange(4)], axis=0, return_inverse=True)
        upper = np.array([bytes(h).decode(errors="ignore")[:1].isupper() for h in heads])
        out[beyond] = upper[which.ravel()]
    length = np.where(data[start] < 128, 1, np.where(data[start] < 224, 2, np.where(data[start] < 240, 3, 4)))
    second = data[np.minimum(start + length, len(data) - 1)]
    return out & (end - start > length) & (_SMALL[second] | (second >= 128))


def canonical(data: np.ndarray, offsets: np.ndarray, units: np.ndarray, reading: int = INSIDE):
    """(words, their canonical hashes, their own hashes with the kind of a slot in the last bits, which are slots)."""
    words = words_of(data, offsets, ALNUM, joined=b".,", unglued=reading == CAPITALS)
    plain = _plain_hashes(words)
    if not len(plain) or reading == PLAIN:
        return words, plain, plain, np.zeros(len(plain), dtype=bool)
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    other = count(~_NUMERAL[data])
    number = other[words.end] == other[words.start]
    follows = np.zeros(len(plain), dtype=bool)
    follows[1:] = words.doc[1:] == words.doc[:-1]
    before = np.concatenate([[False], number[:-1]]) & follows
    unit = before & np.isin(plain, units)
    ends = count(_SENTENCE_END[data])
    inside = follows.copy()
    inside[1:] &= ends[words.start[1:]] == ends[words.end[:-1]]
    second = np.minimum(words.start + 1, len(data) - 1)
    name = inside & _UPPER[data[words.start]] & (words.end - words.start > 1) & _SMALL[data[second]]
    if reading == CAPITALS:
        name = _capital(data, words.start, words.end)
    canon, own = plain.copy(), plain & ~np.uint64(3)
    for mask, kind in ((name, "name"), (unit, "unit"), (number, "number")):
        canon[mask] = _SLOT[kind]
    slot = number | unit | name
    return words, canon, np.where(slot, own | canon & np.uint64(3), plain), slot


def _windows(sizes: dict[int, tuple[int, ...]], whole: int, wanted=None):
    """Windows of each reading's sizes; ``whole``: of items, cut by their own size up to this one only; ``wanted``: sorted keys, others are left out."""

    def cut(rows, data, offsets, units, reading):
        words, canon, plain, slot = canonical(data, offsets, units, reading)
        counts, ordinal = words.counts, words.ordinal()
        ids, hashes = ints(rows, "_id"), ints(rows, "_h")
        places, before = np.flatnonzero(slot), np.concatenate([[0], np.cumsum(slot)])
        for k in sizes.get(reading, ()):
            n = len(canon) - k + 1
            if n <= 0:
                continue
            at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
            at = at[before[at + k] - before[at] <= k // 2]
            if whole:
                size = counts[words.doc[at]]
                at = at[(size == k) | (size > k) & (k == whole)]
            key = signed(span_hashes(canon, at, at + k))
            if wanted is not None:
                keys = wanted.value
                near = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                found = keys[near] == key if len(keys) else np.zeros(len(key), dtype=bool)
                at, key = at[found], key[found]
            low, high = before[at], before[at + k]
            span = high - low
            ends = np.cumsum(span)
            inner = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - span, span)
            filled = plain[places[np.repeat(low, span) + inner]] if len(inner) else np.zeros(0, dtype=np.uint64)
            slots = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(signed(filled)))
            doc = words.doc[at]
            full = lambda x: pa.array(np.full(len(at), x, dtype=np.int32))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[doc]), pa.array(hashes[doc]), pa.array(ordinal[at].astype(np.int32)), full(reading), full(k), pa.array(key), slots], schema=_WINDOWS
            )

    def run(batches):
        units = _unit_hashes()
        for rows, data, offsets in chunks(batches, "_text"):
            for reading in sizes:
                yield from cut(rows, data, offsets, units, reading)

    return run


_DDL = "_id bigint, _h bigint, pos int, reading int, k int, key bigint, slots array<bigint>"


def _leaks(docs: DataFrame, benchmark: DataFrame, window: int, coverage: float, doc_key: list[str], least: int = 1) -> DataFrame:
    """(*doc_key, item, n_hits, verbatim, n_windows, coverage, short); ``doc_key``: what makes rows one document.

    Items of fewer than ``least`` words are not looked for.
    """
    spark = docs.sparkSession
    template = tuple(range(MIN_WORDS, window + 1))
    sizes = {INSIDE: template, CAPITALS: template, PLAIN: tuple(range(least, window + 1))}
    item = keyed(benchmark, "item_id").select("_id", "_h", "_text").mapInArrow(_windows(sizes, window), _DDL)
    item = item.select(F.col("_id").alias("item"), F.col("pos").alias("ipos"), "reading", "k", "key", F.col("slots").alias("islots"))
    item = stage(item, new_run_dir(spark, "templates"))
    # At most one row per reading and size, so documents are cut only by sizes that some item needs.
    needed: dict[int, tuple[int, ...]] = {}
    for r in sorted(item.select("reading", "k").distinct().collect()):
        needed[r["reading"]] = (*needed.get(r["reading"], ()), r["k"])
    totals = item.groupBy("item", "reading").agg(F.count_distinct("ipos").alias("n_windows"), (F.max("k") < LEAST_WORDS).alias("short"))
    small, wanted = fits_broadcast(item), None
    if small:  # as many keys as may be broadcast: windows that no item has stay in the task
        wanted = spark.sparkContext.broadcast(np.unique(item.select("key").toArrow().column("key").to_numpy()))
    own = keyed(docs).select("_id", "_h", "_text").mapInArrow(_windows(needed, 0, wanted), _DDL)
    group = [*doc_key, "item", "reading"]
    hits = own.join(F.broadcast(item) if small else item, ["reading", "k", "key"]).select(
        *group, "pos", "ipos", (F.col("slots") == F.col("islots")).alias("equal"), F.arrays_zip("islots", "slots").alias("pairs")
    )
    hits = stage(hits, new_run_dir(spark, "hits"))

    def placed(order: str, reach: int) -> DataFrame:
        by_place = Window.partitionBy(*group).orderBy(order, "pos", "ipos")
        new = F.when(F.col(order) - F.lag(order).over(by_place) <= reach, 0).otherwise(1)
        marked = hits.withColumn("diagonal", F.col("pos") - F.col("ipos")).withColumn("new", new)
        return marked.withColumn("place", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))

    def counted(places: DataFrame, names_only: bool) -> DataFrame:
        pairs = F.array_distinct(F.flatten(F.collect_set("pairs")))
        found = places.groupBy(*group, "place").agg(
            F.count_distinct("ipos").alias("all_hits"),
            F.count_distinct(F.when(F.col("equal"), F.col("ipos"))).alias("equal_hits"),
            pairs.alias("pairs"),
        )
        if names_only:  # on a diagonal a number's place in the item tells it; equal numbers may part
            found = found.withColumn("pairs", F.filter("pairs", lambda p: p["islots"].bitwiseAND(F.lit(3)) == int(_SLOT["name"])))
        steady = F.size(F.array_distinct(F.transform("pairs", lambda p: p["islots"]))) == F.size("pairs")
        found = found.withColumn("n_hits", F.when(steady, F.col("all_hits")).otherwise(F.col("equal_hits")))
        return found.select(*group, F.struct("n_hits", (F.col("n_hits") == F.col("equal_hits")).alias("verbatim")).alias("best"))

    found = counted(placed("pos", 2 * window), False).unionByName(counted(placed("diagonal", BAND), True))
    per_reading = (
        found.groupBy(*group)
        .agg(F.max("best").alias("best"))
        .join(totals, ["item", "reading"])
        .withColumn("coverage", F.col("best.n_hits") / F.col("n_windows"))
        .where(F.col("coverage") >= coverage)
    )
    return per_reading.groupBy(*doc_key, "item").agg(F.min(F.struct("reading", "best", "n_windows", "coverage", "short")).alias("x")).select(
        *doc_key, "item", "x.best.n_hits", "x.best.verbatim", "x.n_windows", "x.coverage", "x.short"
    )


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """One row per document and benchmark item that it holds.

    ``doc_id``, ``item_id``, ``n_hits`` (distinct windows of the item found in the
    best place), ``n_windows`` (of the item), ``coverage``, ``kind`` ('verbatim',
    'reparameterised', or 'short' for items too short to tell), in the first reading that covers enough. A place is a
    run of hits no further apart than two windows, or on neighbouring diagonals.
    Where its slots contradict each other only windows with equal values count.
    """
    return _leaks(docs, benchmark, window, coverage, ["_id"]).select(
        bare_id(F.col("_id")).alias("doc_id"),
        bare_id(F.col("item")).alias("item_id"),
        "n_hits",
        "n_windows",
        "coverage",
        F.when(F.col("short"), "short").when(F.col("verbatim"), "verbatim").otherwise("reparameterised").alias("kind"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item of ``LEAST_WORDS`` words or more, told apart by id and text."""
    bad = _leaks(docs, benchmark, window, coverage, ["_id", "_h"], LEAST_WORDS).select("_id", "_h").distinct()
    return keyed(docs).select("row", "_id", "_h").join(bad, ["_id", "_h"], "left_anti").select("row.*")
