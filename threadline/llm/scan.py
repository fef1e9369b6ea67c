"""Whole-batch word scanning of Arrow text columns with numpy.

Tasks walk their Arrow batches in chunks of about half a megabyte of text (a
longer text is one chunk), so a task's memory does not depend on the table.
Words, hashes and window hashes of a chunk are found with array operations
over the raw UTF-8 bytes; no Python runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19


def byte_class(pattern: bytes) -> np.ndarray:
    """True for the bytes of ``pattern``."""
    table = np.zeros(256, dtype=bool)
    table[list(pattern)] = True
    return table


SPACE = byte_class(b" \t\n\x0b\x0c\r")
#: Words between ASCII white space.
SPACED = ~SPACE
DIGIT = byte_class(b"0123456789")
#: Runs of ASCII letters and digits, and of anything beyond ASCII.
ALNUM = DIGIT | byte_class(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | (np.arange(256) >= 128)
#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_STEP = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))
_power = {True: np.ones(1, dtype=np.uint64), False: np.ones(1, dtype=np.uint64)}


def _powers(n: int, forward: bool) -> np.ndarray:
    """The first n powers of the odd step, or of its inverse, modulo 2**64."""
    have = _power[forward]
    if len(have) < n:
        base = _STEP if forward else pow(_STEP, -1, 1 << 64)
        grown = np.full(max(n, 2 * len(have)), base, dtype=np.uint64)
        grown[0] = 1
        have = _power[forward] = np.multiply.accumulate(grown)
    return have[:n]


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for every span, from one running sum."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _powers(len(values), True), out=sums[1:])
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    shift = _powers(int(start.max()) + 1, False)[start]
    return mix((sums[end] - sums[start]) * shift ^ (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of consecutive texts: ``doc`` is the row in the chunk, start/end are byte offsets in ``data``."""

    data: np.ndarray
    offsets: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)

    @property
    def first(self) -> np.ndarray:
        """Index of each row's first word (where it has any)."""
        return np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64)

    def ordinal(self) -> np.ndarray:
        """Place of each word in its row, from 0."""
        return np.arange(len(self.doc)) - self.first[self.doc]

    def hashes(self) -> np.ndarray:
        return span_hashes(_BYTE[self.data], self.start, self.end)

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that start k words of one row, and a hash of those k words."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return at, span_hashes(hashes, at, at + k)


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, joined: bytes = b"", unglued: bool = False) -> Words:
    """Words are runs of bytes in ``table``; a byte of ``joined`` between two digits belongs to the word; ``unglued`` cuts between digit and letter."""
    inside = table[data]
    if joined and len(data) > 2:
        digit = DIGIT[data]
        inside[1:-1] |= byte_class(joined)[data[1:-1]] & digit[:-2] & digit[2:]
    edge = np.ones(len(data) + 1, dtype=bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    if unglued:
        edge[1:-1] |= inside[1:] & inside[:-1] & DIGIT[data[:-1]] & ~DIGIT[data[1:]] & ALNUM[data[1:]]
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    begin, stop = cuts[:-1], cuts[1:]
    keep = inside[begin] if len(begin) else np.zeros(0, dtype=bool)
    begin, stop = begin[keep], stop[keep]
    doc = np.searchsorted(offsets, begin, side="right") - 1
    return Words(data, offsets, doc, begin, stop)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    body = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and len(data) else np.zeros(0, dtype=np.uint8)
    return body, at - at[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of each chunk of rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = raw(batch.column(text))
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK_BYTES, side="right")) - 1)
            stop = min(stop, batch.num_rows)
            yield batch.slice(at, stop - at), data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at]
            at = stop


def scan(batches: Iterator[pa.RecordBatch], text: str, table: np.ndarray, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for rows, data, offsets in chunks(batches, text):
        yield rows, words_of(LOWER[data] if lower else data, offsets, table)


def ints(rows: pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False)


def signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)
