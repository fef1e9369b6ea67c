"""Near copies by five-word shingles against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from threadline.llm import overlap, simhash


def _shingles(text: str) -> frozenset:
    words = (text or "").split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def _with(words: list, share: float, draw: random.Random) -> str:
    return " ".join(draw.choice("abcdefgh") * 3 + str(draw.randint(0, 999)) if draw.random() < share else w for w in words)


def _corpus(seed: int) -> dict[int, str]:
    draw = random.Random(seed)
    texts = []
    for n in (6, 12, 40, 120, 400, 900):
        for _ in range(12):
            base = [f"w{draw.randint(0, 5000)}" for _ in range(n)]
            texts += [" ".join(base)] + [_with(base, rate, draw) for rate in (0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1)]
    draw.shuffle(texts)
    return dict(enumerate([*texts, "", None, "one two"]))


def test_every_pair_is_found(spark):
    texts = _corpus(3)
    sets = {i: _shingles(t) for i, t in texts.items()}
    want = {(a, b) for a in sets for b in range(a) if sets[a] and sets[b] and sets[a] != sets[b] and _jaccard(sets[a], sets[b]) >= 0.8}
    assert len(want) > 200
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in sorted({(a, b) for a in sets for b in range(a) if _jaccard(sets[a], sets[b]) >= 0.8}):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    kept = {r["doc_id"] for r in simhash.representatives(docs, max_bits=0, segments=1).collect()}
    assert kept == {i for i in root if find(i) == i}


def test_links_hold_the_share(spark):
    """What comes out is checked on the sets; a group of near copies costs a few links a member."""
    draw = random.Random(5)
    base = [f"w{draw.randint(0, 5000)}" for _ in range(300)]
    texts = {i: _with(base, 0.004, draw) for i in range(900)} | {1000 + i: _with(base, 0.12, draw) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    kept = {r["doc_id"] for r in simhash.representatives(docs).collect()}
    sets = {i: _shingles(t) for i, t in texts.items()}
    alone = {i for i in sets if all(_jaccard(sets[i], sets[j]) < 0.8 for j in sets if j != i)}
    assert len(alone) > 50 and len(alone & set(range(900))) < 5
    assert kept == alone | {0}


@pytest.mark.parametrize("share", [0.8, 0.9])
def test_leaders_cover_their_bucket(share):
    draw = np.random.default_rng(7)
    base = draw.integers(0, 256, overlap.HASHES, dtype=np.uint8)
    seen = np.stack([np.where(draw.random(overlap.HASHES) < p, draw.integers(0, 256, overlap.HASHES), base) for p in np.linspace(0, 0.4, 50)]).astype(np.uint8)
    node, size = np.arange(50, dtype=np.uint64), np.full(50, 100)
    leads, links = overlap._clustered(node, size, seen, share)
    joined = {int(b) for _, y in links for b in y}
    assert leads[0] and all(leads[i] or i in joined for i in range(50))
