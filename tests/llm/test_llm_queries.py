"""Every query of the subpackage against its SQL twin, or against brute force where SQL cannot express it."""

from __future__ import annotations

import math
import os
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from check_oracle import connect, difference

import corpus_pipeline
from threadline.llm import decontaminate, lm_score, mixing, queries
from threadline.llm.scan import LOWER


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, sf_dir, con, name):
    assert difference(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLE[name]) is None


def _documents(con):
    return con.execute("SELECT doc_id, text, source FROM documents ORDER BY doc_id").fetchall()


def _grams(text: str, k: int) -> list:
    words = (text or "").encode().translate(bytes(LOWER)).split()
    return [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def _fingerprint(text: str, k: int = 4) -> int:
    grams = _grams(text, k)
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _classes(prints: dict, sets: dict | None = None) -> dict:
    """Classes by fingerprints within 4 bits, and by a Jaccard similarity of 0.8 of the sets."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            alike = sets and min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
            if alike or (prints[a] ^ prints[b]).bit_count() <= 4:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def test_simhash_equals_all_pairs(spark, sf_dir, con):
    prints = {i: _fingerprint(t) for i, t, _ in _documents(con)}
    roots = _classes(prints)
    got = queries.QUERIES["op9_simhash_near_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}


def _canonical(text: str) -> list:
    """(canonical word, own word, slot) by the rules of the operator, one word at a time."""
    body, out, end = (text or "").encode(), [], None
    for m in re.finditer(rb"(?:[0-9A-Za-z\x80-\xff]|(?<=[0-9])[.,](?=[0-9]))+", body):
        word = m[0]
        plain = word.translate(bytes(LOWER))
        gap = b"." if end is None else body[end : m.start()]
        if re.fullmatch(rb"[0-9.,]+", word):
            kind = "number"
        elif out and out[-1][0] == "<number>" and plain.decode() in decontaminate.UNITS:
            kind = "unit"
        elif not re.search(rb'[.!?:;\n"]', gap) and re.match(rb"[A-Z][a-z]", word):
            kind = "name"
        else:
            kind = None
        out.append((f"<{kind}>" if kind else plain, plain, kind is not None))
        end = m.end()
    return out


def _cut(words: list, k: int) -> list:
    return [(i, tuple(w[0] for w in words[i : i + k]), [w[1] for w in words[i : i + k] if w[2]]) for i in range(len(words) - k + 1) if sum(w[2] for w in words[i : i + k]) <= k // 2]


def _leaks(docs: dict, items: dict) -> dict:
    index, totals = defaultdict(list), {}
    for item, text in items.items():
        words = _canonical(text)
        k = min(8, len(words))
        cut = _cut(words, k) if k >= decontaminate.MIN_WORDS else []
        totals[item] = len(cut)
        for i, key, slots in cut:
            index[(k, key)].append((item, i, slots))
    out = {}
    for doc, text in docs.items():
        hits = defaultdict(list)
        words = _canonical(text)
        for k in sorted({k for k, _ in index}):
            for pos, key, slots in _cut(words, k):
                for item, i, islots in index.get((k, key), ()):
                    hits[item].append((pos, i, list(zip(islots, slots, strict=True))))
        for item, found in hits.items():
            found.sort(key=lambda h: h[:2])
            places, last = [], None
            for h in found:
                if last is None or h[0] - last > 16:
                    places.append([])
                places[-1].append(h)
                last = h[0]
            best = 0
            for place in places:
                pairs = {p for h in place for p in h[2]}
                steady = len({a for a, _ in pairs}) == len(pairs)
                best = max(best, len({h[1] for h in place if steady or all(a == b for a, b in h[2])}))
            if best / totals[item] >= 0.5:
                out[(doc, item)] = best
    return out


def test_leaks_equal_brute_force(spark, sf_dir, con):
    items = dict(con.execute("SELECT item_id, text FROM benchmark").fetchall())
    want = _leaks({i: t for i, t, _ in _documents(con)}, items)
    got = queries.QUERIES["op5_benchmark_decontamination"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["item_id"]): r["n_hits"] for r in got} == want and want


def test_reparameterised_questions_are_caught(spark):
    ask = "In the morning Anna buys {} kg of apples for 3 euro and gives {} kg to her brother, how many does Anna keep"
    items = spark.createDataFrame([(1, ask.format(5, 2))], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [
            (1, "Before it. " + ask.format(5, 2)),
            (2, "Before it. " + ask.format(9, 4).replace("Anna", "Bob").replace("kg", "lb")),
            (3, ask.format(9, 4).replace("keep", "throw away")[:70]),
            (4, ask.format(9, 4).replace("Anna", "Bob", 1)),
            (5, "1 2 3 4 5 6 7 8 9 10 11 12"),
        ],
        "doc_id bigint, text string",
    )
    got = {r["doc_id"]: r["kind"] for r in decontaminate.leaks(docs, items).collect()}
    assert got.get(1) == "verbatim" and got.get(2) == "reparameterised"
    # One name became two: its slots contradict each other.
    assert not {4, 5} & set(got)


def _found_in(spark, item: str, *texts: str) -> set:
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"] for r in decontaminate.leaks(docs, items).collect()}


def test_two_copies_in_a_row_are_two_places(spark):
    ask = "in a shop there are {} red balls and {} blue balls in one large box, how many balls are there in the box when {} are taken away"
    assert _found_in(spark, ask.format(3, 3, 2), ask.format(4, 6, 1), f"{ask.format(5, 8, 4)}. {ask.format(7, 9, 3)}.", "no balls at all") == {0, 1}


def test_names_that_start_a_sentence_and_glued_units(spark):
    ask = "{0} has {1} apples. {0} buys {2} more at the shop. {0} eats {3} of them today. {0} then bakes {4} cakes. How many apples are left?"
    assert _found_in(spark, ask.format("Tom", 5, 7, 2, 3), ask.format("Anna", 9, 8, 4, 6), ask.format("Élodie", 9, 8, 4, 6), "Tom has apples") == {0, 1}
    flour = "a baker mixes {}kg of flour with {}ml of water and bakes bread for {}min"
    assert _found_in(spark, flour.format(5, 300, 40), flour.format(7, 450, 55), flour.format("7 ", "450 ", "55 ")) == {0, 1}
    assert _found_in(spark, "Seven brave sailors cross the sea", "we read that Seven brave sailors cross the sea") == {0}


def test_verbatim_copies_of_slots_and_short_items(spark):
    for item in ("Compute 12 + 35 * 7 - 4 / 2 + 18 * 3", "Which Famous French Painter Lived Near The Old Harbour", "name three rivers"):
        assert _found_in(spark, item, f"once asked: {item}, and more", "name two rivers, 12 + 36") == {0}


def test_scores_equal_a_plain_model(spark, sf_dir, con):
    docs = {i: (t or "").encode().translate(bytes(LOWER)).split() for i, t, _ in _documents(con)}
    good = {r[0] for r in con.execute("SELECT doc_id FROM labels WHERE quality = 1").fetchall()}
    words, pairs = (Counter(), Counter()), (Counter(), Counter())
    for i, ws in docs.items():
        for k in (0, 1) if i in good else (1,):
            words[k].update(ws)
    total = sum(words[1].values())
    known = {w for w, n in words[1].items() if n >= max(2, lm_score.WORD_SHARE * total)}
    folded = {i: [w if w in known else None for w in ws] for i, ws in docs.items()}
    single = [Counter(), Counter()]
    for i, ws in folded.items():
        for k in (0, 1) if i in good else (1,):
            single[k].update(ws)
            pairs[k].update(zip(ws, ws[1:], strict=False))
    kept = {p for p, n in pairs[1].items() if n >= max(2, lm_score.PAIR_SHARE * total)}
    p1 = lambda k, w: (single[k][w] + 1) / (sum(single[k].values()) + len(known) + 1)

    def loss(k, ws):
        out = -math.log(p1(k, ws[0]))
        for h, w in zip(ws, ws[1:], strict=False):
            share = pairs[k][(h, w)] / single[k][h] if (h, w) in kept and single[k][h] else 0
            out -= math.log(lm_score.LAMBDA * share + (1 - lm_score.LAMBDA) * p1(k, w))
        return out / len(ws)

    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op8_lm_score"](spark, sf_dir).collect()}
    assert set(got) == set(docs)
    for i, ws in list(folded.items())[::5]:
        assert got[i] is None if not ws else got[i] == pytest.approx(loss(0, ws) - loss(1, ws), abs=1e-9)


def test_scores_separate_held_out_documents(spark):
    good = [(i, f"fine prose about rivers and hills number {i} " * 6) for i in range(60)]
    bad = [(100 + i, f"click here cheap offer buy now {i} " * 6) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id bigint, text string")
    marks = spark.createDataFrame([(i,) for i in range(30)], "doc_id bigint")
    got = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy_difference(docs, marks).collect()}
    assert max(got[i] for i in range(30, 60)) < min(got[i] for i in range(100, 160))


def test_rare_words_keep_their_signal(spark):
    rare = [(i, "zeta omega") for i in (1, 2, 3)]
    docs = spark.createDataFrame([*rare, (4, "other thing"), (5, "other thing"), (10, "common words again " * 150_000)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(1,), (2,)], "doc_id bigint")
    got = {r["doc_id"]: r["score"] for r in lm_score.cross_entropy_difference(docs, marks).collect()}
    # Three in 450,000 words; document 3 is held out.
    assert got[3] < got[4] - 1


def test_scores_do_not_depend_on_the_head(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, "lonely unseen pair"), (None, "another null one")], docs.schema))
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    scores = lambda: sorted((r["doc_id"] or -1, r["n_words"], r["target_loss"] or 0, r["background_loss"] or 0) for r in lm_score.cross_entropy_difference(docs, marks).collect())
    whole = scores()
    monkeypatch.setattr(lm_score, "HEAD_WORDS", 1e-3)
    monkeypatch.setattr(lm_score, "HEAD_PAIRS", 1e-3)
    small = scores()
    assert len(whole) == len(small) == docs.count()
    for a, b in zip(whole, small, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_scores_do_not_depend_on_slices_and_shares(spark, sf_dir, monkeypatch, tmp_path):
    """Many slices and shares give the same scores, and the tables of the pairs do not stay on the disk."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120)
    docs = docs.union(docs.limit(5)).union(spark.createDataFrame([(None, "lonely unseen pair"), (7, None)], docs.schema))
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    made = []
    monkeypatch.setattr(lm_score, "new_run_dir", lambda spark, label: made.append((label, f"{tmp_path}/{label}-{len(made)}")) or made[-1][1])
    scores = lambda: sorted((r["doc_id"] or -1, r["n_words"], r["target_loss"] or 0, r["background_loss"] or 0) for r in lm_score.cross_entropy_difference(docs, marks).collect())
    whole = scores()
    assert not [path for label, path in made if label in ("pairs", "pair_changes") and os.path.exists(path)]
    for name, value in (("PAIRS_HELD", 5_000), ("KEYS_HELD", 2_000), ("SHARE_WORDS", 10_000), ("HEAD_WORDS", 1e-3), ("HEAD_PAIRS", 1e-3)):
        monkeypatch.setattr(lm_score, name, value)
    cut = scores()
    assert len([label for label, _ in made if label == "scored"]) == 1 + lm_score.SHARES
    assert len(whole) == len(cut) == docs.count()
    for a, b in zip(whole, cut, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-9)


def test_pipeline_stages_against_brute_force(spark, sf_dir, con):
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, states = docs.columns, []
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, sf_dir)
        states.append(docs.collect())
        docs = spark.createDataFrame(states[-1], docs.schema)
    by = dict(zip(names, states, strict=True))
    assert all(r.__fields__ == columns for n in names[:-1] for r in by[n][:1])
    passed = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLE['op6_quality_ledger']}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in by["quality_rules"]} == passed
    keeper: dict = {}
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").encode().translate(bytes(LOWER)).decode() for x in (t or "").split("\n")]
    for r in sorted(by["quality_rules"], key=lambda r: r["doc_id"]):
        for k in keys(r["text"]):
            keeper.setdefault(k, r["doc_id"])
    want = {
        r["doc_id"]: "\n".join(x for x, k in zip(r["text"].split("\n"), keys(r["text"]), strict=True) if len(k) < 10 or keeper[k] == r["doc_id"])
        for r in by["quality_rules"]
    }
    assert {r["doc_id"]: r["text"] for r in by["line_dedup"]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in by["line_dedup"])
    roots = _classes({i: _fingerprint(t, 5) for i, t in want.items()}, {i: frozenset(_grams(t, 5)) for i, t in want.items()})
    alone = {i for i, root in roots.items() if i == root}
    assert {r["doc_id"] for r in by["simhash_near_dedup"]} == alone
    leaking = {d for d, _ in _leaks({i: want[i] for i in alone}, dict(con.execute("SELECT item_id, text FROM benchmark").fetchall()))}
    assert {r["doc_id"] for r in by["benchmark_decontamination"]} == alone - leaking
    mixed = by["source_mixing"]
    assert {r["doc_id"] for r in mixed} <= alone - leaking
    taken, target = Counter(), {}
    for r in mixed:
        assert r["size"] == len(want[r["doc_id"]].encode().split()) and r["taken"] <= 3 * r["size"] and r["text"] == want[r["doc_id"]]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    largest = max(r["size"] for r in mixed)
    assert all(abs(taken[s] - target[s]) <= largest for s in target)


def test_mix_prefers_quality_and_reruns_agree(spark):
    docs = spark.createDataFrame([(i, "a b c d", "big") for i in range(4000)] + [(9000, "x " * 50, "small")], "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([(i, 5.0 if i % 2 else 0.2) for i in range(4000)], "doc_id bigint, weight double")
    first, again = (sorted(mixing.mix(docs, weights, weights=(1, 3)).collect()) for _ in range(2))
    assert first == again
    low = {r["doc_id"]: r for r in first}
    assert low[9000]["target"] == 150 and low[9000]["taken"] == 150
    # The other source has what is left: all but 100 words of its own size.
    odd, even = (sum(low[i]["taken"] for i in range(k, 4000, 2)) for k in (1, 0))
    assert odd >= even and odd + even == pytest.approx(low[0]["target"], abs=4)
