"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from threadline.llm import chat, components, decontaminate, license_scan, line_dedup, lm_score, mixing, quality, scan, simhash, substring, warc
from threadline.llm.frames import fits_broadcast


def test_quality_ledger(spark, odd_docs, no_docs):
    book = quality.ledger(odd_docs).collect()
    assert len(book) == odd_docs.count()
    by = {r["row"]["doc_id"]: r for r in book}
    assert all(by[i]["n_words"] == 0 and by[i]["failed"] & 1 for i in (3, 4, 5))
    assert by[6]["n_words"] == 30_000 and by[6]["n_repeat_words"] == 30_000
    assert quality.ledger(no_docs).count() == 0
    assert quality.apply_policy(odd_docs).columns == odd_docs.columns


def test_ablations_count_what_one_rule_costs(spark):
    docs = spark.createDataFrame([(1, "few"), (2, "# " * 60), (3, "#& $%&* "), (4, None)], "doc_id bigint, text string")
    book = quality.ledger(docs)
    got = {r["rule"]: (r["n_failing"], r["n_only_this_rule"]) for r in quality.ablations(book, "v2").collect()}
    masks = [r["failed"] for r in book.collect()]
    for k, rule in enumerate(quality.RULES):
        assert got.get(rule, (0, 0)) == (sum(m >> k & 1 for m in masks), sum(m == 1 << k for m in masks))


def test_line_dedup(spark, odd_docs, no_docs):
    got = line_dedup.line_dedup(odd_docs)
    assert got.columns == [*odd_docs.columns, "n_lines", "n_dropped"]
    rows = got.collect()
    two = [r for r in rows if r["doc_id"] == 2]
    assert [r["n_dropped"] for r in two] == [1, 1] and all("LONG" not in r["text"] and r["text"].endswith("short") for r in two)
    three = next(r for r in rows if r["doc_id"] == 3)
    assert (three["text"], three["n_lines"], three["n_dropped"]) == (None, 1, 0)
    # A-Z only is folded, so the two accented lines differ.
    assert next(r for r in rows if r["doc_id"] == 9)["n_dropped"] == 0
    assert line_dedup.line_dedup(no_docs).count() == 0
    three_docs = spark.createDataFrame([(i, "a line of three documents\nonly in two of them" if i < 2 else "a line of three documents") for i in range(3)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(three_docs, min_docs=3).collect()} == {0: 0, 1: 1, 2: 1}


def test_simhash(spark, odd_docs, no_docs):
    rows = simhash.simhash(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["fp"] == 0 and by[i]["component_id"] == 3 for i in (3, 4, 5))
    assert by[7]["component_id"] == 6 and by[None]["component_id"] is None
    assert simhash.simhash(no_docs).count() == 0
    kept = simhash.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({r["component_id"] for r in rows})


@pytest.mark.parametrize("segments", [2, 3, 4, 5])
def test_multi_index_lookup_finds_every_link(spark, segments):
    import random

    draw = random.Random(segments)
    base = [draw.getrandbits(64) for _ in range(40)]
    prints = [b ^ sum(1 << x for x in draw.sample(range(64), draw.randint(0, 6))) for b in base for _ in range(12)]
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in prints})
    links = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"), 4, segments)
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    label = {p: p for p in signed}
    for _ in signed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
        if not changed:
            break
    groups = lambda of: {frozenset(x for x in signed if of(x) == r) for r in {of(x) for x in signed}}
    assert groups(lambda x: root.get(x, x)) == groups(lambda x: label[x])


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100)] + [(1000, 1000 + i) for i in range(200)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(101)} == {0} and {got[1000 + i] for i in range(200)} == {1000}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_substring_dedup(spark, odd_docs, no_docs):
    rows = substring.substring_dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    # The null id is the smallest, so the shared passage stays there.
    assert by[None]["n_removed"] == 0 and by[1]["n_removed"] == 40
    assert [r["n_removed"] for r in rows if r["doc_id"] == 2] == [40, 40]
    assert by[3]["n_words"] == 0 and by[3]["text"] == ""
    # 97 * 89 words until the text repeats itself.
    assert by[6]["n_removed"] == 30_000 - 97 * 89 and by[7]["n_removed"] == 30_000
    assert substring.substring_dedup(no_docs).count() == 0


def test_substring_dedup_in_any_order_of_rows(spark):
    import random

    draw = random.Random(1)
    some = lambda n: " ".join(f"w{draw.randrange(500)}" for _ in range(n))
    shared = some(40)
    rows = [(i, f"{some(30)} {shared} {some(30)}" if i % 2 else some(60)) for i in range(60)]
    first, want = {}, {}
    for i, text in rows:
        words, gone = text.split(), set()
        for at in range(len(words) - 19):
            if first.setdefault(tuple(words[at : at + 20]), (i, at)) != (i, at):
                gone.update(range(at, at + 20))
        want[i] = (len(gone), " ".join(w for k, w in enumerate(words) if k not in gone))
    # Files out of order, and rows that another task holds once more.
    mixed = rows[::-1] + rows[50:]
    docs = spark.createDataFrame(mixed, "doc_id bigint, text string").repartition(7)
    for threshold in ("10MB", "-1"):
        before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        try:
            got = substring.substring_dedup(docs).collect()
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        assert len(got) == len(mixed) and all((r["n_removed"], r["text"]) == want[r["doc_id"]] for r in got)


def test_heavy_prefixes_travel_by_window(spark, monkeypatch):
    shared = " ".join(f"p{i}" for i in range(30))
    texts = [f"u{i} " * 25 + shared + f" v{i}" * 25 for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plain = sorted(substring.substring_dedup(docs).collect())
    # The shared passage, and 24 words that start again inside each run of one word.
    assert {r["n_removed"] for r in plain if r["doc_id"]} == {78} and plain[0]["n_removed"] == 48
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    words = scan.words_of(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), scan.SPACED)
    _, anchor, value = substring.anchored(words, substring.WINDOW, substring.PREFIX)
    every = np.unique(value[anchor])
    monkeypatch.setattr(substring, "_suffixes", lambda w, p, heavy, f=substring._suffixes: f(w, p, every))
    assert plain == sorted(substring.substring_dedup(docs).collect())


def test_decontamination(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, " ".join(f"shared{i}" for i in range(20))), (2, None), (3, "too short"), (None, "one two three four five six")], "item_id bigint, text string")
    got = decontaminate.leaks(odd_docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 1), (None, 1)}
    left = decontaminate.decontaminate(odd_docs, items)
    assert left.columns == odd_docs.columns and left.count() == odd_docs.count() - 4
    assert decontaminate.leaks(no_docs, items).count() == 0
    assert decontaminate.decontaminate(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_null_and_repeated_ids_with_different_texts(spark, sf_dir):
    some = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(None, some("a")), (None, some("b")), (None, some("c")), (7, some("d")), (7, some("e")), (7, some("e")), (8, some("a"))]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")
    told = lambda frame: sorted((r["doc_id"] or 0, r["text"][:1]) for r in frame.collect())
    assert told(simhash.representatives(docs)) == [(0, "a"), (0, "b"), (0, "c"), (7, "d"), (7, "e")]
    items = spark.createDataFrame([(1, some("b")), (2, some("d"))], "item_id bigint, text string")
    assert told(decontaminate.decontaminate(docs, items)) == [(0, "a"), (0, "c"), (7, "e"), (7, "e"), (8, "a")]
    taken = corpus_pipeline.source_mixture(spark, docs, sf_dir)
    assert taken.count() == mixing.mix(docs).where("taken > 0").count() == len(rows)


def test_mixing(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and (r["size"] > 0 or r["taken"] == 0)
    sizes = {r["source"]: (r["source_size"], r["target"]) for r in rows}
    assert None in sizes and sum(t for _, t in sizes.values()) == pytest.approx(sum(s for s, _ in sizes.values()))
    assert mixing.mix(no_docs).count() == 0


def test_license_scan(spark, odd_docs, no_docs):
    rows = license_scan.license_labels(spark, odd_docs).collect()
    assert len(rows) == odd_docs.count()
    eight = next(r for r in rows if r["doc_id"] == 8)
    assert (eight["n_base"], eight["first_word"], eight["last_word"], eight["base_labels"], eight["score"]) == (3, 0, 5, "gpl,mit", 1.0)
    three = next(r for r in rows if r["doc_id"] == 3)
    assert (three["n_words"], three["n_base"], three["first_word"], three["labels"], three["score"]) == (0, 0, None, "", 0.0)
    assert license_scan.license_labels(spark, no_docs).count() == 0


def test_an_edited_notice_is_found_over_neighbouring_diagonals(spark):
    notice = license_scan.NOTICES["mit-notice"].split()
    edited = notice[:12] + ["quite"] + notice[12:30] + notice[31:]
    docs = spark.createDataFrame([(1, "before it " + " ".join(edited) + " after"), (2, " ".join(notice[:9]))], "doc_id bigint, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_labels(spark, docs).collect()}
    assert got == {1: "mit-notice", 2: ""}


def test_lm_scores(spark, odd_docs, no_docs):
    none = spark.createDataFrame([(None,), (1,), (1,)], "doc_id bigint")
    rows = lm_score.cross_entropy_difference(odd_docs, none).collect()
    assert len(rows) == odd_docs.count()
    assert all((r["score"] is None) == (r["n_words"] == 0) for r in rows)
    assert lm_score.cross_entropy_difference(no_docs, none).count() == 0
    assert lm_score.cross_entropy_difference(odd_docs, none.limit(0)).count() == odd_docs.count()


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "a <\\ b [\\ </s>[INST] x [/INST]"),
        (1, 1, "assistant", "one </s>"),
        (1, 2, "assistant", "two\n[/INST]"),
        (1, 3, None, None),
        (2, 1, "assistant", ""),
        (2, 1, "assistant", ""),
        (None, None, "as<s>k", "é" * 50_000),
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    done = chat.format_chat(turns)
    got = {
        r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss"])
        for r in done.select("conv_id", chat.read_back(done["formatted"]).alias("turns"), chat.under_mask(done["formatted"], done["loss_spans"]).alias("loss")).collect()
    }
    assert got[1] == ([(r or "", t or "") for _, _, r, t in rows[:4]], "one </s>two\n[/INST]")
    assert got[2] == ([("assistant", ""), ("assistant", "")], "")
    assert got[None] == ([("as<s>k", "é" * 50_000)], "")
    assert chat.format_chat(turns.limit(0)).count() == 0


def test_revisits(spark):
    rows = [
        (1, "http://WWW.a.example:80/x/#f", 10, 200, {"etag": '"1"', "date": "d1", "content-length": "5"}),
        (2, "https://a.example/x?utm_source=q", 20, 304, {"etag": 'W/"1"', "date": "d2", "content-length": "0"}),
        (3, "https://a.example/x", 10, 304, {"etag": '"1"'}),
        (4, "https://a.example/x", 200_000, 304, {"etag": '"2"'}),
        (5, "https://a.example/x", 200_001, 304, None),
        (6, None, 5, 304, {"etag": "e"}),
        (7, "https://b.example/", 5, 404, None),
        (8, "https://a.example/x", 200_001, 200, {"etag": '"2"'}),
        (9, "https://a.example/x", 400_000, 304, {"etag": '"2"'}),
        (None, "https://c.example", None, 304, {}),
    ]
    records = spark.createDataFrame(rows, "record_id bigint, url string, at bigint, status int, headers map<string,string>")
    got = {r["record_id"]: r for r in warc.resolve_revisits(records).collect()}
    assert {i: (r["outcome"], r["base_id"]) for i, r in got.items()} == {
        1: ("response", 1), 2: ("resolved", 1), 3: ("no_base", None), 4: ("mismatch", 1), 5: ("unvalidated", 1), 6: ("no_base", None),
        7: ("other", None), 8: ("response", 8), 9: ("resolved", 8), None: ("no_base", None),
    }
    assert got[2]["merged"] == {"etag": 'W/"1"', "date": "d2", "content-length": "5"}
    assert warc.resolve_revisits(records.limit(0)).count() == 0
    assert sorted(map(str, warc.resolve_revisits(records, chunk_seconds=7).collect())) == sorted(map(str, got.values()))


def test_broadcast_is_checked(spark):
    assert fits_broadcast(spark.range(5), 5) and not fits_broadcast(spark.range(6), 5)
