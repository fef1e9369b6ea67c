"""Repeated records, columns with clashing names, and benchmark items that are too short to tell."""

from __future__ import annotations

from collections import Counter

from threadline.llm import chat, decontaminate, warc

RECORD = "record_id bigint, url string, at bigint, status int, headers map<string,string>"


def test_repeated_records_give_as_many_rows(spark):
    rows = [
        (1, "http://a.example/", 10, 200, {"etag": '"1"', "server": "x"}), (1, "http://a.example/", 10, 200, {"etag": '"1"', "server": "x"}),
        (2, "http://a.example/", 20, 304, {"etag": '"1"'}), (2, "http://a.example/", 20, 304, {"etag": '"1"'}),
        # The same id under another URL answers only there.
        (1, "http://b.example/", 5, 200, {"etag": '"9"'}), (3, "http://b.example/", 6, 304, {"etag": '"9"'}),
    ]
    got = warc.resolve_revisits(spark.createDataFrame(rows, RECORD)).collect()
    assert Counter((r["record_id"], r["outcome"]) for r in got) == {(1, "response"): 3, (2, "resolved"): 2, (3, "resolved"): 1}
    assert all(r["merged"]["server"] == "x" for r in got if r["record_id"] == 2)
    assert next(r["merged"] for r in got if r["record_id"] == 3) == {"etag": '"9"'}


def test_extra_columns_with_clashing_names(spark):
    rows = [(1, "http://a.example/", 10, 200, {"etag": "e"}, "c", "o", 7), (2, "http://a.example/", 20, 304, {"etag": "e"}, "c", "o", 7)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, RECORD + ", canonical string, row string, id bigint")).collect()
    assert {(r["record_id"], r["canonical"], r["outcome"], r["row"], r["id"]) for r in got} == {(1, "a.example", "response", "o", 7), (2, "a.example", "resolved", "o", 7)}
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x", 1), (1, 0, "user", "hi", "x", 1)], "conv_id bigint, turn bigint, role string, text string, turns string, formatted int")
    made = chat.format_chat(turns).collect()
    assert len(made) == 1 and made[0]["formatted"].count("hi") == 2


def test_short_items_remove_nothing(spark):
    items = spark.createDataFrame([(1, "Yes"), (2, "the answer"), (3, "name three rivers"), (4, ""), (5, None)], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "yes it is the answer"), (2, "please name three rivers for us"), (3, "nothing here"), (4, "Yes")], "doc_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.leaks(docs, items).collect()}
    assert found == {(1, 1): "short", (1, 2): "short", (4, 1): "short", (2, 3): "verbatim"}
    assert {r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()} == {1, 3, 4}


def test_offsets_over_several_chunks(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(c, t, ["user", "assistant", "assistant", None][(t * 7 + c) % 4], f"<{t}[" * (t % 3)) for c in range(4) for t in range(700 * c + 1)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")

    def made(df):
        return sorted((r["conv_id"], r["formatted"], tuple(map(tuple, r["loss_spans"]))) for r in df.collect())

    whole = made(chat.format_chat(turns))
    monkeypatch.setattr(chat, "PREFIX_CHUNK", 3)
    assert made(chat.format_chat(turns)) == whole
    said = {c: "".join(text or "" for cc, _, role, text in rows if cc == c and role == "assistant") for c in range(4)}
    for c, formatted, spans in whole:
        assert "".join(formatted[s : s + n] for s, n in spans).replace("[\\", "[").replace("<\\", "<") == said[c]
    read = chat.format_chat(turns).select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()
    assert {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in read} == {c: [(role or "", text) for cc, _, role, text in rows if cc == c] for c in range(4)}
