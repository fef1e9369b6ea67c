"""License scan by diagonal voting.

All rolling word k-gram hashes of every text are joined with the k-gram
positions of the templates. A hit votes for its diagonal, the text position
minus the template position: a copy of a template puts all its votes on one
diagonal, and an inserted or dropped word moves the rest to a neighbour. Votes
are counted per diagonal, neighbouring diagonals of long templates are merged,
and a span is verified by how much of the template it holds and how long it is.

The templates are a fixed table of a few hundred rows, so it is broadcast; the
texts' k-grams are never shuffled, only hits are, and those are keyed by
document. Phrases (two or three words) take pairs of words and must be complete
on one diagonal; long templates take four words.

Defined results: null text is empty and has no words; a null id comes back
null; rows equal in id and text each give a row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadline.llm.frames import bare_id, keyed
from threadline.llm.scan import ALNUM, ints, scan, signed, words_of

PHRASE_GRAM, TEXT_GRAM = 2, 4
#: Diagonals this close belong to one copy of a long template.
BAND = 6
#: Share of a long template's k-grams that a span must hold.
COVERAGE = 0.5

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public license notices and the labels that this method adds.
NOTICES = {
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
    "apache-notice": """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed
        under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND""",
    "gpl-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version""",
    "bsd-notice": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
        and the following disclaimer""",
    "spdx": "SPDX License Identifier",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def template_positions(phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> list[tuple]:
    """(key, template, label, exact, tpos, n_grams, n_words) of every k-gram of every template."""
    rows = []
    for exact, table in ((True, [(p, label) for p, label in phrases.items()]), (False, [(t, label) for label, t in notices.items()])):
        for number, (text, label) in enumerate(table):
            joined = " ".join(template_words(text)).encode()
            words = words_of(np.frombuffer(joined, dtype=np.uint8), np.array([0, len(joined)]), ALNUM)
            n = len(words.doc)
            whole = exact or n <= TEXT_GRAM
            at, grams = words.grams(words.hashes(), PHRASE_GRAM if whole else TEXT_GRAM)
            rows += [
                (int(key), f"{'p' if exact else 'n'}{number}", label, exact, whole, int(pos), len(at), n)
                for pos, key in zip(at, signed(grams), strict=True)
            ]
    return rows


_TEMPLATE_DDL = "key bigint, template string, label string, base boolean, whole boolean, tpos int, n_grams int, size int"
_GRAMS_DDL = "_id bigint, _h bigint, pos int, key bigint, n_words bigint"


def _grams(batches):
    for rows, words in scan(batches, "_text", ALNUM, lower=True):
        ids, hs, ordinal, hashes = ints(rows, "_id"), ints(rows, "_h"), words.ordinal().astype(np.int32), words.hashes()
        # One row per text, without a key, so that texts without a hit stay.
        none = pa.nulls(rows.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [rows.column("_id"), rows.column("_h"), pa.nulls(rows.num_rows, pa.int32()), none, pa.array(words.counts.astype(np.int64))],
            ["_id", "_h", "pos", "key", "n_words"],
        )
        for k in (PHRASE_GRAM, TEXT_GRAM):
            at, grams = words.grams(hashes, k)
            doc = words.doc[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[doc]), pa.array(hs[doc]), pa.array(ordinal[at]), pa.array(signed(grams)), pa.nulls(len(at), pa.int64())],
                ["_id", "_h", "pos", "key", "n_words"],
            )


def scan_licenses(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every verified span, and a row without a label per distinct text.

    ``_id``, ``_h``, ``label``, ``base``, ``start``, ``stop`` (words, stop excluded),
    ``coverage``; rows without a label have ``n_words`` and ``copies`` instead.
    """
    templates = F.broadcast(spark.createDataFrame(template_positions(), _TEMPLATE_DDL))
    grams = keyed(docs).select("_id", "_h", "_text").mapInArrow(_grams, _GRAMS_DDL)
    hits = grams.join(templates, "key", "left").where("template is not null or n_words is not null")
    what = ["_id", "_h", "template", "label", "base", "whole", "n_grams", "size"]
    votes = hits.groupBy(*what, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        # Distinct places: rows equal in id and text vote twice for the same ones.
        F.collect_set("tpos").alias("held"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
        F.max("n_words").alias("n_words"),
        F.count("n_words").alias("copies"),
    )
    # A phrase's diagonal stands alone; those of a long template join their neighbours.
    by = Window.partitionBy("_id", "_h", "template").orderBy("diagonal")
    near = ~F.col("whole") & (F.col("diagonal") - F.lag("diagonal").over(by) <= BAND)
    placed = votes.withColumn("apart", F.when(near, 0).otherwise(1)).withColumn("place", F.sum("apart").over(by))
    merged = placed.groupBy(*what, "place").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("n_held"),
        F.min("first").alias("start"),
        F.max("last").alias("last"),
        F.max("n_words").alias("n_words"),
        F.max("copies").alias("copies"),
    )
    spans = merged.withColumn("coverage", F.col("n_held") / F.col("n_grams")).withColumn(
        "stop", F.when(F.col("whole"), F.col("start") + F.col("size")).otherwise(F.col("last") + TEXT_GRAM)
    )
    complete = F.col("whole") & (F.col("n_held") == F.col("n_grams"))
    enough = ~F.col("whole") & (F.col("coverage") >= COVERAGE) & (F.col("stop") - F.col("start") <= 1.5 * F.col("size") + BAND)
    kept = spans.where(F.col("template").isNull() | complete | enough)
    return kept.select("_id", "_h", "label", "base", "start", "stop", "coverage", "n_words", "copies")


def license_labels(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``.

    Places and labels of phrases are the base; ``score`` is the best coverage of any span (0: none).
    """
    joined = lambda kept: F.array_join(F.sort_array(F.collect_set(kept)), ",")
    both = scan_licenses(spark, docs)
    per_text = both.groupBy("_id", "_h").agg(
        F.max("n_words").alias("n_words"),
        F.max("copies").alias("copies"),
        F.count(F.when(F.col("base"), 1)).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("bigint").alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined(F.col("label")).alias("labels"),
        F.coalesce(F.max("coverage"), F.lit(0.0)).alias("score"),
    )
    rows = per_text.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return rows.select(bare_id(F.col("_id")).alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
