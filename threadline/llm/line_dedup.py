"""Line dedup: repeated lines stay only in the first document that holds them.

Lines are exploded to (hash of the normalised line, document, position). One
aggregate per hash gives the smallest and the largest document that holds it,
which is all that "how many documents" needs for a threshold of two; for higher
thresholds distinct (hash, document) pairs are counted. Positions to drop are
gathered per document and the text is put together again by position.

A hot line (a third of all documents) meets in the aggregate as one partial row
per task, and in the join as the left side of a join that adaptive execution
splits. Hashes have 128 bits.

Defined results: null text is one empty line. Ids tell documents apart, null
is the smallest id; rows with the same id are one document. Columns other than
the text pass through, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.llm.frames import keyed
from threadline.llm.scan import LOWER

STRIPPED = b" \t\n\x0b\x0c\r"
_TABLE = bytes(LOWER)


def _line_keys(min_chars: int):
    def run(batches):
        for batch in batches:
            out = {"_id": [], "_h": [], "pos": [], "key": []}
            ids, marks = batch.column("_id").to_pylist(), batch.column("_h").to_pylist()
            for doc, mark, text in zip(ids, marks, batch.column("_text").cast(pa.binary()).to_pylist(), strict=True):
                for pos, line in enumerate(text.split(b"\n")):
                    key = line.strip(STRIPPED)
                    # A code point has 1 to 4 bytes, so most lines need no count.
                    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
                        continue
                    out["_id"].append(doc)
                    out["_h"].append(mark)
                    out["pos"].append(pos)
                    out["key"].append(xxhash.xxh3_128_digest(key.translate(_TABLE)))
            yield pa.RecordBatch.from_pydict(out, schema=_LINES)

    return run


_LINES = pa.schema([("_id", pa.int64()), ("_h", pa.int64()), ("pos", pa.int32()), ("key", pa.binary())])


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with rewritten ``text``, and ``n_lines`` (before) and ``n_dropped``.

    A line whose key has ``min_chars`` code points or more and is held by
    ``min_docs`` documents or more goes, except from the smallest ``doc_id``
    that holds it. Lines that stay are joined by a line feed.
    """
    rows = keyed(docs)
    lines = rows.select("_id", "_h", "_text").mapInArrow(_line_keys(min_chars), "_id bigint, _h bigint, pos int, key binary")
    if min_docs <= 2:
        held = lines.groupBy("key").agg(F.min("_id").alias("keeper"), F.max("_id").alias("last"))
        repeated = held.where("keeper < last") if min_docs == 2 else held
    else:
        held = lines.groupBy("key", "_id").agg(F.lit(1).alias("one")).groupBy("key")
        repeated = held.agg(F.min("_id").alias("keeper"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    drops = (
        lines.join(repeated.select("key", "keeper"), "key")
        .where("_id <> keeper")
        .groupBy("_id", "_h")
        # One entry per line of the document; equal rows send the same places.
        .agg(F.collect_set("pos").alias("gone"))
    )
    # The text travels once, in its row.
    split = F.split(F.coalesce("row.text", F.lit("")), "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    joined = rows.drop("_text").join(drops, ["_id", "_h"], "left").withColumn("lines", split).withColumn("kept", places)
    text = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    # A document that loses nothing keeps its text untouched, null included.
    new_row = F.when(F.col("gone").isNull(), F.col("row")).otherwise(F.col("row").withField("text", text))
    return joined.select(
        F.inline(
            F.array(
                F.struct(
                    new_row.alias("_row"), F.size("lines").cast("bigint").alias("_lines"), (F.size("lines") - F.size("kept")).cast("bigint").alias("_dropped")
                )
            )
        )
    ).select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")], F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"))
