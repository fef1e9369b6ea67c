"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share of the budget, limited to ``max_epochs`` times
its size; what a limit leaves over is shared again by weight. A source takes as
many complete epochs as fit its target; the rest is a weighted sample without
replacement: every document gets the key -ln(u) / quality, documents are
sorted by key within their source, and a prefix sum of sizes is cut at the
budget.

A hot source is not one group: keys are cut into equal slices of their
distribution, prefix sums run per (source, slice) and slices are offset by the
sums of those before them (one row per slice and source).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.llm.frames import NULL_ID
from threadline.llm.scan import SPACED, chunks, words_of

#: Slices per source for the prefix sums.
SLICES = 1024


def _sizes(batches):
    for rows, data, offsets in chunks(batches, "_text"):
        yield pa.RecordBatch.from_arrays(
            [rows.column("_row"), pa.array(words_of(data, offsets, SPACED).counts.astype("int64"))], ["_row", "size"]
        )


def targets(per_source: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """``target`` of every row of (source, source_size); the weights repeat over sources by name, null last.

    With sources in ascending order of limit / weight, those before the water
    level stand at their limit and the others share what is left by weight, so
    the level is the first that does not pass the next limit. One row per
    source: a source is a named dataset, not something that grows with rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name) - 1
    ranked = per_source.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), place % len(weights)).cast("bigint"))
    ranked = ranked.withColumn("limit", F.col("source_size") * max_epochs)
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("own", level).withColumn("open", F.col("own") * F.col("weight") < F.col("limit"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("limit") / F.col("weight"), F.col("own")))).over(Window.partitionBy())
    return leveled.withColumn("level", final["own"]).select(
        "source",
        "source_size",
        F.when(F.col("level").isNull(), F.col("limit").cast("double"))
        .otherwise(F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")))
        .alias("target"),
    )


def uniform(id_: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on id and seed alone, so that reruns agree."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), id_.cast("string")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))


def mix(
    docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 7
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    ``quality`` has ``doc_id`` and a positive ``weight``, one row per id (no row,
    null or not positive: 1); it meets ids and sizes only, never a text. The document at the cut is taken if that brings the source
    nearer to its target. Null text has size 0 and takes 0; null sources are one
    source, sorted last; a null id draws like any other id. Ties in the key go
    to the smaller id, then the smaller size. Repeated rows draw the same
    number, and each is taken on its own.
    """
    light = F.struct(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"),
        F.col("source").alias("source"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("id"),
    )
    packed = docs.select(light.alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    shape = packed.select("_row").schema["_row"].dataType.simpleString()
    sized = packed.mapInArrow(_sizes, f"_row {shape}, size bigint").select("_row.row", "_row.source", "_row.id", "size")
    if quality is None:
        sized = sized.withColumn("factor", F.lit(1.0))
    else:
        rated = quality.select(F.col("doc_id").alias("rated"), F.col("weight").cast("double").alias("w"))
        sized = sized.join(rated, F.col("id") == F.col("rated"), "left").withColumn("factor", F.when(F.col("w") > 0, F.col("w")).otherwise(F.lit(1.0))).drop("rated", "w")
    key = -F.log(uniform(F.col("id"), seed)) / F.col("factor")
    # exp(-key) is uniform where the factor is 1: a fixed cut of it gives even slices.
    slice_ = F.floor((1 - F.exp(-key)) * SLICES).cast("int")
    drawn = sized.withColumn("key", key).withColumn("slice", slice_)
    slices = drawn.groupBy("source", "slice").agg(F.sum("size").alias("in_slice"))
    whole = targets(slices.groupBy("source").agg(F.sum("in_slice").alias("source_size")), weights, max_epochs)
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("before", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)))
    plan = (
        offsets.join(whole.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("s"), F.col("slice").alias("p"), "before", "source_size", "target")
    )
    rows = drawn.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("p"))).drop("s", "p")
    inside = Window.partitionBy("source", "slice").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("upto", F.col("before") + F.sum("size").over(inside)).withColumn("epochs", epochs)
    # Half a document: the cut falls to the nearer side.
    partial = F.col("upto") - F.col("size") / 2 <= F.col("target") - F.col("epochs") * F.col("source_size")
    taken = F.col("size") * (F.col("epochs") + F.when(partial & (F.col("epochs") < max_epochs), 1).otherwise(0))
    own = [c for c in docs.columns if c not in ("text", "size", "source_size", "target", "taken")]
    return rows.select(*[F.col(f"row.`{c}`") for c in own], "size", "source_size", "target", taken.cast("bigint").alias("taken"))
