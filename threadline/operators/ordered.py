"""Ordered operators that survive a key holding a large share of all rows.

A plain window over a key sorts the whole key in one task. Here every key is
cut into chunks of its order column, the window runs per (key, chunk), and what
crosses a chunk edge is carried over from one small summary row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadline.runtime import new_run_dir, stage

CHUNK = "_chunk"


def with_chunk(df: DataFrame, order: Column, width: int) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(order / F.lit(width)).cast("bigint"))


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: str, out: str, width: int
) -> DataFrame:
    """Inclusive running sum of a BIGINT column per key; ``order`` must be unique in a key."""
    rows = with_chunk(df, F.col(order), width)
    per_chunk = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.sum(value).alias("_total"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_total").over(
                    Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0).cast("bigint"),
            ),
        )
        .drop("_total")
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(per_chunk, [*keys, CHUNK])
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_before", CHUNK)


def row_ordinal(df: DataFrame, keys: list[str], order: str, out: str, width: int) -> DataFrame:
    """1-based position of a row in its key."""
    marked = df.withColumn("_one", F.lit(1).cast("bigint"))
    return running_sum(marked, keys, order, "_one", out, width).drop("_one")


def previous_row(
    df: DataFrame, keys: list[str], order: str, cols: list[str], width: int, prefix: str = "prev_"
) -> DataFrame:
    """The given columns of the preceding row of the key, as ``prev_<col>``.

    A key's first row has NULL in every added column and ``prev_exists`` false.
    """
    rows = with_chunk(df, F.col(order), width)
    state = F.struct(F.lit(True).alias("exists"), *cols)
    carried = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.max_by(state, F.col(order)).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(CHUNK)))
        .drop("_last")
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(order)
    joined = rows.join(carried, [*keys, CHUNK]).withColumn(
        "_prev", F.coalesce(F.lag(state).over(inside), F.col("_carry"))
    )
    added = {f"{prefix}{c}": F.col(f"_prev.{c}") for c in cols}
    added[f"{prefix}exists"] = F.coalesce(F.col("_prev.exists"), F.lit(False))
    return joined.withColumns(added).drop("_prev", "_carry", CHUNK)


def top_per_key(df: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """One whole row per key: the one that sorts first by ``rank``.

    The rank is folded to a comparable struct and reduced with ``min_by``, which
    combines on the map side; no task ever sorts a whole key.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.min_by(row, F.struct(*rank)).alias("_row")
    )
    return best.select("_row.*")


def running_max(
    df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int
) -> DataFrame:
    """Largest ``value`` (any ordered type, structs included) among the EARLIER rows of the key."""
    rows = with_chunk(df, F.col(order), width).withColumn("_value", value)
    along = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, CHUNK)
        .agg(F.max("_value").alias("_top"))
        .withColumn("_carry", F.max("_top").over(along))
        .drop("_top")
    )
    inside = Window.partitionBy(*keys, CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(carried, [*keys, CHUNK]).withColumn("_local", F.max("_value").over(inside))
    # greatest() skips NULLs but does not take structs, so compare by hand.
    best = (
        F.when(F.col("_local").isNull(), F.col("_carry"))
        .when(F.col("_carry").isNull() | (F.col("_local") >= F.col("_carry")), F.col("_local"))
        .otherwise(F.col("_carry"))
    )
    return joined.withColumn(out, best).drop("_value", "_carry", "_local", CHUNK)


def position(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """0-based position of every row in a total order, with no task holding more than its share.

    The rows are range partitioned and sorted, and the sorted frame is written
    once: a range partitioning samples its input, so only a stored one gives
    the same parts when it is read for the sizes and again for the rows.
    A row's position is the size of the parts before it plus its place in its own.
    ``order`` must be unique, or ties fall in any order.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = placed.withColumn("_mid", F.monotonically_increasing_id())
    rows = stage(marked, new_run_dir(spark, "position")).withColumns(
        {"_part": F.shiftright("_mid", 33), "_in_part": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))}
    )
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # One row per partition of the sort: always small.
    joined = rows.join(F.broadcast(starts), "_part")
    return joined.withColumn(out, F.col("_start") + F.col("_in_part")).drop("_part", "_start", "_in_part", "_mid")
