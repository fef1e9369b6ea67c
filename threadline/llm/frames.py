"""DataFrame helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A null id counts as the smallest id.
NULL_ID = -(1 << 63)
#: Rows that a side may have to be broadcast; at under 100 bytes a row that is at most 100 MB.
BROADCAST_ROWS = 1_000_000


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with the key that tells them apart: (``_id``, ``_h``), id and hash of the text.

    Everything else is packed away in ``row``, so no column of the caller can
    clash with one of ours. Rows equal in id and text share a key; whatever
    holds for one of them holds for the others.
    """
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(f"`{doc_id}`").cast("bigint"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(F.col(f"`{text}`")).alias("_h"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"),
    )


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most so many rows; never counts further than that."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after the size was checked; beyond it the planner shuffles both sides."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def bare_id(column: Column) -> Column:
    """The caller's id: null again where it was null."""
    return F.when(column == F.lit(NULL_ID), F.lit(None).cast("bigint")).otherwise(column)
