"""Keep an expensive expression from being copied into every place that uses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """Add columns through a one-row generator.

    A filter on a projected column is pushed below the projection with the
    whole expression copied into it, so a JSON parse would run once per filter
    and inflate the generated code. Filters stop at a generator, so the
    expression is evaluated exactly once per row.
    """
    row = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    kept = [F.col(c) for c in (df.columns if keep is None else keep)]
    return df.select(*kept, F.inline(row))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used; for values that higher-order functions make."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
