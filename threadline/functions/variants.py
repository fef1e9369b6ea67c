"""Typed reads out of a VARIANT, strict about JSON types.

A counter that arrives as the string "5" reads as 0 and a title that arrives as
a number reads as NULL, so every read checks the stored type before converting.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\f\x0b"


def get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column, path: str) -> Column:
    """The stored type of a scalar field; do not use it on large arrays or objects."""
    return F.schema_of_variant(get(v, path))


def text(v: Column, path: str) -> Column:
    """A string value exactly as stored, NULL for any other type."""
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def word(v: Column, path: str) -> Column:
    """A stripped string value, NULL when blank or not a string."""
    return F.nullif(strip(text(v, path)), F.lit(""))


def present(v: Column, path: str) -> Column:
    """A string value kept with its spaces, NULL only when empty or not a string."""
    return F.nullif(text(v, path), F.lit(""))


def number(v: Column, path: str) -> Column:
    """A JSON number as BIGINT (fractions cut), anything else 0."""
    numeric = kind(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")
    return F.coalesce(F.when(numeric, F.try_variant_get(v, path, "bigint")), F.lit(0).cast("bigint"))


def integer(v: Column, path: str) -> Column:
    """A JSON integer as BIGINT, NULL for any other type."""
    return F.when(kind(v, path) == "BIGINT", F.try_variant_get(v, path, "bigint"))


def is_true(v: Column, path: str) -> Column:
    return F.coalesce(
        F.when(kind(v, path) == "BOOLEAN", F.try_variant_get(v, path, "boolean")), F.lit(False)
    )


def items(v: Column, path: str) -> Column:
    """The elements of an array field, NULL when the field is not an array."""
    return F.try_variant_get(v, path, "array<variant>")


def fields(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "map<string,variant>")


def union_text(v: Column, path: str) -> Column:
    """The string arm of a field that is either a string or an array."""
    scalar = items(v, path).isNull() & fields(v, path).isNull()
    return F.when(scalar, text(v, path))


# ---- fields already read as a small VARIANT of their own ----------------------


def leaf_word(c: Column) -> Column:
    """Stripped text of a scalar VARIANT, NULL when blank or not a string."""
    return F.nullif(strip(F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))), F.lit(""))


def leaf_true(c: Column) -> Column:
    value = F.when(F.schema_of_variant(c) == "BOOLEAN", F.try_variant_get(c, "$", "boolean"))
    return F.coalesce(value, F.lit(False))


def leaf_integer(c: Column) -> Column:
    return F.when(F.schema_of_variant(c) == "BIGINT", F.try_variant_get(c, "$", "bigint"))
