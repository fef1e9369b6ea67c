"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is evaluated once. The ledger keeps the measurements and one bit per
failed rule; a policy is a named set of bits. Verdicts of any policy, old or
new, and what each rule costs (its ablation) come from bitwise operations over
the ledger, without reading a text again.

Defined results: null or empty text has no words and fails the length rule.
Very long texts are measured whole. Equal rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadline.functions.once import computed_once

_BLANKS = " \t\n\x0b\f\r"

#: Rule name -> failure condition over the measurements, in bit order. New rules go to the end.
RULES: dict[str, str] = {
    "too_few_words": "n_words < 50",
    "repeated_trigrams": "100 * n_repeat_words > 50 * n_words",
    "symbols": "n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_text_lines AND n_dup_lines >= 3",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_trigrams"),
    "v1": ("too_few_words", "repeated_trigrams", "symbols", "duplicate_lines"),
    "v2": tuple(RULES),
}

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines"]


def policy_mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and the measurements, one pass per text.

    Each step sits behind a one-row generator, so an array is built once however
    often a later expression reads it.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("body"))
    trimmed = F.btrim("body", F.lit(_BLANKS))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+", -1))
    lines = F.filter(F.split("body", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = computed_once(
        base, {"words": words, "lines": lines, "n_symbols": F.regexp_count("body", F.lit(r"[#*$%&|<>]")).cast("bigint")}, ["row"]
    )
    window = lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
    grams = F.when(F.size("words") < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size("words") - 3), window))
    step = computed_once(
        step,
        {
            "grams": grams,
            "n_words": F.size("words").cast("bigint"),
            "word_chars": F.length(F.array_join("words", "")).cast("bigint"),
            "n_text_lines": F.size("lines").cast("bigint"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        },
        ["row", "n_symbols"],
    )
    # Only a text with a repeated window needs its windows sorted with their places.
    placed = F.when(
        F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    )
    keep = ["row", "n_symbols", "n_words", "word_chars", "n_text_lines", "n_dup_lines"]
    step = computed_once(step, {"placed": placed}, keep)
    same = lambda e, other: F.coalesce(other["g"] == e["g"], F.lit(False))
    twice = F.filter("placed", lambda e, i: same(e, F.get("placed", i - 1)) | same(e, F.get("placed", i + 1)))
    step = computed_once(step, {"at": F.sort_array(F.transform(twice, lambda e: e["i"]))}, keep)
    # A window covers three words; the next repeated window may start inside it.
    added = F.transform("at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - x, F.lit(3))))
    covered = F.coalesce(F.aggregate(added, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("bigint")
    return computed_once(step, {"n_repeat_words": covered}, keep)


def failures() -> Column:
    """One bit per failed rule."""
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, condition in enumerate(RULES.values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return mask.cast("bigint")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``row``, the measurements and ``failed``, the bitmask of failed rules."""
    return measured(docs, text).withColumn("failed", failures())


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy_mask(policy))) == 0


def apply_policy(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns."""
    return ledger(docs).where(passes(policy)).select(*[F.col(f"row.`{c}`") for c in docs.columns])


def ablations(book: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that fail nothing else.

    One aggregate over the ledger: documents are counted per distinct mask (at
    most 2**rules rows), and every figure is a bitwise test on that.
    """
    mask = F.lit(policy_mask(policy))
    masks = book.groupBy(F.col("failed").bitwiseAND(mask).alias("failed")).agg(F.count("*").alias("n"))
    names = list(RULES)
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("bigint").alias("bit")) for r in POLICIES[policy]])
    return (
        masks.select("failed", "n", F.inline(rules))
        .groupBy("rule", "bit")
        .agg(
            F.coalesce(F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n"))), F.lit(0)).alias("n_failing"),
            F.coalesce(F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_only_this_rule"),
        )
    )
