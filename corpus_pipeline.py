"""A training corpus from raw documents: five stages, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm import decontaminate, line_dedup, mixing, quality, simhash
from threadline.llm.frames import NULL_ID, keyed
from threadline.llm.queries import quality_weights
from threadline.runtime import new_run_dir, stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy rejects go."""
    return quality.apply_policy(docs, "v2")


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 10 code points or more stay in the first document that holds them; ``n_chars`` follows the text."""
    done = line_dedup.line_dedup(docs).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else done


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays; linked are fingerprints within 4 bits and 5-word shingle sets at a similarity of 0.8."""
    return simhash.representatives(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a row per document with ``taken`` words, and its text."""
    weights = quality_weights(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    taken = mixing.mix(docs.withColumn("_mix_h", F.xxhash64("text")), weights).where("taken > 0")
    columns = [c for c in taken.columns if c not in ("doc_id", "_mix_h")]
    taken = taken.withColumn("_mix_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)))
    # One text per id and text: a row of the mix meets its own text only.
    texts = keyed(docs).select("_id", "_h", F.col("row.text").alias("text")).dropDuplicates(["_id", "_h"])
    return texts.join(taken, (F.col("_id") == F.col("_mix_id")) & (F.col("_h") == F.col("_mix_h"))).select("doc_id", "text", *columns)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_leaks),
    ("source_mixing", source_mixture),
]

#: SimHash and the components of its links have no plain SQL; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), new_run_dir(spark, name))
    return STAGES[-1][1](spark, docs, sf_dir)
