"""Connected components of a link table, by large-star and small-star rounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadline.runtime import new_run_dir, stage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect the same nodes as the given ones: each node to the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link; root is the smallest node of its component.

    ``links`` has BIGINT columns ``a`` and ``b``. Every round is written to the
    shared scratch folder, so a lost executor costs no more than one round, and
    minima combine before the shuffle, so a hub is one row per task.
    """
    spark = links.sparkSession
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stage(pairs, new_run_dir(spark, "links"))
    seen = None
    while True:
        # Large star: larger neighbours of a node hang on the smallest of its neighbourhood.
        both = pairs.union(pairs.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # Small star: smaller neighbours, and the node, hang on the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low).where("a <> b").distinct()
        pairs = stage(small, new_run_dir(spark, "links"))
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())
        seen = state
