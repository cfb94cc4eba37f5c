"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.scratch import materialize


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and its neighbours. The join's sides can be split where u is hot."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least.hint("shuffle_merge"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    joined = _with_least(edges)
    to_least = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = edges.groupBy("u").agg(F.min("v").alias("v"))
    return to_least.unionByName(own).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component_id): component_id is the smallest node reachable; nodes without a link to another are absent.

    Needs O(log^2 n) rounds, each of a few shuffles of the link table; every round's
    table is written to the shared folder, so a lost executor costs one round at most.
    Null ends and self-links are ignored. No links give an empty table.
    """
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = materialize(edges, "edges")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        edges = materialize(_small_star(_large_star(edges)), "edges")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    roots = stars.select(F.col("component_id").alias("node"), "component_id").distinct()
    return stars.unionByName(roots)


def local_roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches over the links (a, b), given as row numbers."""
    root = ids.copy()
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        if (new == root).all():
            return root
        root = new
