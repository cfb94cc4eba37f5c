"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.scratch import materialize

#: Rows of one key that a task takes at least, and keys that count as hot at most (they are broadcast).
LEAST_HOT = 2000
MOST_HOT = 20_000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(key, ways): the keys of ``rows`` (a written table) with so many rows that they are to be split, into that many ways.

    A key is hot above LEAST_HOT rows and above an even share of MOST_HOT keys, so that there are never more than MOST_HOT.
    """
    limit = max(LEAST_HOT, rows.count() // MOST_HOT)
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    return materialize(counts.select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_ways")), "hot-keys")


def spread_join(rows: DataFrame, key: str, side: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` (a written table) joined with ``side``, which has one row for each key: hot keys' rows are dealt over several tasks, each with a copy of the side's row."""
    hot = hot_keys(rows, key)
    if hot.isEmpty():
        return rows.join(side, key, how)
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_deal", F.when(F.col("_ways").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("_ways"))).cast("int")).drop("_ways")
    copied = side.join(F.broadcast(hot), key, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_ways", F.lit(1)) - 1))).drop("_ways")
    return dealt.join(copied, [key, "_deal"], how).drop("_deal")
