"""Mixing sources to target weights with weights that change over the course of training."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Each source's weight over training time 0 to 1, as (time, factor) knots joined by straight
#: lines: fading out, steady, fading in; sources take them in turn. Each has a mean factor of 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Hexadecimal digits of the hash that name a bucket: 4096 buckets for each source.
BUCKET_DIGITS = 3


def _position(demand: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """The time by which the schedule's integral reaches the share ``demand`` (0 to 1) of its total."""
    total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False))
    out, before = None, 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area = (t1 - t0) * (w0 + w1) / 2
        slope = (w1 - w0) / (t1 - t0)
        q = F.greatest(F.lit(0.0), demand * total - before)
        # w0 x + slope x^2 / 2 = q, in the form that stays exact for a small slope
        x = 2 * q / F.nullif(F.lit(w0) + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * q)), F.lit(0.0))
        here = F.lit(t0) + F.least(F.coalesce(x, F.lit(0.0)), F.lit(t1 - t0))
        reached = demand * total <= before + area
        out = F.when(reached, here) if out is None else out.when(reached, here)
        before += area
    return out.otherwise(F.lit(float(schedule[-1][0])))


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Each row of ``sizes`` (source, source_size) with its rank, weight and target.

    Sources rank by code point, null last, and take the weights in turn. Together they get
    ``share`` of all sizes by weight; what would exceed ``most`` times a source's size goes to
    the others by weight, which is the level at which min(most * size, level * weight) adds up.
    One row per source: the windows hold no documents.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.selectExpr("source", "source_size", "cast(row_number() over (order by source is null, source) - 1 as int) as rank").withColumn("weight", w)
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
    filled = ranked.selectExpr(
        "*",
        f"least({share}D * sum(source_size) over (), sum(cap) over ()) as total",
        "coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0D) as cap_before",
        "sum(weight) over (order by cap / weight desc, rank desc rows between unbounded preceding and current row) as weight_left",
    )
    leveled = filled.selectExpr("*", "max(case when (total - cap_before) / weight_left <= cap / weight then (total - cap_before) / weight_left end) over () as level")
    return leveled.select("source", "source_size", "rank", "weight", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, schedules: Sequence = SCHEDULES, carry: Sequence[str] = ()) -> DataFrame:
    """Assign every row of ``docs`` (doc_id, text, source) its words in the mix and its training position.

    Returns doc_id, size (words of the text, null: 0), source, source_size, target (words its
    source gives to the mix), taken (words of this row that the mix takes, repeats counted,
    never over 2 * size), position (0 to 1: when the row is first reached, null if never) and
    repeat_position (when it is reached for the second time, else null), range-sorted by
    position, plus the columns named in ``carry``.

    Within a source, rows lie one after the other by a hash of doc_id and text on an axis of
    words that is run through again for a target above the source's size; a row takes the part
    of the axis before the target. A source's takes add up to its rounded target, reruns agree.
    A null source is a source of its own, wordless rows take nothing; a null doc_id counts as a
    value; equal rows share one place and split it evenly by order, in one window group: a table that
    repeats one row very often should be grouped first. An empty table gives no rows.

    Offsets come from sums per (source, hash bucket) and a window within a bucket, so that a
    source with a third of all rows spreads over 16 ** BUCKET_DIGITS groups.
    """
    place = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))))
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), place.alias("_place"), *carry)
    rows = rows.withColumn("_bucket", F.substring("_place", 1, BUCKET_DIGITS))
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_in"))
    offsets = buckets.selectExpr("source", "_bucket", "cast(coalesce(sum(_in) over (partition by source order by _bucket rows between unbounded preceding and 1 preceding), 0) as long) as _before")
    sizes = buckets.groupBy("source").agg(F.sum("_in").cast("long").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    plan = offsets.join(targets, offsets["source"].eqNullSafe(targets["source"])).select(offsets["source"].alias("_s"), F.col("_bucket").alias("_b"), "_before", "source_size", "rank", "target")
    placed = rows.withColumn("_own", F.expr("cast(coalesce(sum(size) over (partition by source, _bucket order by _place, doc_id, size rows between unbounded preceding and 1 preceding), 0) as long)"))
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["_s"]) & (placed["_bucket"] == plan["_b"]))
    at, goal, size, own = F.col("_before") + F.col("_own"), F.round("target").cast("long"), F.col("size"), F.col("source_size")
    overlap = lambda start: F.greatest(F.lit(0), F.least(start + size, goal) - start)
    taken = overlap(at) + overlap(own + at)

    def when_reached(start: Column) -> Column:
        share_of = start / F.nullif(F.col("target"), F.lit(0.0))
        out = None
        for k, s in enumerate(schedules):
            here = F.col("rank") % len(schedules) == k
            out = F.when(here, _position(share_of, s)) if out is None else out.when(here, _position(share_of, s))
        return F.when((overlap(start) > 0), out)

    mixed = joined.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"), when_reached(at).alias("position"), when_reached(own + at).alias("repeat_position"), *carry)
    return mixed.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
