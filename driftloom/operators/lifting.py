"""Chains of decisions on keys of any size: each row knows the row that acts next if it acts itself.

Where a decision depends on the last acting row only, the acting rows are the path from the first
one. The path is found by doubling: after round k the first 2^k acting rows are known and every row
knows the one 2^k steps on, so the rounds grow with the log of the path. Rows that no row leads to any
more are dropped on the way. Rows are dealt by key and position; no task gets a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.operators.timeline import whole_part
from driftloom.session import cut

ROW = ["_key", "_rn"]


def first_at_or_after(targets: DataFrame, probes: DataFrame, width: int) -> DataFrame:
    """(_key, _rn, _found): for each probe (_key, _rn, _at) the smallest `_value` of the targets
    (_key, _at, _value) of its key at or after `_at`, or null.

    Values must grow with `_at`. Rows meet in buckets of `width`; a small table of buckets tells
    what comes after each.
    """
    both = targets.select("_key", "_at", F.col("_value").cast("long"), F.lit(None).cast("long").alias("_rn")).unionAll(
        probes.select("_key", "_at", F.lit(None).cast("long").alias("_value"), "_rn")
    ).withColumn("_bucket", whole_part(F.col("_at"), width))
    back = W.partitionBy("_key", "_bucket").orderBy(F.desc("_at"), F.col("_rn").isNotNull())
    inside = F.min("_value").over(back.rowsBetween(W.unboundedPreceding, W.currentRow))
    later = W.partitionBy("_key").orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)
    buckets = both.groupBy("_key", "_bucket").agg(F.min("_value").alias("_low")).select(
        "_key", "_bucket", F.min("_low").over(later).alias("_later")
    )
    found = both.withColumn("_inside", inside).filter("_rn IS NOT NULL").join(buckets, ["_key", "_bucket"])
    return found.select("_key", "_rn", F.coalesce("_inside", "_later").alias("_found"))


def reached(steps: DataFrame, starts: DataFrame) -> tuple[DataFrame, int]:
    """Rows (_key, _rn) on the paths from `starts` along steps (_key, _rn, _next), and the rounds."""
    jump = cut(steps.filter("_next IS NOT NULL").select(*ROW, "_next"))
    seen, rounds = cut(starts.select(*ROW)), 0
    while True:
        rounds += 1
        new = cut(seen.join(jump, ROW).select("_key", F.col("_next").alias("_rn")))
        if new.isEmpty():
            return seen, rounds
        seen = cut(seen.unionAll(new))
        # Beyond those seen, the path goes on over rows that some row leads to; the others are done with.
        led = jump.select("_key", F.col("_next").alias("_rn")).unionAll(seen).distinct()
        jump = cut(jump.join(led, ROW, "left_semi"))
        on = jump.select("_key", F.col("_rn").alias("_next"), F.col("_next").alias("_far"))
        jump = cut(jump.join(on, ["_key", "_next"]).select(*ROW, F.col("_far").alias("_next")))
