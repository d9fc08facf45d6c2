"""Exact order-dependent work on keys of any size.

A key may own a third of all rows, so nothing here sorts a whole key in one task. Rows are
first placed in (key, time bucket) groups; the small table of bucket counts gives every
bucket its offset, and the position inside the bucket does the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HOUR_US = 3_600_000_000
# Exact running totals: differences of totals then lose nothing to rounding.
EXACT = TOTAL = "decimal(38,18)"


def whole_part(a: Column, b: int) -> Column:
    """Integer quotient, without the rounding of a double division."""
    return F.call_function("div", a, F.lit(b))


def ranked(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    ts: str = "ts_us",
    bucket_us: int = HOUR_US,
    out: str = "rn",
) -> DataFrame:
    """Adds the 0-based position of each row in its key's order, as one global `row_number`.

    Keys are compared as a struct, which joins null keys to each other.
    """
    key = ["_key"] if keys else []
    rows = df.withColumn("_bucket", whole_part(F.col(ts), bucket_us))
    if keys:
        rows = rows.withColumn("_key", F.struct(*keys))
    sizes = rows.groupBy(*key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *key, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    inside = W.partitionBy(*key, "_bucket").orderBy(*order)
    return (
        rows.withColumn("_i", F.row_number().over(inside))
        .join(offsets, [*key, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_i") - 1)
        .drop("_key", "_bucket", "_before", "_i")
    )


def exact(value: Column) -> Column:
    """Value as a decimal with 18 places; NaN and infinite values count as missing.

    Values and sums of 1e20 or more do not fit and raise an overflow error.
    """
    usable = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(usable, value).cast(EXACT)


def trailing_means(
    df: DataFrame,
    keys: list[str],
    value: str,
    windows_s: dict[str, int],
    ts: str = "ts_us",
    tie: str = "request_id",
    span_s: int = 3600,
    prefix: str = "avg_",
) -> DataFrame:
    """Mean of `value` over the last w seconds (inclusive, current row included) for each w.

    Rows go to (key, span) groups, and each span also gets a copy of the rows at most the
    longest window before it. Inside a group every mean is the running total minus the total
    that ends just before the window: both frames start at the first row, so the cost is
    linear in the rows however many of them a window holds.
    """
    span = span_s * 1_000_000
    longest = max(windows_s.values()) * 1_000_000
    own = whole_part(F.col(ts), span)
    reach = whole_part(F.col(ts) + F.lit(longest), span)
    rows = df.withColumn("_own", own).withColumn("_span", F.explode(F.sequence(own, reach)))

    part = W.partitionBy(*keys, "_span")
    upto = part.orderBy(ts, tie).rowsBetween(W.unboundedPreceding, W.currentRow)
    x = exact(F.col(value))
    zero = F.lit(0).cast(TOTAL)
    cols = {"_sum": F.sum(x).over(upto), "_cnt": F.count(x).over(upto)}
    for name, w in windows_s.items():
        before = part.orderBy(ts).rangeBetween(W.unboundedPreceding, -(w * 1_000_000 + 1))
        cols["_sum_" + name] = F.coalesce(F.sum(x).over(before), zero)
        cols["_cnt_" + name] = F.count(x).over(before)
    out = rows.withColumns(cols).filter(F.col("_span") == F.col("_own"))
    means = {
        prefix + n: F.try_divide(
            (F.col("_sum") - F.col("_sum_" + n)).cast("double"), F.col("_cnt") - F.col("_cnt_" + n)
        )
        for n in windows_s
    }
    return out.withColumns(means).drop("_own", "_span", *cols)


def row_blocks(df: DataFrame, rn: str, block_rows: int, halo_rows: int) -> DataFrame:
    """Places ranked rows in blocks; the last `halo_rows` rows of a block also lead the next.

    Adds `_block` and `_halo` (true on the copies).
    """
    own = whole_part(F.col(rn), block_rows)
    last = whole_part(F.col(rn) + F.lit(halo_rows), block_rows)
    return df.withColumn("_own", own).withColumn(
        "_block", F.explode(F.sequence(own, last))
    ).withColumn("_halo", F.col("_block") != F.col("_own")).drop("_own")
