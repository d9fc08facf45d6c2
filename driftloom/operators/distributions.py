"""Histograms, bucket quantiles, two-sample tests and lexical diversity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from driftloom.functions.text import word_count, words


def cumulative_histogram(
    df: DataFrame, value: str, bounds: list[float], labels: list[str] = []
) -> DataFrame:
    """Observations at or below each bound (`le`, null for +Inf) with sum and count per label.

    One aggregate with a conditional count per bound, then unfolded: rows are not multiplied.
    """
    counts = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    total = F.count(value).alias("observations")
    agg = df.groupBy(*labels).agg(*counts, total, F.sum(value).alias("total"))
    cells = [
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
        for i, b in enumerate(bounds)
    ]
    cells.append(
        F.struct(F.lit(None).cast("double").alias("le"), F.col("observations").alias("cumulative"))
    )
    return agg.select(*labels, "observations", "total", F.inline(F.array(*cells)))


def bucket_quantile(
    df: DataFrame, value: str, bounds: list[float], q: float, labels: list[str] = []
) -> DataFrame:
    """Smallest bound whose cumulative count reaches ceil(q*n); null in the open bucket, 0 if empty."""
    n = F.count(value).alias("observations")
    agg = df.groupBy(*labels).agg(
        n, *[F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    )
    need = F.ceil(F.col("observations") * F.lit(q))
    out = F.when(F.col("observations") == 0, F.lit(0.0))
    for i, b in enumerate(bounds):
        out = out.when(F.col(f"_b{i}") >= need, F.lit(float(b)))
    return agg.select(*labels, "observations", out.alias("quantile"))


def ks_statistic(
    df: DataFrame, group: list[str], value: str, is_first: Column
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance per group, with sizes and means.

    The samples are reduced to counts per distinct value first; only those are ordered.
    """
    hist = df.groupBy(*group, value).agg(
        F.count_if(is_first).alias("_a"), F.count_if(~is_first).alias("_b")
    )
    whole = W.partitionBy(*group)
    line = whole.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    n, m = F.sum("_a").over(whole), F.sum("_b").over(whole)
    gap = F.abs(
        F.try_divide(F.sum("_a").over(line), n) - F.try_divide(F.sum("_b").over(line), m)
    )
    x = F.col(value).cast("double")
    return (
        hist.withColumn("_gap", gap)
        .groupBy(*group)
        .agg(
            F.sum("_a").alias("n_first"),
            F.sum("_b").alias("n_second"),
            F.try_divide(F.sum(x * F.col("_a")), F.sum("_a")).alias("mean_first"),
            F.try_divide(F.sum(x * F.col("_b")), F.sum("_b")).alias("mean_second"),
            F.max("_gap").alias("ks_distance"),
        )
    )


def ks_p_exact(n: int, m: int, d: float) -> float:
    """Chance of a distance of at least d for samples of n and m, by counting lattice paths.

    A path from (0, 0) to (n, m) is a way to mix the samples; the paths that stay nearer than d to
    the diagonal are counted row by row, holding only the cells of a row inside that band. Counts
    are scaled down as they grow. The band is about 2 * d * m cells wide. A chance that is lost
    next to 1 anyway, by the bound e * exp(-2 d^2 nm / (n + m)), is 0.
    """
    limit = round(d * n * m)
    if limit <= 0:
        return 1.0
    if 1.0 - 2.0 * d * d * n * m / (n + m) < math.log(1e-17):
        return 0.0
    low, log_scale = 0, 0.0
    row = np.ones(min(m, (limit - 1) // n) + 1)
    for i in range(1, n + 1):
        lo = max(0, (i * m - limit) // n + 1)
        hi = min(m, -(-(i * m + limit) // n) - 1)
        if hi < lo:
            return 1.0
        new = np.zeros(hi - lo + 1)
        kept = row[lo - low:]
        new[:len(kept)] = kept
        row, low = np.cumsum(new), lo
        top = row[-1]
        if top <= 0:
            return 1.0
        if top > 1e200:
            row /= top
            log_scale += math.log(top)
    if low + len(row) - 1 < m:
        return 1.0
    total = math.lgamma(n + m + 1) - math.lgamma(n + 1) - math.lgamma(m + 1)
    return float(min(1.0, max(0.0, 1.0 - math.exp(math.log(row[-1]) + log_scale - total))))


def ks_p_asymptotic(n: Column, m: Column, d: Column) -> Column:
    """Kolmogorov series at sqrt(n*m/(n+m))*d."""
    lam = F.sqrt(n * m / (n + m)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(
        F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))
    )


def with_p_value(ks: DataFrame, method: str = "exact") -> DataFrame:
    """Adds p_value and method: `exact` counts paths for samples of any size, `asymptotic` takes the
    limiting law. Counting takes time that grows as the power 1.5 of the sample size, in one call
    for each row; at 10 million it is minutes, so choose the law for samples beyond that."""
    n, m, d = F.col("n_first"), F.col("n_second"), F.col("ks_distance")
    usable = (n > 0) & (m > 0)
    if method == "asymptotic":
        p = ks_p_asymptotic(n, m, d)
    elif method == "exact":

        @F.pandas_udf(T.DoubleType())
        def exact(n: pd.Series, m: pd.Series, d: pd.Series) -> pd.Series:
            return pd.Series(
                [ks_p_exact(int(a), int(b), c) if c == c else None for a, b, c in zip(n, m, d)],
                dtype="float64",
            )

        p = exact(n, m, F.when(usable, d))
    else:
        raise ValueError(f"no method {method!r}")
    # The count runs in its own step, so that rows without a distance only pass through.
    return ks.withColumn("_p", p).select(
        *ks.columns, F.when(usable, F.col("_p")).alias("p_value"), F.when(usable, F.lit(method)).alias("method")
    )


def type_token_ratio(df: DataFrame, group: list[str], text: str) -> DataFrame:
    """Distinct over all lower-case words per group (0 without words), in two levels."""
    tokens = df.select(*group, F.explode_outer(words(F.lower(F.col(text)))).alias("_t"))
    counts = tokens.groupBy(*group, "_t").agg(F.count("_t").alias("_n"))
    return (
        counts.groupBy(*group)
        .agg(F.count("_t").alias("distinct_tokens"), F.sum("_n").alias("tokens"))
        .withColumn(
            "ttr",
            F.when(F.col("tokens") > 0, F.col("distinct_tokens") / F.col("tokens")).otherwise(0.0),
        )
    )


def with_words(df: DataFrame, text: str, out: str = "n_words") -> DataFrame:
    return df.withColumn(out, word_count(F.col(text)))
