"""Counters, gauges and latency reports over observation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.config import CAPTURE_LATENCY_NS, HISTOGRAM_BOUNDS
from driftloom.operators.distributions import bucket_quantile, cumulative_histogram


def counters(obs: DataFrame, labels: list[str], amount: str | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if amount is None else F.sum(amount)
    return obs.groupBy(*labels).agg(n.alias("total"))


def gauges(obs: DataFrame, labels: list[str], value: str, order: list[str]) -> DataFrame:
    """Latest value per label."""
    return obs.groupBy(*labels).agg(F.max_by(value, F.struct(*order)).alias("current"))


def histogram(obs: DataFrame, metric: str, value: str, labels: list[str] = []) -> DataFrame:
    return cumulative_histogram(obs, value, HISTOGRAM_BOUNDS[metric], labels)


def metrics_rollup(obs: DataFrame) -> DataFrame:
    """(metric, kind, label, le, value, observations) of every observed metric and label.

    obs: metric, kind (counter, gauge or histogram), label, value, ts, seq. A counter is the sum of
    its values, a gauge the latest one. A histogram has a row for each bound of its metric and one
    without (le null), whose value counts the observations up to it. Rows without a value count
    for nothing; other kinds are left out.
    """
    keys = ["metric", "kind", "label"]
    seen = obs.filter("value IS NOT NULL")
    plain = seen.filter("kind IN ('counter', 'gauge')").groupBy(*keys).agg(
        F.sum("value").alias("_sum"),
        F.max_by("value", F.struct("ts", "seq")).alias("_latest"),
        F.count(F.lit(1)).alias("observations"),
    ).select(
        *keys,
        F.lit(None).cast("double").alias("le"),
        F.when(F.col("kind") == "counter", F.col("_sum")).otherwise(F.col("_latest")).alias("value"),
        "observations",
    )
    bounds = F.array().cast("array<double>")
    for metric, limits in HISTOGRAM_BOUNDS.items():
        own = F.array(*[F.lit(float(b)) for b in limits])
        bounds = F.when(F.col("metric") == metric, own).otherwise(bounds)
    slot = F.size(F.filter(bounds, lambda b: b < F.col("value")))
    slots = seen.filter("kind = 'histogram'").groupBy(*keys, slot.alias("_slot")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    held = slots.groupBy(*keys).agg(  # at most one entry for each bound and one beyond
        F.collect_list(F.struct("_slot", "_n")).alias("_held"), F.sum("_n").alias("observations")
    )
    bars = held.select(
        *keys, "observations", "_held",
        F.posexplode(F.concat(bounds, F.array(F.lit(None).cast("double")))).alias("_at", "le"),
    )
    upto = F.aggregate(
        "_held",
        F.lit(0).cast("long"),
        lambda total, x: total + F.when(x["_slot"] <= F.col("_at"), x["_n"]).otherwise(F.lit(0)),
    )
    bars = bars.select(*keys, "le", upto.cast("double").alias("value"), "observations")
    return plain.unionByName(bars)


def capture_p99(obs: DataFrame, latency_ns: str, labels: list[str] = []) -> DataFrame:
    return bucket_quantile(obs, latency_ns, CAPTURE_LATENCY_NS, 0.99, labels)


def mean_latency(obs: DataFrame, value: str, labels: list[str] = []) -> DataFrame:
    return obs.groupBy(*labels).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_latency"))


def capture_outcomes(obs: DataFrame, captured: Column, published: Column) -> DataFrame:
    """Captured, dropped, published and failed events of an outcome log."""
    return obs.groupBy().agg(
        F.count_if(captured).alias("captured"),
        F.count_if(~captured).alias("dropped"),
        F.count_if(captured & published).alias("published"),
        F.count_if(captured & ~published).alias("errors"),
    )


def detector_counters(signals: DataFrame) -> DataFrame:
    keys = signals.groupBy("model_version", "tenant_id").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("events_processed"),
        F.count(F.lit(1)).alias("baselines_loaded"),
    )


def bucketed_counters(obs: DataFrame, ts: str, width: str, labels: list[str]) -> DataFrame:
    """Counts per time bucket and label; the same call serves streams after a watermark."""
    return obs.groupBy(F.window(ts, width), *labels).agg(F.count(F.lit(1)).alias("total")).select(
        F.col("window.start").alias("bucket_start"), *labels, "total"
    )
