"""Views over the given tables that have the shape the operators expect.

Each Spark view has an SQL twin (`*_SQL`) used by the counterpart queries.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.config import DriftConfig
from driftloom.session import spread

# Keys of the given tables are short, so baselines calibrate on fewer events.
CALIBRATION = 200
CFG = replace(DriftConfig(), calibration_events=CALIBRATION)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    # The tables hold zone-free timestamps; they are read as UTC.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    # Text and JSON work on these tables is heavy, and they may come as a single file.
    return spread(df) if name in ("events", "documents", "conversations") else df


def micros(c):
    return F.unix_micros(F.col(c).cast("timestamp"))


def signals(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    drift = (
        (F.col("ts") >= F.to_timestamp_ntz(F.lit("2024-01-21 00:00:00")))
        & F.col("event_type").isin("error", "purchase")
    ).cast("int")
    v = e.withColumns({"_k": k, "_drift": drift})
    return v.select(
        F.col("event_id").cast("string").alias("request_id"),
        "event_id",
        micros("ts").alias("ts_us"),
        F.col("event_type").alias("model_version"),
        F.concat(F.lit("t"), (F.col("user_id") % 2).cast("string")).alias("tenant_id"),
        (F.lit(128) + F.col("user_id") % 64).alias("input_token_count"),
        (F.lit(32) + F.col("event_id") % 33).alias("output_token_count"),
        (F.col("_k") % 3 + F.lit(5) * F.col("_drift")).alias("n_spikes"),
        (F.lit(-1.5) - F.col("value") / 100 - F.lit(3.0) * F.col("_drift")).alias("mean_logprob"),
        (
            F.lit(0.3) + (F.col("event_id") % 10) / F.lit(50.0) + F.lit(0.6) * F.col("_drift")
        ).alias("logprob_variance"),
        (F.lit(2.0) + F.col("_k") / F.lit(100.0) + F.lit(2.0) * F.col("_drift")).alias(
            "logprob_entropy_mean"
        ),
        (F.col("user_id") % 7).alias("_u"),
    ).withColumns(
        {
            "min_logprob": F.col("mean_logprob") - 1.0 - F.col("_u") / F.lit(10.0),
            "uncertainty_spike_freq": F.col("n_spikes").cast("double")
            / F.greatest("output_token_count", F.lit(1)),
        }
    ).drop("_u")


SIGNALS_SQL = """
raw AS (
  SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
         CASE WHEN ts >= TIMESTAMP '2024-01-21 00:00:00'
               AND event_type IN ('error', 'purchase') THEN 1 ELSE 0 END AS drift
  FROM events),
base AS (
  SELECT CAST(event_id AS VARCHAR) AS request_id, event_id, epoch_us(ts) AS ts_us,
         event_type AS model_version, 't' || CAST(user_id % 2 AS VARCHAR) AS tenant_id,
         128 + user_id % 64 AS input_token_count, 32 + event_id % 33 AS output_token_count,
         k % 3 + 5 * drift AS n_spikes,
         -1.5e0 - value / 100e0 - 3e0 * drift AS mean_logprob,
         0.3e0 + (event_id % 10) / 50e0 + 0.6e0 * drift AS logprob_variance,
         2e0 + k / 100e0 + 2e0 * drift AS logprob_entropy_mean,
         user_id % 7 AS u
  FROM raw),
signals AS (
  SELECT * EXCLUDE (u), mean_logprob - 1e0 - u / 10e0 AS min_logprob,
         CAST(n_spikes AS DOUBLE) / greatest(output_token_count, 1) AS uncertainty_spike_freq
  FROM base)
"""
