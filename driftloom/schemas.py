"""Declared schemas of every record the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

SPIKE = T.StructType(
    [T.StructField("position", T.LongType()), T.StructField("logprob", T.DoubleType())]
)

PERCENTILES = T.StructType(
    [T.StructField(p, T.DoubleType()) for p in ("p10", "p25", "p50", "p75", "p90", "p99")]
)

SIGNAL = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("input_token_count", T.LongType()),
        T.StructField("output_token_count", T.LongType()),
        T.StructField("mean_logprob", T.DoubleType()),
        T.StructField("min_logprob", T.DoubleType()),
        T.StructField("logprob_entropy_mean", T.DoubleType()),
        T.StructField("logprob_variance", T.DoubleType()),
        T.StructField("token_uncertainty_spikes", T.ArrayType(SPIKE)),
        T.StructField("sequence_logprob_percentiles", PERCENTILES),
    ]
)

SIGNAL_BREAKDOWN = T.StructType(
    [
        T.StructField(n, T.DoubleType())
        for n in (
            "mean_logprob_zscore",
            "variance_zscore",
            "entropy_zscore",
            "spike_frequency_zscore",
        )
    ]
)

DRIFT_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("detected_at", T.StringType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("alert_level", T.StringType()),
        T.StructField("drift_type", T.StringType()),
        T.StructField("composite_anomaly_score", T.DoubleType()),
        T.StructField("signal_breakdown", SIGNAL_BREAKDOWN),
        T.StructField("affected_request_fraction", T.DoubleType()),
        T.StructField("evidence_request_ids", T.ArrayType(T.StringType())),
        T.StructField("qualification_status", T.StringType()),
        T.StructField("training_cycle_id", T.StringType()),
    ]
)

SFT_ROW = T.StructType(
    [T.StructField("prompt", T.StringType()), T.StructField("response", T.StringType())]
)

DPO_ROW = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("chosen", T.StringType()),
        T.StructField("rejected", T.StringType()),
    ]
)

FAILURE_ROW = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("response", T.StringType()),
        T.StructField("mean_logprob", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

CHECKPOINT = T.StructType(
    [
        T.StructField("cycle_id", T.StringType()),
        T.StructField("step", T.LongType()),
        T.StructField("phase", T.StringType()),
        T.StructField("train_loss", T.DoubleType()),
        T.StructField("eval_loss", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
    ]
)

LINEAGE_NODE = T.StructType(
    [
        T.StructField("adapter_id", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("base_model_id", T.StringType()),
        T.StructField("training_cycle_id", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("parent_adapter_id", T.StringType()),
        T.StructField("target_failure_cluster_ids", T.StringType()),
        T.StructField("evaluation_scores", T.StringType()),
        T.StructField("deployment_record", T.StringType()),
    ]
)
