"""Drift detection over a table of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.config import DIMENSIONS, DriftConfig
from driftloom.functions.signals import alert_level, drift_type, score_against
from driftloom.operators.adaptive import adaptive_scores
from driftloom.operators.evidence import evidence_stats, qualified, with_evidence_ids
from driftloom.operators.ewma import calibrated_baseline
from driftloom.operators.timeline import trailing_means
from driftloom.session import broadcast_if_small, stage

CFG = DriftConfig()
KEYS = ["model_version", "tenant_id"]
NARROW = ["request_id", "ts_us", *KEYS, *DIMENSIONS]


# A baseline row is about 150 bytes, so this is some 75 MB.
BROADCAST_BASELINES = 500_000


def join_baselines(signals: DataFrame, baselines: DataFrame) -> DataFrame:
    """Signals with the baseline of their key; an unseen key is still calibrating.

    `baselines` is a written snapshot. While it is small the signals, whose keys are skewed,
    stay where they are.
    """
    small = broadcast_if_small(baselines, BROADCAST_BASELINES)
    return signals.join(small, KEYS, "left").withColumn(
        "is_calibrating", F.coalesce(F.col("is_calibrating"), F.lit(True))
    )


def score_frozen(
    signals: DataFrame, baselines: DataFrame | None = None, cfg: DriftConfig = CFG
) -> DataFrame:
    """Scores signals against a saved snapshot: one join, no order, fully parallel.

    Without `baselines` the snapshot of each key's first events is taken from `signals`.
    Keys that are still calibrating are not scored.
    """
    if baselines is None:
        baselines = stage(calibrated_baseline(signals, KEYS, cfg=cfg), "baselines")
    usable = join_baselines(signals, baselines).filter(~F.col("is_calibrating"))
    learned = ["event_count", "is_calibrating"] + [
        p + d for d in DIMENSIONS for p in ("mean_", "var_")
    ]
    return score_against(usable, cfg).drop(*learned)


def with_alert_level(
    scored: DataFrame, cfg: DriftConfig = CFG, thresholds: dict | None = None
) -> DataFrame:
    """Adds the four window averages per key and the level they reach."""
    out = trailing_means(scored, KEYS, "composite", cfg.windows_s, span_s=cfg.span_s)
    averages = {n: F.col("avg_" + n) for n in cfg.windows_s}
    return out.withColumn("alert_level", alert_level(averages, thresholds or cfg.thresholds))


def with_thresholds(
    scored: DataFrame, changes: list[tuple[str, float, int]], cfg: DriftConfig = CFG
) -> DataFrame:
    """Alert levels under thresholds an operator changed while events came in.

    `changes` lists (level, value, valid_from_us). The last change at or before an event
    applies to it, the default before the first one.
    """
    if any(value <= 0 for _, value, _ in changes):
        raise ValueError("thresholds must be positive")
    limits = {}
    for name, default in cfg.thresholds.items():
        limit = F.lit(float(default))
        for _, value, since in sorted((c for c in changes if c[0] == name), key=lambda c: c[2]):
            limit = F.when(F.col("ts_us") >= since, F.lit(float(value))).otherwise(limit)
        limits[name] = limit
    return with_alert_level(scored, cfg, limits)


def event_id() -> Column:
    """The same trigger always makes the same id, also when a stream is replayed."""
    return F.sha2(F.concat_ws("|", "request_id", "model_version"), 256)


def drift_event_columns(cfg: DriftConfig = CFG) -> list[Column]:
    detected = F.date_format(
        F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    )
    return [
        event_id().alias("event_id"),
        detected.alias("detected_at"),
        F.col("model_version"),
        F.col("alert_level"),
        drift_type().alias("drift_type"),
        F.col("composite").alias("composite_anomaly_score"),
        F.struct(
            F.col("z_mean_logprob").alias("mean_logprob_zscore"),
            F.col("z_logprob_variance").alias("variance_zscore"),
            F.col("z_logprob_entropy_mean").alias("entropy_zscore"),
            F.col("z_uncertainty_spike_freq").alias("spike_frequency_zscore"),
        ).alias("signal_breakdown"),
        F.least(F.col("buffer_len") / F.lit(float(cfg.buffer_rows)), F.lit(1.0)).alias(
            "affected_request_fraction"
        ),
        F.col("evidence_request_ids"),
        F.lit("QUALIFIED").alias("qualification_status"),
        F.lit(None).cast("string").alias("training_cycle_id"),
    ]


def drift_events(leveled: DataFrame, cfg: DriftConfig = CFG, extra: list[str] = []) -> DataFrame:
    """Qualified events of CRITICAL and EMERGENCY rows, in the declared event schema."""
    stats = evidence_stats(leveled, cfg)
    wanted = F.coalesce(F.col("alert_level").isin(*cfg.qualified_levels), F.lit(False))
    rows = with_evidence_ids(stats, wanted & qualified(cfg), cfg)
    return rows.select(*drift_event_columns(cfg), *extra)


def detect_drift(
    signals: DataFrame, cfg: DriftConfig = CFG, adaptive: bool = True
) -> DataFrame:
    """Signals with dimensions in, drift events out."""
    narrow = signals.select(*NARROW)
    if adaptive:
        # The fold is the costly part and is read twice below.
        scored = stage(adaptive_scores(narrow, KEYS, cfg), "scored")
    else:
        scored = score_frozen(narrow, None, cfg)
    # Evidence ranks the rows, which reads them twice.
    return drift_events(stage(with_alert_level(scored, cfg), "leveled"), cfg)
