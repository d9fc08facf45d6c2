"""Frozen settings of every operator family.

The defaults below are fixed values: results depend on them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# The five tracked signal dimensions, in weight order.
DIMENSIONS = (
    "mean_logprob",
    "logprob_variance",
    "logprob_entropy_mean",
    "uncertainty_spike_freq",
    "min_logprob",
)

# Weight of each dimension in the composite score.
WEIGHTS = {
    "mean_logprob": 0.35,
    "logprob_variance": 0.25,
    "logprob_entropy_mean": 0.20,
    "uncertainty_spike_freq": 0.15,
    "min_logprob": 0.05,
}

# Alert levels from the most to the least severe.
ALERT_LEVELS = ("EMERGENCY", "CRITICAL", "WARNING", "INFO")


@dataclass(frozen=True)
class DriftConfig:
    alpha_mean: float = 0.01
    alpha_var: float = 0.005
    calibration_events: int = 1000
    std_floor_fraction: float = 0.01
    std_floor: float = 0.01
    zero_std: float = 1e-10
    # Baselines stop learning from events at or above this composite.
    freeze_at: float = 2.0
    thresholds: dict = field(
        default_factory=lambda: {"INFO": 2.0, "WARNING": 3.0, "CRITICAL": 4.5, "EMERGENCY": 6.0}
    )
    windows_s: dict = field(
        default_factory=lambda: {"INFO": 3600, "WARNING": 1800, "CRITICAL": 600, "EMERGENCY": 300}
    )
    qualified_levels: tuple = ("CRITICAL", "EMERGENCY")
    # Evidence buffer per model version.
    buffer_rows: int = 500
    evidence_ids: int = 50
    anomalous_at: float = 2.0
    min_anomalous: int = 30
    max_variation: float = 0.5
    persistence_windows_s: tuple = (60, 300, 600)
    persistence_at: float = 3.0
    # Physical layout: rows of one key handled by one task at a time.
    fold_rows: int = 200_000
    block_rows: int = 16_384
    span_s: int = 3600


@dataclass(frozen=True)
class ClusterConfig:
    min_cluster_size: int = 5
    min_samples: int = 3
    min_persistence: float = 0.0
    archetype_samples: int = 10
    archetype_keywords: int = 5
    # Physical layout: vectors per block and tree edges per task.
    block_points: int = 2048
    edges_per_task: int = 1_000_000


@dataclass(frozen=True)
class SynthesisConfig:
    pairs_per_cluster: int = 20
    judge_threshold: float = 0.7
    cost_per_pair_usd: float = 0.01
    oracle_model: str = "gpt-4o-mini"


@dataclass(frozen=True)
class TrainingConfig:
    budget_usd: float = 30.0
    projected_sft_hours: float = 3.0
    projected_dpo_hours: float = 2.0
    hourly_usd: float = 3.21
    spot_fraction: float = 0.7
    fallback_hourly_usd: float = 4.10
    keep_checkpoints: int = 3
    eval_fraction: float = 0.1

    @property
    def projected_usd(self) -> float:
        return (self.projected_sft_hours + self.projected_dpo_hours) * self.hourly_usd


@dataclass(frozen=True)
class GateConfig:
    regression_ratio: float = 0.95
    ks_p_value: float = 0.01
    ttr_delta_pct: float = 15.0
    improvement_pct: float = 10.0
    refusal_rate: float = 0.95


@dataclass(frozen=True)
class AlertBudgetConfig:
    window_s: int = 3600
    limits: dict = field(
        default_factory=lambda: {"INFO": 0, "WARNING": 10, "CRITICAL": 5, "EMERGENCY": 100}
    )
    unknown_limit: int = 100
    fold_rows: int = 500_000


@dataclass(frozen=True)
class LoopConfig:
    trigger_score: float = 4.5
    trigger_budget_usd: float = 30.0
    min_cycle_gap_s: int = 43_200
    schedule_interval_s: int = 604_800
    canary_sigma: float = 2.0
    max_lineage_depth: int = 10
    fold_rows: int = 500_000


# On-demand price per GPU hour, USD.
GPU_HOURLY_USD = {
    "A100-80GB": 4.10,
    "A100-40GB": 3.06,
    "H100-80GB": 8.50,
    "V100-16GB": 2.48,
    "T4-16GB": 0.53,
}

# Legal moves of the training loop.
LOOP_TRANSITIONS = {
    "IDLE": ["EVIDENCE_QUALIFYING"],
    "EVIDENCE_QUALIFYING": ["SYNTHESIZING", "IDLE"],
    "SYNTHESIZING": ["TRAINING_SFT", "IDLE"],
    "TRAINING_SFT": ["TRAINING_DPO", "IDLE"],
    "TRAINING_DPO": ["EVALUATING", "IDLE"],
    "EVALUATING": ["DEPLOYING_CANARY", "REJECTED"],
    "DEPLOYING_CANARY": ["PROMOTING_FULL", "ROLLED_BACK"],
    "PROMOTING_FULL": ["IDLE"],
    "REJECTED": ["IDLE"],
    "ROLLED_BACK": ["IDLE"],
}
LOOP_TERMINAL = ("IDLE", "REJECTED", "ROLLED_BACK")

# Legal moves of an adapter.
ADAPTER_TRANSITIONS = {
    "CANDIDATE": ["STAGING", "ROLLED_BACK"],
    "STAGING": ["PROMOTING", "ROLLED_BACK"],
    "PROMOTING": ["PRODUCTION", "ROLLED_BACK"],
    "PRODUCTION": ["SUPERSEDED", "ROLLED_BACK"],
    "SUPERSEDED": [],
    "ROLLED_BACK": [],
}

# Histogram bounds per metric, and capture latency bounds in ns.
HISTOGRAM_BOUNDS = {
    "training_cycle_duration_seconds": [300, 600, 1800, 3600, 7200, 14400],
    "promotion_duration_ms": [100, 500, 1000, 2000, 3000, 5000],
    "rollback_duration_ms": [50, 100, 200, 500, 1000],
    "loop_cycle_end_to_end_seconds": [1800, 3600, 7200, 14400, 21600],
    "training_cycle_cost_usd": [1, 5, 10, 15, 20, 25, 30, 40, 60],
    "trainer_cycle_duration_seconds": [60, 300, 600, 1800, 3600, 7200, 14400, 28800],
}
CAPTURE_LATENCY_NS = [500, 1000, 2000, 5000, 10_000, 50_000, 100_000]

# Topic names.
TOPICS = {
    "signals": "logprob.signals",
    "drift": "drift.events",
    "synthesis": "synthesis.jobs",
    "training": "training.jobs",
    "evaluation": "evaluation.results",
    "promotions": "adapter.promotions",
}
