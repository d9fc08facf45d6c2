"""Signal dimensions, z-scores, composite, drift type and alert level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.config import ALERT_LEVELS, DIMENSIONS, WEIGHTS, DriftConfig

CFG = DriftConfig()


def spike_frequency(n_spikes: Column, output_tokens: Column) -> Column:
    """Spikes per output token; zero tokens count as one, the ratio is not clamped."""
    return n_spikes.cast("double") / F.greatest(output_tokens, F.lit(1)).cast("double")


def with_dimensions(signals: DataFrame) -> DataFrame:
    """Adds the one derived dimension; the other four are columns of the signal itself."""
    n = F.coalesce(F.size("token_uncertainty_spikes"), F.lit(0))
    return signals.withColumn(
        "uncertainty_spike_freq", spike_frequency(F.greatest(n, F.lit(0)), F.col("output_token_count"))
    )


def finite(columns=DIMENSIONS) -> Column:
    """True when every dimension is a usable number."""
    ok = F.lit(True)
    for c in columns:
        x = F.col(c)
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return ok


def split_finite(signals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable signals, and the rejects with a NaN, infinite or missing dimension."""
    return signals.filter(finite()), signals.filter(~finite())


def baseline_std(mean: Column, var: Column, cfg: DriftConfig = CFG) -> Column:
    """Standard deviation with its floor; an unseen dimension has the absolute floor."""
    floor = F.greatest(F.abs(mean) * cfg.std_floor_fraction, F.lit(cfg.std_floor))
    return F.when(mean.isNull(), F.lit(cfg.std_floor)).otherwise(
        F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), floor)
    )


def baseline_mean(mean: Column) -> Column:
    return F.coalesce(mean, F.lit(0.0))


def z_score(value: Column, mean: Column, std: Column, zero: float = CFG.zero_std) -> Column:
    return F.when(F.abs(std) < zero, F.lit(0.0)).otherwise((value - mean) / std)


def composite(prefix: str = "z_") -> Column:
    """Weighted sum of absolute z-scores, added in weight order; missing ones count 0."""
    total = F.lit(0.0)
    for d in DIMENSIONS:
        total = total + F.lit(WEIGHTS[d]) * F.abs(F.coalesce(F.col(prefix + d), F.lit(0.0)))
    return total


def dominant_dimension(prefix: str = "z_") -> Column:
    """Dimension of the largest absolute z-score; ties go to the earlier dimension."""
    ranked = [
        F.struct(
            F.abs(F.coalesce(F.col(prefix + d), F.lit(0.0))).alias("size"),
            F.lit(-i).alias("order"),
            F.lit(d).alias("name"),
        )
        for i, d in enumerate(DIMENSIONS)
    ]
    return F.array_max(F.array(*ranked))["name"]


def score_against(df: DataFrame, cfg: DriftConfig = CFG) -> DataFrame:
    """Adds z-scores, composite and dominant dimension from `mean_*`/`var_*` columns."""
    z = {
        "z_" + d: z_score(
            F.col(d),
            baseline_mean(F.col("mean_" + d)),
            baseline_std(F.col("mean_" + d), F.col("var_" + d), cfg),
            cfg.zero_std,
        )
        for d in DIMENSIONS
    }
    return df.withColumns(z).withColumns(
        {"composite": composite(), "dominant_dimension": dominant_dimension()}
    )


def drift_type(prefix: str = "z_") -> Column:
    """Fixed cuts, tried in this order."""
    low = F.abs(F.coalesce(F.col(prefix + "min_logprob"), F.lit(0.0)))
    spike = F.abs(F.coalesce(F.col(prefix + "uncertainty_spike_freq"), F.lit(0.0)))
    entropy = F.abs(F.coalesce(F.col(prefix + "logprob_entropy_mean"), F.lit(0.0)))
    variance = F.abs(F.coalesce(F.col(prefix + "logprob_variance"), F.lit(0.0)))
    mean = F.coalesce(F.col(prefix + "mean_logprob"), F.lit(0.0))
    return (
        F.when((low >= 5.0) & (spike >= 4.0), "CATASTROPHIC")
        .when((entropy > 3.0) & (variance < 2.0), "INPUT_DISTRIBUTION")
        .when((mean < -2.0) & (entropy < 2.0), "CONCEPT")
        .otherwise("GRADUAL")
    )


def alert_level(averages: dict[str, Column], thresholds: dict) -> Column:
    """Most severe level whose window average reaches its threshold, else null."""
    level = None
    for name in ALERT_LEVELS:
        limit = thresholds[name]
        limit = limit if isinstance(limit, Column) else F.lit(float(limit))
        hit = averages[name] >= limit
        level = F.when(hit, name) if level is None else level.when(hit, name)
    return level


def is_drift_trigger(threshold: float = 4.5) -> Column:
    """CRITICAL or EMERGENCY, qualified, and scored at or above the threshold."""
    return (
        F.col("alert_level").isin("CRITICAL", "EMERGENCY")
        & (F.col("qualification_status") == "QUALIFIED")
        & (F.coalesce(F.col("composite_anomaly_score"), F.lit(0.0)) >= threshold)
    )


def keep_sample(key: Column, rate: float) -> Column:
    """Repeatable sampling gate: the same id is always kept or always dropped."""
    return F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(round(rate * 1_000_000))
