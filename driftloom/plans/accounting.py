"""Training cost, budgets and checkpoints per cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.config import GPU_HOURLY_USD, TrainingConfig

CFG = TrainingConfig()


def total_per_cycle(costs: DataFrame, cycles: DataFrame | None = None) -> DataFrame:
    """Cost per cycle; with `cycles`, those without records count 0."""
    totals = costs.groupBy("cycle_id").agg(F.sum("amount_usd").alias("total_usd"))
    if cycles is None:
        return totals
    return (
        cycles.select("cycle_id").distinct()
        .join(totals, "cycle_id", "left")
        .select("cycle_id", F.coalesce("total_usd", F.lit(0.0)).alias("total_usd"))
    )


def cost_breakdown(costs: DataFrame) -> DataFrame:
    return costs.groupBy("cycle_id", "component").agg(F.sum("amount_usd").alias("total_usd"))


def cost_breakdown_wide(costs: DataFrame, components: list[str]) -> DataFrame:
    return costs.groupBy("cycle_id").pivot("component", components).agg(F.sum("amount_usd"))


def records_of_cycle(costs: DataFrame, cycle_id, order: str = "seq") -> DataFrame:
    return costs.filter(F.col("cycle_id") == cycle_id).orderBy(order)


def record_positions(costs: DataFrame, order: list[str]) -> DataFrame:
    """Adds the position of each record among those of its cycle, in insertion order."""
    w = W.partitionBy("cycle_id").orderBy(*order)
    return costs.withColumn("position", F.row_number().over(w))


def budget_guard(
    totals: DataFrame, extra_usd, budget_usd=CFG.budget_usd, out: str = "exceeds"
) -> DataFrame:
    """Adds whether total + extra would pass the budget; either may be a column name."""
    extra = F.col(extra_usd) if isinstance(extra_usd, str) else F.lit(float(extra_usd))
    budget = F.col(budget_usd) if isinstance(budget_usd, str) else F.lit(float(budget_usd))
    return totals.withColumn(out, F.col("total_usd") + extra > budget)


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(GPU_HOURLY_USD.items()), "instance_type string, on_demand_usd double"
    )


def spot_caps(instances: DataFrame, cfg: TrainingConfig = CFG) -> DataFrame:
    """On-demand price (fallback for unknown types) and spot cap. The catalogue has five rows."""
    prices = F.broadcast(price_table(instances.sparkSession))
    return (
        instances.join(prices, "instance_type", "left")
        .withColumn(
            "on_demand_usd", F.coalesce("on_demand_usd", F.lit(cfg.fallback_hourly_usd))
        )
        .withColumn("spot_cap_usd", F.col("on_demand_usd") * cfg.spot_fraction)
    )


def phase_costs(runs: DataFrame) -> DataFrame:
    """Adds amount_usd to runs with duration_s and hourly_usd."""
    return runs.withColumn("amount_usd", F.col("duration_s") / 3600.0 * F.col("hourly_usd"))


def candidate_path():
    """Artifact to evaluate: the DPO output, else the SFT output, else the cycle folder."""
    return F.coalesce("dpo_path", "sft_path", "cycle_dir")


def gpu_hours(runs: DataFrame) -> DataFrame:
    return runs.groupBy("cycle_id").agg(
        (F.coalesce(F.sum("duration_s"), F.lit(0.0)) / 3600.0).alias("gpu_hours")
    )


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    rest = [c for c in checkpoints.columns if c != "cycle_id"]
    return (
        checkpoints.groupBy("cycle_id")
        .agg(F.max_by(F.struct(*rest), F.struct("step", "timestamp")).alias("_c"))
        .select("cycle_id", "_c.*")
    )


def checkpoint_retention(checkpoints: DataFrame, keep: int = CFG.keep_checkpoints) -> DataFrame:
    """Adds `keep`: whether a checkpoint is among its cycle's highest steps."""
    w = W.partitionBy("cycle_id").orderBy(F.desc("step"), F.desc("phase"))
    return checkpoints.withColumn("_rn", F.row_number().over(w)).withColumn(
        "keep", F.col("_rn") <= keep
    ).drop("_rn")


def cycle_accounting(
    cycles: DataFrame, runs: DataFrame, costs: DataFrame, cfg: TrainingConfig = CFG
) -> DataFrame:
    """One row per cycle: spend, hours, artifact, status under its budget.

    `cycles` has cycle_id, cycle_dir and budget_usd (null for the default); `runs` has cycle_id,
    phase (sft or dpo), duration_s, hourly_usd, path; `costs` are records made before the cycle.
    Status: COST_EXCEEDED before provisioning when the projection passes the budget, after SFT
    when the projected DPO phase would; COMPLETED with both phases, else FAILED.
    """
    by_phase = phase_costs(runs).groupBy("cycle_id").agg(
        *[
            F.max(F.when(F.col("phase") == p, F.col(c))).alias(f"{p}_{c}")
            for p in ("sft", "dpo")
            for c in ("duration_s", "amount_usd", "path", "hourly_usd")
        ]
    )
    before = costs.groupBy("cycle_id").agg(F.sum("amount_usd").alias("_before"))
    rows = (
        cycles.join(by_phase, "cycle_id", "left").join(before, "cycle_id", "left")
        .withColumn("_before", F.coalesce("_before", F.lit(0.0)))
        .withColumn("budget_usd", F.coalesce("budget_usd", F.lit(cfg.budget_usd)))
    )
    budget = F.col("budget_usd")
    preflight = F.col("_before") + cfg.projected_usd > budget
    ran_sft = ~preflight & F.col("sft_path").isNotNull()
    after_sft = F.col("_before") + F.coalesce("sft_amount_usd", F.lit(0.0))
    stop = ran_sft & (after_sft + cfg.projected_dpo_hours * F.col("sft_hourly_usd") > budget)
    ran_dpo = ran_sft & ~stop & F.col("dpo_path").isNotNull()
    flags = rows.withColumns({"_pre": preflight, "_sft": ran_sft, "_stop": stop, "_dpo": ran_dpo})
    zero = F.lit(0.0)
    return flags.select(
        "cycle_id",
        F.when(F.col("_pre") | F.col("_stop"), "COST_EXCEEDED")
        .when(F.col("_dpo"), "COMPLETED")
        .otherwise("FAILED")
        .alias("status"),
        (
            F.col("_before")
            + F.when(F.col("_sft"), F.col("sft_amount_usd")).otherwise(zero)
            + F.when(F.col("_dpo"), F.col("dpo_amount_usd")).otherwise(zero)
        ).alias("cost_usd"),
        (
            (
                F.when(F.col("_sft"), F.col("sft_duration_s")).otherwise(zero)
                + F.when(F.col("_dpo"), F.col("dpo_duration_s")).otherwise(zero)
            )
            / 3600.0
        ).alias("gpu_hours"),
        F.coalesce(
            F.when(F.col("_dpo"), F.col("dpo_path")),
            F.when(F.col("_sft"), F.col("sft_path")),
            F.col("cycle_dir"),
        ).alias("candidate_path"),
        "budget_usd",
    )
