"""Keyed tables kept as append logs: last write wins, status updates, cost rows, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.config import DIMENSIONS
from driftloom.schemas import CHECKPOINT


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key by `order`. An aggregate, so one hot key is reduced before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return log.groupBy(*keys).agg(picked).select(*keys, "_last.*").select(*log.columns)


def lineage_nodes(log: DataFrame, order: list[str] = ["seq"]) -> DataFrame:
    return latest(log, ["adapter_id"], order)


def lineage_edges(log: DataFrame, order: list[str] = ["seq"]) -> DataFrame:
    return latest(log, ["parent_id", "child_id"], order)


def checkpoints(
    log: DataFrame, order: list[str] = ["seq"], with_phase: bool = True
) -> DataFrame:
    """One row per cycle, step and phase; without phase later phases overwrite earlier ones."""
    return latest(log, ["cycle_id", "step"] + (["phase"] if with_phase else []), order)


def updated_status(nodes: DataFrame, updates: DataFrame) -> DataFrame:
    """Nodes with the status of `updates` (adapter_id, status); unknown ids change nothing.

    Of several updates of one adapter the last one wins, by `seq` if there is one.
    """
    order = F.struct(*[c for c in ("seq", "status") if c in updates.columns])
    new = updates.groupBy("adapter_id").agg(F.max_by("status", order).alias("_status"))
    return (
        nodes.join(new, "adapter_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .select(*nodes.columns)
    )


def decode_lineage(rows: DataFrame) -> DataFrame:
    """Lineage rows with their JSON columns decoded."""
    return rows.withColumns(
        {
            "target_failure_cluster_ids": F.from_json(
                "target_failure_cluster_ids", "array<int>"
            ),
            "evaluation_scores": F.from_json("evaluation_scores", "map<string,double>"),
            "deployment_record": F.from_json("deployment_record", "map<string,string>"),
        }
    )


def valid_costs(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): amounts must not be negative."""
    good = F.coalesce(F.col("amount_usd") >= 0, F.lit(False))
    return records.filter(good), records.filter(~good)


def append_costs(records: DataFrame, path: str) -> None:
    good, bad = valid_costs(records)
    if not bad.isEmpty():
        raise ValueError("cost amounts must be >= 0")
    good.write.mode("append").parquet(path)


def training_events(cycles: DataFrame) -> DataFrame:
    """Training-cycle events; an unknown trigger is MANUAL, a candidate needs completion."""
    known = F.col("triggered_by").isin("DRIFT", "SCHEDULE", "MANUAL")
    return cycles.select(
        "cycle_id",
        F.when(known, F.col("triggered_by")).otherwise("MANUAL").alias("triggered_by"),
        "trigger_event_id",
        "started_at",
        "status",
        "base_adapter_id",
        F.when(F.col("status") == "COMPLETED", F.col("candidate_adapter_id")).alias(
            "candidate_adapter_id"
        ),
        "cost_usd",
        "gpu_hours",
        "completed_at",
    )


def read_checkpoints(spark: SparkSession, folder: str, cycle_id: str | None = None) -> DataFrame:
    """Checkpoint metadata below folder/ckpt-<cycle>-step<n>/, lowest step first."""
    name = f"ckpt-{cycle_id}-step*" if cycle_id else "ckpt-*"
    rows = spark.read.schema(CHECKPOINT).json(f"{folder}/{name}/metadata.json")
    if cycle_id:
        rows = rows.filter(F.col("cycle_id") == cycle_id)
    return rows.orderBy("cycle_id", "step")


SNAPSHOT_COLUMNS = (
    ["model_version", "tenant_id", "event_count"]
    + ["mean_" + d for d in DIMENSIONS]
    + ["var_" + d for d in DIMENSIONS]
)


def save_baselines(baselines: DataFrame, path: str) -> None:
    baselines.select(*SNAPSHOT_COLUMNS).write.mode("overwrite").partitionBy(
        "model_version"
    ).parquet(path)


def load_baselines(spark: SparkSession, path: str, calibration_events: int = 1000) -> DataFrame:
    fields = ["tenant_id string", "event_count long"]
    fields += [f"{p}_{d} double" for p in ("mean", "var") for d in DIMENSIONS]
    return (
        spark.read.schema(", ".join(fields + ["model_version string"]))
        .parquet(path)
        .withColumn("is_calibrating", F.col("event_count") < calibration_events)
    )


def baseline_json(baselines: DataFrame) -> DataFrame:
    """Baselines as JSON documents keyed `baseline:<model>:<tenant>`."""
    body = F.struct(
        "model_version",
        "tenant_id",
        "event_count",
        F.struct(*[F.col("mean_" + d).alias(d) for d in DIMENSIONS]).alias("mean"),
        F.struct(*[F.col("var_" + d).alias(d) for d in DIMENSIONS]).alias("var"),
    )
    return baselines.select(
        F.concat_ws(":", F.lit("baseline"), "model_version", "tenant_id").alias("key"),
        F.to_json(body).alias("value"),
    )


def baseline_from_json(documents: DataFrame, calibration_events: int = 1000) -> DataFrame:
    dims = ", ".join(f"{d}: double" for d in DIMENSIONS)
    schema = (
        "struct<model_version: string, tenant_id: string, event_count: bigint, "
        f"mean: struct<{dims}>, var: struct<{dims}>>"
    )
    return (
        documents.select(F.from_json("value", schema).alias("_r"))
        .select(
            "_r.model_version",
            "_r.tenant_id",
            "_r.event_count",
            *[F.col("_r.mean." + d).alias("mean_" + d) for d in DIMENSIONS],
            *[F.col("_r.var." + d).alias("var_" + d) for d in DIMENSIONS],
        )
        .withColumn("is_calibrating", F.col("event_count") < calibration_events)
    )
