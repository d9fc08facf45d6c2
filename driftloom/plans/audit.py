"""Audit of trigger, transition and promotion logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.config import ADAPTER_TRANSITIONS, LOOP_TERMINAL, LOOP_TRANSITIONS, LoopConfig
from driftloom.functions.signals import is_drift_trigger
from driftloom.operators.greedy import cycle_admission

CFG = LoopConfig()


def transition_table(spark: SparkSession, table: dict = LOOP_TRANSITIONS) -> DataFrame:
    moves = [(a, b) for a, targets in table.items() for b in targets]
    return spark.createDataFrame(moves, "from_state string, to_state string")


def illegal_transitions(log: DataFrame, table: dict = LOOP_TRANSITIONS) -> DataFrame:
    """Log rows whose move is not in the fixed adjacency table (a dozen rows, broadcast)."""
    legal = F.broadcast(transition_table(log.sparkSession, table))
    return log.join(legal, ["from_state", "to_state"], "left_anti")


def illegal_adapter_transitions(log: DataFrame) -> DataFrame:
    return illegal_transitions(log, ADAPTER_TRANSITIONS)


def drift_triggers(events: DataFrame, cfg: LoopConfig = CFG) -> DataFrame:
    """Trigger rows of drift events that fire."""
    return events.filter(is_drift_trigger(cfg.trigger_score)).select(
        F.sha2(F.concat_ws("|", F.lit("DRIFT"), "event_id"), 256).alias("trigger_id"),
        F.lit("DRIFT").alias("trigger_type"),
        F.col("event_id").alias("source_event_id"),
        F.lit(cfg.trigger_budget_usd).alias("budget_cap_usd"),
    )


def state_steps(
    log: DataFrame, key: str = "execution_id", order: list[str] = ["ts_us"]
) -> DataFrame:
    """Adds previous state, legality and seconds spent in each state. One key is one execution."""
    w = W.partitionBy(key).orderBy(*order)
    legal = F.lit(False)
    for a, targets in LOOP_TRANSITIONS.items():
        legal = legal | ((F.col("from_state") == a) & F.col("to_state").isin(*targets))
    return log.withColumns(
        {
            "previous_state": F.lag("to_state").over(w),
            "is_legal": legal,
            "seconds_in_state": (F.lead("ts_us").over(w) - F.col("ts_us")) / 1e6,
        }
    )


def execution_summaries(log: DataFrame) -> DataFrame:
    """One row per execution: start, current state, first terminal time, archive time, moves.

    The bootstrap row (IDLE to IDLE) is a history entry but no completion.
    """
    start = (F.col("from_state") == "IDLE") & (F.col("to_state") == "IDLE")
    ended = ~start & F.col("to_state").isin(*LOOP_TERMINAL)
    archived = ~start & (F.col("to_state") == "IDLE")
    when = F.struct("ts_us", "seq")
    out = log.groupBy("execution_id").agg(
        F.min("ts_us").alias("started_us"),
        F.min(F.when(ended, F.col("ts_us"))).alias("completed_us"),
        F.min(F.when(archived, F.col("ts_us"))).alias("archived_us"),
        F.max("ts_us").alias("_last_us"),
        F.max_by("to_state", when).alias("current_state"),
        F.count(F.lit(1)).alias("history_rows"),
        F.array_sort(
            F.collect_list(F.struct("ts_us", "seq", "from_state", "to_state"))
        ).alias("state_history"),
    )
    end = F.coalesce("completed_us", "_last_us")
    return out.withColumn("duration_s", (end - F.col("started_us")) / 1e6).drop("_last_us")


def execution_history(summaries: DataFrame, last_n: int = 20) -> DataFrame:
    """Last n archived executions, oldest first."""
    done = summaries.filter("archived_us IS NOT NULL")
    newest = done.orderBy(F.desc("archived_us"), F.desc("execution_id")).limit(last_n)
    return newest.orderBy("archived_us", "execution_id")


def stuck_executions(summaries: DataFrame) -> DataFrame:
    """Executions that never came back to IDLE: they block every later start."""
    return summaries.filter("archived_us IS NULL")


def loop_audit(requests: DataFrame, log: DataFrame, key: str = "cluster_id") -> DataFrame:
    """What became of every start request and every execution in the transition log.

    requests: request_id (the execution's id), key, ts_us, completed_us; log: execution_id, seq,
    ts_us, from_state, to_state. One row per execution_id with the admission decision, the number
    of moves and of illegal ones, the last state, and a finding. Ids of null match nothing.
    """
    started = cycle_admission(requests, key).select(
        F.col("request_id").alias("execution_id"), "admitted", "reason"
    )
    legal = transition_table(log.sparkSession).withColumn("_legal", F.lit(True))
    moves = (
        log.join(F.broadcast(legal), ["from_state", "to_state"], "left")
        .groupBy("execution_id")
        .agg(
            F.count(F.lit(1)).alias("moves"),
            F.count_if(F.col("_legal").isNull()).alias("illegal_moves"),
            F.max_by("to_state", F.struct("ts_us", "seq")).alias("current_state"),
        )
    )
    ran = F.col("moves").isNotNull()
    finding = (
        F.when(F.col("admitted").isNull(), "unrequested")
        .when(~F.col("admitted") & ran, "ran though refused")
        .when(~F.col("admitted"), "refused")
        .when(~ran, "never started")
        .when(F.col("illegal_moves") > 0, "illegal moves")
        .when(F.col("current_state") != "IDLE", "open")
        .otherwise("ok")
    )
    return started.join(moves, "execution_id", "full").withColumn("finding", finding)


def canary_anomalies(pairs: DataFrame, cfg: LoopConfig = CFG) -> DataFrame:
    gap = F.col("canary_score") - F.col("production_score")
    return pairs.withColumn("roll_back", gap > cfg.canary_sigma)


def current_production(promotions: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Latest promoted adapter per cluster."""
    return promotions.groupBy(key).agg(
        F.max_by("adapter_id", F.struct("ts_us", "adapter_id")).alias("adapter_id")
    )


def adapter_states(adapters: DataFrame, log: DataFrame) -> DataFrame:
    """Current state of every registered adapter, CANDIDATE before its first move."""
    last = log.groupBy("adapter_id").agg(
        F.max_by("to_state", F.struct("ts_us", "seq")).alias("state")
    )
    return adapters.select("adapter_id").distinct().join(last, "adapter_id", "left").withColumn(
        "state", F.coalesce("state", F.lit("CANDIDATE"))
    )


def promotion_outcomes(loads: DataFrame) -> DataFrame:
    """Outcome per adapter from its replica loads: any failure rolls back."""
    return loads.groupBy("adapter_id").agg(
        F.count_if(~F.col("success")).alias("failed_replicas"),
        F.count_if(F.col("success")).alias("loaded_replicas"),
        (F.count_if(~F.col("success")) > 0).alias("rolled_back"),
    )
