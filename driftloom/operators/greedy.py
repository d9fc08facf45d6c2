"""Greedy admission: whether a row is let through depends on the rows let through before it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.config import AlertBudgetConfig, LoopConfig
from driftloom.operators.folds import ordered_fold
from driftloom.operators.lifting import ROW, first_at_or_after, reached
from driftloom.operators.timeline import ranked
from driftloom.session import stage

DAY_US = 24 * 3_600_000_000
POSITIONS = 1 << 20


def _placed(df: DataFrame, key: str, tie: str) -> DataFrame:
    """Rows with their key as a struct (null keys meet) and their exact position in it."""
    return stage(ranked(df, [key], ["ts_us", tie], bucket_us=DAY_US, out="_rn").withColumn("_key", F.struct(key)))


def _fits(df: DataFrame, key: str, rows: int) -> bool:
    return df.groupBy(key).count().filter(F.col("count") > rows).isEmpty()


def admit_within_budget(times: np.ndarray, sent: list[int], limit: int, window_us: int):
    """Marks which sorted times are admitted, and the admitted times still in the window.

    At most `limit` admissions lie in the open-ended window (t - w, t]. When the budget is used
    up, the next candidate is the first time at or after the oldest admission plus w.
    """
    taken = np.zeros(len(times), dtype=bool)
    sent = list(sent)
    i = 0
    while limit > 0 and i < len(times):
        t = int(times[i])
        sent = [s for s in sent if s > t - window_us]
        if len(sent) < limit:
            taken[i] = True
            sent.append(t)
            i += 1
        else:
            i = max(i + 1, int(np.searchsorted(times, sent[0] + window_us, "left")))
    if len(times):
        sent = [s for s in sent if s > int(times[-1]) - window_us]
    return taken, sent


def alert_budget(
    alerts: DataFrame,
    cfg: AlertBudgetConfig = AlertBudgetConfig(),
    level: str = "level",
    tie: str = "alert_id",
) -> DataFrame:
    """Adds `dispatched`: alerts that fit their level's budget per rolling hour."""

    def step(pdf: pd.DataFrame, start: dict):
        limit = cfg.limits.get(pdf[level].iloc[0], cfg.unknown_limit)
        taken, sent = admit_within_budget(
            pdf["ts_us"].to_numpy(), start["sent"], limit, cfg.window_s * 1_000_000
        )
        return {"dispatched": taken}, {"sent": sent}

    return ordered_fold(
        alerts, [level], ["ts_us", tie], step, {"sent": []},
        T.StructType([T.StructField("sent", T.ArrayType(T.LongType()))]),
        T.StructType([T.StructField("dispatched", T.BooleanType())]),
        cfg.fold_rows,
    )


def schedule_fires(
    ticks: DataFrame, key: str, cfg: LoopConfig = LoopConfig(), tie: str = "tick_id"
) -> DataFrame:
    """Adds `fired`: a tick fires an interval after the last fire or recorded start.

    Rows with `recorded` true only stamp the clock. Nothing fires before the first stamp. Keys of
    at most `fold_rows` rows are folded in one group each; larger ones by doubling, see `lifting`.
    """
    gap = cfg.schedule_interval_s * 1_000_000
    if not _fits(ticks, key, cfg.fold_rows):
        return _schedule_by_doubling(ticks, key, gap, tie)

    def step(pdf: pd.DataFrame, start: dict):
        times = pdf["ts_us"].to_numpy()
        stamps = np.flatnonzero(pdf["recorded"].to_numpy(dtype=bool))
        fired = np.zeros(len(times), dtype=bool)
        last = start["last"]
        i = 0
        while i < len(times):
            s = int(np.searchsorted(stamps, i))
            stamp = int(stamps[s]) if s < len(stamps) else len(times)
            due = len(times) if last is None else max(
                i, int(np.searchsorted(times, last + gap, "left"))
            )
            at = min(stamp, due)
            if at >= len(times):
                break
            fired[at] = at != stamp
            last = int(times[at])
            i = at + 1
        return {"fired": fired}, {"last": last}

    return ordered_fold(
        ticks, [key], ["ts_us", tie], step, {"last": None},
        T.StructType([T.StructField("last", T.LongType())]),
        T.StructType([T.StructField("fired", T.BooleanType())]),
        cfg.fold_rows, bucket_us=24 * 3_600_000_000,
    )


def _schedule_by_doubling(ticks: DataFrame, key: str, gap: int, tie: str) -> DataFrame:
    rows = _placed(ticks, key, tie)
    position = F.col("_rn")
    times = rows.select("_key", F.col("ts_us").alias("_at"), position.alias("_value"))
    stamps = rows.filter("recorded").select("_key", position.alias("_at"), position.alias("_value"))
    due = first_at_or_after(times, rows.select(*ROW, (F.col("ts_us") + gap).alias("_at")), DAY_US)
    stamp = first_at_or_after(stamps, rows.select(*ROW, (position + 1).alias("_at")), POSITIONS)
    steps = due.join(stamp.withColumnRenamed("_found", "_stamp"), ROW).select(
        *ROW, F.least("_found", "_stamp").alias("_next")
    )
    acting, _ = reached(steps, stamps.groupBy("_key").agg(F.min("_value").alias("_rn")))
    marked = rows.join(acting.withColumn("_acts", F.lit(True)), ROW, "left")
    fired = F.col("_acts").isNotNull() & ~F.coalesce("recorded", F.lit(False))
    return marked.select(*ticks.columns, fired.alias("fired"))


def _admission_by_doubling(requests: DataFrame, key: str, gap: int, tie: str) -> DataFrame:
    rows = _placed(requests, key, tie)
    position = F.col("_rn")
    times = rows.select("_key", F.col("ts_us").alias("_at"), position.alias("_value"))
    ended = rows.filter("completed_us IS NOT NULL").select(*ROW, (F.col("completed_us") + gap).alias("_at"))
    steps = first_at_or_after(times, ended, DAY_US).select(*ROW, F.greatest("_found", position + 1).alias("_next"))
    steps = steps.join(ended, ROW).filter("_next IS NOT NULL")
    # A cycle that ends after the last request leaves no next one.
    steps = steps.join(rows.select("_key", position.alias("_next"), F.col("ts_us").alias("_t")), ["_key", "_next"])
    acting, _ = reached(steps.filter("_t >= _at"), rows.filter("_rn = 0"))
    admitted = stage(rows.join(acting, ROW).select(*ROW, "completed_us"))
    back = admitted.select("_key", (-position).alias("_at"), (-position).alias("_value"))
    holder = first_at_or_after(back, rows.select(*ROW, (-position).alias("_at")), POSITIONS)
    busy = admitted.select("_key", position.alias("_holder"), F.col("completed_us").alias("_busy"))
    marked = rows.join(holder.select(*ROW, (-F.col("_found")).alias("_holder")), ROW).join(busy, ["_key", "_holder"])
    reason = (
        F.when(F.col("_holder") == position, "ok")
        .when(F.col("_busy").isNull() | (F.col("ts_us") < F.col("_busy")), "running").otherwise("rate_limited")
    )
    return marked.select(*requests.columns, (F.col("_holder") == position).alias("admitted"), reason.alias("reason"))


def cycle_admission(
    requests: DataFrame, key: str, cfg: LoopConfig = LoopConfig(), tie: str = "request_id"
) -> DataFrame:
    """Adds `admitted` and `reason` to start requests with `ts_us` and `completed_us`.

    A request is blocked while an admitted cycle runs (for good when it never completed) and
    for the minimum gap after its completion. Keys of at most `fold_rows` rows are folded in one
    group each; larger ones by doubling, see `lifting`.
    """
    gap = cfg.min_cycle_gap_s * 1_000_000
    if not _fits(requests, key, cfg.fold_rows):
        return _admission_by_doubling(requests, key, gap, tie)
    forever = np.iinfo(np.int64).max

    def step(pdf: pd.DataFrame, start: dict):
        times = pdf["ts_us"].to_numpy()
        ended = pdf["completed_us"]
        done = np.full(len(times), forever, dtype="int64")
        done[ended.notna()] = ended[ended.notna()].astype("int64")
        reason = np.full(len(times), "ok", dtype=object)
        busy = start["done"]
        i = 0
        while i < len(times):
            if busy is not None:
                free = forever if busy == forever else busy + gap
                open_at = len(times) if free == forever else int(
                    np.searchsorted(times, free, "left")
                )
                if open_at > i:
                    blocked = times[i:open_at]
                    reason[i:open_at] = np.where(blocked < busy, "running", "rate_limited")
                    i = open_at
                    continue
            busy = int(done[i])
            i += 1
        return {"admitted": reason == "ok", "reason": reason}, {"done": busy}

    return ordered_fold(
        requests, [key], ["ts_us", tie], step, {"done": None},
        T.StructType([T.StructField("done", T.LongType())]),
        T.StructType(
            [T.StructField("admitted", T.BooleanType()), T.StructField("reason", T.StringType())]
        ),
        cfg.fold_rows, bucket_us=24 * 3_600_000_000,
    )
