"""Alert budget, counters and the handoff to synthesis on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from driftloom.config import AlertBudgetConfig
from driftloom.operators.greedy import admit_within_budget
from driftloom.plans.metrics import bucketed_counters
from driftloom.sources.signals import evidence_requests

CFG = AlertBudgetConfig()


def budget_stream(alerts: DataFrame, cfg: AlertBudgetConfig = CFG) -> DataFrame:
    """Alerts (alert_id, level, ts_us) with `dispatched`; state is the last hour's admissions."""
    out = T.StructType(
        [
            T.StructField("alert_id", alerts.schema["alert_id"].dataType),
            T.StructField("level", T.StringType()),
            T.StructField("ts_us", T.LongType()),
            T.StructField("dispatched", T.BooleanType()),
        ]
    )
    stored = T.StructType([T.StructField("sent", T.ArrayType(T.LongType()))])

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        sent = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(parts)).sort_values(["ts_us", "alert_id"], kind="stable")
        limit = cfg.limits.get(key[0], cfg.unknown_limit)
        taken, sent = admit_within_budget(
            pdf["ts_us"].to_numpy(dtype=np.int64), sent, limit, cfg.window_s * 1_000_000
        )
        state.update(([int(s) for s in sent],))
        yield pdf[["alert_id", "level", "ts_us"]].assign(dispatched=taken)

    return (
        alerts.select("alert_id", "level", "ts_us")
        .groupBy("level")
        .applyInPandasWithState(run, out, stored, "append", "NoTimeout")
    )


def counter_stream(
    obs: DataFrame, ts: str, labels: list[str], width: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    """Live counters per time bucket; a bucket is final once the watermark passes it."""
    return bucketed_counters(obs.withWatermark(ts, delay), ts, width, labels)


def send_to_channels(
    admitted: DataFrame, channels: list[Callable[[DataFrame], None]], checkpoint: str
) -> DataStreamWriter:
    """Writer that gives each batch of admitted alerts to every channel, failures apart."""
    from driftloom.plans.alerts import LOG

    def each(batch: DataFrame, epoch: int) -> None:
        sent = batch.filter("dispatched").persist()
        try:
            for channel in channels:
                try:
                    channel(sent)
                except Exception as exc:  # noqa: BLE001 - one broken sink must not stop the rest
                    LOG.warning("alert channel %r failed: %s", channel, exc)
        finally:
            sent.unpersist()

    return admitted.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def handoff_to_synthesis(
    events: DataFrame,
    requests: DataFrame,
    run: Callable[[DataFrame, str], None],
    checkpoint: str,
) -> DataStreamWriter:
    """Writer that starts one synthesis job per batch of qualified events.

    The failures of a job are the distinct evidence requests found in `requests`. The job id
    comes from the batch's event ids, so a replayed batch overwrites its own output.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates(["event_id"]).persist()
        try:
            mark = fresh.filter("qualification_status = 'QUALIFIED'").agg(
                F.count(F.lit(1)).alias("n"),
                F.bit_xor(F.xxhash64("event_id")).alias("h"),
            ).first()
            if mark["n"]:
                asked = evidence_requests(fresh).select("request_id").distinct()
                run(requests.join(asked, "request_id", "left_semi"),
                    f"job-{mark['n']}-{mark['h'] & 0xFFFFFFFFFFFFFFFF:016x}")
        finally:
            fresh.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
