"""Stage B: alert levels and qualified drift events per model, over the scored stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.config import ALERT_LEVELS, DIMENSIONS, DriftConfig
from driftloom.plans.drift import drift_event_columns

CFG = DriftConfig()

TICK_US = 1_000_000

# Evidence tail (last 499 rows), rows seen so far, and for every tenant the rows that the longest
# window still reaches: their times and scores, 16 bytes a row, in one binary cell for each tick.
STORED = T.StructType(
    [
        T.StructField("seen", T.LongType()),
        T.StructField("e_ts", T.ArrayType(T.LongType())),
        T.StructField("e_score", T.ArrayType(T.DoubleType())),
        T.StructField("e_id", T.ArrayType(T.StringType())),
        T.StructField("w_tenant", T.ArrayType(T.StringType())),
        T.StructField("w_tick", T.ArrayType(T.LongType())),
        T.StructField("w_rows", T.ArrayType(T.BinaryType())),
    ]
)
LEVELED = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
    ]
    + [T.StructField("z_" + d, T.DoubleType()) for d in DIMENSIONS]
    + [
        T.StructField("composite", T.DoubleType()),
        T.StructField("alert_level", T.StringType()),
        T.StructField("qualified", T.BooleanType()),
        T.StructField("buffer_len", T.LongType()),
        T.StructField("evidence_request_ids", T.ArrayType(T.StringType())),
    ]
)


def window_means(ts: np.ndarray, score: np.ndarray, new: int, seconds: float) -> np.ndarray:
    """Mean over the last `seconds` for the last `new` rows of one sorted series."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    at = np.arange(len(ts) - new, len(ts))
    lo = np.searchsorted(ts, ts[at] - int(seconds * 1_000_000), "left")
    return (total[at + 1] - total[lo]) / (at + 1 - lo)


def levels_of(ts: np.ndarray, score: np.ndarray, new: int, cfg: DriftConfig) -> np.ndarray:
    out = np.full(new, None, dtype=object)
    for name in reversed(ALERT_LEVELS):
        hit = window_means(ts, score, new, cfg.windows_s[name]) >= cfg.thresholds[name]
        out[hit] = name
    return out


def by_tick(ts: np.ndarray, score: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(tick, its rows) of a sorted series."""
    ticks, first = np.unique(ts // TICK_US * TICK_US, return_index=True)
    for tick, i, j in zip(ticks.tolist(), first, [*first[1:], len(ts)]):
        yield tick, ts[i:j].tobytes() + score[i:j].tobytes()


def of_ticks(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Times and scores of the rows that `by_tick` packed."""
    ts = b"".join(bytes(c[:len(c) // 2]) for c in cells)
    score = b"".join(bytes(c[len(c) // 2:]) for c in cells)
    return np.frombuffer(ts, "int64"), np.frombuffer(score, "float64")


def judge_buffer(ts: np.ndarray, score: np.ndarray, cfg: DriftConfig) -> bool:
    """Whether one buffer, ending at the current event, is significant, coherent, persistent."""
    hit = score >= cfg.anomalous_at
    found, when = score[hit], ts[hit]
    if len(found) < cfg.min_anomalous or found.mean() == 0:
        return False
    if found.std() / found.mean() >= cfg.max_variation:
        return False
    for w in cfg.persistence_windows_s:
        recent = found[when >= ts[-1] - w * 1_000_000]
        if not len(recent) or recent.mean() < cfg.persistence_at:
            return False
    return True


def alert_stream(scored: DataFrame, cfg: DriftConfig = CFG, delay: str = "10 minutes") -> DataFrame:
    """Every scored row with its level; CRITICAL and EMERGENCY rows are also judged.

    The scored table is read as a stream of its own, keyed by model, so both stages keep their
    own partitioning. What earlier batches left of a window is kept row by row, so levels depend
    neither on the rate nor on the cut into batches. Rows that come later than `delay` are left out.
    A model that stays silent for longer than its longest window gives back the room of its windows;
    its evidence is kept.
    """
    zs = ["z_" + d for d in DIMENSIONS]
    tail = cfg.buffer_rows - 1
    longest = int(max(cfg.windows_s.values()) * 1_000_000)

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stored = state.get if state.exists else (0, [], [], [], [], [], [])
        seen, e_ts, e_score, e_id, w_tenant, w_tick, w_rows = stored
        if state.hasTimedOut:
            state.update((seen, list(e_ts), list(e_score), list(e_id), [], [], []))
            return
        pdf = pd.concat(list(parts)).sort_values(["ts_us", "request_id"], kind="stable")
        pdf = pdf.reset_index(drop=True)

        old: dict[str | None, list] = {}
        for tenant, *entry in zip(w_tenant, w_tick, w_rows):
            old.setdefault(tenant, []).append(entry)
        level = np.full(len(pdf), None, dtype=object)
        now = int(pdf["ts_us"].iloc[-1])
        oldest = (now - longest) // TICK_US * TICK_US
        for tenant, rows in pdf.groupby("tenant_id", dropna=False):
            tenant = None if pd.isna(tenant) else tenant
            ts, score = of_ticks([cell for _, cell in old.get(tenant, [])])
            ts = np.concatenate([ts, rows["ts_us"].to_numpy("int64")])
            score = np.concatenate([score, rows["composite"].to_numpy("float64")])
            level[rows.index.to_numpy()] = levels_of(ts, score, len(rows), cfg)
            order = np.argsort(ts, kind="stable")
            old[tenant] = list(by_tick(ts[order], score[order]))
        kept = [(t, *e) for t, entries in old.items() for e in entries if e[0] >= oldest]

        ts = np.concatenate([np.array(e_ts, dtype="int64"), pdf["ts_us"].to_numpy("int64")])
        score = np.concatenate([np.array(e_score, dtype="float64"),
                                pdf["composite"].to_numpy("float64")])
        ids = [*e_id, *pdf["request_id"].tolist()]
        base = len(e_id)
        ok = np.zeros(len(pdf), dtype=bool)
        evidence = [None] * len(pdf)
        for i in range(len(pdf)):
            if level[i] in cfg.qualified_levels:
                end = base + i + 1
                lo = max(0, end - cfg.buffer_rows)
                ok[i] = judge_buffer(ts[lo:end], score[lo:end], cfg)
                if ok[i]:
                    evidence[i] = ids[max(lo, end - cfg.evidence_ids):end]
        size = np.minimum(seen + np.arange(1, len(pdf) + 1), cfg.buffer_rows)
        state.update((
            int(seen + len(pdf)), ts[-tail:].tolist(), score[-tail:].tolist(), ids[-tail:],
            *([e[i] for e in kept] for i in range(3)),
        ))
        state.setTimeoutTimestamp(max((now + longest) // 1000, state.getCurrentWatermarkMs()) + 1)
        out = pdf[["request_id", "ts_us", "model_version", "tenant_id", *zs, "composite"]]
        yield out.assign(
            alert_level=level, qualified=ok, buffer_len=size,
            evidence_request_ids=pd.Series(evidence, dtype=object),
        )

    rows = scored.filter(~F.coalesce(F.col("late"), F.lit(False))).select(
        "request_id", "ts_us", "model_version", "tenant_id", *zs, "composite",
        F.timestamp_micros("ts_us").alias("event_time"),
    ).withWatermark("event_time", delay)
    return rows.groupBy("model_version").applyInPandasWithState(
        run, LEVELED, STORED, "append", "EventTimeTimeout"
    )


def drift_event_stream(scored: DataFrame, cfg: DriftConfig = CFG) -> DataFrame:
    """Qualified drift events of the scored stream, in the declared event schema."""
    rows = alert_stream(scored, cfg).filter("qualified")
    return rows.select(*drift_event_columns(cfg))
