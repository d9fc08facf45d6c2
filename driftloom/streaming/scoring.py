"""Stage A: adaptive scores per (model, tenant), with the baseline as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.config import DIMENSIONS, DriftConfig
from driftloom.functions.signals import dominant_dimension
from driftloom.operators.adaptive import SCORES, SEED, STATE, sliced_scores

CFG = DriftConfig()
KEYS = ["model_version", "tenant_id"]

# The state also holds the position of the last folded event, so that late rows are told apart.
STORED = T.StructType(
    STATE.fields
    + [T.StructField("last_us", T.LongType()), T.StructField("last_id", T.StringType())]
)
SCORED = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
    ]
    + [T.StructField("z_" + d, T.DoubleType()) for d in DIMENSIONS]
    + [T.StructField("composite", T.DoubleType()), T.StructField("late", T.BooleanType())]
)


def once(signals: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Signals of a stream without redelivered requests; adds the event-time column."""
    timed = signals.withColumn("event_time", F.timestamp_micros("ts_us"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["request_id"])


def score_stream(signals: DataFrame, cfg: DriftConfig = CFG) -> DataFrame:
    """Scored events of a stream; rows older than their key's state come out with `late` set.

    Late rows are neither scored nor learned from. The batch job over the whole table is the
    way to include them.
    """
    names = STATE.fieldNames()

    def fold(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stored = state.get if state.exists else None
        start = dict(zip(names, stored)) if stored else dict(SEED)
        last = tuple(stored[len(names):]) if stored else (-1, "")
        pdf = pd.concat(list(parts), ignore_index=True).sort_values(["ts_us", "request_id"], kind="stable")
        late = ((pdf["ts_us"] < last[0]) | ((pdf["ts_us"] == last[0]) & (pdf["request_id"] <= last[1]))).to_numpy()
        fresh = pdf[~late]
        scores, has, end = sliced_scores(fresh, start, cfg)
        if len(fresh):
            last = (int(pdf["ts_us"].iloc[-1]), pdf["request_id"].iloc[-1])
            state.update((*[end[n] for n in names], *last))
        where = ["request_id", "ts_us", *KEYS]
        out = fresh.loc[has, where]
        if len(out):
            yield out.assign(**dict(zip(SCORES.fieldNames(), scores[has].T)), late=False)
        missed = pdf.loc[late, where]
        if len(missed):
            yield missed.assign(**{n: np.nan for n in SCORES.fieldNames()}, late=True)

    narrow = signals.select("request_id", "ts_us", *KEYS, *DIMENSIONS)
    return (
        narrow.groupBy(*KEYS)
        .applyInPandasWithState(fold, SCORED, STORED, "append", "NoTimeout")
        .withColumn("dominant_dimension", dominant_dimension())
    )
