"""Adaptive scores in event order across micro-batches, started from and saved to snapshots.

Rows of a key wait in state until the watermark has passed them and are then scored in the order of
event time and request id, whatever order they came in. An event-time timer releases them when no
further row of the key arrives. What waits is bounded by the rate times the watermark's delay; rows
that come later than that never reach the processor (`ingest.py` keeps them in a table).

The processor's input and its lists go row by row between Spark and Python. So rows of one key travel
and wait as bundles: Arrow batches in one binary cell.

A stream may start from a stored snapshot of baselines, and `stored_baselines` reads the state of a
stopped stream as such a snapshot, so a stream can go on under a new checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftloom.config import DIMENSIONS, DriftConfig
from driftloom.functions.signals import dominant_dimension
from driftloom.operators.adaptive import SEED, SLICE_ROWS, STATE, sliced_scores
from driftloom.streaming.scoring import KEYS, once

CFG = DriftConfig()
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: The baseline, and how many events of the key were released so far.
STORED = T.StructType([*STATE.fields, T.StructField("released", T.LongType())])
#: Rows of a bundle, and of a partition that are sorted into bundles at a time.
BUNDLE_ROWS = SLICE_ROWS
SORTED_ROWS = 20 * SLICE_ROWS
ROW = pa.schema(
    [("request_id", pa.string()), ("ts_us", pa.int64())] + [(d, pa.float64()) for d in DIMENSIONS]
)
WAITING = T.StructType([T.StructField("bundle", T.BinaryType())])
BUNDLED = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + WAITING.fields)
ORDERED = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("tenant_id", T.StringType()),
        T.StructField("position", T.LongType()),
    ]
    + [T.StructField("z_" + d, T.DoubleType()) for d in DIMENSIONS]
    + [T.StructField("composite", T.DoubleType())]
)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State variables need this store; the setting is put back after the query has started."""
    old = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, old)


def bundles(rows: pa.Table) -> Iterator[bytes]:
    """Rows as Arrow batches without their schema, which is always `ROW`."""
    for i in range(0, rows.num_rows, BUNDLE_ROWS):
        for batch in rows.slice(i, BUNDLE_ROWS).combine_chunks().to_batches():
            yield batch.serialize().to_pybytes()


def rows_of(found: list[bytes]) -> pa.Table:
    return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(x), ROW) for x in found], ROW)


def _keyed_bundles(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Bundles of these rows, each of one key."""
    rows = pa.Table.from_batches(batches)
    code = np.zeros(rows.num_rows, np.int64)
    for k in KEYS:
        at = pc.fill_null(rows.column(k).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        _, code = np.unique(code * (int(at.max()) + 2) + at + 1, return_inverse=True)
    order = np.argsort(code, kind="stable")
    rows, ends = rows.take(pa.array(order)).combine_chunks(), np.cumsum(np.bincount(code)).tolist()
    own, out = rows.select(ROW.names).cast(ROW), {f.name: [] for f in BUNDLED.fields}
    for i, j in zip([0, *ends], ends):
        found = list(bundles(own.slice(i, j - i)))
        for k in KEYS:
            out[k] += [rows.column(k)[i].as_py()] * len(found)
        out["bundle"] += found
    return pa.RecordBatch.from_pydict(out, pa.schema([(k, pa.string()) for k in KEYS] + [("bundle", pa.binary())]))


def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition as bundles of single keys."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= SORTED_ROWS:
            yield _keyed_bundles(held)
            held, n = [], 0
    if n:
        yield _keyed_bundles(held)


class OrderedScorer(StatefulProcessor):
    """Holds rows back until the watermark passes them, then scores before it learns."""

    def __init__(self, cfg: DriftConfig):
        self.cfg = cfg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.baseline = handle.getValueState("baseline", STORED)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        values = [None if pd.isna(row[n]) else row[n].item() for n in STATE.fieldNames()]
        self.baseline.update((int(values[0] or 0), *values[1:], int(row["released"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [x for f in rows for x in f["bundle"]]
        yield self._release(key, [*self._held(), *new], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._release(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def _held(self) -> list[bytes]:
        return [x[0] for x in self.waiting.get()] if self.waiting.exists() else []

    def _release(self, key, held: list[bytes], watermark_ms: int) -> pd.DataFrame:
        rows = rows_of(held).sort_by([("ts_us", "ascending"), ("request_id", "ascending")])
        if rows.column("ts_us").null_count:
            raise ValueError("rows without a time have no place in the order")
        n = int(np.searchsorted(rows.column("ts_us").to_numpy(), watermark_ms * 1000, "right"))
        due, rest = rows.slice(0, n).to_pandas(), rows.slice(n)
        self.waiting.clear()
        if rest.num_rows:
            for x in bundles(rest):
                self.waiting.appendList([(x,)])
            self.handle.registerTimer(rest.column("ts_us")[0].as_py() // 1000 + 1)
        names = STATE.fieldNames()
        stored = tuple(self.baseline.get()) if self.baseline.exists() else (*SEED.values(), 0)
        scores, _, end = sliced_scores(due, dict(zip(names, stored)), self.cfg)
        if n:
            self.baseline.update((*[end[n] for n in names], stored[-1] + n))
        out = due[["request_id", "ts_us"]].assign(
            model_version=key[0], tenant_id=key[1], position=stored[-1] + np.arange(n)
        )
        return out.assign(**dict(zip(ORDERED.fieldNames()[5:], scores.T)))

    def close(self) -> None:
        pass


def ordered_scores(
    signals: DataFrame, cfg: DriftConfig = CFG, delay: str = "10 minutes", baselines: DataFrame | None = None
) -> DataFrame:
    """Every released event of a stream of signals with its `position` in its key and its scores.

    Calibration events have no scores. `baselines` is a snapshot to start from: keys, the columns
    of the state and optionally `released`, the position to go on from. Start the query within
    `rocksdb_state`.
    """
    rows = once(signals.select("request_id", "ts_us", *KEYS, *DIMENSIONS), delay)
    start = None
    if baselines is not None:
        released = F.col("released") if "released" in baselines.columns else F.col("event_count")
        start = baselines.select(*KEYS, *STATE.fieldNames(), released.cast("long").alias("released")).groupBy(*KEYS)
    out = rows.drop("event_time").mapInArrow(bundled, BUNDLED).groupBy(*KEYS).transformWithStateInPandas(
        OrderedScorer(cfg), ORDERED, "Append", "EventTime", initialState=start
    )
    return out.withColumn("dominant_dimension", F.when(F.col("composite").isNotNull(), dominant_dimension()))


def stored_baselines(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Snapshot of a stopped `ordered_scores` stream: keys, baseline columns and `released`."""
    operators = spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorName").collect()
    number = next(r["operatorId"] for r in operators if r["operatorName"].startswith("transformWithState"))
    source = spark.read.format("statestore").option("path", checkpoint).option("operatorId", number)
    state = source.option("stateVarName", "baseline").load()
    return state.select("key.*", "value.*")
