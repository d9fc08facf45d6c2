"""Ordered folds whose next step depends on earlier decisions.

A key small enough for one task is folded in one go. A larger key is cut into chunks of
`fold_rows` rows. Every chunk is folded from an assumed start state; a chunk whose assumed
start differs from the end of the chunk before it is folded again, until no start changes.
The first chunk's start is known, so each round settles at least one more chunk, and folds
that forget their start settle in two or three rounds. The result is that of one long fold.

Rows of a chunk come sorted and in Arrow batches, led by one row that holds the start state; the
state is carried from batch to batch, so a Python worker holds one batch whatever the chunk's size.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from driftloom.operators.timeline import HOUR_US, ranked, whole_part
from driftloom.session import broadcast_if_small, cut, stage


# A chunk's start state is below 1 KB.
BROADCAST_CHUNKS = 50_000


def _null_safe(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on `by` in which null keys match each other; keeps the left side's key columns."""
    named = right.withColumnsRenamed({k: "_r_" + k for k in by})
    on = F.lit(True)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col("_r_" + k))
    return left.join(named, on, how).drop(*["_r_" + k for k in by])


def _led(rows: DataFrame, starts: DataFrame, by: list[str], order: list[str], names: list[str]) -> DataFrame:
    """Rows sorted within their chunks, each chunk led by a row that holds its start state in `_s_*`.

    Lists travel as text: Spark measures a batch after each row, and for that walks a list column again.
    """
    held = {n: starts.schema[n].dataType for n in names}
    lists = [n for n in names if isinstance(held[n], T.ArrayType)]
    starts = starts.withColumns({n: F.to_json(n) for n in lists})
    blank = {"_s_" + n: F.lit(None).cast("string" if n in lists else held[n]) for n in names}
    plain = rows.select("*", *[c.alias(n) for n, c in blank.items()], F.lit(1).alias("_lead"))
    given = {"_s_" + n: F.col(n) for n in names} | {"_lead": F.lit(0)} | {k: F.col(k) for k in by}
    leads = starts.select(
        *[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in plain.schema.fields]
    )
    both = plain.unionAll(leads).repartition(*by)
    return both.sortWithinPartitions(*by, "_lead", *[F.col(c).asc_nulls_last() for c in order])


def _folded(batches: Iterator[pa.RecordBatch], step: Callable, seed: dict, names: list[str]) -> Iterator[tuple]:
    """(leading row, None, None) for each chunk, then (rows, new columns, end state) for each part of it
    that one batch holds."""
    now = dict(seed)
    for batch in batches:
        table = pa.Table.from_batches([batch])
        lead = table.column("_lead").to_numpy() == 0
        marks = np.flatnonzero(np.diff(np.concatenate(([True], lead, [True]))) != 0).tolist()
        bounds = sorted({0, *marks, *np.flatnonzero(lead).tolist(), table.num_rows})
        for i, j in zip(bounds, bounds[1:]):
            part = table.slice(i, j - i)
            if lead[i]:
                now = {n: _plain(part.column("_s_" + n)[0].as_py(), seed[n]) for n in names}
                yield part, None, None
            else:
                rows = part.drop_columns(["_lead", *["_s_" + n for n in names]])
                cols, now = step(rows.to_pandas(date_as_object=True), now)
                yield rows, cols, now


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    step: Callable[[pd.DataFrame, dict], tuple[dict, dict]],
    seed: dict,
    state: T.StructType,
    added: T.StructType,
    fold_rows: int,
    ts: str = "ts_us",
    guesses: Callable[[], DataFrame] | None = None,
    bucket_us: int = HOUR_US,
) -> DataFrame:
    """Adds the columns `added` computed by `step(rows, start) -> (new columns, end)`.

    `step` gets sorted rows and the state before them: the rows of one key, or a part of them that the
    next call goes on from. `guesses` may give a better assumed start per key than `seed`; it changes the
    number of rounds only.
    """
    names = state.fieldNames()
    types = {f.name: f.dataType for f in state.fields}
    known = [F.lit(seed[n]).cast(types[n]).alias(n) for n in names]
    out_schema = T.StructType(df.schema.fields + added.fields)
    wanted = df.columns
    given = [(f.name, to_arrow_type(f.dataType)) for f in added.fields]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, cols, _ in _folded(batches, step, seed, names):
            if cols is not None:
                table = part.select(wanted)
                for name, kind in given:
                    table = table.append_column(name, pa.array(cols[name], kind, from_pandas=True))
                yield from table.combine_chunks().to_batches()

    counts = cut(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    if counts.filter(F.col("n") > fold_rows).isEmpty():
        return _led(df, counts.select(*keys, *known), keys, order, names).mapInArrow(emit, out_schema)

    rows = stage(
        ranked(df, keys, order, ts, bucket_us, "_rn")
        .withColumn("_chunk", whole_part(F.col("_rn"), fold_rows))
        .drop("_rn")
    )
    by = [*keys, "_chunk"]
    chunks = rows.select(*by).distinct()
    if guesses is None:
        starts = chunks.select(*by, *known)
    else:
        g = guesses().select(*keys, *[F.col(n).cast(types[n]).alias("_g_" + n) for n in names])
        assumed = [
            F.when(F.col("_chunk") == 0, k).otherwise(F.coalesce(F.col("_g_" + n), k)).alias(n)
            for n, k in zip(names, known)
        ]
        starts = _null_safe(chunks, g, keys, "left").select(*by, *assumed)
    starts = cut(starts)

    end_schema = T.StructType([rows.schema[k] for k in by] + [T.StructField("_end_" + n, types[n]) for n in names])
    end_kinds = [to_arrow_type(types[n]) for n in names]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(head: pa.Table, end: dict) -> pa.RecordBatch:
            cols = [head.column(k).combine_chunks() for k in by]
            cols += [pa.array([end[n]], kind) for n, kind in zip(names, end_kinds)]
            return pa.RecordBatch.from_arrays(cols, names=[*by, *["_end_" + n for n in names]])

        head = end = None
        for part, cols, state_now in _folded(batches, step, seed, names):
            if cols is not None:
                end = state_now
                continue
            if end is not None:
                yield row(head, end)
            head, end = part.select(by), None
        if end is not None:
            yield row(head, end)

    def of_chunks(s: DataFrame) -> DataFrame:
        # Later rounds fold few chunks; a short list of them filters the rows where they are.
        return _null_safe(rows, broadcast_if_small(s.select(*by), BROADCAST_CHUNKS), by, "left_semi")

    todo, done = starts, None
    while True:
        asked = rows if done is None else of_chunks(todo)
        fresh = _led(asked, todo, by, order, names).mapInArrow(ends, end_schema)
        if done is not None:
            fresh = fresh.unionByName(_null_safe(done, todo.select(*by), by, "left_anti"))
        done = cut(fresh)
        previous = W.partitionBy(*keys).orderBy("_chunk")
        linked = done.select(
            *by, *[F.lag("_end_" + n).over(previous).alias("_new_" + n) for n in names]
        ).filter(F.col("_chunk") > 0)
        joined = _null_safe(starts, linked, by, "left")
        moved = F.lit(False)
        for n in names:
            moved = moved | ~F.col(n).eqNullSafe(F.col("_new_" + n))
        moved = moved & (F.col("_chunk") > 0)
        pick = [F.when(moved, F.col("_new_" + n)).otherwise(F.col(n)).alias(n) for n in names]
        nxt = cut(joined.select(*by, moved.alias("_moved"), *pick))
        starts = nxt.drop("_moved")
        todo = nxt.filter("_moved").drop("_moved")
        if todo.isEmpty():
            break

    return _led(rows, starts, by, order, names).mapInArrow(emit, out_schema)


def _plain(v, like):
    """Cell of a leading row back to the Python value a state holds (None stays None)."""
    if isinstance(like, list):
        return [] if v is None else [int(x) for x in json.loads(v)]
    if v is None or v != v:
        return None
    if isinstance(like, bool):
        return bool(v)
    if isinstance(like, int):
        return int(v)
    return float(v)
