"""Arrays of a fixed length, filled by all tasks and merged chunk by chunk."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

CHUNK = 1 << 14
PART = "chunk int, part binary"


def parts(array: np.ndarray) -> list[tuple[int, bytes]]:
    """Chunks of a task's array that hold anything."""
    cut = array.reshape(-1, min(CHUNK, len(array)))
    return [(i, row.tobytes()) for i, row in enumerate(cut) if row.any()]


def merged(chunks: DataFrame, length: int, kind: type, how=np.add, once: bool = False) -> np.ndarray:
    """Merges the tasks' chunks on the executors; the driver gets `length` values, never more.

    `once` says that no partition holds a chunk twice: then a task needs no second Python worker.
    """
    width = min(CHUNK, length)

    def pair(batches):
        """Merges the chunks of one partition, so that at most one row per chunk leaves it."""
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, part in zip(b.column(0).to_pylist(), b.column(1)):
                new = np.frombuffer(part.as_py(), kind)
                held[i] = how(held[i], new) if i in held else new
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())],
            names=["chunk", "part"],
        )

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = how.reduce([np.frombuffer(x, kind) for x in rows["part"]])
        return pd.DataFrame({"chunk": [key[0]], "part": [out.tobytes()]})

    whole = np.zeros(length, kind)
    small = (chunks if once else chunks.mapInArrow(pair, PART)).groupBy("chunk").applyInPandas(join, PART)
    for row in small.collect():
        whole[row["chunk"] * width : (row["chunk"] + 1) * width] = np.frombuffer(row["part"], kind)
    return whole


def bit_parts(values: np.ndarray, bits: np.ndarray) -> None:
    """Sets the bits that stand for some values (two each)."""
    for at in bit_places(values, len(bits)):
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


def bit_places(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    u = values.view(np.uint64)
    n = np.uint64(size * 8 - 1)
    return (u & n).astype(np.int64), ((u >> np.uint64(29)) & n).astype(np.int64)


def bit_found(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which values may have been set; none that was set is left out."""
    out = np.ones(len(values), bool)
    for at in bit_places(values, len(bits)):
        out &= (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def bloom(column: DataFrame, size: int) -> np.ndarray:
    """Filter of `size` bytes over a table of one long column."""

    def fill(batches):
        bits = np.zeros(size, np.uint8)
        for b in batches:
            bit_parts(b.column(0).to_numpy().copy(), bits)
        got = parts(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())],
            names=["chunk", "part"],
        )

    return merged(column.mapInArrow(fill, PART), size, np.uint8, np.bitwise_or)
