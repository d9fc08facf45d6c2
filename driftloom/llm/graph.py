"""Connected components of an edge table, by stars (large star, small star) until nothing moves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.llm.scratch import Scratch

EDGE = "u long, v long"


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star of each component of a bounded set of edges: (node, smallest node)."""
    nodes, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = codes[: len(u)], codes[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches):
    for batch in batches:
        u, v = (batch.column(i).to_numpy() for i in (0, 1))
        a, b = forest(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step; edges are (larger, smaller)."""
    both = edges if small else edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(low, "u")
    if small:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionAll(low.where("u != m").select("u", F.col("m").alias("v")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()


def components(scratch: Scratch, edges: DataFrame, native: bool = False) -> DataFrame:
    """(u, v): every node u that is not the smallest of its component, with that smallest node v.

    Edges are two long columns u, v. Every round is a written table, so lost executors repeat one
    round at most. The number of rounds grows with the square of the log of the longest path.
    """
    edges = edges.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    if not native:
        edges = edges.mapInArrow(_contract, EDGE)
    edges = scratch.write(edges.distinct(), "edges")
    before = None
    while True:
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if now == before or not now["n"]:
            return edges
        before = now
        nxt = scratch.write(_star(_star(edges, small=False), small=True), "edges")
        scratch.drop(edges)
        edges = nxt
