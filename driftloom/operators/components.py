"""Connected components of edge tables of any shape, by hooking and pointer doubling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.session import cut

LABEL = "id long, root long"


def follow(pointers: DataFrame) -> DataFrame:
    """(id, root) from a forest of pointers (id, up): roots are the ups that do not point on."""
    now = cut(pointers.select("id", F.col("up").alias("root"), F.lit(True).alias("open")))
    while not now.filter("open").isEmpty():
        above = now.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        now = cut(
            now.join(above, "root", "left").select(
                "id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("open")
            )
        )
    return now.select("id", "root")


def _union_find(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest node of each component; whole table of a bounded number of edges."""
    if pdf.empty:
        return pd.DataFrame({"id": [], "root": []}, dtype=np.int64)
    nodes, codes = np.unique(pdf[["u", "v"]].to_numpy(np.int64), return_inverse=True)
    codes = codes.reshape(-1, 2)
    label = np.arange(len(nodes))
    while True:
        low = label[codes].min(axis=1)
        new = label.copy()
        np.minimum.at(new, label[codes[:, 0]], low)
        np.minimum.at(new, label[codes[:, 1]], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return pd.DataFrame({"id": nodes, "root": nodes[label]})
        label = new


def component_labels(edges: DataFrame, limit: int) -> DataFrame:
    """(id, root) for every node of edges (u, v): root is the smallest node of its component.

    Up to `limit` edges are joined in one task. More are contracted in rounds: every node hooks to
    its smallest neighbour if that is smaller, hooks are followed by doubling, and the edges between
    what is left go on. Both ways give the smallest node.
    """
    edges = cut(edges.select("u", "v"))
    labels = None
    while True:
        if edges.limit(limit + 1).count() <= limit:
            last = cut(edges.coalesce(1).mapInPandas(_all_in_one, LABEL))
            return last if labels is None else _through(labels, last)
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("up"))
        roots = follow(low.filter("up < u").select(F.col("u").alias("id"), "up"))
        nodes = low.select(F.col("u").alias("id")).join(roots, "id", "left")
        step = cut(nodes.select("id", F.coalesce("root", "id").alias("root")))
        labels = step if labels is None else _through(labels, step)
        for side in ("u", "v"):
            to = step.select(F.col("id").alias(side), F.col("root").alias("_to"))
            edges = edges.join(to, side).withColumn(side, F.col("_to")).drop("_to")
        edges = cut(
            edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        )


def _all_in_one(frames):
    frames = list(frames)
    if frames:
        yield _union_find(pd.concat(frames))


def _through(labels: DataFrame, step: DataFrame) -> DataFrame:
    to = step.select(F.col("id").alias("root"), F.col("root").alias("_to"))
    return cut(labels.join(to, "root", "left").select("id", F.coalesce("_to", "root").alias("root")))
