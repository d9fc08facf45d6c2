"""Exact top-k search by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks of bounded size, near each other by a bounded sample of pivots (this
sets how much is skipped, never the result). A block keeps, for each dimension, the list of its
vectors in descending and in ascending order. For a query the lists are read in parallel from the
end that its component favours, for the queries of a block together; each vector met is scored in full; the threshold is the score that
a vector standing at the current depth of all lists would have. Reading stops when the threshold
cannot beat the k-th result; at equal score, when every vector not met yet has a larger id.

1. each query searches its own block, which gives the score that others must beat;
2. bounds of blocks (largest and smallest component per dimension, the threshold at depth 0) are
   compared with it, query tiles against tiles of blocks;
3. the blocks left over are searched from that score on.

Vectors that are null, or hold a null or a non-finite component, or differ in length from `dim`,
take no part. A null id takes no part. Of equal scores the smaller id comes first; repeated ids are
repeated rows. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.scratch import Scratch

HIT = "query_id long, vec_id long, score long"
#: Queries of a block that read its lists together.
TOGETHER = 512
#: Stands for no floor.
LEAST = -(2**62)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with whole numbers floor(scale * x); rows that take no part are gone."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(
        F.coalesce(sound, F.lit(False))
    ).select("vec_id", x.alias("v"))


class Lists:
    """Sorted lists of one block: ids ascending, so equal values stand in order of id."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.down = np.argsort(-self.rows, axis=0, kind="stable")
        self.up = np.argsort(self.rows, axis=0, kind="stable")

    def search(
        self, queries: np.ndarray, own: np.ndarray | None, k: int, floors: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of each query as (query, score, id); those below its floor may be missing.

        All queries read on together, each from the ends its components favour, and a vector that one
        of them meets is scored for all that still read. `floors` are the least numbers where there are none.
        """
        n, dims = self.rows.shape
        rows, asked = self.rows, queries
        # products in double precision are exact as long as no sum can reach 2**53
        if np.abs(rows).max(initial=0).astype(float) * np.abs(asked).astype(float).sum(1).max(initial=0) < 2.0**53:
            rows, asked = rows.astype(np.float64), asked.astype(np.float64)
        met = np.zeros(n, bool)
        places = np.arange(dims)
        reading = np.arange(len(queries))
        least, name = floors.copy(), np.full(len(queries), -1)
        full = np.zeros(len(queries), bool)
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        depth, step = 0, 8
        while depth < n and len(reading):
            upto = min(n, depth + step)
            wanted = asked[reading]
            used = [(wanted > 0).any(0), (wanted < 0).any(0)]
            fresh = np.concatenate([self.down[depth:upto, used[0]].ravel(), self.up[depth:upto, used[1]].ravel()])
            fresh = np.unique(fresh) if upto < n else np.arange(n)
            fresh = fresh[~met[fresh]]
            met[fresh] = True
            scores = (wanted @ rows[fresh].T).astype(np.int64)
            q, v = np.nonzero(scores >= least[reading][:, None])
            if own is not None:
                other = self.ids[fresh[v]] != own[reading[q]]
                q, v = q[other], v[other]
            best = _best(np.append(best[0], reading[q]), np.append(best[1], scores[q, v]), np.append(best[2], self.ids[fresh[v]]), k)
            last = np.flatnonzero(np.bincount(best[0], minlength=1)[best[0]] == k)[k - 1 :: k]
            full[best[0][last]], least[best[0][last]], name[best[0][last]] = True, best[1][last], best[2][last]
            high, low = self.down[upto - 1], self.up[upto - 1]
            threshold = np.maximum(wanted, 0) @ rows[high, places] + np.minimum(wanted, 0) @ rows[low, places]
            seen = np.where(wanted > 0, self.ids[high], np.where(wanted < 0, self.ids[low], np.iinfo(np.int64).min))
            tied = (threshold == least[reading]) & full[reading] & (seen.max(1, initial=np.iinfo(np.int64).min) >= name[reading])
            reading = reading[~((threshold < least[reading]) | tied)]
            depth, step = upto, step * 2
        return best


def _best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, in order."""
    order = np.lexsort((vec, -score, query))
    query = query[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], score[order][kept], vec[order][kept]


def _matrix(column) -> np.ndarray:
    return np.array(column.tolist(), np.int64)


def _search(k: int, own_block: bool):
    def run(_key, block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(queries):
            lists = Lists(block["vec_id"].to_numpy(), _matrix(block["v"]))
            names, asked = queries["query_id"].to_numpy(), _matrix(queries["v"])
            floors = queries["floor"].fillna(LEAST).to_numpy().astype(np.int64)
            for lo in range(0, len(names), TOGETHER):
                own = names[lo : lo + TOGETHER]
                q, score, vec = lists.search(asked[lo : lo + TOGETHER], own if own_block else None, k, floors[lo : lo + TOGETHER])
                out.append(pd.DataFrame({"query_id": own[q], "vec_id": vec, "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return run


def _near(_key, queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
    """(query, block) pairs whose bound reaches the query's score."""
    if not len(queries) or not len(blocks):
        return pd.DataFrame({"query_id": [], "block": []})
    q = _matrix(queries["v"])
    high, low = _matrix(blocks["high"]), _matrix(blocks["low"])
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    floor = queries["floor"].fillna(LEAST).to_numpy().astype(np.int64)
    own = queries["block"].to_numpy()[:, None] == blocks["block"].to_numpy()[None, :]
    a, b = np.nonzero((bound >= floor[:, None]) & ~own)
    return pd.DataFrame({"query_id": queries["query_id"].to_numpy()[a], "block": blocks["block"].to_numpy()[b]})


def _pivots(vectors: DataFrame, most: int) -> list[list[int]]:
    """At most `most` vectors, those whose ids have the smallest hashes."""
    got = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).select("v").collect()
    return [list(r["v"]) for r in got]


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 2048, pivots: int = 48, tile: int = 2048
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of vectors (vec_id, v) for each of queries.

    `v` are arrays of whole numbers of one length. A vector with the query's own id is no result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    base = scratch.write(vectors, "vectors")
    centres = _pivots(base, pivots)
    if not centres:
        return base.selectExpr("vec_id as query_id", "1 as rank", "vec_id", "0L as score").limit(0)
    made = np.array(centres, np.int64)

    @F.pandas_udf("int")
    def nearest(v: pd.Series) -> pd.Series:
        rows = _matrix(v) if len(v) else np.empty((0, made.shape[1]), np.int64)
        return pd.Series((rows @ made.T * 2 - (made * made).sum(axis=1)).argmax(axis=1).astype(np.int32))

    dealt = scratch.write(base.withColumn("cell", nearest("v")), "cells")
    sizes = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    named = dealt.join(F.broadcast(sizes), "cell").withColumn(  # at most `pivots` rows
        "block", F.col("cell").cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    ).select("block", "vec_id", "v")
    named = scratch.write(named, "blocks")

    asked = queries.select(F.col("vec_id").alias("query_id"))
    asked = named.join(asked.withColumnRenamed("query_id", "vec_id").distinct(), "vec_id", "left_semi").select(
        "block", F.col("vec_id").alias("query_id"), "v"
    ).dropDuplicates(["query_id"])
    asked = scratch.write(asked, "queries")
    own = named.groupBy("block").cogroup(
        asked.withColumn("floor", F.lit(None).cast("double")).groupBy("block")
    ).applyInPandas(_search(k, True), HIT)
    own = scratch.write(own, "own")
    floors = own.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor")
    )
    asked = asked.join(floors, "query_id", "left")

    dims = len(centres[0])
    bounds = named.groupBy("block").agg(
        F.array([F.max(F.col("v")[i]) for i in range(dims)]).alias("high"),
        F.array([F.min(F.col("v")[i]) for i in range(dims)]).alias("low"),
    )
    bounds = scratch.write(bounds, "bounds")
    asked = scratch.write(asked, "floors")
    q_tiles, b_tiles = 1 + asked.count() // tile, 1 + bounds.count() // tile
    left = asked.withColumn("qt", F.pmod(F.xxhash64("query_id"), F.lit(q_tiles))).withColumn(
        "bt", F.explode(F.sequence(F.lit(0), F.lit(b_tiles - 1)))
    )
    right = bounds.withColumn("bt2", F.pmod(F.xxhash64("block"), F.lit(b_tiles))).withColumn(
        "qt2", F.explode(F.sequence(F.lit(0), F.lit(q_tiles - 1)))
    )
    pairs = left.groupBy("qt", F.col("bt").cast("long")).cogroup(
        right.groupBy(F.col("qt2").cast("long"), "bt2")
    ).applyInPandas(_near, "query_id long, block long")
    pairs = scratch.write(pairs, "pairs")

    # a block asked by many queries is copied for every `tile` of them
    loads = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("copies"))
    loads = scratch.write(loads, "loads")
    copies = named.join(loads, "block").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    ).select("block", "copy", "vec_id", "v")
    wanted = pairs.join(loads, "block").join(asked.drop("block"), "query_id").select(
        F.col("block").alias("b"), F.pmod(F.xxhash64("query_id"), F.col("copies")).cast("int").alias("c"),
        "query_id", "v", "floor",
    )
    more = copies.groupBy("block", "copy").cogroup(wanted.groupBy("b", "c")).applyInPandas(_search(k, True), HIT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return own.unionAll(more).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
