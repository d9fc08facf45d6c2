"""Exact nearest neighbours by cosine similarity, in blocks.

Vectors and queries are hashed into blocks of bounded size. Each block pair is worked out in one task,
by matrix products of small tiles, which keeps only the k best per query; the best of all blocks follow
from a ranked merge. No pair of rows is ever a row of its own beyond those k per block. Blocks get
larger with the table, up to `BLOCK_BYTES`: till then what is sent grows as the table does. The
products themselves are quadratic, as for any exact method without bounds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: Blocks of a side while they are small enough, largest block as a matrix, rows of a tile.
FEW_BLOCKS = 16
BLOCK_BYTES = 32 << 20
TILE = 1024


def matrix(column: pd.Series, normalise: bool) -> np.ndarray:
    m = np.stack(column.to_list()).astype(np.float64)
    if normalise:
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    return m


def block_count(df: DataFrame, vec_col: str, rows: int) -> int:
    """Blocks of `rows` rows, but no more than `FEW_BLOCKS` while a block stays below `BLOCK_BYTES`:
    every row is sent once for each block of the other side."""
    n, dim = df.agg(F.count(F.lit(1)), F.max(F.size(vec_col))).first()
    least = -(-n * max(dim or 1, 1) * 8 // BLOCK_BYTES)
    return max(1, min(-(-n // rows), max(FEW_BLOCKS, least)))


def best_of(a: np.ndarray, b: np.ndarray, k: int, skip: np.ndarray | None = None):
    """(row, column, score) of the k largest products of every row of `a` with rows of `b`, ties to the
    smaller column. `skip` has the ids of both sides; pairs of equal ids do not count.

    After the first tile only what beats the k-th best so far is looked at.
    """
    row, col, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = np.full(len(a), -np.inf)
    for j in range(0, len(b), TILE):
        s = a @ b[j:j + TILE].T
        if np.isnan(s.sum()):
            s[np.isnan(s)] = -np.inf
        if skip is not None:
            s[skip[0][:, None] == skip[1][None, j:j + TILE]] = -np.inf
        if not j and s.shape[1] > k:
            best = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            r, c = np.nonzero((s >= best[:, None]) & (s > -np.inf))
        else:
            r, c = np.nonzero(s > floor[:, None])
        row, col, score = np.concatenate([row, r]), np.concatenate([col, c + j]), np.concatenate([score, s[r, c]])
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(a)))[row]
        row, col, score, place = (x[place < k] for x in (row, col, score, place))
        floor[row[place == k - 1]] = score[place == k - 1]
    return row, col, score


def in_blocks(df: DataFrame, id_col: str, n: int) -> DataFrame:
    return df.withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int"))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "vec",
    query_id: str = "query_id",
    query_vec: str = "query_vec",
    normalise_vectors: bool = False,
    skip_same_id: bool = False,
    block_rows: int = 4096,
) -> DataFrame:
    """The k most similar vectors per query: query_id, id, score, rank.

    Queries are normalised; ties go to the smaller id; fewer than k rows come back when there
    are fewer vectors.
    """
    v = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("query_vec"))
    nv, nq = block_count(v, "vec", block_rows), block_count(q, "query_vec", block_rows)
    left = in_blocks(q, "query_id", nq).withColumnRenamed("_b", "_qb").withColumn(
        "_vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))
    )
    right = in_blocks(v, "id", nv).withColumnRenamed("_b", "_vb").withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))
    )
    schema = T.StructType(
        [
            T.StructField("query_id", q.schema["query_id"].dataType),
            T.StructField("id", v.schema["id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def best(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or vs.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        vs = vs.sort_values("id", kind="stable")
        ids, asked = vs["id"].to_numpy(), qs["query_id"].to_numpy()
        a, b = matrix(qs["query_vec"], True), matrix(vs["vec"], normalise_vectors)
        parts = []
        for i in range(0, len(a), TILE):
            own = asked[i:i + TILE]
            row, col, score = best_of(a[i:i + TILE], b, k, (own, ids) if skip_same_id else None)
            parts.append(pd.DataFrame({"query_id": own[row], "id": ids[col], "score": score}))
        return pd.concat(parts, ignore_index=True)

    partial = (
        left.groupBy("_qb", "_vb")
        .cogroup(right.groupBy("_qb", "_vb"))
        .applyInPandas(best, schema)
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def core_distances(
    points: DataFrame, k: int, id_col: str = "id", vec_col: str = "vec", block_rows: int = 2048
) -> DataFrame:
    """Cosine distance of every point to its k-th other point (or the farthest there is)."""
    near = nearest(
        points, points, k, id_col, vec_col, id_col, vec_col,
        normalise_vectors=True, skip_same_id=True, block_rows=block_rows,
    )
    return near.groupBy(F.col("query_id").alias("id")).agg(
        F.greatest(F.max(1.0 - F.col("score")), F.lit(0.0)).alias("core")
    )
