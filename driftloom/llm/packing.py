"""Packing of documents into sequences of bounded length by a grouping genetic algorithm.

Pieces as long as a sequence fill one alone. The others are dealt by hash into chunks of a bounded
number of pieces. Several islands evolve packings of one chunk apart from each other:

* a genome is the list of bins (groups), not of pieces;
* crossover injects whole well-filled bins of one parent into the other, takes out the bins that
  hold duplicates, and puts the displaced pieces where they fit best, largest first;
* after each epoch the elite of an island migrates to the next island of its chunk, by a join;
* a chunk's fullest packing wins.

Islands are small groups of one Spark job per epoch; their state is a written table, so a lost
executor repeats one epoch at most. All random numbers come from seeds of chunk, island and epoch,
so reruns agree.

Null and empty texts have the closing id alone. Repeated rows are packed as often as they occur.
Extra columns are ignored; an empty table gives no rows. Only texts longer than a sequence are cut.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.scratch import Scratch
from driftloom.llm.tokens import encoder
from driftloom.llm.words import slices

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class GeneticConfig:
    """Sizes of the search; they bound a task's work, not the input."""

    chunk_pieces: int = 4096
    islands: int = 2
    epochs: int = 2
    population: int = 4
    generations: int = 6
    elite: int = 1
    injected: float = 0.25
    seed: int = 17


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int = 0) -> DataFrame:
    """Token pieces of every text; `tokenizer` is the path of a tokenizer file on all executors."""

    def run(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for lo, _, data, at in slices(batch.column("text"), 1 << 21):
                ids, bounds = enc.encode(data, at)
                docs_, parts, starts, lengths, crcs = [], [], [], [], []
                names = batch.column("doc_id")[lo : lo + len(at) - 1].to_pylist()
                for k, doc in enumerate(names):
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    raw = own.tobytes()
                    for p, s in enumerate(range(0, len(own), size)):
                        docs_.append(doc)
                        parts.append(p)
                        starts.append(s)
                        lengths.append(min(size, len(own) - s))
                        crcs.append(zlib.crc32(raw[4 * s : 4 * (s + size)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs_, pa.int64()), pa.array(parts, pa.int32())]
                    + [pa.array(x, pa.int64()) for x in (starts, lengths, crcs)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.mapInArrow(run, PIECE)


class Bins:
    """Bins by free room; the fullest one that still takes a piece is found by one bit scan."""

    def __init__(self, size: int, room: list[int]):
        self.size = size
        self.room = room
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]
        self.mask = 0
        for b, r in enumerate(room):
            self._put(b, r)

    def _put(self, b: int, r: int) -> None:
        if r:
            self.by_room[r].append(b)
            self.mask |= 1 << r

    def best_fit(self, length: int) -> int:
        """Places a piece and returns its bin, a new one if none has room."""
        m = self.mask >> length
        if m:
            r = length + (m & -m).bit_length() - 1
            same = self.by_room[r]
            b = same.pop()
            if not same:
                self.mask ^= 1 << r
        else:
            r, b = self.size, len(self.room)
            self.room.append(r)
        self.room[b] = r - length
        self._put(b, r - length)
        return b


def _fit_all(lengths: np.ndarray, order: np.ndarray, size: int, bins: np.ndarray, room: list[int]) -> np.ndarray:
    held = Bins(size, room)
    for k, length in zip(order.tolist(), lengths[order].tolist()):
        bins[k] = held.best_fit(length)
    return bins


def _fill(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths).astype(np.int64)


def fitness(lengths: np.ndarray, bins: np.ndarray, size: int) -> tuple[int, float]:
    """Fewest bins first, then the mean square of their fill (larger is better)."""
    fill = _fill(lengths, bins)
    return -len(fill), float(((fill / size) ** 2).mean())


def crossover(lengths: np.ndarray, one: np.ndarray, two: np.ndarray, size: int, share: float, rng) -> np.ndarray:
    """Child: well-filled bins of `two`, the bins of `one` without duplicates, the rest best-fitted."""
    fill = _fill(lengths, two)
    good = np.argsort(-fill, kind="stable")[: max(1, len(fill) // 2)]
    taken = rng.choice(good, max(1, int(share * len(fill))), replace=False) if share * len(fill) < len(good) else good
    injected = np.isin(two, taken)
    broken = np.unique(one[injected])
    displaced = np.isin(one, broken) & ~injected
    child = np.full(len(lengths), -1, np.int64)
    kept = ~injected & ~displaced
    groups = np.concatenate([two[injected], one[kept] + len(fill)])
    _, child[np.concatenate([np.flatnonzero(injected), np.flatnonzero(kept)])] = np.unique(groups, return_inverse=True)
    placed = child >= 0
    room = (size - _fill(lengths[placed], child[placed])).tolist()
    loose = np.flatnonzero(displaced)
    return _fit_all(lengths, loose[np.argsort(-lengths[loose], kind="stable")], size, child, room)


def _epoch(size: int, cfg: GeneticConfig, number: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pid", kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        rng = np.random.default_rng([cfg.seed, int(key[0]), int(key[1]), number])
        held: list[np.ndarray] = []
        if number:
            state = np.array(rows["bins"].tolist(), np.int64)
            held = [state[:, k] for k in range(state.shape[1])]
        while len(held) < cfg.population:
            weight = lengths * (1 + (0.15 * rng.random(len(lengths)) if held or key[1] else 0.0))
            held.append(_fit_all(lengths, np.argsort(-weight, kind="stable"), size, np.zeros(len(lengths), np.int64), []))
        ranked = sorted(((fitness(lengths, b, size), k, b) for k, b in enumerate(held)), key=lambda x: (x[0], -x[1]), reverse=True)
        made = len(ranked)
        for _ in range(cfg.generations):
            i, j = rng.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
            child = crossover(lengths, ranked[i][2], ranked[j][2], size, cfg.injected, rng)
            made += 1
            ranked.append((fitness(lengths, child, size), made, child))
            ranked = sorted(ranked, key=lambda x: (x[0], -x[1]), reverse=True)[: cfg.population]
        state = np.stack([r[2] for r in ranked], axis=1).astype(np.int32)
        return pd.DataFrame({
            "chunk": key[0], "island": key[1], "pid": rows["pid"], "length": lengths,
            "used": np.int32(-ranked[0][0][0]), "fit": ranked[0][0][1], "bins": list(state),
        })

    return run


_STATE = "chunk long, island int, pid long, length long, used int, fit double, bins array<int>"


def evolve(scratch: Scratch, items: DataFrame, size: int, cfg: GeneticConfig) -> DataFrame:
    """(pid, chunk, bin) of items (pid, length) with lengths below `size`."""
    chunks = 1 + items.count() // cfg.chunk_pieces
    dealt = items.withColumn("chunk", F.pmod(F.xxhash64("pid"), F.lit(chunks)))
    state = dealt.withColumn("island", F.explode(F.array([F.lit(i) for i in range(cfg.islands)])))
    state = state.groupBy("chunk", "island").applyInPandas(_epoch(size, cfg, 0), _STATE)
    state = scratch.write(state, "epoch")
    for number in range(1, cfg.epochs):
        guests = state.select(
            "chunk", ((F.col("island") + 1) % cfg.islands).alias("island"), "pid",
            F.slice("bins", 1, cfg.elite).alias("guests"),
        )
        mixed = state.join(guests, ["chunk", "island", "pid"]).withColumn(
            "bins", F.concat(F.slice("bins", 1, cfg.population - cfg.elite), "guests")
        ).drop("guests", "used", "fit")
        nxt = scratch.write(
            mixed.groupBy("chunk", "island").applyInPandas(_epoch(size, cfg, number), _STATE), "epoch"
        )
        scratch.drop(state)
        state = nxt
    best = state.groupBy("chunk").agg(
        F.min(F.struct("used", (-F.col("fit")).alias("f"), "island")).alias("best")
    ).select("chunk", F.col("best.island").alias("island"))
    return state.join(best, ["chunk", "island"]).select("pid", "chunk", F.col("bins")[0].alias("bin"))


def pack(
    docs: DataFrame, tokenizer: str, size: int = 2048, cfg: GeneticConfig = GeneticConfig(), end_id: int = 0
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row."""
    scratch = Scratch(docs.sparkSession, "packing")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cut = scratch.write(
        pieces(docs, tokenizer, size, end_id).withColumn("pid", F.monotonically_increasing_id()), "pieces"
    )
    packed = evolve(scratch, cut.where(f"length < {size}").select("pid", "length"), size, cfg)
    within = Window.partitionBy("sequence_id").orderBy("pid")
    whole = (
        cut.join(packed, "pid", "left")
        .withColumn("sequence_id", F.when(F.col("bin").isNull(), -1 - F.col("pid")).otherwise(F.col("chunk") * (1 << 20) + F.col("bin")))
        .withColumn("offset", F.sum("length").over(within) - F.col("length"))
    )
    return whole.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
