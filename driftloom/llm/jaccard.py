"""N-gram Jaccard join: which documents share at least a given share of their word n-grams.

The method is a join over size-banded tiles with hashed bitmap signatures:

1. Every text becomes the sorted array of its distinct n-gram hashes; equal arrays are one node.
   A node also has a bitmap, in which each n-gram flips one of at least as many bits as the node
   has n-grams (a power of two; wider bitmaps fold to narrower ones). The bits in which two bitmaps
   differ cannot outnumber the n-grams that only one of them has, so
   `(|A| + |B| - bits) / 2` bounds the overlap from above.
2. Two sets at or above the threshold share one of the first `|A| - ceil(t |A|) + 1` members in any
   common order. The order puts n-grams that the corpus repeats most last (counted in a fixed-size
   sketch), so passages that many documents hold rarely make a bucket.
3. Inside a bucket nodes are sorted by size, and by two hashes. Each node is first compared with
   the node that stands before it most often, one for each order; that already joins groups of near
   copies, however large, by three pairs per node.
4. What is left are pairs of one bucket whose components differ. They go through tiles: bands of
   at most `band_rows` nodes by size, pairs of bands whose sizes can match. A bucket passes a pair
   on only if enough of both sets stands behind its member in the common order; the bucket of the
   first member that a similar pair shares always does, so most pairs come from few of their
   buckets. Rows that have such a partner in their tile get their bitmaps; then the bitmap bound,
   then the exact intersection of the sorted arrays. Every such pair is tested, so the components
   are exact.

Sets are never collected: a tile holds at most `tile_pairs` pairs. 64-bit hashes stand for n-grams
and for sets.

Null and empty texts have no n-grams and link with nothing. Shorter texts than n words have one
member, the whole sequence. Repeated rows are linked. Extra columns are ignored. The result of an
empty table is empty. A null id is kept; the smallest id of its group is taken over the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm import graph, sketch
from driftloom.llm.scratch import Scratch, checked_broadcast
from driftloom.llm.words import (
    LOWER, mixed, signed, slices, span_hashes, window_mask, word_spans,
)

COUNTERS = 1 << 18
BLOOM_BYTES = 1 << 21
#: Orders of a bucket in which each node is first compared with the node before it.
FIRST_PAIRS = 3
#: Least and largest number of 64-bit words of a bitmap.
SIGN_WORDS = (8, 1024)
#: Multipliers of the places in an n-gram.
_PLACE = mixed(np.arange(11, 75, dtype=np.uint64)) | np.uint64(1)
#: Columns of a tile's rows before they get their bitmaps.
_TILE = {
    "token": np.int64, "i": np.int32, "j": np.int32, "side": np.int32,
    "id": np.int64, "n": np.int32, "pos": np.int32, "comp": np.int64,
}
_SQL_TYPE = {np.int64: "long", np.int32: "int"}


def gram_sets(data: np.ndarray, at: np.ndarray, n: int):
    """For each text of a slice its sorted array of distinct n-gram hashes."""
    data = LOWER[data]
    begins, ends, bounds = word_spans(data, at)
    words = span_hashes(data, begins, ends)
    most = max(len(words) - n + 1, 0)
    grams = np.zeros(most, np.uint64)
    for k in range(n):
        grams += words[k : k + most] * _PLACE[k]
    grams = mixed(grams)
    for i in range(len(bounds) - 1):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            short = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            yield mixed(np.array([short], np.uint64))
        else:
            yield np.empty(0, np.uint64)


def set_id(grams: np.ndarray) -> int:
    """Hash of a set, whatever the order."""
    with np.errstate(over="ignore"):
        total = mixed(grams ^ np.uint64(0x5BF0A8B1457695C1)).sum(dtype=np.uint64)
        return int(mixed(np.array([total + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


def bitmap(grams: np.ndarray) -> bytes:
    """Parity bitmap of a set."""
    least, most = SIGN_WORDS
    bits = 64 * min(most, max(least, 1 << (-(-len(grams) // 64) - 1).bit_length()))
    odd = np.bincount((grams >> np.uint64(40)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sets(batches, n: int):
    """(row of the batch, set) of each text of a task."""
    for batch in batches:
        texts = batch.column("text")
        for lo, _, data, at in slices(texts):
            for i, grams in enumerate(gram_sets(data, at, n)):
                yield batch, lo + i, grams


def _firsts(batches, n: int):
    """(id, set) of every set, once in a task."""
    seen = set()
    for _, _, grams in _sets(batches, n):
        if len(grams) and (key := set_id(grams)) not in seen:
            seen.add(key)
            yield key, grams


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _prefix(size: int, share: int) -> int:
    """How many members, in the common order, must be looked at."""
    return size - -(-share * size // 100) + 1


def nodes(docs: DataFrame, n: int) -> DataFrame:
    """Each text's set: kind 0 (doc_id, row, id, n, low, sign), kind 1 (counts, chunk by chunk)."""

    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        rows, ids, keys = [], [], []

        def out():
            got = _table({
                "kind": pa.array([0] * len(rows), pa.int32()),
                "doc_id": pa.array(ids, pa.int64()),
                "row": pa.array(keys, pa.int64()),
                "id": pa.array([r[0] for r in rows], pa.int64()),
                "n": pa.array([r[1] for r in rows], pa.int32()),
                "low": pa.array([r[2] for r in rows], pa.int64()),
                "part": pa.array([r[3] for r in rows], pa.binary()),
            })
            rows.clear()
            ids.clear()
            keys.clear()
            return got

        for batch, i, grams in _sets(batches, n):
            ids.append(batch.column("doc_id")[i].as_py())
            keys.append(batch.column("row")[i].as_py())
            if len(grams):
                rows.append((set_id(grams), len(grams), int(signed(grams[:1])[0]), bitmap(grams)))
                np.add.at(counts, (grams & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            else:
                rows.append((None, 0, None, None))
            if len(rows) >= 4096:
                yield out()
        yield out()
        got = sketch.parts(counts)
        yield _table({
            "kind": pa.array([1] * len(got), pa.int32()),
            "doc_id": pa.array([None] * len(got), pa.int64()),
            "row": pa.array([None] * len(got), pa.int64()),
            "id": pa.array([i for i, _ in got], pa.int64()),
            "n": pa.array([0] * len(got), pa.int32()),
            "low": pa.array([None] * len(got), pa.int64()),
            "part": pa.array([x for _, x in got], pa.binary()),
        })

    return docs.mapInArrow(run, "kind int, doc_id long, row long, id long, n int, low long, part binary")


def prefix_rows(docs: DataFrame, n: int, share: int, counts) -> DataFrame:
    """(token, id, n, pos) of the members that a set must share one of with every similar set.

    pos is the member's place in the common order, from 1; equal ranks share the first place.
    """

    def run(batches):
        common = counts.value
        held: list[tuple] = []

        def out():
            sizes = [len(x[2]) for x in held]
            got = _table({
                "token": pa.array(signed(np.concatenate([x[2] for x in held])) if held else np.empty(0, np.int64)),
                "id": pa.array(np.repeat(np.array([x[0] for x in held], np.int64), sizes)),
                "n": pa.array(np.repeat(np.array([x[1] for x in held], np.int32), sizes)),
                "pos": pa.array(np.concatenate([x[3] for x in held]) if held else np.empty(0, np.int32)),
            })
            held.clear()
            return got

        for key, grams in _firsts(batches, n):
            most = _prefix(len(grams), share)
            order = common[(grams & np.uint64(COUNTERS - 1)).astype(np.int64)] | (grams & np.uint64((1 << 40) - 1))
            last = np.partition(order, most - 1)[most - 1]
            front = order <= last
            pos = np.searchsorted(np.sort(order[front]), order[front]) + 1
            held.append((key, len(grams), grams[front], pos.astype(np.int32)))
            if len(held) >= 500:
                yield out()
        yield out()

    return docs.mapInArrow(run, "token long, id long, n int, pos int")


def chosen_sets(docs: DataFrame, n: int, wanted) -> DataFrame:
    """(id, grams) of the sets that a filter of wanted ids lets through."""

    def run(batches):
        bits, held = wanted.value, []

        def out():
            got = _table({
                "id": pa.array([k for k, _ in held], pa.int64()),
                "grams": pa.array([g for _, g in held], pa.binary()),
            })
            held.clear()
            return got

        for key, grams in _firsts(batches, n):
            if sketch.bit_found(np.array([key], np.int64), bits)[0]:
                held.append((key, grams.tobytes()))
                if len(held) >= 500:
                    yield out()
        yield out()

    return docs.mapInArrow(run, "id long, grams binary")


def _linked(share: int):
    def run(_key, pairs, sets):
        held = {k: np.frombuffer(g, np.uint64) for k, g in zip(sets["id"], sets["grams"])}
        keep = []
        for a, b in zip(pairs["u"], pairs["v"]):
            x, y = held[a], held[b]
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int((y[at] == x).sum())
            keep.append(100 * both >= share * (len(x) + len(y) - both))
        return pairs.loc[np.array(keep, bool), ["u", "v"]]

    return run


def verified(scratch: Scratch, docs: DataFrame, pairs: DataFrame, n: int, share: int, tile_pairs: int) -> DataFrame:
    """Those of the pairs (u, v, low) that are similar: exact intersection of sorted arrays.

    Pairs with the same smallest member are close to each other; they share a tile, so that a set
    goes to few tiles. A tile holds about half of `tile_pairs`, and at most that many of one member.
    """
    spark = docs.sparkSession
    order = Window.partitionBy("low").orderBy("u", "v")
    ranked = pairs.withColumn("part", ((F.row_number().over(order) - 1) / tile_pairs).cast("int"))
    ranked = scratch.write(ranked, "pairs")
    groups = 1 + 2 * ranked.count() // tile_pairs
    tiles = ranked.withColumn("tile", F.pmod(F.xxhash64("low"), F.lit(groups)))
    needs = tiles.select(
        F.col("tile").alias("t"), F.col("part").alias("p"), F.explode(F.array("u", "v")).alias("id")
    ).distinct()
    needs = scratch.write(needs, "needs")
    bits = sketch.bloom(needs.select("id"), BLOOM_BYTES)
    wanted = checked_broadcast(spark, bits, bits.nbytes, BLOOM_BYTES)
    sets = needs.join(chosen_sets(docs, n, wanted).dropDuplicates(["id"]), "id")
    out = tiles.groupBy("tile", "part").cogroup(sets.groupBy("t", "p")).applyInPandas(_linked(share), graph.EDGE)
    return scratch.write(out, "links")


def _apart(pool: np.ndarray, at_a, width_a, at_b, width_b) -> np.ndarray:
    """Bits in which the bitmaps of pairs differ; both are folded to the narrower width."""
    out = np.zeros(len(at_a), np.int64)
    narrow = np.minimum(width_a, width_b)
    for width in np.unique(narrow):
        own = np.flatnonzero(narrow == width)
        for part in np.array_split(own, 1 + len(own) * int(width) // (1 << 20)):
            both = [_folded(pool, at[part], wide[part], int(width)) for at, wide in ((at_a, width_a), (at_b, width_b))]
            out[part] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
    return out


def _folded(pool: np.ndarray, at: np.ndarray, wide: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(at), width), np.uint64)
    for step in range(int(wide.max()) // width if len(wide) else 0):
        on = np.flatnonzero(wide > step * width)
        out[on] ^= pool[at[on][:, None] + step * width + np.arange(width)]
    return out


def _possible(left: dict, right: dict, share: int) -> np.ndarray:
    """Which pairs of rows sizes, components and places leave open."""
    n_left, n_right = left["n"], right["n"]
    small, large = np.minimum(n_left, n_right), np.maximum(n_left, n_right)
    # were this the first member both have, the overlap could be no more than what is left of either
    rest = np.minimum(left["rest"], right["rest"])
    return (
        (100 * small >= share * large) & (left["comp"] != right["comp"])
        & ((100 + share) * rest >= share * (n_left + n_right))
    )


def _runs(batches):
    """Columns of rows and the starts and ends of their runs of equal (token, i, j), whole runs only."""
    kept = None
    for batch in _with_end(batches):
        if batch is not None:
            now = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names if k != "sign"}
            now["n"] = now["n"].astype(np.int64)
            now["rest"] = now["n"] - now["pos"] + 1
            if "sign" in batch.schema.names:
                now["sign"] = np.array([*batch.column("sign").to_pylist(), None], object)[:-1]
            rows = now if kept is None else {k: np.concatenate([kept[k], now[k]]) for k in now}
        elif kept is None:
            return
        else:
            rows = kept
        size = len(rows["id"])
        if not size:
            continue
        new = np.zeros(size, bool)
        new[0] = True
        for k in ("token", "i", "j"):
            new[1:] |= rows[k][1:] != rows[k][:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], size)
        if batch is not None:  # the last run may go on in the next batch
            kept = {k: v[starts[-1] :].copy() for k, v in rows.items()}
            starts, ends = starts[:-1], ends[:-1]
        yield rows, starts, ends


def _pairs_of(rows: dict, starts: np.ndarray, ends: np.ndarray):
    """All pairs of each run: row k with the later rows, or side 0 with side 1 of two bands."""
    budget, left, right, made = 1 << 18, [], [], 0
    for s, e in zip(starts.tolist(), ends.tolist()):
        side = rows["side"][s:e]
        first = np.flatnonzero(side == 0)
        second = np.flatnonzero(side == 1)
        if len(second):
            for k in first:
                left.append(np.full(len(second), s + k))
                right.append(s + second)
                made += len(second)
                if made >= budget:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, made = [], [], 0
        else:
            for k in range(e - s - 1):
                left.append(np.full(e - s - 1 - k, s + k))
                right.append(np.arange(s + k + 1, e))
                made += e - s - 1 - k
                if made >= budget:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, made = [], [], 0
    if made:
        yield np.concatenate(left), np.concatenate(right)


def _open_rows(share: int):
    """Rows of a tile that have a possible partner there; only these need their bitmaps."""

    def run(batches):
        for rows, starts, ends in _runs(batches):
            plain = {k: rows[k] for k in ("n", "rest", "comp")}
            found = np.zeros(len(rows["id"]), bool)
            for a, b in _pairs_of(rows, starts, ends):
                ok = _possible({k: v[a] for k, v in plain.items()}, {k: v[b] for k, v in plain.items()}, share)
                found[a[ok]] = True
                found[b[ok]] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[k][found].astype(t)) for k, t in _TILE.items()], names=list(_TILE)
            )

    return run


def _tile_pairs(share: int):
    """Pairs of different components inside each run of rows with equal (token, i, j)."""

    def emit(left, right, pool):
        ok = _possible(left, right, share)
        left, right = ({k: v[ok] for k, v in x.items()} for x in (left, right))
        # a pair stands once in a chunk, in however many buckets it meets
        _, once = np.unique(np.stack([left["id"], right["id"]]), axis=1, return_index=True)
        left, right = ({k: v[once] for k, v in x.items()} for x in (left, right))
        total = left["n"] + right["n"]
        apart = _apart(pool, left["at"], left["wide"], right["at"], right["wide"])
        # similar only if (100 + share) * overlap >= share * total, and overlap <= (total - apart) / 2
        ok = (100 + share) * (total - apart) >= 2 * share * total
        a, b = left["id"][ok], right["id"][ok]
        u, v, low = np.maximum(a, b), np.minimum(a, b), np.minimum(left["low"][ok], right["low"][ok])
        both = np.stack([u, v, low], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[:, k]) for k in range(3)], names=["u", "v", "low"])

    def run(batches):
        for rows, starts, ends in _runs(batches):
            signs = rows["sign"].tolist()
            pool = np.frombuffer(b"".join(signs), np.uint64)
            plain = {k: rows[k] for k in ("id", "n", "rest", "comp", "low")}
            plain["wide"] = np.array([len(x) // 8 for x in signs], np.int64)
            plain["at"] = np.cumsum(plain["wide"]) - plain["wide"]
            for a, b in _pairs_of(rows, starts, ends):
                yield emit({k: v[a] for k, v in plain.items()}, {k: v[b] for k, v in plain.items()}, pool)

    return run


def _with_end(batches):
    yield from batches
    yield None


def remaining_pairs(
    scratch: Scratch, buckets: DataFrame, marks: DataFrame, comps: DataFrame, share: int, band_rows: int
) -> DataFrame:
    """Pairs (u, v, low) of one bucket in different components that the bounds leave over."""
    marked = (
        buckets.join(comps.select(F.col("u").alias("id"), F.col("v").alias("comp")), "id", "left")
        .withColumn("comp", F.coalesce("comp", "id"))
    )
    whole = Window.partitionBy("token")
    marked = (
        marked.withColumn("a", F.min("comp").over(whole))
        .withColumn("b", F.max("comp").over(whole))
        .withColumn("band", ((F.row_number().over(whole.orderBy("n", "id")) - 1) / band_rows).cast("int"))
        .where("a != b")
        .select("token", "id", "n", "pos", "comp", "band")
    )
    marked = scratch.write(marked, "marked")
    bands = marked.groupBy("token", "band").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    two = bands.alias("x").join(bands.alias("y"), "token").where(
        f"x.band < y.band and 100 * x.hi >= {share} * y.lo"
    ).select("token", F.col("x.band").alias("i"), F.col("y.band").alias("j"))
    sides = two.select("token", "i", "j", F.explode(F.array(
        F.struct(F.col("i").alias("band"), F.lit(0).alias("side")),
        F.struct(F.col("j").alias("band"), F.lit(1).alias("side")),
    )).alias("s")).select("token", "i", "j", "s.*")
    columns = list(_TILE)
    own = marked.withColumns({"i": F.col("band"), "j": F.col("band"), "side": F.lit(0)}).select(columns)
    other = marked.join(sides, ["token", "band"]).select(columns)
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def tiles(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "token", "i", "j").sortWithinPartitions("token", "i", "j")

    schema = ", ".join(f"{k} {_SQL_TYPE[t]}" for k, t in _TILE.items())
    left = scratch.write(tiles(own.unionAll(other)).mapInArrow(_open_rows(share), schema), "open")
    return tiles(left.join(marks, "id")).mapInArrow(_tile_pairs(share), "u long, v long, low long").distinct()


def row_key() -> Column:
    """Hash of a row's id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def jaccard_groups(
    docs: DataFrame, n: int = 5, share: int = 80, band_rows: int = 1024, tile_pairs: int = 2048
) -> DataFrame:
    """(doc_id, row, n_shingles, set_id, component, component_id) of every row of docs (doc_id, text).

    Rows link when `100 * intersection >= share * union` of their n-gram sets; component_id is the
    smallest doc_id that links lead to, component a number of the component. set_id and component
    are null for rows without words. row is a hash of id and text, to find the row again by.
    """
    if not 1 <= n <= len(_PLACE) or not 1 <= share <= 100:
        raise ValueError("n must be 1 to 64 and share 1 to 100")
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(row_key().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = scratch.write(nodes(docs, n), "nodes")
    rows = found.where("kind = 0").select("doc_id", "row", "id", "n", "low", F.col("part").alias("sign"))
    counts = sketch.merged(
        found.where("kind = 1").select(F.col("id").cast("int").alias("chunk"), "part"), COUNTERS, np.int64
    )
    # the count leads the order, the hash breaks ties
    lead = np.minimum(counts, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)
    common = checked_broadcast(spark, lead, lead.nbytes, 8 * COUNTERS)

    bucket = Window.partitionBy("token")
    inside = bucket.orderBy("n", "id")
    buckets = (
        prefix_rows(docs, n, share, common)
        .withColumn("p", F.lag("id").over(inside))
        .withColumn("a", F.min("id").over(bucket))
        .withColumn("b", F.max("id").over(bucket))
        .where("a != b and (p is null or p != id)")
        .select("token", "id", "n", "pos")
    )
    buckets = scratch.write(buckets, "buckets")

    marks = rows.where("id is not null").groupBy("id").agg(F.first("low").alias("low"), F.first("sign").alias("sign"))
    marks = scratch.write(marks, "marks")
    lows = marks.select("id", "low")

    before = F.struct("id", "n")
    orders = [bucket.orderBy("n", "id")] + [
        bucket.orderBy(F.xxhash64("id", F.lit(k)), "id") for k in range(1, FIRST_PAIRS)
    ]
    placed = buckets.select("id", "n", F.array([F.lag(before).over(o) for o in orders]).alias("earlier"))
    met = placed.select("id", "n", F.posexplode("earlier").alias("order", "p"))
    near = (
        met.where(f"p is not null and 100 * least(n, p.n) >= {share} * greatest(n, p.n)")
        .groupBy("order", "id", F.col("p.id").alias("p")).agg(F.count(F.lit(1)).alias("met"), F.first("n").alias("n"))
        .where(f"met >= greatest(1, 0.2 * (n - ceil({share / 100} * n)))")
        .groupBy("order", "id").agg(F.max(F.struct("met", "p")).alias("best"))
        .select(F.greatest("best.p", "id").alias("u"), F.least("best.p", "id").alias("v")).distinct()
        .withColumn("id", F.col("u")).join(lows, "id").select("u", "v", "low")
    )
    links = verified(scratch, docs, near, n, share, tile_pairs)
    comps = graph.components(scratch, links)
    more = remaining_pairs(scratch, buckets, marks, comps, share, band_rows)
    more = scratch.write(more, "more")
    rest = verified(scratch, docs, more, n, share, tile_pairs)
    if rest.isEmpty():
        whole = comps
    else:
        whole = graph.components(scratch, comps.select("u", "v").unionAll(rest))

    named = rows.join(whole.select(F.col("u").alias("id"), "v"), "id", "left").withColumn("top", F.coalesce("v", "id"))
    least = named.where("top is not null").groupBy("top").agg(F.min("doc_id").alias("component"))
    return named.join(least, "top", "left").select(
        "doc_id",
        "row",
        F.col("n").cast("long").alias("n_shingles"),
        F.col("id").alias("set_id"),
        F.col("top").alias("component"),
        F.coalesce("component", "doc_id").alias("component_id"),
    )
