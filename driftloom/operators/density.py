"""Hierarchical density clustering with excess-of-mass selection.

1. Equal vectors are one point with copies; core distances and near lists come from cells with
   bounds (`cells.py`).
2. The spanning tree of mutual reachability grows in Boruvka rounds. Near lists and the edges to
   the pivots give every component an upper bound for its lightest edge to another one; points ask
   only the cells that can beat it. The lightest edges found join components until one is left.
   Copies hang on their point at its core distance.
3. What counts is which components exist at each weight, and that does not depend on which of
   several equal edges the tree holds. All edges of one weight are contracted at once, so neither
   the numbering of the ids nor the layout changes a label.
4. The condensed tree is built bottom up in parallel. A weight is chosen below which no component
   of the tree has more edges than a task may get; these components are condensed at the same time,
   each with all its edges, and the heavier edges form a smaller tree over what is left. A
   component carries its size and the running sums of its open cluster. Lambda is 1 / distance.
   Stability of a cluster is the sum of the lambdas at which its points leave or its children split
   off, minus its birth lambda times its size.
5. A cluster is chosen when it is at least as stable as the best choice below it (up to rounding)
   and no ancestor is chosen. The root is never chosen.

Points without a vector are noise.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.config import ClusterConfig
from driftloom.operators.cells import (
    Cells, distances, distinct_points, lower_bounds, margin, near_lists, pair_distances, ready, small_frames, unit, with_cores,
)
from driftloom.operators.components import component_labels
from driftloom.operators.timeline import ranked
from driftloom.session import cut, release

CFG = ClusterConfig()
MIN_DISTANCE = 1e-12
#: Stabilities that differ by less are equal; sums of floats depend on their order.
TOLERANCE = 1e-9

EDGE = T.StructType(
    [
        T.StructField("u", T.LongType()),
        T.StructField("v", T.LongType()),
        T.StructField("w", T.DoubleType()),
    ]
)

# One row type for everything a merge batch reports; `kind` says which columns are set.
REPORT = T.StructType(
    [
        T.StructField("kind", T.StringType()),  # moved | open | fell | closed | peak
        T.StructField("id", T.LongType()),
        T.StructField("target", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("acc", T.DoubleType()),
        T.StructField("below", T.DoubleType()),
        T.StructField("stability", T.DoubleType()),
        T.StructField("chosen", T.BooleanType()),
    ]
)


def dense_tree(dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree (from, to, weight) of a full distance matrix."""
    n = len(dist)
    best = dist[0].copy()
    source = np.zeros(n, dtype=np.int64)
    outside = np.ones(n, dtype=bool)
    outside[0] = False
    best[0] = np.inf
    frm, to, w = np.empty(n - 1, np.int64), np.empty(n - 1, np.int64), np.empty(n - 1)
    for i in range(n - 1):
        j = int(np.argmin(best))
        frm[i], to[i], w[i] = source[j], j, best[j]
        outside[j] = False
        best[j] = np.inf
        closer = outside & (dist[j] < best)
        best[closer] = dist[j][closer]
        source[closer] = j
    return frm, to, w


def reachability(d: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.maximum(d, a[:, None]), b[None, :])


def _tree_of_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning tree of all points of the only block."""
    pdf = pdf.sort_values("id")
    ids, core, m = pdf["id"].to_numpy(), pdf["core"].to_numpy(), unit(pdf["vec"])
    a, b, w = dense_tree(reachability(distances(m, m), core, core))
    return pd.DataFrame({"u": ids[a], "v": ids[b], "w": w})


def _known_edges(cells: Cells, points: DataFrame, near: DataFrame) -> DataFrame:
    """(u, v, w): a connected graph of true edges, from near lists, to the own pivot, among pivots."""
    core = points.select(F.col("id").alias("v"), F.col("core").alias("_core"))
    close = near.select(F.col("id").alias("u"), "core", F.explode("near").alias("n")).select(
        "u", "core", F.col("n.id").alias("v"), F.col("n.d").alias("d")
    ).filter("u <> v").join(core, "v")
    close = close.select("u", "v", F.greatest("core", "_core", "d").alias("w"))

    ids = [int(x) for x in cells.pivot_ids]
    found = {r["id"]: r["core"] for r in points.filter(F.col("id").isin(ids)).select("id", "core").collect()}
    own, pivots = np.array([found[i] for i in ids]), cells.pivots

    def spokes(frames):
        for pdf in frames:
            at = np.minimum(pdf["cell"].to_numpy(), len(ids) - 1)
            d = np.round(np.clip(1.0 - np.einsum("ij,ij->i", unit(pdf["vec"]), pivots[at]), 0, 2), 9)
            w = np.maximum(np.maximum(d, pdf["core"].to_numpy()), own[at])
            yield pd.DataFrame({"u": pdf["id"], "v": np.array(ids)[at], "w": w})

    wheel = points.mapInPandas(spokes, EDGE).filter("u <> v")
    a, b, w = dense_tree(reachability(distances(pivots, pivots), own, own))
    hub = pd.DataFrame({"u": np.array(ids)[a], "v": np.array(ids)[b], "w": w})
    hub = cells.spark.createDataFrame(hub, EDGE)
    return cut(close.unionAll(wheel).unionAll(hub))


LIGHTEST = "comp long, to_comp long, w double, u long, v long"


def _lightest(
    asked: pd.DataFrame, wave: dict, pivots: np.ndarray, radius: np.ndarray, floors: np.ndarray, owners: np.ndarray
) -> pd.DataFrame:
    """For each component asked for, its lightest edge below `bound` to another one in the blocks of a wave."""
    vec, core, comp, bound = unit(asked["vec"]), *(asked[c].to_numpy() for c in ("core", "comp", "bound"))
    single, off = vec.astype(np.float32), margin(vec.shape[1])
    comps, code = np.unique(comp, return_inverse=True)
    limit = bound.copy()
    best, to = np.full(len(asked), np.inf), np.full(len(asked), -1, np.int64)
    held = np.unique([c for c, _, _, _ in wave["spans"]])
    low = np.maximum(np.maximum(lower_bounds(vec, held, pivots, radius), floors[held]), core[:, None])
    for c, _, i, j in wave["spans"]:
        rows = np.flatnonzero((low[:, np.searchsorted(held, c)] < limit) & (comp != owners[c]))
        if not len(rows):
            continue
        j = i + int(np.searchsorted(wave["core"][i:j], limit[rows].max(), "left"))
        if i == j:
            continue
        s = single[rows] @ wave["single"][i:j].T
        r, at = np.nonzero(s > (1.0 - limit[rows] - off).astype(np.float32)[:, None] - np.float32(1e-7))
        r, at = rows[r], at + i
        open_ = (comp[r] != wave["comp"][at]) & (wave["core"][at] < limit[r])
        r, at = r[open_], at[open_]
        w = np.maximum(np.maximum(pair_distances(vec[r], wave["double"][at]), core[r]), wave["core"][at])
        open_ = w < limit[r]
        r, at, w = r[open_], at[open_], w[open_]
        if not len(r):
            continue
        order = np.lexsort((wave["id"][at], w, r))
        r, at, w = r[order], at[order], w[order]
        first = np.flatnonzero(np.diff(r, prepend=-1))
        r, at, w = r[first], at[first], w[first]
        best[r], to[r] = w, at  # lighter than any found before
        least = np.full(len(comps), np.inf)
        np.minimum.at(least, code, np.minimum(best, limit))
        limit = least[code]
    found = np.flatnonzero(to >= 0)
    rows = pd.DataFrame({
        "comp": comp[found], "to_comp": wave["comp"][to[found]], "w": best[found], "u": asked["id"].to_numpy()[found],
        "v": wave["id"][to[found]],
    })
    return rows.sort_values(["w", "u", "v"]).drop_duplicates("comp")


def spanning_edges(cells: Cells, near: DataFrame, limit: int) -> DataFrame:
    """Edges (u, v, w) that connect all points and have, at every weight, the components of all pairs.

    `near` has id, core and near lists of the points of the cells.
    """
    points = cut(cells.points.join(near.select("id", "core"), "id"))
    if cells.one_block:
        return points.groupBy().applyInPandas(_tree_of_block, EDGE)
    known = _known_edges(cells, points, near)
    comps = cut(points.select("id", F.col("id").alias("comp")))
    chosen, old = None, []
    while True:
        before = known
        for side in ("u", "v"):
            to = comps.select(F.col("id").alias(side), F.col("comp").alias(f"{side}_comp"))
            known = known.drop(f"{side}_comp").join(to, side)
        known = cut(known.select("u", "v", "w", "u_comp", "v_comp").filter("u_comp <> v_comp"))
        release(before, *old)
        if known.isEmpty():
            release(points, comps)
            return chosen if chosen is not None else cells.spark.createDataFrame([], EDGE)
        sides = known.select(F.col("u_comp").alias("comp"), F.col("v_comp").alias("to_comp"), "w", "u", "v").unionAll(
            known.select(F.col("v_comp").alias("comp"), F.col("u_comp").alias("to_comp"), "w", F.col("v").alias("u"), F.col("u").alias("v"))
        )
        edge = F.struct("w", "u", "v", "to_comp")
        now = cut(points.join(comps, "id").select("id", "vec", "core", "comp", "cell", "block"))
        # every other component finds its lightest edge; the largest one waits to be found
        largest = now.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()["comp"]
        bounds = cut(sides.filter(F.col("comp") != largest).groupBy("comp").agg(F.min(edge).alias("e")))
        floors, owners = np.full(len(cells.radius), np.inf), np.full(len(cells.radius), -1, np.int64)
        for r in now.groupBy("cell").agg(F.min("core").alias("f"), F.min("comp").alias("a"), F.max("comp").alias("b")).collect():
            floors[r["cell"]] = r["f"]
            if r["a"] == r["b"]:
                owners[r["cell"]] = r["a"]
        asking = cut(now.join(bounds.select("comp", F.col("e.w").alias("bound")), "comp").filter("core < bound"))
        found = _lightest_edges(cells, now, asking, floors, owners)
        best = cut(
            bounds.unionAll(found.select("comp", edge.alias("e"))).groupBy("comp").agg(F.min("e").alias("e")).select("comp", "e.*")
        )
        labels = component_labels(best.select(F.col("comp").alias("u"), F.col("to_comp").alias("v")), limit)
        labels = labels.select(F.col("id").alias("comp"), "root")
        comps, old = cut(comps.join(labels, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp"))), [comps, labels]
        joins = best.select("u", "v", "w")
        if chosen is None:
            chosen = joins
        else:
            old += [chosen, best]
            chosen = cut(chosen.unionAll(joins))
        release(now, asking, bounds, found)


def _lightest_edges(cells: Cells, now: DataFrame, asking: DataFrame, floors: np.ndarray, owners: np.ndarray) -> DataFrame:
    """Edges found for the points `asking`, wave after wave; at most one for each component and frame."""
    pivots, radius = cells.pivots, cells.radius
    if asking.isEmpty():
        return cells.spark.createDataFrame([], LIGHTEST)
    found = None
    for shared in cells.waves(now.select("id", "vec", "core", "comp", "cell", "block"), "core"):

        def passed(frames, shared=shared):
            wave = ready(shared.value)
            for pdf in small_frames(frames):
                yield _lightest(pdf, wave, pivots, radius, floors, owners)

        more = asking.select("id", "vec", "core", "comp", "bound").mapInPandas(passed, LIGHTEST)
        edge = F.struct("w", "u", "v", "to_comp")
        every = more if found is None else more.unionByName(found)
        now_found = cut(every.groupBy("comp").agg(F.min(edge).alias("e")).select("comp", "e.to_comp", "e.w", "e.u", "e.v"))
        if found is not None:
            release(found)
        found = now_found
    return found


def merge_edges(edges: pd.DataFrame, m: int) -> pd.DataFrame:
    """Merges components along edges, all of one weight at once; see the module text.

    Edges carry the state of both end components (`u_`/`v_` + size, cluster, acc, below). Components
    are numbered and their state is kept in flat arrays: a batch takes some hundred bytes an edge.
    """
    order = np.lexsort([edges[c].to_numpy() for c in ("v", "u", "w")])
    us, vs, ws = (edges[c].to_numpy()[order] for c in ("u", "v", "w"))
    ids, first = np.unique(np.concatenate([us, vs]), return_index=True)
    n = len(ids)

    def given(name: str, kind: str) -> array:
        both = np.concatenate([edges[f"{side}_{name}"].to_numpy()[order] for side in ("u", "v")])
        return array(kind, both[first].astype("int64" if kind == "q" else "float64").tobytes())

    size, cluster, acc, below = given("size", "q"), given("cluster", "q"), given("acc", "d"), given("below", "d")
    us, vs = (array("q", np.searchsorted(ids, x).astype("int64").tobytes()) for x in (us, vs))
    ws = array("d", ws.astype("float64").tobytes())
    names = array("q", ids.astype("int64").tobytes())
    parent = array("q", range(n))
    # Members of components below `m`, as chains that are joined end to end.
    last, after = array("q", range(n)), array("q", [-1]) * n
    fell, fell_to = array("q"), array("q")
    closed: list[tuple] = []
    peak = 0.0

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    def fall(r: int, to: int):
        while r >= 0:
            fell.append(names[r])
            fell_to.append(to)
            r = after[r]

    def join(old: list[int], into: int, lam: float):
        """One component of several, at one lambda."""
        nonlocal peak
        total = sum(size[r] for r in old)
        if total < m:
            for r in old:
                if r != into:
                    after[last[into]] = r
                    last[into] = last[r]
            size[into], cluster[into], acc[into], below[into] = total, 0, 0.0, 0.0
            return
        large = [r for r in old if size[r] >= m]
        small = [r for r in old if size[r] < m]
        peak = max(peak, lam)
        if len(large) == 1:
            one = large[0]
            to, sums, under = cluster[one], acc[one] + lam * (total - size[one]), below[one]
        elif not large:
            to, sums, under = names[into], lam * total, 0.0
        else:
            # Clusters meet: all end here, their parent begins. A component that ends is never a
            # root again, so its number, made negative, names the parent.
            to, sums, under = -max(names[r] for r in old if r != into) - 1, lam * total, 0.0
            for r in large:
                own = acc[r] - lam * size[r]
                chosen = own >= below[r] - TOLERANCE * abs(below[r])
                under += own if chosen else below[r]
                closed.append((cluster[r], to, size[r], own, chosen))
        for r in small:
            fall(r, to)
        size[into], cluster[into], acc[into], below[into] = total, to, sums, under

    i = 0
    while i < len(ws):
        w, joined = ws[i], {}
        while i < len(ws) and ws[i] == w:
            a, b = root(us[i]), root(vs[i])
            i += 1
            if a == b:
                continue
            x, y = joined.pop(a, [a]), joined.pop(b, [b])
            if len(x) < len(y):
                a, b, x, y = b, a, y, x
            parent[b] = a
            joined[a] = x + y
        for into, old in joined.items():
            join(old, into, 1.0 / w)

    roots = np.array([root(c) for c in range(n)], dtype=np.int64)
    alive = np.flatnonzero(roots == np.arange(n))
    sizes, clusters, accs, belows = (np.array(x) for x in (size, cluster, acc, below))
    grown = sizes[alive] >= m
    c_id, c_to, c_size, c_own, c_chosen = zip(*closed) if closed else ((),) * 5
    return pd.concat([
        _report("moved", id=ids, target=ids[roots]),
        _report("fell", id=np.array(fell, np.int64), target=np.array(fell_to, np.int64)),
        _report("closed", id=c_id, target=c_to, size=c_size, stability=c_own, chosen=c_chosen),
        _report(
            "open", id=ids[alive], target=np.where(grown, clusters[alive], 0), size=sizes[alive],
            acc=np.where(grown, accs[alive], 0.0), below=np.where(grown, belows[alive], 0.0),
        ),
        _report("peak", acc=[peak]),
    ], ignore_index=True)


def _report(kind: str, **cols) -> pd.DataFrame:
    """Rows of one kind with the columns of `REPORT`; what is not given is null."""
    n = len(next(iter(cols.values())))
    types = {"long": "Int64", "bigint": "Int64", "double": "float64", "boolean": "boolean"}
    out = {"kind": pd.Categorical.from_codes(np.zeros(n, np.int8), [kind]).astype(object)}
    for f in REPORT.fields[1:]:
        t = types[f.dataType.simpleString()]
        out[f.name] = pd.Series(np.asarray(cols[f.name]), dtype=t) if f.name in cols else pd.Series([None] * n, dtype=t)
    return pd.DataFrame(out)


def merge_level(edges: DataFrame, comps: DataFrame, w: float, m: int, limit: int) -> DataFrame:
    """What `merge_edges` reports, for edges of one weight of any number, by grouping alone."""
    lam = 1.0 / w
    labels = component_labels(edges, limit)
    parts = cut(labels.join(comps, "id"))
    large = F.col("size") >= m
    joined = parts.groupBy("root").agg(
        F.sum("size").alias("total"), F.count_if(large).alias("n_large"), F.max("id").alias("last"),
        F.max(F.when(large, F.struct("size", "cluster", "acc", "below"))).alias("one"),
        F.sum(F.when(large, F.greatest(F.col("acc") - lam * F.col("size"), F.col("below")))).alias("best"),
    )
    cluster = (
        F.when(F.col("total") < m, F.lit(0)).when(F.col("n_large") == 0, F.col("root"))
        .when(F.col("n_large") == 1, F.col("one.cluster")).otherwise(-F.col("last") - 1)
    )
    one = F.col("n_large") == 1
    acc = F.when(F.col("total") < m, 0.0).when(
        one, F.col("one.acc") + lam * (F.col("total") - F.col("one.size"))
    ).otherwise(lam * F.col("total"))
    below = F.when(one, F.col("one.below")).when(F.col("n_large") > 1, F.col("best")).otherwise(0.0)
    joined = cut(joined.select(
        "root", "total", "n_large", cluster.cast("long").alias("to_cluster"), acc.alias("to_acc"), below.alias("to_below")
    ))
    both = parts.join(joined, "root")
    none = {"target": "long", "size": "long", "acc": "double", "below": "double", "stability": "double", "chosen": "boolean"}

    def report(df: DataFrame, kind: str, id_col: str | None, **cols) -> DataFrame:
        cells = [F.lit(kind).alias("kind"), (F.col(id_col) if id_col else F.lit(None).cast("long")).alias("id")]
        return df.select(*cells, *[(cols.get(c) if c in cols else F.lit(None)).cast(t).alias(c) for c, t in none.items()])

    own = F.col("acc") - lam * F.col("size")
    ended = both.filter(large & (F.col("n_large") > 1))
    peak = joined.agg(F.max(F.when(F.col("total") >= m, lam)).alias("p"))
    return cut(
        report(both, "moved", "id", target=F.col("root"))
        .unionByName(report(both.filter(~large & (F.col("total") >= m)), "fell", "id", target=F.col("to_cluster")))
        .unionByName(report(ended, "closed", "cluster", target=F.col("to_cluster"), size=F.col("size"), stability=own,
                            chosen=own >= F.col("below") - TOLERANCE * F.abs("below")))
        .unionByName(report(joined, "open", "root", target=F.col("to_cluster"), size=F.col("total"),
                            acc=F.col("to_acc"), below=F.col("to_below")))
        .unionByName(report(peak, "peak", None, acc=F.coalesce("p", F.lit(0.0))))
    )


def _round(edges: DataFrame, comps: DataFrame, m: int, limit: int) -> tuple[DataFrame, object]:
    """(report, condition of the edges that were merged, or None for all) of one round."""

    def merged(batch: DataFrame, key: str) -> DataFrame:
        return cut(_with_sides(batch, comps).groupBy(key).applyInPandas(lambda pdf: merge_edges(pdf, m), REPORT))

    n = edges.count()
    if n <= limit:
        return merged(edges.withColumn("_bucket", F.lit(0)), "_bucket"), None
    lowest = edges.agg(F.min("w")).first()[0]
    ties = F.col("w") == F.lit(lowest)
    if edges.filter(ties).count() > limit // 2:
        return merge_level(edges.filter(ties), comps, lowest, m, limit), ties
    share = 0.5
    while True:
        t = edges.agg(F.percentile_approx("w", F.lit(share), F.lit(10_000))).first()[0]
        light = F.col("w") < F.lit(t) if t > lowest else ties
        labels = component_labels(edges.filter(light), limit)
        rooted = cut(edges.filter(light).join(labels.withColumnRenamed("id", "u"), "u"))
        if light is not ties and rooted.groupBy("root").count().agg(F.max("count")).first()[0] > limit // 2:
            share /= 4
            continue
        parts = 1 + 2 * rooted.count() // limit
        while True:
            bucket = rooted.withColumn("_bucket", F.pmod(F.xxhash64("root"), F.lit(parts)))
            if bucket.groupBy("_bucket").count().agg(F.max("count")).first()[0] <= limit:
                return merged(bucket.drop("root"), "_bucket"), light
            parts *= 2


def _with_sides(edges: DataFrame, comps: DataFrame) -> DataFrame:
    out = edges
    for side in ("u", "v"):
        c = comps.select(F.col("id").alias(side), *[
            F.col(x).alias(f"{side}_{x}") for x in ("size", "cluster", "acc", "below")
        ])
        out = out.join(c, side)
    return out


def tree_edges(points: DataFrame, cfg: ClusterConfig = CFG) -> DataFrame:
    """Spanning edges (u, v, w) of all points (id, vec), copies included."""
    cells = Cells(distinct_points(points), cfg.block_points)
    near = cut(with_cores(near_lists(cells, cfg.min_samples), cfg.min_samples))
    tree = spanning_edges(cells, near, cfg.edges_per_task)
    named = cells.points.filter("n > 1").select("vec", F.col("id").alias("u"))
    copies = points.join(named, "vec").filter("id <> u").join(near.select(F.col("id").alias("u"), "core"), "u")
    copies = copies.select("u", F.col("id").alias("v"), F.col("core").alias("w"))
    edges = tree.unionAll(copies)
    edges = cut(
        edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(
            F.greatest(F.min("w"), F.lit(MIN_DISTANCE)).alias("w")
        )
    )
    release(cells.points, near, tree)
    return edges


def density_clusters(
    vectors: DataFrame, id_col: str = "id", vec_col: str = "vec", cfg: ClusterConfig = CFG
) -> tuple[DataFrame, DataFrame]:
    """Clusters vectors by cosine distance.

    Returns (labels: id, cluster_id with -1 for noise) and (clusters: cluster_id, member_count,
    persistence_score). `id` must be a non-negative long. Cluster ids count from 0 by smallest
    member.
    """
    points = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    m = cfg.min_cluster_size
    edges = tree_edges(points.filter("vec IS NOT NULL"), cfg)

    members = points.select("id", F.col("id").alias("comp"), F.lit(None).cast("long").alias("leaf"))
    comps = points.select(
        "id", F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("cluster"),
        F.lit(0.0).alias("acc"), F.lit(0.0).alias("below"),
    )
    closed = None
    peaks = []
    while not edges.isEmpty():
        report, light = _round(edges, comps, m, cfg.edges_per_task)
        peaks.append(report.filter("kind = 'peak'").agg(F.max("acc")).first()[0])
        moved = report.filter("kind = 'moved'").select("id", F.col("target").alias("to"))
        fell = report.filter("kind = 'fell'").select(
            F.col("id").alias("comp"), F.col("target").alias("_leaf")
        )
        ended = report.filter("kind = 'closed'").select(
            F.col("id").alias("cluster"), F.col("target").alias("parent"), "size", "stability",
            "chosen",
        )
        closed = ended if closed is None else closed.unionByName(ended)
        members = (
            members.join(fell, "comp", "left")
            .join(moved.select(F.col("id").alias("comp"), "to"), "comp", "left")
            .select("id", F.coalesce("to", "comp").alias("comp"),
                    F.coalesce("leaf", "_leaf").alias("leaf"))
        )
        if light is None:
            break
        opened = report.filter("kind = 'open'").select(
            "id", "size", F.col("target").alias("cluster"), "acc", "below"
        )
        comps = cut(comps.join(moved.select("id"), "id", "left_anti").unionByName(opened))
        members = cut(members)
        rest = edges.filter(~light)
        for side in ("u", "v"):
            to = moved.select(F.col("id").alias(side), F.col("to").alias("_to"))
            rest = rest.join(to, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        edges = cut(
            rest.filter("u <> v")
            .groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
            .agg(F.min("w").alias("w"))
        )

    if closed is None:
        nothing = points.select("id", F.lit(-1).cast("long").alias("cluster_id"))
        empty = nothing.select(
            "cluster_id", F.lit(0).cast("long").alias("member_count"),
            F.lit(0.0).alias("persistence_score"),
        ).limit(0)
        return nothing, empty

    members, closed = cut(members), cut(closed)
    top = _topmost_chosen(closed)
    placed = (
        members.join(top.select(F.col("cluster").alias("leaf"), "top"), "leaf", "left")
        .select("id", "top")
    )
    peak = max(peaks)
    sizes = placed.filter("top IS NOT NULL").groupBy("top").agg(
        F.count(F.lit(1)).alias("member_count"), F.min("id").alias("_first")
    )
    scored = sizes.join(closed.withColumnRenamed("cluster", "top"), "top").select(
        "top", "_first", "member_count",
        (F.col("stability") / (F.col("member_count") * F.lit(peak))).alias("persistence_score"),
    )
    numbered = cut(ranked(scored, [], ["_first"], "_first", 1_000_000, "cluster_id"))
    labels = placed.join(numbered.select("top", "cluster_id"), "top", "left").select(
        "id", F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id")
    )
    return labels, numbered.select("cluster_id", "member_count", "persistence_score")


def _topmost_chosen(closed: DataFrame) -> DataFrame:
    """Highest chosen ancestor (or self) of every ended cluster, by pointer doubling."""
    ends = closed.select(F.col("cluster").alias("parent"), F.lit(True).alias("_ended"))
    jump = cut(
        closed.join(ends, "parent", "left").select(
            "cluster",
            F.when(F.col("_ended"), F.col("parent")).alias("up"),
            F.when(F.col("chosen"), F.col("cluster")).alias("top"),
        )
    )
    while not jump.filter("up IS NOT NULL").isEmpty():
        above = jump.select(
            F.col("cluster").alias("up"), F.col("up").alias("_up"), F.col("top").alias("_top")
        )
        jump = cut(
            jump.join(above, "up", "left").select(
                "cluster", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top")
            )
        )
    return jump
