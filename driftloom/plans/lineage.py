"""Adapter lineage and the dashboard reports built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.config import LoopConfig
from driftloom.session import stage


def children(nodes: DataFrame, adapter_id: str | None = None) -> DataFrame:
    """Direct children: of one adapter, or (parent_adapter_id, child_id) pairs of all."""
    if adapter_id is not None:
        return nodes.filter(F.col("parent_adapter_id") == adapter_id)
    parents = nodes.select(F.col("adapter_id").alias("parent_adapter_id"))
    return nodes.join(parents, "parent_adapter_id", "left_semi").select(
        "parent_adapter_id", F.col("adapter_id").alias("child_id")
    )


def _spread(key):
    """Join key whose nulls become distinct values that match nothing, so they do not pile up."""
    return F.coalesce(key, F.concat(F.lit("\x00"), F.col("adapter_id")))


def ancestor_chains(nodes: DataFrame, max_depth: int = LoopConfig().max_lineage_depth) -> DataFrame:
    """Chain of every adapter as (adapter_id, position, ancestor_id), root at position 0.

    The chain is built by doubling: a chain of n parents is extended with the chain of its last
    element, so ten hops take four joins. It ends at a missing parent, at the depth limit, or
    before the first adapter it already holds.
    """
    ids = nodes.select(F.col("adapter_id").alias("_last"), F.lit(True).alias("_known"))
    hops = nodes.select(
        "adapter_id", "parent_adapter_id", _spread(F.col("parent_adapter_id")).alias("_last")
    ).join(ids, "_last", "left")
    chain = hops.select(
        "adapter_id",
        F.when(F.col("_known"), F.array("parent_adapter_id"))
        .otherwise(F.array().cast("array<string>"))
        .alias("_up"),
    )
    chain = stage(chain)
    length = 1
    while length < max_depth:
        more = chain.select(F.col("adapter_id").alias("_last"), F.col("_up").alias("_more"))
        full = F.when(F.size("_up") == length, F.element_at("_up", -1))
        none = F.array().cast("array<string>")
        # Both sides of the next join are this table: without the cut the plan would double.
        chain = stage(
            chain.withColumn("_last", _spread(full))
            .join(more, "_last", "left")
            .select(
                "adapter_id",
                F.slice(
                    F.concat("_up", F.coalesce("_more", none)), 1, max_depth
                ).alias("_up"),
            )
        )
        length = min(2 * length, max_depth)
    path = F.concat(F.array("adapter_id"), F.col("_up"))
    fresh = F.filter(
        F.sequence(F.lit(1), F.size("_path")),
        lambda i: F.array_position("_path", F.element_at("_path", i)) < i.cast("long"),
    )
    stop = F.coalesce(F.try_element_at(fresh, F.lit(1)) - 1, F.size("_path"))
    return (
        chain.select("adapter_id", path.alias("_path"))
        .withColumn("_path", F.slice("_path", F.lit(1), stop))
        .select("adapter_id", F.posexplode(F.reverse("_path")).alias("position", "ancestor_id"))
    )


def lineage_of(nodes: DataFrame, adapter_id: str, max_depth: int = 10) -> DataFrame:
    """Full node rows of one adapter's chain, root first."""
    chain = ancestor_chains(nodes, max_depth).filter(F.col("adapter_id") == adapter_id)
    return (
        chain.select("position", F.col("ancestor_id").alias("adapter_id"))
        .join(nodes, "adapter_id")
        .orderBy("position")
    )


def chain_depths(nodes: DataFrame, max_depth: int = 10) -> DataFrame:
    """Number of nodes in every adapter's chain, and its root."""
    return ancestor_chains(nodes, max_depth).groupBy("adapter_id").agg(
        F.count(F.lit(1)).alias("depth"), F.min_by("ancestor_id", "position").alias("root_id")
    )


def list_adapters(nodes: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    rows = nodes if status is None else nodes.filter(F.col("status") == status)
    return rows.orderBy("created_at", "adapter_id").limit(limit)


def list_cycles(nodes: DataFrame, limit: int = 20) -> DataFrame:
    """Latest adapters as cycle summaries; `deployment_record` may be null or lack a cost."""
    return (
        cycle_summaries(nodes).orderBy(F.desc("created_at"), F.asc("adapter_id")).limit(limit)
    )


def cycle_summaries(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.col("training_cycle_id").alias("cycle_id"),
        "adapter_id",
        "status",
        "created_at",
        F.get_json_object("deployment_record", "$.cost_usd").try_cast("double").alias("cost_usd"),
        "evaluation_scores",
    )


def score_deltas(pairs: DataFrame) -> DataFrame:
    """One row per benchmark of either adapter: other - base, rounded, a missing score as 0.

    `pairs` has base_id, other_id and the two score maps base_scores, other_scores.
    """
    empty = F.create_map().cast("map<string,double>")
    merged = F.map_zip_with(
        F.coalesce("base_scores", empty),
        F.coalesce("other_scores", empty),
        lambda k, b, o: F.round(
            F.coalesce(o, F.lit(0.0)) - F.coalesce(b, F.lit(0.0)), 6
        ),
    )
    return pairs.select("base_id", "other_id", F.explode(merged).alias("benchmark", "delta"))


def compare_adapters(nodes: DataFrame, base_id: str, other_id: str) -> DataFrame:
    """Score deltas of two adapters by name; raises when either is unknown."""
    scores = nodes.select(
        "adapter_id", F.from_json("evaluation_scores", "map<string,double>").alias("scores")
    ).filter(F.col("adapter_id").isin(base_id, other_id))
    both = scores.groupBy().agg(
        F.max_by("scores", F.col("adapter_id") == base_id).alias("base_scores"),
        F.max_by("scores", F.col("adapter_id") == other_id).alias("other_scores"),
        F.count_distinct("adapter_id").alias("n"),
    )
    if both.first()["n"] < len({base_id, other_id}):
        raise KeyError(f"unknown adapter: {base_id} or {other_id}")
    pairs = both.withColumns({"base_id": F.lit(base_id), "other_id": F.lit(other_id)})
    return score_deltas(pairs).orderBy("benchmark")


def status_counts(nodes: DataFrame) -> DataFrame:
    """Adapters per status, with the total in the row of status null."""
    return nodes.rollup("status").agg(F.count(F.lit(1)).alias("adapters"))


def production_health(nodes: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Rows (item, name, n): production adapters, dispatched alerts per level, their total."""
    adapters = nodes.groupBy().agg(F.count_if(F.col("status") == "PRODUCTION").alias("n")).select(
        F.lit("production_adapters").alias("item"), F.lit("").alias("name"), "n"
    )
    levels = dispatched.groupBy(F.col("level").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    alerts = levels.select(F.lit("recent_alerts").alias("item"), "name", "n")
    total = levels.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit("total_alerts_dispatched").alias("item"), F.lit("").alias("name"), "n"
    )
    return adapters.unionByName(alerts).unionByName(total)
