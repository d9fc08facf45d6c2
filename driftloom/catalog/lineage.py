"""Lineage and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog.audit import ALERTS_SQL, BUDGET_SQL, alerts
from driftloom.catalog.registry import query
from driftloom.catalog.sources import NODES_SQL, nodes
from driftloom.operators.greedy import alert_budget
from driftloom.plans import lineage as L


def adapter_pairs(spark, sf):
    """Every adapter next to its parent, with decoded scores."""
    n = nodes(spark, sf).withColumn(
        "scores", F.from_json("evaluation_scores", "map<string,double>")
    )
    base = n.select(F.col("adapter_id").alias("base_id"), F.col("scores").alias("base_scores"))
    other = n.select(
        F.col("parent_adapter_id").alias("base_id"), F.col("adapter_id").alias("other_id"),
        F.col("scores").alias("other_scores"),
    )
    return other.join(base, "base_id")


SCORES_SQL = """
scores AS (
  SELECT adapter_id, 'accuracy' AS benchmark, CAST(p_size AS DOUBLE) AS score FROM nodes
  UNION ALL SELECT adapter_id, p_type, CAST(price AS DOUBLE) FROM nodes),
pairs AS (
  SELECT parent_adapter_id AS base_id, adapter_id AS other_id FROM nodes
  WHERE parent_adapter_id IN (SELECT adapter_id FROM nodes)),
names AS (
  SELECT base_id, other_id, benchmark FROM pairs JOIN scores ON adapter_id = base_id
  UNION SELECT base_id, other_id, benchmark FROM pairs JOIN scores ON adapter_id = other_id)
"""


@query(
    "jon4_score_deltas",
    f"WITH {NODES_SQL}, {SCORES_SQL} SELECT n.base_id, n.other_id, n.benchmark, "
    "round(coalesce(o.score, 0e0) - coalesce(b.score, 0e0), 6) AS delta FROM names n "
    "LEFT JOIN scores b ON b.adapter_id = n.base_id AND b.benchmark = n.benchmark "
    "LEFT JOIN scores o ON o.adapter_id = n.other_id AND o.benchmark = n.benchmark",
)
def jon4(spark, sf):
    return L.score_deltas(adapter_pairs(spark, sf))


@query(
    "set2_benchmark_names",
    f"WITH {NODES_SQL}, {SCORES_SQL} SELECT base_id, other_id, "
    "string_agg(benchmark, ',' ORDER BY benchmark) AS names FROM names GROUP BY 1, 2",
)
def set2(spark, sf):
    return adapter_pairs(spark, sf).select(
        "base_id", "other_id",
        F.concat_ws(
            ",", F.array_sort(F.array_union(F.map_keys("base_scores"), F.map_keys("other_scores")))
        ).alias("names"),
    )


@query(
    "jon5_children",
    f"WITH {NODES_SQL} SELECT parent_adapter_id, adapter_id AS child_id FROM nodes "
    "WHERE parent_adapter_id IN (SELECT adapter_id FROM nodes)",
)
def jon5(spark, sf):
    return L.children(nodes(spark, sf))


CHAIN_SQL = f"""
WITH RECURSIVE {NODES_SQL},
walk AS (
  SELECT adapter_id, adapter_id AS ancestor_id, 0 AS hop FROM nodes
  UNION ALL
  SELECT w.adapter_id, n.parent_adapter_id, w.hop + 1
  FROM walk w JOIN nodes n ON n.adapter_id = w.ancestor_id
  WHERE n.parent_adapter_id IS NOT NULL AND w.hop < 10)
"""


@query(
    "jon6_ancestor_chains",
    f"{CHAIN_SQL} SELECT adapter_id, ancestor_id, CAST(max(hop) OVER (PARTITION BY adapter_id) "
    "- hop AS INTEGER) AS position FROM walk",
)
def jon6(spark, sf):
    return L.ancestor_chains(nodes(spark, sf))


@query(
    "jon6_chain_depths",
    f"{CHAIN_SQL} SELECT adapter_id, count(*) AS depth, max_by(ancestor_id, hop) AS root_id "
    "FROM walk GROUP BY 1",
)
def jon6_depths(spark, sf):
    return L.chain_depths(nodes(spark, sf))


@query(
    "agg22_status_counts",
    f"WITH {NODES_SQL} SELECT status, count(*) AS adapters FROM nodes GROUP BY ROLLUP (status)",
)
def agg22(spark, sf):
    return L.status_counts(nodes(spark, sf))


@query(
    "agg23_production_health",
    f"WITH RECURSIVE {NODES_SQL}, {ALERTS_SQL}, {BUDGET_SQL} "
    "SELECT 'production_adapters' AS item, '' AS name, count(*) FILTER (WHERE status = "
    "'PRODUCTION') AS n FROM nodes UNION ALL SELECT 'recent_alerts', level, count(*) FROM budget "
    "WHERE dispatched GROUP BY level UNION ALL SELECT 'total_alerts_dispatched', '', count(*) "
    "FROM budget WHERE dispatched",
)
def agg23(spark, sf):
    sent = alert_budget(alerts(spark, sf)).filter("dispatched")
    return L.production_health(nodes(spark, sf), sent)


@query(
    "srt2_adapters_by_age",
    f"WITH {NODES_SQL} SELECT adapter_id, status, created_at FROM nodes "
    "WHERE status = 'PRODUCTION' ORDER BY created_at, adapter_id LIMIT 50",
)
def srt2(spark, sf):
    return L.list_adapters(nodes(spark, sf), "PRODUCTION", 50).select(
        "adapter_id", "status", "created_at"
    )


@query(
    "srt3_recent_cycles",
    f"WITH {NODES_SQL} SELECT training_cycle_id AS cycle_id, adapter_id, created_at FROM nodes "
    "ORDER BY created_at DESC, adapter_id LIMIT 20",
)
def srt3(spark, sf):
    return L.list_cycles(nodes(spark, sf), 20).select("cycle_id", "adapter_id", "created_at")


@query(
    "exp25_cycle_summaries",
    f"WITH {NODES_SQL} SELECT training_cycle_id AS cycle_id, adapter_id, status, created_at, "
    "CASE WHEN p_partkey % 3 = 1 THEN p_size + 0.5e0 END AS cost_usd, evaluation_scores "
    "FROM nodes",
)
def exp25(spark, sf):
    return L.cycle_summaries(nodes(spark, sf))
