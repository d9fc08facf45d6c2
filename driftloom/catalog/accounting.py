"""Cost, budget and checkpoint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog.fixtures import table
from driftloom.catalog.registry import query
from driftloom.catalog.sources import CKPT_SQL, saved_checkpoints
from driftloom.plans import accounting as A
from driftloom.sources.tables import valid_costs

SEQ = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "component"]


def costs(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat(F.lit("c"), "l_orderkey").alias("cycle_id"),
        F.col("l_returnflag").alias("component"),
        (F.col("l_extendedprice") / 1000 - 5).alias("amount_usd"),
        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
    )
    return valid_costs(rows)[0]


COSTS_SQL = """
costs AS (
  SELECT 'c' || l_orderkey AS cycle_id, l_returnflag AS component,
         l_extendedprice / 1000 - 5 AS amount_usd, l_shipdate, l_linenumber, l_partkey,
         l_suppkey, l_extendedprice
  FROM lineitem WHERE l_extendedprice / 1000 - 5 >= 0)
"""


def cycles(spark, sf):
    return table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_orderkey").alias("cycle_id"))


@query(
    "agg10_cost_per_cycle",
    f"WITH {COSTS_SQL} SELECT 'c' || o_orderkey AS cycle_id, round(coalesce(sum(amount_usd), 0e0),"
    " 6) AS total_usd FROM orders LEFT JOIN costs ON cycle_id = 'c' || o_orderkey GROUP BY 1",
)
def agg10(spark, sf):
    out = A.total_per_cycle(costs(spark, sf), cycles(spark, sf))
    return out.select("cycle_id", F.round("total_usd", 6).alias("total_usd"))


@query(
    "agg11_cost_breakdown",
    f"WITH {COSTS_SQL} SELECT cycle_id, component, round(sum(amount_usd), 6) AS total_usd "
    "FROM costs GROUP BY 1, 2",
)
def agg11(spark, sf):
    return A.cost_breakdown(costs(spark, sf)).withColumn("total_usd", F.round("total_usd", 6))


@query(
    "agg11_cost_breakdown_wide",
    f"WITH {COSTS_SQL} SELECT cycle_id, "
    + ", ".join(
        f"round(sum(amount_usd) FILTER (WHERE component = '{c}'), 6) AS {c}" for c in "ANR"
    )
    + " FROM costs GROUP BY 1",
)
def agg11_wide(spark, sf):
    out = A.cost_breakdown_wide(costs(spark, sf), list("ANR"))
    return out.select("cycle_id", *[F.round(c, 6).alias(c) for c in "ANR"])


@query(
    "agg12_budget_guard",
    f"WITH {COSTS_SQL} SELECT cycle_id, sum(amount_usd) + 16.05e0 > 150e0 AS exceeds "
    "FROM costs GROUP BY 1",
)
def agg12(spark, sf):
    totals = A.total_per_cycle(costs(spark, sf))
    return A.budget_guard(totals, A.CFG.projected_usd, 150.0).select("cycle_id", "exceeds")


@query(
    "set5_cycle_records",
    f"WITH {COSTS_SQL} SELECT cycle_id, component, round(amount_usd, 6) AS amount_usd, "
    "CAST(row_number() OVER (PARTITION BY cycle_id ORDER BY l_shipdate, l_linenumber, l_partkey, "
    "l_suppkey, l_extendedprice, component) AS INTEGER) AS position FROM costs",
)
def set5(spark, sf):
    return A.record_positions(costs(spark, sf), SEQ).select(
        "cycle_id", "component", F.round("amount_usd", 6).alias("amount_usd"), "position"
    )


TYPES = ["A100-80GB", "A100-40GB", "H100-80GB", "V100-16GB", "T4-16GB", "L4-24GB"]


@query(
    "exp20_spot_price_caps",
    "WITH prices(instance_type, usd) AS (VALUES ('A100-80GB', 4.10e0), ('A100-40GB', 3.06e0), "
    "('H100-80GB', 8.50e0), ('V100-16GB', 2.48e0), ('T4-16GB', 0.53e0)), "
    "asked AS (SELECT l_orderkey, l_linenumber, ['A100-80GB', 'A100-40GB', 'H100-80GB', "
    "'V100-16GB', 'T4-16GB', 'L4-24GB'][l_partkey % 6 + 1] AS instance_type FROM lineitem) "
    "SELECT instance_type, count(*) AS requests, round(min(coalesce(usd, 4.10e0)), 6) AS "
    "on_demand_usd, round(max(coalesce(usd, 4.10e0) * 0.7e0), 6) AS spot_cap_usd "
    "FROM asked LEFT JOIN prices USING (instance_type) GROUP BY 1",
)
def exp20(spark, sf):
    types = F.array(*[F.lit(t) for t in TYPES])
    asked = table(spark, sf, "lineitem").select(
        F.element_at(types, (F.col("l_partkey") % 6 + 1).cast("int")).alias("instance_type")
    )
    return A.spot_caps(asked).groupBy("instance_type").agg(
        F.count(F.lit(1)).alias("requests"),
        F.round(F.min("on_demand_usd"), 6).alias("on_demand_usd"),
        F.round(F.max("spot_cap_usd"), 6).alias("spot_cap_usd"),
    )


def runs(spark, sf):
    """An SFT run per order, and a DPO run for two orders of three."""
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    sft = F.struct(
        F.lit("sft").alias("phase"), (F.col("o_totalprice") / 50).alias("duration_s"),
        F.lit(3.21).alias("hourly_usd"), F.concat(F.lit("sft/"), key).alias("path"),
    )
    dpo = F.struct(
        F.lit("dpo").alias("phase"), (F.col("o_totalprice") / 100).alias("duration_s"),
        F.lit(3.21).alias("hourly_usd"), F.concat(F.lit("dpo/"), key).alias("path"),
    )
    both = F.when(key % 3 != 0, F.array(sft, dpo)).otherwise(F.array(sft))
    return o.select(F.concat(F.lit("c"), key).alias("cycle_id"), F.inline(both))


RUNS_SQL = """
runs AS (
  SELECT 'c' || o_orderkey AS cycle_id, 'sft' AS phase, o_totalprice / 50 AS duration_s,
         3.21e0 AS hourly_usd, 'sft/' || o_orderkey AS path FROM orders
  UNION ALL
  SELECT 'c' || o_orderkey, 'dpo', o_totalprice / 100, 3.21e0, 'dpo/' || o_orderkey
  FROM orders WHERE o_orderkey % 3 <> 0)
"""


@query(
    "exp21_phase_costs",
    f"WITH {RUNS_SQL} SELECT cycle_id, phase, round(duration_s / 3600e0 * hourly_usd, 10) AS "
    "amount_usd FROM runs",
)
def exp21(spark, sf):
    return A.phase_costs(runs(spark, sf)).select(
        "cycle_id", "phase", F.round("amount_usd", 10).alias("amount_usd")
    )


@query(
    "agg30_gpu_hours",
    f"WITH {RUNS_SQL} SELECT cycle_id, round(sum(duration_s) / 3600e0, 9) AS gpu_hours "
    "FROM runs GROUP BY 1",
)
def agg30(spark, sf):
    return A.gpu_hours(runs(spark, sf)).withColumn("gpu_hours", F.round("gpu_hours", 9))


@query(
    "exp22_candidate_artifact",
    "SELECT 'c' || o_orderkey AS cycle_id, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN 'dpo/' || "
    "o_orderkey END, CASE WHEN o_orderstatus <> 'P' THEN 'sft/' || o_orderkey END, "
    "'cycles/' || o_orderkey) AS candidate_path FROM orders",
)
def exp22(spark, sf):
    key = F.col("o_orderkey")
    o = table(spark, sf, "orders").select(
        F.concat(F.lit("c"), key).alias("cycle_id"),
        F.when(key % 3 != 0, F.concat(F.lit("dpo/"), key)).alias("dpo_path"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("sft/"), key)).alias("sft_path"),
        F.concat(F.lit("cycles/"), key).alias("cycle_dir"),
    )
    return o.select("cycle_id", A.candidate_path().alias("candidate_path"))


@query(
    "win7_latest_checkpoint",
    f"WITH {CKPT_SQL} SELECT cycle_id, step, train_loss, eval_loss, timestamp FROM saved "
    "QUALIFY row_number() OVER (PARTITION BY cycle_id ORDER BY step DESC, timestamp DESC, "
    "phase DESC) = 1",
)
def win7(spark, sf):
    rows = saved_checkpoints(spark, sf).withColumn(
        "timestamp", F.struct(F.col("timestamp").alias("t"), F.col("phase").alias("p"))
    )
    return A.latest_checkpoint(rows).select(
        "cycle_id", "step", "train_loss", "eval_loss", F.col("timestamp.t").alias("timestamp")
    )


@query(
    "win8_checkpoint_retention",
    f"WITH {CKPT_SQL} SELECT cycle_id, step, phase, row_number() OVER (PARTITION BY cycle_id "
    "ORDER BY step DESC, phase DESC) <= 3 AS keep FROM saved",
)
def win8(spark, sf):
    return A.checkpoint_retention(saved_checkpoints(spark, sf)).select(
        "cycle_id", "step", "phase", "keep"
    )


@query(
    "cycle_accounting",
    f"WITH {RUNS_SQL}, phases AS (SELECT cycle_id, max(duration_s) FILTER (WHERE phase = 'sft') "
    "AS sd, max(duration_s) FILTER (WHERE phase = 'dpo') AS dd, max(path) FILTER (WHERE phase = "
    "'sft') AS sp, max(path) FILTER (WHERE phase = 'dpo') AS dp FROM runs GROUP BY 1), "
    "earlier AS (SELECT 'c' || l_orderkey AS cycle_id, sum(l_discount) AS spent FROM lineitem "
    "GROUP BY 1), j AS (SELECT 'c' || o_orderkey AS cycle_id, 'cycles/' || o_orderkey AS dir, "
    "CASE WHEN o_orderkey % 4 = 0 THEN 30e0 ELSE o_totalprice / 10000 END AS budget_usd, "
    "coalesce(spent, 0e0) AS spent, sd, dd, sp, dp FROM orders "
    "LEFT JOIN phases ON phases.cycle_id = 'c' || o_orderkey "
    "LEFT JOIN earlier ON earlier.cycle_id = 'c' || o_orderkey), "
    "f AS (SELECT *, spent + 5 * 3.21e0 > budget_usd AS pre, sd / 3600 * 3.21e0 AS sc, "
    "dd / 3600 * 3.21e0 AS dc FROM j), "
    "g AS (SELECT *, NOT pre AND spent + sc + 2 * 3.21e0 > budget_usd AS stop FROM f), "
    "h AS (SELECT *, NOT pre AND NOT stop AND dp IS NOT NULL AS dpo FROM g) "
    "SELECT cycle_id, CASE WHEN pre OR stop THEN 'COST_EXCEEDED' WHEN dpo THEN 'COMPLETED' ELSE "
    "'FAILED' END AS status, round(spent + CASE WHEN NOT pre THEN sc ELSE 0 END + CASE WHEN dpo "
    "THEN dc ELSE 0 END, 10) AS cost_usd, round((CASE WHEN NOT pre THEN sd ELSE 0 END + CASE WHEN "
    "dpo THEN dd ELSE 0 END) / 3600, 9) AS gpu_hours, CASE WHEN dpo THEN dp WHEN NOT pre THEN sp "
    "ELSE dir END AS candidate_path FROM h",
)
def cycle_accounting(spark, sf):
    o = table(spark, sf, "orders")
    key = F.col("o_orderkey")
    cyc = o.select(
        F.concat(F.lit("c"), key).alias("cycle_id"),
        F.concat(F.lit("cycles/"), key).alias("cycle_dir"),
        F.when(key % 4 != 0, F.col("o_totalprice") / 10000).alias("budget_usd"),
    )
    earlier = table(spark, sf, "lineitem").select(
        F.concat(F.lit("c"), "l_orderkey").alias("cycle_id"),
        F.col("l_discount").alias("amount_usd"),
    )
    out = A.cycle_accounting(cyc, runs(spark, sf), earlier)
    return out.select(
        "cycle_id", "status", F.round("cost_usd", 10).alias("cost_usd"),
        F.round("gpu_hours", 9).alias("gpu_hours"), "candidate_path",
    )
