"""Alert budget, trigger, transition and promotion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog.fixtures import micros, table
from driftloom.catalog.registry import query
from driftloom.config import ADAPTER_TRANSITIONS, LOOP_TERMINAL, LOOP_TRANSITIONS, LoopConfig
from driftloom.operators import greedy
from driftloom.plans import audit
from driftloom.plans.alerts import dispatch_alerts

LEVEL_OF = {"click": "INFO", "view": "WARNING", "signup": "CRITICAL", "purchase": "EMERGENCY"}


def alerts(spark, sf):
    """Events as alerts, ten times denser in time, with one unlisted level."""
    level = F.lit("DEBUG")
    for kind, name in LEVEL_OF.items():
        level = F.when(F.col("event_type") == kind, name).otherwise(level)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("alert_id"), level.alias("level"),
        F.expr("unix_micros(cast(ts as timestamp)) div 10").alias("ts_us"),
    )


ALERTS_SQL = """
alerts AS (
  SELECT event_id AS alert_id, CASE event_type WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'WARNING'
    WHEN 'signup' THEN 'CRITICAL' WHEN 'purchase' THEN 'EMERGENCY' ELSE 'DEBUG' END AS level,
    epoch_us(ts) // 10 AS ts_us FROM events),
lined AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY level ORDER BY ts_us, alert_id) AS rn,
         CASE level WHEN 'INFO' THEN 0 WHEN 'WARNING' THEN 10 WHEN 'CRITICAL' THEN 5 ELSE 100 END
           AS allowed
  FROM alerts)
"""
BUDGET_SQL = """
budget AS (
  SELECT level, rn, alert_id, allowed > 0 AS dispatched,
         CASE WHEN allowed > 0 THEN [ts_us] ELSE CAST([] AS BIGINT[]) END AS sent
  FROM lined WHERE rn = 1
  UNION ALL
  SELECT level, rn, alert_id, len(kept) < allowed,
         CASE WHEN len(kept) < allowed THEN list_append(kept, ts_us) ELSE kept END
  FROM (SELECT l.level, l.rn, l.alert_id, l.ts_us, l.allowed,
               list_filter(b.sent, lambda t: t > l.ts_us - 3600000000) AS kept
        FROM budget b JOIN lined l ON l.level = b.level AND l.rn = b.rn + 1))
"""


@query(
    "win5_alert_budget",
    f"WITH RECURSIVE {ALERTS_SQL}, {BUDGET_SQL} SELECT alert_id, level, dispatched FROM budget",
)
def win5(spark, sf):
    return greedy.alert_budget(alerts(spark, sf)).select("alert_id", "level", "dispatched")


@query(
    "dispatch_alerts",
    f"WITH RECURSIVE {ALERTS_SQL}, {BUDGET_SQL} SELECT level, count(*) AS sent FROM budget "
    "WHERE dispatched GROUP BY 1",
)
def dispatched(spark, sf):
    return dispatch_alerts(alerts(spark, sf)).groupBy("level").agg(
        F.count(F.lit(1)).alias("sent")
    )


def ticks(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("tick_id"), F.col("event_type").alias("schedule"),
        micros("ts").alias("ts_us"), (F.col("event_id") % 500 == 7).alias("recorded"),
    )


DAILY = LoopConfig(schedule_interval_s=86_400)


@query(
    "win9_schedule_trigger",
    "WITH RECURSIVE ticks AS MATERIALIZED (SELECT event_id AS tick_id, event_type AS schedule, "
    "epoch_us(ts) AS ts_us, event_id % 500 = 7 AS recorded, row_number() OVER (PARTITION BY "
    "event_type ORDER BY ts, event_id) AS rn FROM events), "
    "run AS (SELECT schedule, rn, tick_id, FALSE AS fired, CASE WHEN recorded THEN ts_us END AS "
    "last FROM ticks WHERE rn = 1 UNION ALL SELECT schedule, rn, tick_id, due AND NOT recorded, "
    "CASE WHEN recorded OR due THEN ts_us ELSE last END FROM (SELECT t.*, r.last, "
    "coalesce(t.ts_us - r.last >= 86400000000, FALSE) AS due FROM run r JOIN ticks t "
    "ON t.schedule = r.schedule AND t.rn = r.rn + 1)) SELECT schedule, tick_id, fired FROM run",
)
def win9(spark, sf):
    return greedy.schedule_fires(ticks(spark, sf), "schedule", DAILY).select(
        "schedule", "tick_id", "fired"
    )


def start_requests(spark, sf):
    o = table(spark, sf, "orders")
    ts = micros("o_orderdate") + F.col("o_orderkey")
    done = ts + (F.col("o_totalprice") * 1_000_000).cast("long")
    return o.select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("cluster_id"),
        ts.alias("ts_us"), F.when(F.col("o_orderkey") % 5000 != 3, done).alias("completed_us"),
    )


ADMISSION_SQL = (
    "req AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cluster_id "
    "ORDER BY ts_us, request_id) AS rn FROM (SELECT o_orderkey AS request_id, o_orderpriority AS "
    "cluster_id, epoch_us(o_orderdate) + o_orderkey AS ts_us, CASE WHEN o_orderkey % 5000 <> 3 "
    "THEN epoch_us(o_orderdate) + o_orderkey + CAST(trunc(o_totalprice * 1000000) AS BIGINT) ELSE "
    "9000000000000000000 END AS done FROM orders)), "
    "run AS (SELECT cluster_id, rn, request_id, 'ok' AS reason, done FROM req WHERE rn = 1 "
    "UNION ALL SELECT cluster_id, rn, request_id, reason, CASE WHEN reason = 'ok' THEN own ELSE "
    "busy END FROM (SELECT q.cluster_id, q.rn, q.request_id, q.done AS own, r.done AS busy, CASE "
    "WHEN q.ts_us < r.done THEN 'running' WHEN q.ts_us - r.done < 43200000000 THEN "
    "'rate_limited' ELSE 'ok' END AS reason FROM run r JOIN req q ON q.cluster_id = r.cluster_id "
    "AND q.rn = r.rn + 1))"
)


@query(
    "win10_cycle_admission",
    f"WITH RECURSIVE {ADMISSION_SQL} "
    "SELECT request_id, reason = 'ok' AS admitted, reason FROM run",
)
def win10(spark, sf):
    return greedy.cycle_admission(start_requests(spark, sf), "cluster_id").select(
        "request_id", "admitted", "reason"
    )


LOOP_STATES = list(LOOP_TRANSITIONS)
ADAPTER_STATES = list(ADAPTER_TRANSITIONS)


def _log(spark, sf, states, key):
    """Events as state moves, legal and illegal ones."""
    e = table(spark, sf, "events")
    names = F.array(*[F.lit(s) for s in states])
    k = F.get_json_object("props", "$.k").cast("long")
    pick = lambda i: F.element_at(names, (i % len(states) + 1).cast("int"))
    return e.select(
        F.concat(F.lit("x"), "user_id").alias(key), F.col("event_id").alias("seq"),
        micros("ts").alias("ts_us"), pick(k).alias("from_state"),
        pick(k + 1 + (F.col("event_id") % 3 == 0).cast("int")).alias("to_state"),
    )


def _log_sql(states, key):
    names = "[" + ", ".join(f"'{s}'" for s in states) + "]"
    n = len(states)
    return f"""
log AS MATERIALIZED (
  SELECT 'x' || user_id AS {key}, event_id AS seq, epoch_us(ts) AS ts_us,
         {names}[k % {n} + 1] AS from_state,
         {names}[(k + 1 + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) % {n} + 1] AS to_state
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events))
"""


def loop_log(spark, sf):
    return _log(spark, sf, LOOP_STATES, "execution_id")


LOOP_SQL = _log_sql(LOOP_STATES, "execution_id")
ADAPTER_SQL = _log_sql(ADAPTER_STATES, "adapter_id")


def _legal_sql(table):
    pairs = [f"('{a}', '{b}')" for a, bs in table.items() for b in bs]
    return "(from_state, to_state) IN (" + ", ".join(pairs) + ")"


@query(
    "jon10_illegal_loop_moves",
    f"WITH {LOOP_SQL} SELECT execution_id, seq, from_state, to_state FROM log "
    f"WHERE NOT {_legal_sql(LOOP_TRANSITIONS)}",
)
def jon10(spark, sf):
    return audit.illegal_transitions(loop_log(spark, sf)).select(
        "execution_id", "seq", "from_state", "to_state"
    )


@query(
    "jon10_illegal_adapter_moves",
    f"WITH {ADAPTER_SQL} SELECT adapter_id, seq, from_state, to_state FROM log "
    f"WHERE NOT {_legal_sql(ADAPTER_TRANSITIONS)}",
)
def jon10_adapters(spark, sf):
    log = _log(spark, sf, ADAPTER_STATES, "adapter_id")
    return audit.illegal_adapter_transitions(log).select(
        "adapter_id", "seq", "from_state", "to_state"
    )


@query(
    "win11_state_steps",
    f"WITH {LOOP_SQL} SELECT execution_id, seq, lag(to_state) OVER w AS previous_state, "
    f"{_legal_sql(LOOP_TRANSITIONS)} AS is_legal, "
    "round((lead(ts_us) OVER w - ts_us) / 1e6, 6) AS seconds_in_state FROM log "
    "WINDOW w AS (PARTITION BY execution_id ORDER BY ts_us)",
)
def win11(spark, sf):
    return audit.state_steps(loop_log(spark, sf)).select(
        "execution_id", "seq", "previous_state", "is_legal",
        F.round("seconds_in_state", 6).alias("seconds_in_state"),
    )


SUMMARY_SQL = f"""
{LOOP_SQL},
summary AS (
  SELECT execution_id, min(ts_us) AS started_us,
         min(ts_us) FILTER (WHERE moved AND to_state IN {LOOP_TERMINAL}) AS completed_us,
         min(ts_us) FILTER (WHERE moved AND to_state = 'IDLE') AS archived_us,
         arg_max(to_state, ts_us) AS current_state, count(*) AS history_rows,
         max(ts_us) AS last_us,
         string_agg(from_state || '>' || to_state, ',' ORDER BY ts_us) AS history
  FROM (SELECT *, NOT (from_state = 'IDLE' AND to_state = 'IDLE') AS moved FROM log) GROUP BY 1)
"""


@query(
    "win12_execution_summaries",
    f"WITH {SUMMARY_SQL} SELECT execution_id, started_us, completed_us, archived_us, "
    "current_state, history_rows, round((coalesce(completed_us, last_us) - started_us) / 1e6, 6) "
    "AS duration_s, history FROM summary",
)
def win12(spark, sf):
    moves = F.transform(
        "state_history", lambda h: F.concat(h["from_state"], F.lit(">"), h["to_state"])
    )
    return audit.execution_summaries(loop_log(spark, sf)).select(
        "execution_id", "started_us", "completed_us", "archived_us", "current_state",
        "history_rows", F.round("duration_s", 6).alias("duration_s"),
        F.concat_ws(",", moves).alias("history"),
    )


@query(
    "srt4_execution_history",
    f"WITH {SUMMARY_SQL} SELECT execution_id, archived_us FROM summary WHERE archived_us IS NOT "
    "NULL ORDER BY archived_us DESC, execution_id DESC LIMIT 20",
)
def srt4(spark, sf):
    s = audit.execution_summaries(loop_log(spark, sf))
    return audit.execution_history(s, 20).select("execution_id", "archived_us")


@query(
    "stuck_executions",
    f"WITH {SUMMARY_SQL} SELECT execution_id, current_state FROM summary WHERE archived_us IS NULL",
)
def stuck(spark, sf):
    s = audit.execution_summaries(loop_log(spark, sf))
    return audit.stuck_executions(s).select("execution_id", "current_state")


@query(
    "loop_audit",
    f"WITH RECURSIVE {LOOP_SQL}, {ADMISSION_SQL}, moves AS (SELECT execution_id, count(*) AS moves, "
    f"count(*) FILTER (WHERE NOT {_legal_sql(LOOP_TRANSITIONS)}) AS illegal_moves, "
    "arg_max(to_state, (ts_us, seq)) AS current_state FROM log GROUP BY 1), asked AS (SELECT 'x' || "
    "request_id AS execution_id, reason = 'ok' AS admitted, reason FROM run) SELECT execution_id, "
    "admitted, reason, moves, illegal_moves, current_state, CASE WHEN admitted IS NULL THEN "
    "'unrequested' WHEN NOT admitted THEN CASE WHEN moves IS NULL THEN 'refused' ELSE 'ran though "
    "refused' END WHEN moves IS NULL THEN 'never started' WHEN illegal_moves > 0 THEN 'illegal "
    "moves' WHEN current_state <> 'IDLE' THEN 'open' ELSE 'ok' END AS finding "
    "FROM asked FULL JOIN moves USING (execution_id)",
)
def audit_loop(spark, sf):
    requests = start_requests(spark, sf).withColumn(
        "request_id", F.concat(F.lit("x"), "request_id")
    )
    return audit.loop_audit(requests, loop_log(spark, sf))


@query(
    "win13_current_production",
    "SELECT user_id % 10 AS cluster_id, 'a' || arg_max(event_id, (ts, 'a' || event_id)) AS adapter_id "
    "FROM events GROUP BY 1",
)
def win13(spark, sf):
    promotions = table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("cluster_id"),
        F.concat(F.lit("a"), "event_id").alias("adapter_id"), micros("ts").alias("ts_us"),
    )
    return audit.current_production(promotions)


@query(
    "win14_adapter_states",
    f"WITH {ADAPTER_SQL} SELECT a AS adapter_id, coalesce(state, 'CANDIDATE') AS state FROM "
    "(SELECT 'x' || c_custkey AS a FROM customer) LEFT JOIN (SELECT adapter_id, "
    "arg_max(to_state, ts_us) AS state FROM log GROUP BY 1) ON adapter_id = a",
)
def win14(spark, sf):
    adapters = table(spark, sf, "customer").select(
        F.concat(F.lit("x"), "c_custkey").alias("adapter_id")
    )
    return audit.adapter_states(adapters, _log(spark, sf, ADAPTER_STATES, "adapter_id"))


@query(
    "exp11_canary_anomalies",
    "WITH c AS (SELECT user_id, avg(value) AS s FROM events WHERE event_id % 10 = 0 GROUP BY 1), "
    "p AS (SELECT user_id, avg(value) AS s FROM events WHERE event_id % 10 <> 0 GROUP BY 1) "
    "SELECT c.user_id, round(c.s, 10) AS canary_score, round(p.s, 10) AS production_score, "
    "c.s - p.s > 2 AS roll_back FROM c JOIN p USING (user_id)",
)
def exp11(spark, sf):
    side = lambda cond, name: F.avg(F.when(cond, F.col("value"))).alias(name)
    canary = F.col("event_id") % 10 == 0
    pairs = (
        table(spark, sf, "events").groupBy("user_id")
        .agg(side(canary, "canary_score"), side(~canary, "production_score"))
        .filter("canary_score IS NOT NULL AND production_score IS NOT NULL")
    )
    return audit.canary_anomalies(pairs).select(
        "user_id", F.round("canary_score", 10).alias("canary_score"),
        F.round("production_score", 10).alias("production_score"), "roll_back",
    )


@query(
    "agg31_promotion_outcomes",
    "SELECT 'a' || l_orderkey AS adapter_id, count(*) FILTER (WHERE l_discount >= 0.09) AS "
    "failed_replicas, count(*) FILTER (WHERE l_discount < 0.09) AS loaded_replicas, "
    "count(*) FILTER (WHERE l_discount >= 0.09) > 0 AS rolled_back FROM lineitem GROUP BY 1",
)
def agg31(spark, sf):
    loads = table(spark, sf, "lineitem").select(
        F.concat(F.lit("a"), "l_orderkey").alias("adapter_id"),
        (F.col("l_discount") < 0.09).alias("success"),
    )
    return audit.promotion_outcomes(loads)
