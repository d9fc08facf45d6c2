"""Drift detection queries: dimensions, baselines, scores, windows, evidence, events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from driftloom.catalog.fixtures import CALIBRATION, CFG, SIGNALS_SQL, signals
from driftloom.catalog.registry import query
from driftloom.config import DIMENSIONS, WEIGHTS
from driftloom.functions import signals as S
from driftloom.operators.adaptive import adaptive_baselines, adaptive_scores
from driftloom.operators.evidence import evidence_stats, own_rows, qualified
from driftloom.operators.ewma import calibrated_baseline, moving_baseline
from driftloom.plans import audit, drift
from driftloom.plans.drift import KEYS, NARROW
from driftloom.plans.metrics import detector_counters
from driftloom.session import stage

Z = ["z_" + d for d in DIMENSIONS]

# --- SQL building blocks -------------------------------------------------------------------

ORDERED = """
ordered AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY model_version, tenant_id
                               ORDER BY ts_us, request_id) AS rn
  FROM signals)
"""


def _learn(x, m, v):
    new = f"(0.01e0 * {x} + 0.99e0 * {m})"
    return new, f"(0.005e0 * power({x} - {new}, 2) + 0.995e0 * {v})"


def _moving(limit=""):
    first = ", ".join(f"{d} AS m_{d}, 0e0 AS v_{d}" for d in DIMENSIONS)
    nxt = []
    for d in DIMENSIONS:
        m, v = _learn("o." + d, "f.m_" + d, "f.v_" + d)
        nxt += [f"{m} AS m_{d}", f"{v} AS v_{d}"]
    return f"""
moving AS (
  SELECT model_version, tenant_id, rn, {first} FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.model_version, o.tenant_id, o.rn, {", ".join(nxt)}
  FROM moving f JOIN ordered o
    ON o.model_version = f.model_version AND o.tenant_id = f.tenant_id AND o.rn = f.rn + 1
  {limit})
"""


HEAD = _moving(f"WHERE o.rn <= {CALIBRATION}")

SNAPSHOT = """
snapshot AS MATERIALIZED (
  SELECT m.*, m.rn AS event_count FROM moving m
  JOIN (SELECT model_version, tenant_id, max(rn) AS rn FROM moving GROUP BY 1, 2) l
    USING (model_version, tenant_id, rn))
"""


def _std(m, v):
    return f"greatest(sqrt(greatest({v}, 0e0)), abs({m}) * 0.01e0, 0.01e0)"


def _z(x, m, v):
    return f"(({x} - {m}) / {_std(m, v)})"


COMPOSITE = " + ".join(f"{WEIGHTS[d]}e0 * abs(z_{d})" for d in DIMENSIONS)

FROZEN = f"""
frozen AS MATERIALIZED (
  SELECT *, {COMPOSITE} AS composite FROM (
    SELECT s.request_id, s.ts_us, s.model_version, s.tenant_id,
           {", ".join(_z("s." + d, "b.m_" + d, "b.v_" + d) + " AS z_" + d for d in DIMENSIONS)}
    FROM signals s JOIN snapshot b USING (model_version, tenant_id)
    WHERE b.event_count >= {CALIBRATION}))
"""

DRIFT_TYPE = """
CASE WHEN abs(z_min_logprob) >= 5 AND abs(z_uncertainty_spike_freq) >= 4 THEN 'CATASTROPHIC'
     WHEN abs(z_logprob_entropy_mean) > 3 AND abs(z_logprob_variance) < 2 THEN 'INPUT_DISTRIBUTION'
     WHEN z_mean_logprob < -2 AND abs(z_logprob_entropy_mean) < 2 THEN 'CONCEPT'
     ELSE 'GRADUAL' END
"""


def _adaptive():
    first = ", ".join(f"{d} AS m_{d}, 0e0 AS v_{d}, 0e0 AS z_{d}" for d in DIMENSIONS)
    zs = ", ".join(_z("o." + d, "f.m_" + d, "f.v_" + d) + f" AS z_{d}" for d in DIMENSIONS)
    carry = ", ".join(f"o.{d} AS x_{d}, f.m_{d}, f.v_{d}" for d in DIMENSIONS)
    upd = []
    for d in DIMENSIONS:
        m, v = _learn("x_" + d, "m_" + d, "v_" + d)
        upd += [
            f"CASE WHEN learn THEN {m} ELSE m_{d} END AS m_{d}",
            f"CASE WHEN learn THEN {v} ELSE v_{d} END AS v_{d}",
            f"z_{d}",
        ]
    return f"""
adaptive AS (
  SELECT model_version, tenant_id, rn, request_id, ts_us, CAST(1 AS BIGINT) AS n, FALSE AS scored,
         0e0 AS composite, {first}
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT model_version, tenant_id, rn, request_id, ts_us,
         CASE WHEN learn THEN n + 1 ELSE n END, NOT calibrating, composite, {", ".join(upd)}
  FROM (
    SELECT *, calibrating OR composite < 2e0 AS learn FROM (
      SELECT *, {COMPOSITE} AS composite, n < {CALIBRATION} AS calibrating FROM (
        SELECT o.model_version, o.tenant_id, o.rn, o.request_id, o.ts_us, f.n, {carry}, {zs}
        FROM adaptive f JOIN ordered o
          ON o.model_version = f.model_version AND o.tenant_id = f.tenant_id
         AND o.rn = f.rn + 1))))
"""


LEVELS = [("EMERGENCY", 300, 6.0), ("CRITICAL", 600, 4.5), ("WARNING", 1800, 3.0), ("INFO", 3600, 2.0)]


def _leveled(source):
    frames = ", ".join(
        f"avg(composite) OVER (PARTITION BY model_version, tenant_id ORDER BY ts_us "
        f"RANGE BETWEEN {w * 1_000_000} PRECEDING AND CURRENT ROW) AS avg_{n}"
        for n, w, _ in LEVELS
    )
    case = " ".join(f"WHEN avg_{n} >= {t} THEN '{n}'" for n, _, t in LEVELS)
    return f"""
leveled AS MATERIALIZED (
  SELECT *, CASE {case} END AS alert_level FROM (SELECT *, {frames} FROM {source}))
"""


def _evidence():
    row = "PARTITION BY model_version ORDER BY ts_us, request_id ROWS BETWEEN 499 PRECEDING AND CURRENT ROW"
    hit = "FILTER (WHERE composite >= 2e0)"
    parts = [
        f"count(*) OVER ({row}) AS buffer_len",
        f"count(*) {hit} OVER ({row}) AS n_anomalous",
        f"avg(composite) {hit} OVER ({row}) AS mean_anomalous",
        f"stddev_pop(composite) {hit} OVER ({row}) AS std_anomalous",
        "list(request_id) OVER (PARTITION BY model_version ORDER BY ts_us, request_id "
        "ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS ids",
        f"list(composite) {hit} OVER ({row}) AS buf_c",
        f"list(ts_us) {hit} OVER ({row}) AS buf_t",
    ]
    wins = []
    for w in (60, 300, 600):
        pick = (
            f"list_filter(list_zip(buf_c, buf_t), lambda p: p[2] >= ts_us - {w * 1_000_000})"
        )
        vals = f"list_transform({pick}, lambda p: p[1])"
        wins += [
            f"CAST(coalesce(len({vals}), 0) AS BIGINT) AS n_{w}s",
            f"list_avg({vals}) AS avg_{w}s",
        ]
    ok = "n_anomalous >= 30 AND mean_anomalous <> 0 AND std_anomalous / mean_anomalous < 0.5"
    for w in (60, 300, 600):
        ok += f" AND n_{w}s > 0 AND avg_{w}s >= 3"
    return f"""
evidence AS MATERIALIZED (
  SELECT *, coalesce({ok}, FALSE) AS qualified FROM (
    SELECT *, {", ".join(wins)} FROM (SELECT *, {", ".join(parts)} FROM leveled)))
"""


ADAPTIVE_SCORED = "scored AS MATERIALIZED (SELECT * FROM adaptive WHERE scored)"
BASE = f"WITH RECURSIVE {SIGNALS_SQL}, {ORDERED}"
FROZEN_SQL = f"{BASE}, {HEAD}, {SNAPSHOT}, {FROZEN}"
ADAPTIVE_SQL = f"{BASE}, {_adaptive()}, {ADAPTIVE_SCORED}"
EVENTS_SQL = f"{ADAPTIVE_SQL}, {_leveled('scored')}, {_evidence()}"
FROZEN_EVENTS_SQL = f"{FROZEN_SQL}, {_leveled('frozen')}, {_evidence()}"


def r6(*cols):
    return [F.round(F.col(c), 6).alias(c) for c in cols]


def r6_sql(*cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# --- Dimensions and baselines --------------------------------------------------------------


@query(
    "exp1_signal_dimensions",
    f"WITH {SIGNALS_SQL} SELECT request_id, {r6_sql(*DIMENSIONS)} FROM signals",
)
def exp1(spark, sf):
    from driftloom.catalog.sources import raw_signals
    from driftloom.sources.signals import prepared

    return prepared(raw_signals(spark, sf)).select("request_id", *r6(*DIMENSIONS))


@query(
    "agg1_moving_baseline",
    f"{BASE}, {_moving()}, {SNAPSHOT} "
    + " UNION ALL ".join(
        f"SELECT model_version, tenant_id, '{d}' AS dim, CAST(event_count AS BIGINT) AS n_events, "
        f"round(m_{d}, 6) AS mean, round(v_{d}, 6) AS var FROM snapshot"
        for d in DIMENSIONS
    ),
)
def agg1(spark, sf):
    out = moving_baseline(signals(spark, sf), KEYS, cfg=CFG)
    return out.select(*KEYS, "dim", "n_events", *r6("mean", "var"))


@query(
    "agg2_calibrated_baseline",
    f"{BASE}, {HEAD}, {SNAPSHOT} SELECT model_version, tenant_id, "
    f"CAST(event_count AS BIGINT) AS event_count, event_count < {CALIBRATION} AS is_calibrating, "
    + ", ".join(f"round(m_{d}, 6) AS mean_{d}, round(v_{d}, 6) AS var_{d}" for d in DIMENSIONS)
    + " FROM snapshot",
)
def agg2(spark, sf):
    b = calibrated_baseline(signals(spark, sf), KEYS, cfg=CFG)
    return b.select(
        *KEYS, "event_count", "is_calibrating",
        *r6(*[p + d for d in DIMENSIONS for p in ("mean_", "var_")]),
    )


@query(
    "exp3_baseline_std",
    f"{BASE}, {HEAD}, {SNAPSHOT} SELECT model_version, tenant_id, "
    + ", ".join(f"round({_std('m_' + d, 'v_' + d)}, 6) AS std_{d}" for d in DIMENSIONS)
    + " FROM snapshot",
)
def exp3(spark, sf):
    b = calibrated_baseline(signals(spark, sf), KEYS, cfg=CFG)
    return b.select(
        *KEYS,
        *[
            F.round(S.baseline_std(F.col("mean_" + d), F.col("var_" + d), CFG), 6).alias("std_" + d)
            for d in DIMENSIONS
        ],
    )


@query(
    "jon1_signal_baseline",
    f"{BASE}, {HEAD}, {SNAPSHOT} SELECT s.request_id, b.event_count IS NULL OR "
    f"b.event_count < {CALIBRATION} AS is_calibrating, round(b.m_mean_logprob, 6) AS "
    "mean_mean_logprob FROM signals s LEFT JOIN snapshot b USING (model_version, tenant_id)",
)
def jon1(spark, sf):
    s = signals(spark, sf)
    out = drift.join_baselines(s, stage(calibrated_baseline(s, KEYS, cfg=CFG)))
    return out.select("request_id", "is_calibrating", *r6("mean_mean_logprob"))


# --- Scores against the snapshot -----------------------------------------------------------


def frozen(spark, sf):
    return drift.score_frozen(signals(spark, sf).select(*NARROW), None, CFG)


@query("exp4_z_scores", f"{FROZEN_SQL} SELECT request_id, {r6_sql(*Z)} FROM frozen")
def exp4(spark, sf):
    return frozen(spark, sf).select("request_id", *r6(*Z))


@query(
    "exp5_composite_score",
    f"{FROZEN_SQL} SELECT request_id, round(composite, 6) AS composite FROM frozen",
)
def exp5(spark, sf):
    return frozen(spark, sf).select("request_id", *r6("composite"))


@query(
    "exp6_dominant_dimension",
    f"{FROZEN_SQL} SELECT request_id, CASE "
    + " ".join(
        f"WHEN abs(z_{d}) = greatest({', '.join('abs(' + z + ')' for z in Z)}) THEN '{d}'"
        for d in DIMENSIONS
    )
    + " END AS dominant_dimension FROM frozen",
)
def exp6(spark, sf):
    return frozen(spark, sf).select("request_id", "dominant_dimension")


@query("exp7_drift_type", f"{FROZEN_SQL} SELECT request_id, {DRIFT_TYPE} AS drift_type FROM frozen")
def exp7(spark, sf):
    return frozen(spark, sf).select("request_id", S.drift_type().alias("drift_type"))


@query(
    "score_frozen_summary",
    f"{FROZEN_SQL} SELECT model_version, tenant_id, {DRIFT_TYPE} AS drift_type, "
    "count(*) AS events, count(*) FILTER (WHERE composite >= 2) AS anomalous, "
    "round(avg(composite), 6) AS avg_composite, round(max(composite), 6) AS max_composite "
    "FROM frozen GROUP BY ALL",
)
def score_frozen_summary(spark, sf):
    return (
        frozen(spark, sf)
        .groupBy(*KEYS, S.drift_type().alias("drift_type"))
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("composite") >= 2.0).alias("anomalous"),
            F.round(F.avg("composite"), 6).alias("avg_composite"),
            F.round(F.max("composite"), 6).alias("max_composite"),
        )
    )


# --- Windows and evidence on frozen scores ------------------------------------------------

AVGS = ["avg_INFO", "avg_WARNING", "avg_CRITICAL", "avg_EMERGENCY"]


@query(
    "win1_trailing_averages",
    f"{FROZEN_SQL}, {_leveled('frozen')} SELECT request_id, {r6_sql(*AVGS)} FROM leveled",
)
def win1(spark, sf):
    return drift.with_alert_level(frozen(spark, sf), CFG).select("request_id", *r6(*AVGS))


@query(
    "exp8_alert_level",
    f"{FROZEN_SQL}, {_leveled('frozen')} SELECT request_id, alert_level FROM leveled",
)
def exp8(spark, sf):
    return drift.with_alert_level(frozen(spark, sf), CFG).select("request_id", "alert_level")


def frozen_evidence(spark, sf):
    return own_rows(evidence_stats(drift.with_alert_level(frozen(spark, sf), CFG), CFG))


@query(
    "win2_evidence_buffer",
    f"{FROZEN_EVENTS_SQL} SELECT request_id, buffer_len, n_anomalous FROM evidence",
)
def win2(spark, sf):
    return frozen_evidence(spark, sf).select("request_id", "buffer_len", "n_anomalous")


@query(
    "agg3_evidence_statistics",
    f"{FROZEN_EVENTS_SQL} SELECT request_id, n_anomalous, round(mean_anomalous, 6) AS "
    "mean_anomalous, round(std_anomalous, 5) AS std_anomalous FROM evidence",
)
def agg3(spark, sf):
    return frozen_evidence(spark, sf).select(
        "request_id", "n_anomalous", *r6("mean_anomalous"),
        F.round("std_anomalous", 5).alias("std_anomalous"),
    )


@query(
    "win3_persistence",
    f"{FROZEN_EVENTS_SQL} SELECT request_id, n_60s, n_300s, n_600s, "
    f"{r6_sql('avg_60s', 'avg_300s', 'avg_600s')}, qualified FROM evidence",
)
def win3(spark, sf):
    return frozen_evidence(spark, sf).select(
        "request_id", "n_60s", "n_300s", "n_600s", *r6("avg_60s", "avg_300s", "avg_600s"),
        qualified(CFG).alias("qualified"),
    )


def _event_columns(e):
    return e.select(
        "request_id", "model_version", "alert_level", "drift_type",
        F.round("composite_anomaly_score", 6).alias("composite_anomaly_score"),
        F.round("signal_breakdown.mean_logprob_zscore", 6).alias("mean_logprob_zscore"),
        F.round("affected_request_fraction", 6).alias("affected_request_fraction"),
        F.concat_ws(",", "evidence_request_ids").alias("evidence_request_ids"),
        "qualification_status",
    )


EVENT_SQL = f"""
SELECT request_id, model_version, alert_level, {DRIFT_TYPE} AS drift_type,
       round(composite, 6) AS composite_anomaly_score,
       round(z_mean_logprob, 6) AS mean_logprob_zscore,
       round(least(buffer_len / 500e0, 1e0), 6) AS affected_request_fraction,
       array_to_string(ids, ',') AS evidence_request_ids, 'QUALIFIED' AS qualification_status
FROM evidence WHERE alert_level IN ('CRITICAL', 'EMERGENCY') AND qualified
"""


@query("exp9_drift_events_frozen", FROZEN_EVENTS_SQL + EVENT_SQL)
def exp9(spark, sf):
    leveled = drift.with_alert_level(frozen(spark, sf), CFG)
    return _event_columns(drift.drift_events(leveled, CFG, ["request_id"]))


@query(
    "win4_evidence_ids",
    f"{FROZEN_EVENTS_SQL} SELECT request_id, array_to_string(ids, ',') AS ids, "
    "CAST(len(ids) AS BIGINT) AS n_ids FROM evidence "
    "WHERE alert_level IN ('CRITICAL', 'EMERGENCY') AND qualified",
)
def win4(spark, sf):
    leveled = drift.with_alert_level(frozen(spark, sf), CFG)
    return drift.drift_events(leveled, CFG, ["request_id"]).select(
        "request_id",
        F.concat_ws(",", "evidence_request_ids").alias("ids"),
        F.size("evidence_request_ids").cast("long").alias("n_ids"),
    )


@query(
    "exp10_drift_triggers",
    f"{FROZEN_EVENTS_SQL} SELECT sha256(request_id || '|' || model_version) AS source_event_id, "
    "'DRIFT' AS trigger_type, 30e0 AS budget_cap_usd FROM evidence "
    "WHERE alert_level IN ('CRITICAL', 'EMERGENCY') AND qualified AND composite >= 4.5e0",
)
def exp10(spark, sf):
    leveled = drift.with_alert_level(frozen(spark, sf), CFG)
    return audit.drift_triggers(drift.drift_events(leveled, CFG)).drop("trigger_id")


# --- Adaptive scoring ----------------------------------------------------------------------


def adaptive(spark, sf):
    return adaptive_scores(signals(spark, sf).select(*NARROW), KEYS, CFG)


@query(
    "str1_adaptive_scores",
    f"{ADAPTIVE_SQL} SELECT request_id, {r6_sql('composite', *Z)} FROM scored",
)
def str1(spark, sf):
    return adaptive(spark, sf).select("request_id", *r6("composite", *Z))


@query(
    "src9_baseline_snapshot",
    f"{ADAPTIVE_SQL} SELECT model_version, tenant_id, n AS event_count, "
    + ", ".join(f"round(m_{d}, 6) AS mean_{d}, round(v_{d}, 6) AS var_{d}" for d in DIMENSIONS)
    + " FROM adaptive JOIN (SELECT model_version, tenant_id, max(rn) AS rn FROM ordered "
    "GROUP BY 1, 2) USING (model_version, tenant_id, rn)",
)
def src9(spark, sf):
    from driftloom.sources.tables import baseline_from_json, baseline_json

    b = adaptive_baselines(signals(spark, sf).select(*NARROW), KEYS, CFG)
    back = baseline_from_json(baseline_json(b), CALIBRATION)
    return back.select(
        *KEYS, "event_count", *r6(*[p + d for d in DIMENSIONS for p in ("mean_", "var_")])
    )


@query(
    "str2_alert_levels",
    f"{ADAPTIVE_SQL}, {_leveled('scored')} SELECT model_version, tenant_id, alert_level, "
    "count(*) AS events FROM leveled GROUP BY ALL",
)
def str2(spark, sf):
    leveled = drift.with_alert_level(adaptive(spark, sf), CFG)
    return leveled.groupBy(*KEYS, "alert_level").agg(F.count(F.lit(1)).alias("events"))


@query("str3_qualified_events", EVENTS_SQL + EVENT_SQL)
def str3(spark, sf):
    leveled = drift.with_alert_level(adaptive(spark, sf), CFG)
    return _event_columns(drift.drift_events(leveled, CFG, ["request_id"]))


@query(
    "detect_drift_adaptive",
    f"{EVENTS_SQL} SELECT model_version, alert_level, {DRIFT_TYPE} AS drift_type, "
    "count(*) AS events, round(avg(composite), 6) AS avg_score FROM evidence "
    "WHERE alert_level IN ('CRITICAL', 'EMERGENCY') AND qualified GROUP BY ALL",
)
def detect_drift_adaptive(spark, sf):
    e = drift.detect_drift(signals(spark, sf), CFG)
    return e.groupBy("model_version", "alert_level", "drift_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.round(F.avg("composite_anomaly_score"), 6).alias("avg_score"),
    )


@query(
    "detect_drift_frozen",
    f"{FROZEN_EVENTS_SQL} SELECT model_version, alert_level, {DRIFT_TYPE} AS drift_type, "
    "count(*) AS events, round(avg(composite), 6) AS avg_score FROM evidence "
    "WHERE alert_level IN ('CRITICAL', 'EMERGENCY') AND qualified GROUP BY ALL",
)
def detect_drift_frozen(spark, sf):
    e = drift.detect_drift(signals(spark, sf), CFG, adaptive=False)
    return e.groupBy("model_version", "alert_level", "drift_type").agg(
        F.count(F.lit(1)).alias("events"),
        F.round(F.avg("composite_anomaly_score"), 6).alias("avg_score"),
    )


# An operator loosened EMERGENCY on 2024-01-22 and tightened WARNING on 2024-01-10.
CHANGES = [("EMERGENCY", 9.0, 1_705_881_600_000_000), ("WARNING", 1.5, 1_704_844_800_000_000)]


@query(
    "str4_changed_thresholds",
    f"{FROZEN_SQL}, {_leveled('frozen')} SELECT request_id, CASE "
    "WHEN avg_EMERGENCY >= CASE WHEN ts_us >= 1705881600000000 THEN 9 ELSE 6 END THEN 'EMERGENCY' "
    "WHEN avg_CRITICAL >= 4.5 THEN 'CRITICAL' "
    "WHEN avg_WARNING >= CASE WHEN ts_us >= 1704844800000000 THEN 1.5 ELSE 3 END THEN 'WARNING' "
    "WHEN avg_INFO >= 2 THEN 'INFO' END AS level FROM leveled",
)
def str4(spark, sf):
    out = drift.with_thresholds(frozen(spark, sf), CHANGES, CFG)
    return out.select("request_id", F.col("alert_level").alias("level"))


@query(
    "agg32_detector_counters",
    f"WITH {SIGNALS_SQL} SELECT count(*) AS events_processed, "
    "count(DISTINCT model_version || '/' || tenant_id) AS baselines_loaded FROM signals",
)
def agg32(spark, sf):
    return detector_counters(signals(spark, sf))
