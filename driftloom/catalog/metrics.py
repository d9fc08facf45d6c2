"""Counter, gauge, histogram and latency queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog.fixtures import micros, table
from driftloom.catalog.registry import query
from driftloom.config import CAPTURE_LATENCY_NS, HISTOGRAM_BOUNDS
from driftloom.operators.distributions import cumulative_histogram
from driftloom.plans import metrics as M


@query(
    "agg24_labelled_counters",
    "SELECT event_type AS level, user_id % 4 AS drift_type, count(*) AS total FROM events "
    "GROUP BY 1, 2",
)
def agg24(spark, sf):
    obs = table(spark, sf, "events").select(
        F.col("event_type").alias("level"), (F.col("user_id") % 4).alias("drift_type")
    )
    return M.counters(obs, ["level", "drift_type"])


@query(
    "agg24_pairs_synthesized",
    "SELECT l_returnflag AS status, round(sum(l_quantity), 6) AS total FROM lineitem GROUP BY 1",
)
def agg24_sum(spark, sf):
    obs = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("status"), "l_quantity")
    out = M.counters(obs, ["status"], "l_quantity")
    return out.select("status", F.round("total", 6).alias("total"))


@query(
    "agg25_latest_gauges",
    "SELECT event_type AS model_version, round(arg_max(value, ts), 6) AS current FROM events "
    "GROUP BY 1",
)
def agg25(spark, sf):
    obs = table(spark, sf, "events").select(
        F.col("event_type").alias("model_version"), "value", "ts", "event_id"
    )
    out = M.gauges(obs, ["model_version"], "value", ["ts", "event_id"])
    return out.select("model_version", F.round("current", 6).alias("current"))


def _bounds_sql(bounds):
    return "(VALUES " + ", ".join(f"({float(b)}e0)" for b in bounds) + ", (NULL)) AS b(le)"


@query(
    "agg26_duration_histogram",
    "SELECT o_orderpriority AS label, le, count(*) FILTER (WHERE le IS NULL OR o_totalprice / 30 "
    "<= le) AS cumulative, count(*) AS observations, round(sum(o_totalprice / 30), 6) AS total "
    f"FROM orders CROSS JOIN {_bounds_sql(HISTOGRAM_BOUNDS['training_cycle_duration_seconds'])} "
    "GROUP BY 1, 2",
)
def agg26(spark, sf):
    obs = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("label"), (F.col("o_totalprice") / 30).alias("seconds")
    )
    out = M.histogram(obs, "training_cycle_duration_seconds", "seconds", ["label"])
    return out.withColumn("total", F.round("total", 6))


@query(
    "agg26_promotion_histogram",
    "SELECT le, count(*) FILTER (WHERE le IS NULL OR value * 50 <= le) AS cumulative, count(*) AS "
    f"observations FROM events CROSS JOIN {_bounds_sql(HISTOGRAM_BOUNDS['promotion_duration_ms'])}"
    " GROUP BY 1",
)
def agg26_promotion(spark, sf):
    obs = table(spark, sf, "events").select((F.col("value") * 50).alias("ms"))
    return M.histogram(obs, "promotion_duration_ms", "ms").select(
        "le", "cumulative", "observations"
    )


def observations(spark, sf):
    """Three observations of each event: a counted one, a gauge's and a duration."""

    def seen(metric, kind, value):
        return F.struct(
            F.lit(metric).alias("metric"), F.lit(kind).alias("kind"),
            value.cast("double").alias("value"),
        )

    return table(spark, sf, "events").select(
        F.col("event_type").alias("label"), "ts", F.col("event_id").alias("seq"),
        F.inline(F.array(
            seen("drift_events_total", "counter", F.lit(1)),
            seen("anomaly_score", "gauge", F.col("value")),
            seen("promotion_duration_ms", "histogram", F.col("value") * 50),
        )),
    )


@query(
    "metrics_rollup",
    "SELECT 'drift_events_total' AS metric, 'counter' AS kind, event_type AS label, "
    "CAST(NULL AS DOUBLE) AS le, CAST(count(*) AS DOUBLE) AS value, count(*) AS observations "
    "FROM events GROUP BY event_type UNION ALL "
    "SELECT 'anomaly_score', 'gauge', event_type, NULL, round(arg_max(value, (ts, event_id)), 6), "
    "count(*) FILTER (WHERE value IS NOT NULL) FROM events GROUP BY event_type UNION ALL "
    "SELECT 'promotion_duration_ms', 'histogram', event_type, le, CAST(count(*) FILTER (WHERE le IS "
    "NULL OR value * 50 <= le) AS DOUBLE), count(*) FROM (SELECT * FROM events WHERE value IS NOT "
    f"NULL) CROSS JOIN {_bounds_sql(HISTOGRAM_BOUNDS['promotion_duration_ms'])} GROUP BY event_type, le",
)
def rollup(spark, sf):
    return M.metrics_rollup(observations(spark, sf)).withColumn("value", F.round("value", 6))


@query(
    "agg27_capture_p99",
    "SELECT event_type, observations, CASE WHEN observations = 0 THEN 0e0 ELSE bound END AS "
    "quantile FROM (SELECT event_type, max(n) AS observations, min(le) FILTER (WHERE cum >= "
    "ceil(n * 0.99e0)) AS bound FROM (SELECT event_type, le, count(*) FILTER (WHERE value * 1000 "
    "<= le) AS cum, count(*) AS n FROM events CROSS JOIN (VALUES "
    + ", ".join(f"({float(b)}e0)" for b in CAPTURE_LATENCY_NS)
    + ") AS b(le) GROUP BY 1, 2) GROUP BY 1)",
)
def agg27(spark, sf):
    obs = table(spark, sf, "events").select("event_type", (F.col("value") * 1000).alias("ns"))
    return M.capture_p99(obs, "ns", ["event_type"])


@query(
    "agg28_mean_latency",
    "SELECT event_type, round(coalesce(avg(CASE WHEN user_id % 5 > 0 THEN value END), 0e0), 10) AS "
    "mean_latency FROM events GROUP BY 1",
)
def agg28(spark, sf):
    obs = table(spark, sf, "events").select(
        "event_type", F.when(F.col("user_id") % 5 > 0, F.col("value")).alias("us")
    )
    out = M.mean_latency(obs, "us", ["event_type"])
    return out.select("event_type", F.round("mean_latency", 10).alias("mean_latency"))


@query(
    "agg29_capture_outcomes",
    "SELECT count(*) FILTER (WHERE c) AS captured, count(*) FILTER (WHERE NOT c) AS dropped, "
    "count(*) FILTER (WHERE c AND p) AS published, count(*) FILTER (WHERE c AND NOT p) AS errors "
    "FROM (SELECT event_id % 50 <> 0 AS c, user_id % 20 <> 0 AS p FROM events)",
)
def agg29(spark, sf):
    obs = table(spark, sf, "events")
    return M.capture_outcomes(obs, F.col("event_id") % 50 != 0, F.col("user_id") % 20 != 0)


@query(
    "str7_bucketed_counters",
    "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS bucket_us, event_type, count(*) AS "
    "total FROM events GROUP BY 1, 2",
)
def str7(spark, sf):
    obs = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    out = M.bucketed_counters(obs, "ts", "1 hour", ["event_type"])
    return out.select(micros("bucket_start").alias("bucket_us"), "event_type", "total")


@query(
    "agg26_capture_latency_histogram",
    "SELECT le, count(*) FILTER (WHERE le IS NULL OR value * 1000 <= le) AS cumulative FROM "
    f"events CROSS JOIN {_bounds_sql(CAPTURE_LATENCY_NS)} GROUP BY 1",
)
def agg26_capture(spark, sf):
    obs = table(spark, sf, "events").select((F.col("value") * 1000).alias("ns"))
    return cumulative_histogram(obs, "ns", CAPTURE_LATENCY_NS).select("le", "cumulative")
