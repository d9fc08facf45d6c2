"""Queries that run as streams over the given tables, and hooks with side effects."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog.accounting import TYPES
from driftloom.catalog.audit import ALERTS_SQL, BUDGET_SQL, alerts
from driftloom.catalog.drift import (
    ADAPTIVE_SQL, EVENT_SQL, EVENTS_SQL, Z, _event_columns, _leveled, r6, r6_sql,
)
from driftloom.catalog.evaluation import SUMS_SQL, sums
from driftloom.catalog.fixtures import CFG, micros, signals, table
from driftloom.catalog.registry import query
from driftloom.catalog.sources import (
    EVIDENCE_SQL, TURNS_SQL, event_messages, judged_turns, messages, turns,
)
from driftloom.plans import accounting as A
from driftloom.plans.alerts import dispatch_alerts
from driftloom.plans.datasets import prepare_preference_set, prepare_training_set
from driftloom.plans.drift import NARROW, drift_event_columns
from driftloom.plans.evaluation import improvement_results
from driftloom.session import run_folder, stage
from driftloom.sources import signals as M
from driftloom.sources.datasets import write_training_sets
from driftloom.streaming.alerting import alert_stream
from driftloom.streaming.dispatch import budget_stream, counter_stream, handoff_to_synthesis
from driftloom.streaming.ingest import committed, ingest
from driftloom.streaming.ordered import ordered_scores, rocksdb_state, stored_baselines
from driftloom.streaming.run import dealt_stream, drain, table_stream, timed_parts, timed_stream
from driftloom.streaming.scoring import once, score_stream


def streamed_scores(spark, sf):
    feed = timed_stream(signals(spark, sf).select(*NARROW), "ts_us")
    return drain(score_stream(once(feed), CFG))


@query(
    "str1_streamed_scores",
    f"{ADAPTIVE_SQL} SELECT request_id, {r6_sql('composite', *Z)} FROM scored",
)
def str1_streamed(spark, sf):
    return streamed_scores(spark, sf).filter("not late").select("request_id", *r6("composite", *Z))


def scored_feed(spark, sf):
    """Scored rows as a stream of five micro-batches or more in the order of time."""
    rows = streamed_scores(spark, sf)
    return dealt_stream(rows, *timed_parts(rows, "ts_us", least=5))


@query(
    "str2_streamed_levels",
    f"{ADAPTIVE_SQL}, {_leveled('scored')} SELECT request_id, alert_level FROM leveled",
)
def str2_streamed(spark, sf):
    rows = drain(alert_stream(scored_feed(spark, sf), CFG))
    return rows.select("request_id", "alert_level")


@query("str3_streamed_events", EVENTS_SQL + EVENT_SQL)
def str3_streamed(spark, sf):
    rows = drain(alert_stream(scored_feed(spark, sf), CFG)).filter("qualified")
    return _event_columns(rows.select(*drift_event_columns(CFG), "request_id"))


HOUR_US = 3_600_000_000
END = "end of the feed"


def out_of_order(rows, parts, jitter_us, delay_us):
    """Rows dealt to `parts` micro-batches or more by time plus up to `jitter_us`; a last batch of one
    marker row moves the watermark past all of them."""
    at = F.col("ts_us") + F.xxhash64("request_id") % (jitter_us // 2) + jitter_us // 2
    timed = stage(rows.withColumn("_time", at), "jittered")
    part, parts = timed_parts(timed, "_time", least=parts)
    high = timed.agg(F.max("ts_us")).first()[0]
    marker = timed.limit(1).withColumns(
        {"request_id": F.lit(END), "model_version": F.lit(END), "ts_us": F.lit(high + delay_us + HOUR_US)}
    )
    both = timed.withColumn("_at", part.cast("int")).unionByName(marker.withColumn("_at", F.lit(parts))).drop("_time")
    return dealt_stream(both, F.col("_at"), parts + 1).drop("_at")


def key_order(rows):
    feed = out_of_order(rows.select(*NARROW), 5, 6 * HOUR_US, 12 * HOUR_US)
    with rocksdb_state(rows.sparkSession):
        return drain(ordered_scores(feed, CFG, "12 hours")).filter(F.col("model_version") != END)


@query(
    "str8_key_order",
    f"{ADAPTIVE_SQL} SELECT o.request_id, row_number() OVER (PARTITION BY o.model_version, o.tenant_id ORDER BY "
    f"o.ts_us, o.request_id) - 1 AS position, {r6_sql('composite', *Z)} FROM ordered o LEFT JOIN scored USING (request_id)",
)
def str8(spark, sf):
    return key_order(signals(spark, sf)).select("request_id", "position", *r6("composite", *Z))


@query(
    "str1_restarted_scores",
    f"{ADAPTIVE_SQL} SELECT request_id, {r6_sql('composite', *Z)} FROM scored",
)
def str1_restarted(spark, sf):
    """A stream over half of the time, its state as a snapshot, and a new stream from there."""
    rows = signals(spark, sf).select(*NARROW)
    low, high = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    early = F.col("ts_us") <= (low + high) // 2
    out, snapshot = None, None
    for half in (rows.filter(early), rows.filter(~early)):
        folder = run_folder(spark, "restarted")
        feed = out_of_order(half, 3, 6 * HOUR_US, 12 * HOUR_US)
        with rocksdb_state(spark):
            done = drain(ordered_scores(feed, CFG, "12 hours", snapshot), folder=folder)
        snapshot = stored_baselines(spark, f"{folder}/progress")
        out = done if out is None else out.unionAll(done)
    scored = out.filter(F.col("composite").isNotNull() & (F.col("model_version") != END))
    return scored.select("request_id", *r6("composite", *Z))


@query(
    "src1_stream_tables",
    "WITH m AS (SELECT event_id, epoch_us(ts) AS t, epoch_us(ts) + CASE WHEN event_id % 10 = 0 THEN 259200000000 ELSE 0 END "
    "AS sent FROM events WHERE event_id % 50 <> 7), p AS (SELECT *, event_id % 50 IN (8, 9) AS bad, (sent - (SELECT min(t) FROM m)) "
    "// ((SELECT max(sent) FROM m) // 5 - (SELECT min(t) FROM m) // 5 + 1) AS batch FROM m), n AS (SELECT batch, max(max(t) FILTER "
    "(NOT bad)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM p GROUP BY batch) "
    "SELECT CASE WHEN bad THEN 'rejects' WHEN t < newest - 86400000000 THEN 'late' ELSE 'signals' END AS table_name, batch, "
    "count(*) AS n, CAST(sum(event_id) FILTER (NOT bad) AS BIGINT) AS ids FROM p JOIN n USING (batch) GROUP BY 1, 2",
)
def src1_tables(spark, sf):
    """Messages in five micro-batches, one in ten three days behind, as signals, rejects and late rows."""
    held = F.when(F.col("_id") % 10 == 0, 72 * HOUR_US).otherwise(0)
    at = signals(spark, sf).select(F.col("event_id").alias("_id"), "ts_us").withColumn("at", F.col("ts_us") + held)
    at = at.filter("_id % 50 <> 7")
    sent = messages(spark, sf).join(at, "_id")
    low, high = at.agg(F.min("ts_us"), F.max("at")).first()
    part = F.floor((F.col("at") - low) / (high // 5 - low // 5 + 1))
    folder = run_folder(spark, "ingested")
    feed = dealt_stream(sent.select("key", "value", part.alias("_at")), F.col("_at"), 5).drop("_at")
    ingest(feed, folder, f"{folder}/progress", 24 * HOUR_US).trigger(availableNow=True).start().awaitTermination()
    out = None
    for name in ("signals", "rejects", "late"):
        rows = committed(spark, folder, name)
        ids = F.sum(F.col("request_id").cast("long")) if name != "rejects" else F.lit(None).cast("long")
        rows = rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), ids.alias("ids"))
        rows = rows.select(F.lit(name).alias("table_name"), "batch", "n", "ids")
        out = rows if out is None else out.unionAll(rows)
    return out


@query(
    "str6_streamed_alert_budget",
    f"WITH RECURSIVE {ALERTS_SQL}, {BUDGET_SQL} SELECT alert_id, level, dispatched FROM budget",
)
def str6_streamed(spark, sf):
    rows = drain(budget_stream(table_stream(alerts(spark, sf))))
    return rows.select("alert_id", "level", "dispatched")


@query(
    "str7_streamed_counters",
    "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS bucket_us, event_type, count(*) AS total FROM events GROUP BY 1, 2",
)
def str7_streamed(spark, sf):
    """All buckets of five micro-batches; a marker after the last one closes the open buckets."""
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    low, high = e.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - low) / ((high - low) // 5 + 1))
    marker = spark.range(1).select(F.timestamp_micros(F.lit(high + 2 * HOUR_US)).alias("ts"), F.lit(END).alias("event_type"))
    both = e.withColumn("_at", part).unionByName(marker.withColumn("_at", F.lit(5).cast("long")))
    feed = dealt_stream(both, F.col("_at"), 6).drop("_at")
    rows = drain(counter_stream(feed, "ts", ["event_type"], "1 hour")).filter(F.col("event_type") != END)
    return rows.select(micros("bucket_start").alias("bucket_us"), "event_type", "total")


@query(
    "str5_synthesis_handoff",
    f"WITH {EVIDENCE_SQL} SELECT DISTINCT e.request_id, lang FROM evidence e JOIN documents "
    "ON CAST(doc_id AS VARCHAR) = e.request_id",
)
def str5(spark, sf):
    """Failures handed to the synthesis jobs of all batches of qualified events."""
    events, _ = M.decode_drift_events(M.encode_drift_events(event_messages(spark, sf)))
    requests = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("request_id"), "lang"
    )
    path = run_folder(spark, "handoff")
    writer = handoff_to_synthesis(
        table_stream(events), requests,
        lambda failures, job: failures.write.mode("overwrite").parquet(f"{path}/jobs/job={job}"),
        f"{path}/progress",
    )
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/jobs").select("request_id", "lang").distinct()


@query(
    "udf5_pairwise_judge",
    f"WITH {SUMS_SQL}, v AS (SELECT adapter_id, CASE WHEN prompt_id % 3 = 0 THEN 'A' WHEN "
    "prompt_id % 3 = 1 THEN 'B' ELSE 'TIE' END AS verdict FROM sums) SELECT adapter_id, "
    "round(count(*) FILTER (WHERE verdict = 'A') / CAST(count(*) AS DOUBLE), 6) AS "
    "candidate_win_rate, round(count(*) FILTER (WHERE verdict = 'B') / CAST(count(*) AS DOUBLE), "
    "6) AS production_win_rate FROM v GROUP BY 1",
)
def udf5(spark, sf):
    n = F.col("prompt_id") % 3
    verdict = F.when(n == 0, "A").when(n == 1, "B").otherwise("TIE")
    out = improvement_results(sums(spark, sf), verdict=verdict)
    return out.select(
        "adapter_id", F.round("candidate_win_rate", 6).alias("candidate_win_rate"),
        F.round("production_win_rate", 6).alias("production_win_rate"),
    )


@query(
    "udf6_alert_channels",
    f"WITH RECURSIVE {ALERTS_SQL}, {BUDGET_SQL} SELECT alert_id, level FROM budget "
    "WHERE dispatched",
)
def udf6(spark, sf):
    """What a working channel got although the one before it failed."""
    path = run_folder(spark, "channel")

    def broken(sent):
        raise ConnectionError("channel is down")

    dispatch_alerts(alerts(spark, sf), [broken, lambda sent: sent.write.parquet(path)])
    return spark.read.parquet(path).select("alert_id", "level")


@query(
    "prepare_training_set",
    f"WITH {TURNS_SQL}, t AS (SELECT length(prompt) + length(response) + 60 AS n FROM turns) "
    "SELECT count(*) AS total_records, count(*) AS split_records, min(n) AS min_text_length, "
    "max(n) AS max_text_length FROM t",
)
def prepare(spark, sf):
    """Sets written as JSON lines, loaded back, split and validated."""
    path = run_folder(spark, "sft")
    turns(spark, sf).select("prompt", "response").write.json(path)
    train, held, stats = prepare_training_set(spark, path)
    both = train.unionByName(held)
    n = F.char_length("text").cast("long")
    return both.agg(
        F.lit(stats["total_records"]).cast("long").alias("total_records"),
        F.count(F.lit(1)).alias("split_records"), F.min(n).alias("min_text_length"),
        F.max(n).alias("max_text_length"),
    )


@query(
    "prepare_preference_set",
    f"WITH {TURNS_SQL}, t AS (SELECT prompt, response AS chosen, 'no: ' || prompt AS rejected FROM turns WHERE conv_id % 3 <> 0), "
    "c AS (SELECT unnest(['prompt', 'chosen', 'rejected']) AS name, unnest([prompt, chosen, rejected]) AS text FROM t) "
    "SELECT name, count(*) AS total_records, (SELECT count(*) FROM t) AS split_records, max(length(text)) AS max_text_length, "
    "round(avg(length(text)), 6) AS avg_text_length FROM c GROUP BY 1",
)
def prepare_preferences(spark, sf):
    """Preference pairs written by the sink, loaded back, split and validated."""
    _, path = write_training_sets(judged_turns(spark, sf), run_folder(spark, "dpo"), "job-1")
    train, held, stats = prepare_preference_set(spark, path)
    split = train.unionByName(held).count()
    rows = [(k, v["total_records"], v["max_text_length"], v["avg_text_length"]) for k, v in stats.items()]
    found = spark.createDataFrame(rows, "name string, total_records long, max_text_length long, avg_text_length double")
    return found.withColumns({"split_records": F.lit(split).cast("long"), "avg_text_length": F.round("avg_text_length", 6)})


@query(
    "jon11_price_catalogue",
    "WITH prices(instance_type, usd) AS (VALUES ('A100-80GB', 4.10e0), ('A100-40GB', 3.06e0), "
    "('H100-80GB', 8.50e0), ('V100-16GB', 2.48e0), ('T4-16GB', 0.53e0)) SELECT l_orderkey, "
    "round(sum(coalesce(usd, 4.10e0)), 6) AS hourly_usd FROM (SELECT l_orderkey, ['A100-80GB', "
    "'A100-40GB', 'H100-80GB', 'V100-16GB', 'T4-16GB', 'L4-24GB'][l_partkey % 6 + 1] AS "
    "instance_type FROM lineitem) LEFT JOIN prices USING (instance_type) GROUP BY 1",
)
def jon11(spark, sf):
    types = F.array(*[F.lit(t) for t in TYPES])
    asked = table(spark, sf, "lineitem").select(
        "l_orderkey", F.element_at(types, (F.col("l_partkey") % 6 + 1).cast("int")).alias(
            "instance_type")
    )
    return A.spot_caps(asked).groupBy("l_orderkey").agg(
        F.round(F.sum("on_demand_usd"), 6).alias("hourly_usd")
    )
