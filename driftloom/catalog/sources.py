"""Message, training-set and keyed-table queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.catalog.fixtures import SIGNALS_SQL, micros, signals, table
from driftloom.catalog.registry import query
from driftloom.functions.signals import keep_sample
from driftloom.schemas import LINEAGE_NODE
from driftloom.session import run_folder, stage
from driftloom.sources import datasets as D
from driftloom.sources import signals as M
from driftloom.sources import tables as K


def raw_signals(spark, sf):
    """Signals in the full message schema, with spike and percentile structures."""
    s = signals(spark, sf)
    m = F.col("mean_logprob")
    spikes = F.transform(
        F.sequence(F.lit(1), F.col("n_spikes")),
        lambda i: F.struct(i.cast("long").alias("position"), F.lit(-12.0).alias("logprob")),
    )
    none = F.array().cast(T.ArrayType(T.StructType(
        [T.StructField("position", T.LongType()), T.StructField("logprob", T.DoubleType())])))
    return s.select(
        "request_id",
        (F.col("ts_us") * 1000).alias("timestamp_ns"),
        "model_version",
        "tenant_id",
        "input_token_count",
        "output_token_count",
        "mean_logprob",
        "min_logprob",
        "logprob_entropy_mean",
        "logprob_variance",
        F.when(F.col("n_spikes") > 0, spikes).otherwise(none).alias("token_uncertainty_spikes"),
        F.struct(
            (m - 0.5).alias("p10"), (m - 0.3).alias("p25"), m.alias("p50"), (m + 0.2).alias("p75"),
            (m + 0.4).alias("p90"), (m + 0.8).alias("p99"),
        ).alias("sequence_logprob_percentiles"),
    )


def messages(spark, sf):
    """Signal messages of which some are empty, cut short or lack a field."""
    good = M.encode_signals(raw_signals(spark, sf)).withColumn(
        "_id", F.get_json_object("value", "$.request_id").cast("long")
    )
    broken = (
        F.when(F.col("_id") % 50 == 7, F.lit(None).cast("string"))
        .when(F.col("_id") % 50 == 8, F.expr("substring(value, 1, length(value) - 9)"))
        .when(F.col("_id") % 50 == 9, F.lit('{"request_id": "x"}'))
        .otherwise(F.col("value"))
    )
    return good.select("key", "_id", broken.alias("value"))


@query(
    "src1_signal_stream_rejects",
    "SELECT event_type AS key, count(*) FILTER (WHERE event_id % 50 NOT IN (7, 8, 9)) AS decoded, "
    "count(*) FILTER (WHERE event_id % 50 IN (8, 9)) AS rejected FROM events GROUP BY 1",
)
def src1(spark, sf):
    # Both sides read the messages; written once, they are not built again for each.
    rows, bad = M.decode_signals(stage(messages(spark, sf), "messages"))
    both = rows.select(F.col("model_version").alias("key"), F.lit(True).alias("ok")).unionByName(
        bad.select("key", F.lit(False).alias("ok"))
    )
    return both.groupBy("key").agg(
        F.count_if("ok").alias("decoded"), F.count_if(~F.col("ok")).alias("rejected")
    )


@query(
    "src2_signal_codec",
    f"WITH {SIGNALS_SQL} SELECT request_id, ts_us, model_version, tenant_id, input_token_count, "
    "output_token_count, n_spikes, round(mean_logprob, 6) AS mean_logprob, "
    "round(mean_logprob - 0.5e0, 6) AS p10, round(mean_logprob + 0.8e0, 6) AS p99 FROM signals",
)
def src2(spark, sf):
    rows, _ = M.decode_signals(M.encode_signals(raw_signals(spark, sf)))
    return M.prepared(rows).select(
        "request_id", "ts_us", "model_version", "tenant_id", "input_token_count",
        "output_token_count",
        F.size("token_uncertainty_spikes").cast("long").alias("n_spikes"),
        F.round("mean_logprob", 6).alias("mean_logprob"),
        F.round("sequence_logprob_percentiles.p10", 6).alias("p10"),
        F.round("sequence_logprob_percentiles.p99", 6).alias("p99"),
    )


def event_messages(spark, sf):
    """Drift-event messages: one per event row, ids from its neighbourhood, mixed statuses."""
    e = table(spark, sf, "events").withColumnRenamed("event_id", "_id")
    n = F.col("_id") % 4
    ids = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: (F.col("_id") + i).cast("string"),
    )
    return e.select(
        F.concat(F.lit("e"), "_id").alias("event_id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(
            "detected_at"
        ),
        F.col("event_type").alias("model_version"),
        F.lit("CRITICAL").alias("alert_level"),
        F.lit("GRADUAL").alias("drift_type"),
        F.col("value").alias("composite_anomaly_score"),
        F.lit(None).cast(T.StructType([
            T.StructField(c, T.DoubleType()) for c in (
                "mean_logprob_zscore", "variance_zscore", "entropy_zscore",
                "spike_frequency_zscore")])).alias("signal_breakdown"),
        F.lit(1.0).alias("affected_request_fraction"),
        F.when(n > 0, ids).otherwise(F.array().cast("array<string>")).alias(
            "evidence_request_ids"
        ),
        F.when(F.col("user_id") % 3 == 0, "REJECTED").otherwise("QUALIFIED").alias(
            "qualification_status"
        ),
        F.lit(None).cast("string").alias("training_cycle_id"),
    )


EVIDENCE_SQL = """
evidence AS (
  SELECT 'e' || event_id AS event_id, event_type AS model_version,
         CAST(event_id + i AS VARCHAR) AS request_id
  FROM (SELECT *, unnest(range(1, 1 + event_id % 4)) AS i FROM events
        WHERE user_id % 3 <> 0 AND event_id % 4 > 0))
"""


@query(
    "src3_qualified_evidence",
    f"WITH {EVIDENCE_SQL} SELECT event_id, model_version, request_id FROM evidence",
)
def src3(spark, sf):
    rows, _ = M.decode_drift_events(M.encode_drift_events(event_messages(spark, sf)))
    return M.evidence_requests(rows).drop("detected_at")


@query(
    "jon2_evidence_failures",
    f"WITH {EVIDENCE_SQL} SELECT e.event_id, e.request_id, d.lang AS lang, "
    "d.doc_id IS NULL AS missing FROM evidence e LEFT JOIN documents d "
    "ON CAST(d.doc_id AS VARCHAR) = e.request_id",
)
def jon2(spark, sf):
    rows, _ = M.decode_drift_events(M.encode_drift_events(event_messages(spark, sf)))
    asked = M.evidence_requests(rows).select("event_id", "request_id")
    requests = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("request_id"), "lang"
    )
    found = M.evidence_failures(asked, stage(requests, "requests"))
    return found.select("event_id", "request_id", "lang", "missing")


def loose_failures(spark, sf):
    c = table(spark, sf, "conversations")
    return c.select(
        F.when(F.col("turn") % 2 == 0, F.concat_ws("-", "conv_id", "turn")).alias("request_id"),
        F.when(F.col("role") != "system", F.col("text")).alias("prompt"),
        F.col("role").alias("response"),
        F.when(F.col("turn") % 3 == 0, (-F.col("turn")).cast("string"))
        .when(F.col("turn") % 3 == 1, F.lit("n/a"))
        .alias("mean_logprob"),
        F.when(F.col("conv_id") % 2 == 0, F.lit("2026-03-28T00:00:00Z")).alias("timestamp"),
    )


@query(
    "src4_failure_ingest",
    "SELECT role AS response, CASE WHEN turn % 2 = 0 THEN conv_id || '-' || turn END AS given_id, "
    "CASE WHEN turn % 3 = 0 THEN -CAST(turn AS DOUBLE) ELSE 0e0 END AS mean_logprob, "
    "CASE WHEN conv_id % 2 = 0 THEN '2026-03-28T00:00:00Z' ELSE '' END AS timestamp "
    "FROM conversations WHERE role <> 'system' AND turn % 3 <> 1",
)
def src4(spark, sf):
    rows, _ = D.failure_records(loose_failures(spark, sf))
    given = F.when(F.length("request_id") < 64, F.col("request_id"))
    return rows.select("response", given.alias("given_id"), "mean_logprob", "timestamp")


def turns(spark, sf):
    """User prompts with the assistant response right after them."""
    c = table(spark, sf, "conversations")
    user = c.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")
    )
    reply = c.filter("role = 'assistant'").select(
        "conv_id", "turn", F.col("text").alias("response")
    )
    return user.join(reply, ["conv_id", "turn"])


TURNS_SQL = """
turns AS (
  SELECT u.conv_id, u.turn + 1 AS turn, u.text AS prompt, a.text AS response
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
"""


def sft_lines(spark, sf):
    """Training lines with blank lines and lines that lack a field among them."""
    body = F.to_json(F.struct("prompt", "response"))
    return turns(spark, sf).select(
        F.when(F.col("conv_id") % 10 == 3, F.lit("  \t "))
        .when(F.col("conv_id") % 10 == 4, F.to_json(F.struct("prompt")))
        .otherwise(body)
        .alias("value")
    )


@query(
    "src5_sft_rows",
    f"WITH {TURNS_SQL} SELECT prompt, response, '<|im_start|>user' || chr(10) || prompt || "
    "'<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || response || '<|im_end|>' "
    "AS text FROM turns WHERE conv_id % 10 NOT IN (3, 4)",
)
def src5(spark, sf):
    return D.sft_rows(sft_lines(spark, sf))[0]


@query(
    "src5_sft_rejects",
    f"WITH {TURNS_SQL} SELECT count(*) AS rejected FROM turns WHERE conv_id % 10 = 4",
)
def src5_rejects(spark, sf):
    return D.sft_rows(sft_lines(spark, sf))[1].agg(F.count(F.lit(1)).alias("rejected"))


@query(
    "src6_dpo_rows",
    f"WITH {TURNS_SQL} SELECT prompt, response AS chosen, 'no: ' || prompt AS rejected "
    "FROM turns WHERE conv_id % 10 <> 4",
)
def src6(spark, sf):
    t = turns(spark, sf).withColumns(
        {"chosen": F.col("response"), "rejected": F.concat(F.lit("no: "), "prompt")}
    )
    lines = t.select(
        F.when(F.col("conv_id") % 10 == 4, F.to_json(F.struct("prompt", "chosen")))
        .otherwise(F.to_json(F.struct("prompt", "chosen", "rejected")))
        .alias("value")
    )
    return D.dpo_rows(lines)[0]


def checkpoint_log(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat(F.lit("c"), "l_orderkey").alias("cycle_id"),
        (F.col("l_linenumber") * 100).cast("long").alias("step"),
        F.when(F.col("l_returnflag") == "R", "dpo").otherwise("sft").alias("phase"),
        F.col("l_discount").alias("train_loss"),
        F.col("l_tax").alias("eval_loss"),
        F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd").alias("timestamp"),
        "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus",
    )


CKPT_ORDER = ["timestamp", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
              "l_returnflag", "l_linestatus", "train_loss", "eval_loss"]
CKPT_SQL = """
ckpt AS (
  SELECT 'c' || l_orderkey AS cycle_id, CAST(l_linenumber * 100 AS BIGINT) AS step,
         CASE WHEN l_returnflag = 'R' THEN 'dpo' ELSE 'sft' END AS phase,
         l_discount AS train_loss, l_tax AS eval_loss,
         strftime(l_shipdate, '%Y-%m-%d') AS timestamp, l_partkey, l_suppkey, l_quantity,
         l_extendedprice, l_returnflag, l_linestatus
  FROM lineitem),
saved AS (
  SELECT * FROM ckpt QUALIFY row_number() OVER (PARTITION BY cycle_id, step, phase ORDER BY
    timestamp DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC,
    l_returnflag DESC, l_linestatus DESC, train_loss DESC, eval_loss DESC) = 1)
"""
CKPT_COLS = ["cycle_id", "step", "phase", "train_loss", "eval_loss", "timestamp"]


def saved_checkpoints(spark, sf):
    return K.checkpoints(checkpoint_log(spark, sf), CKPT_ORDER).select(*CKPT_COLS)


@query(
    "snk7_checkpoint_save",
    f"WITH {CKPT_SQL} SELECT {', '.join(CKPT_COLS)} FROM saved",
)
def snk7(spark, sf):
    return saved_checkpoints(spark, sf)


@query(
    "src7_checkpoint_scan",
    f"WITH {CKPT_SQL} SELECT cycle_id, count(*) AS checkpoints, min(step) AS first_step, "
    "max(step) AS last_step FROM saved GROUP BY 1",
)
def src7(spark, sf):
    from driftloom.schemas import CHECKPOINT

    files = saved_checkpoints(spark, sf).select(F.to_json(F.struct(*CKPT_COLS)).alias("value"))
    rows, _ = M.decode(files, CHECKPOINT, ["cycle_id", "step"])
    return rows.groupBy("cycle_id").agg(
        F.count(F.lit(1)).alias("checkpoints"), F.min("step").alias("first_step"),
        F.max("step").alias("last_step"),
    )


def lineage_log(spark, sf):
    """Adapter rows as written over time: every part twice, the later write on top."""
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    states = F.array(*[F.lit(s) for s in STATES])
    rows = p.select(
        F.concat(F.lit("a"), key).alias("adapter_id"),
        F.concat(F.lit("v"), key).alias("version"),
        F.col("p_brand").alias("base_model_id"),
        F.concat(F.lit("c"), key).alias("training_cycle_id"),
        F.concat(F.lit("2024-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0")).alias(
            "created_at"
        ),
        F.element_at(states, (F.col("p_size") % 6 + 1).cast("int")).alias("status"),
        F.when(key >= 2, F.concat(F.lit("a"), F.floor(key / 2))).alias("parent_adapter_id"),
        F.concat(F.lit("["), key % 10, F.lit(", "), key % 7, F.lit("]")).alias(
            "target_failure_cluster_ids"
        ),
        F.concat(
            F.lit('{"accuracy": '), F.col("p_size"), F.lit(', "'), F.col("p_type"),
            F.lit('": '), (F.col("p_retailprice") * 10).cast("long"), F.lit("}"),
        ).alias("evaluation_scores"),
        F.when(key % 3 == 1, F.concat(F.lit('{"cost_usd": '), F.col("p_size"), F.lit(".5}")))
        .when(key % 3 == 2, F.lit('{"note": "manual"}'))
        .alias("deployment_record"),
    )
    first = rows.withColumns({"status": F.lit("CANDIDATE"), "seq": F.lit(0)})
    return first.unionByName(rows.withColumn("seq", F.lit(1)))


STATES = ["CANDIDATE", "STAGING", "PROMOTING", "PRODUCTION", "SUPERSEDED", "ROLLED_BACK"]
NODES_SQL = """
nodes AS (
  SELECT 'a' || p_partkey AS adapter_id, 'v' || p_partkey AS version, p_brand AS base_model_id,
         'c' || p_partkey AS training_cycle_id,
         '2024-01-' || lpad(CAST(p_partkey % 28 + 1 AS VARCHAR), 2, '0') AS created_at,
         ['CANDIDATE', 'STAGING', 'PROMOTING', 'PRODUCTION', 'SUPERSEDED', 'ROLLED_BACK']
           [p_size % 6 + 1] AS status,
         CASE WHEN p_partkey >= 2 THEN 'a' || (p_partkey // 2) END AS parent_adapter_id,
         '[' || (p_partkey % 10) || ', ' || (p_partkey % 7) || ']' AS target_failure_cluster_ids,
         '{"accuracy": ' || p_size || ', "' || p_type || '": '
           || CAST(trunc(p_retailprice * 10) AS BIGINT) || '}' AS evaluation_scores,
         CASE WHEN p_partkey % 3 = 1 THEN '{"cost_usd": ' || p_size || '.5}'
              WHEN p_partkey % 3 = 2 THEN '{"note": "manual"}' END AS deployment_record,
         p_partkey, p_size, p_type, CAST(trunc(p_retailprice * 10) AS BIGINT) AS price
  FROM part)
"""


def nodes(spark, sf):
    return K.lineage_nodes(lineage_log(spark, sf)).drop("seq")


NODE_COLS = LINEAGE_NODE.fieldNames()


@query("snk5_lineage_upsert", f"WITH {NODES_SQL} SELECT {', '.join(NODE_COLS)} FROM nodes")
def snk5(spark, sf):
    return nodes(spark, sf).select(*NODE_COLS)


@query(
    "snk5_edge_upsert",
    "SELECT l_suppkey AS parent_id, l_partkey AS child_id, max_by(l_returnflag, o) AS "
    "improvement_target, max_by(l_extendedprice, o) AS cost_usd FROM (SELECT *, "
    "{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_extendedprice, "
    "'e': l_returnflag} AS o FROM lineitem) GROUP BY 1, 2",
)
def snk5_edges(spark, sf):
    log = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("parent_id"), F.col("l_partkey").alias("child_id"),
        F.col("l_returnflag").alias("improvement_target"),
        F.col("l_extendedprice").alias("cost_usd"), "l_shipdate", "l_orderkey", "l_linenumber",
    )
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "cost_usd", "improvement_target"]
    return K.lineage_edges(log, order).select(
        "parent_id", "child_id", "improvement_target", "cost_usd"
    )


@query(
    "snk6_status_update",
    f"WITH {NODES_SQL} SELECT adapter_id, CASE WHEN p_partkey % 11 = 0 THEN 'ROLLED_BACK' "
    "ELSE status END AS status FROM nodes",
)
def snk6(spark, sf):
    n = nodes(spark, sf)
    late = table(spark, sf, "part").filter(F.col("p_partkey") % 11 == 0).select(
        F.concat(F.lit("a"), "p_partkey").alias("adapter_id"),
        F.explode(F.array(
            F.struct(F.lit(1).alias("seq"), F.lit("STAGING").alias("status")),
            F.struct(F.lit(2).alias("seq"), F.lit("ROLLED_BACK").alias("status")),
        )).alias("u"),
    ).select("adapter_id", "u.*")
    unknown = table(spark, sf, "supplier").select(
        F.concat(F.lit("x"), "s_suppkey").alias("adapter_id"), F.lit(1).alias("seq"),
        F.lit("PRODUCTION").alias("status"),
    )
    return K.updated_status(n, late.unionByName(unknown)).select("adapter_id", "status")


@query(
    "src8_lineage_decode",
    f"WITH {NODES_SQL} SELECT adapter_id, CAST(p_partkey % 10 AS INTEGER) AS first_cluster, "
    "CAST(p_size AS DOUBLE) AS accuracy, CASE WHEN p_partkey % 3 = 1 THEN p_size || '.5' END AS "
    "cost, CAST(2 AS BIGINT) AS benchmarks FROM nodes",
)
def src8(spark, sf):
    return K.decode_lineage(nodes(spark, sf)).select(
        "adapter_id",
        F.element_at("target_failure_cluster_ids", 1).alias("first_cluster"),
        F.col("evaluation_scores")["accuracy"].alias("accuracy"),
        F.try_element_at("deployment_record", F.lit("cost_usd")).alias("cost"),
        F.size("evaluation_scores").cast("long").alias("benchmarks"),
    )


@query(
    "snk1_drift_event_messages",
    "SELECT event_type AS key, 'e' || event_id AS event_id, CASE WHEN user_id % 3 = 0 THEN "
    "'REJECTED' ELSE 'QUALIFIED' END AS status, CAST(event_id % 4 AS BIGINT) AS n_ids FROM events",
)
def snk1(spark, sf):
    out = M.encode_drift_events(event_messages(spark, sf))
    ids = F.from_json(F.get_json_object("value", "$.evidence_request_ids"), "array<string>")
    return out.select(
        "key",
        F.get_json_object("value", "$.event_id").alias("event_id"),
        F.get_json_object("value", "$.qualification_status").alias("status"),
        F.size(ids).cast("long").alias("n_ids"),
    )


def judged_turns(spark, sf):
    return turns(spark, sf).select(
        "prompt", F.col("response").alias("chosen"),
        F.concat(F.lit("no: "), "prompt").alias("rejected"),
        (F.col("conv_id") % 3 != 0).alias("passed_gate"),
    )


@query(
    "snk2_sft_output",
    f"WITH {TURNS_SQL} SELECT prompt, response FROM turns WHERE conv_id % 3 <> 0",
)
def snk2(spark, sf):
    path, _ = D.write_training_sets(judged_turns(spark, sf), run_folder(spark, "sets"), "job-1")
    return D.load_sft(spark, path).select("prompt", "response")


@query(
    "snk3_dpo_output",
    f"WITH {TURNS_SQL} SELECT prompt, response AS chosen, 'no: ' || prompt AS rejected "
    "FROM turns WHERE conv_id % 3 <> 0",
)
def snk3(spark, sf):
    _, path = D.write_training_sets(judged_turns(spark, sf), run_folder(spark, "sets"), "job-1")
    return D.load_dpo(spark, path)


@query(
    "set3_passing_pairs",
    f"WITH {TURNS_SQL} SELECT prompt, response AS chosen, conv_id % 2 AS job FROM turns "
    "WHERE conv_id % 3 <> 0",
)
def set3(spark, sf):
    t = turns(spark, sf)
    jobs = [
        t.filter(F.col("conv_id") % 2 == j).select(
            "prompt", F.col("response").alias("chosen"), F.lit(j).cast("long").alias("job"),
            (F.col("conv_id") % 3 != 0).alias("passed_gate"))
        for j in (0, 1)
    ]
    return jobs[0].unionByName(jobs[1]).filter("passed_gate").drop("passed_gate")


@query(
    "snk4_training_events",
    "SELECT 'c' || o_orderkey AS cycle_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'DRIFT' "
    "WHEN o_orderpriority = '2-HIGH' THEN 'SCHEDULE' ELSE 'MANUAL' END AS triggered_by, "
    "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS "
    "status, CASE WHEN o_orderstatus = 'F' THEN 'adapters/' || o_orderkey END AS "
    "candidate_adapter_id, round(o_totalprice, 6) AS cost_usd FROM orders",
)
def snk4(spark, sf):
    o = table(spark, sf, "orders")
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    cycles = o.select(
        F.concat(F.lit("c"), "o_orderkey").alias("cycle_id"),
        F.when(pr == "1-URGENT", "DRIFT").when(pr == "2-HIGH", "SCHEDULE").otherwise(pr).alias(
            "triggered_by"
        ),
        F.lit(None).cast("string").alias("trigger_event_id"),
        F.col("o_orderdate").cast("string").alias("started_at"),
        F.when(st == "F", "COMPLETED").when(st == "O", "RUNNING").otherwise("FAILED").alias("status"),
        F.lit("base").alias("base_adapter_id"),
        F.concat(F.lit("adapters/"), "o_orderkey").alias("candidate_adapter_id"),
        F.round("o_totalprice", 6).alias("cost_usd"),
        F.lit(0.0).alias("gpu_hours"),
        F.lit(None).cast("string").alias("completed_at"),
    )
    return K.training_events(cycles).select(
        "cycle_id", "triggered_by", "status", "candidate_adapter_id", "cost_usd"
    )


@query(
    "snk8_cost_records",
    "SELECT l_returnflag AS component, count(*) FILTER (WHERE l_extendedprice / 1000 - 5 >= 0) AS "
    "accepted, count(*) FILTER (WHERE l_extendedprice / 1000 - 5 < 0) AS rejected "
    "FROM lineitem GROUP BY 1",
)
def snk8(spark, sf):
    costs = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("component"),
        (F.col("l_extendedprice") / 1000 - 5).alias("amount_usd"),
    )
    good, bad = K.valid_costs(costs)
    return (
        good.withColumn("ok", F.lit(True)).unionByName(bad.withColumn("ok", F.lit(False)))
        .groupBy("component")
        .agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))
    )


@query(
    "smp1_sampling_by_id",
    "SELECT event_type, count(*) AS kept FROM events WHERE event_id % 100 < 50 GROUP BY 1",
)
def smp1(spark, sf):
    e = table(spark, sf, "events").filter(F.col("event_id") % 100 < 50)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


@query(
    "smp1_sampling_gate",
    "SELECT TRUE AS repeatable, TRUE AS near_half, count(*) AS events FROM events",
)
def smp1_gate(spark, sf):
    """The hashed gate keeps the same half of all events each time."""
    e = table(spark, sf, "events").select(
        keep_sample(F.col("event_id").cast("string"), 0.5).alias("a"),
        keep_sample(F.col("event_id").cast("string"), 0.5).alias("b"),
    )
    return e.agg(
        F.every(F.col("a") == F.col("b")).alias("repeatable"),
        (F.abs(F.avg(F.col("a").cast("int")) - 0.5) < 0.05).alias("near_half"),
        F.count(F.lit(1)).alias("events"),
    )
