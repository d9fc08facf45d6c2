from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from driftloom.catalog.audit import alerts
from driftloom.catalog.fixtures import CFG, signals
from driftloom.operators.greedy import alert_budget
from driftloom.plans import drift
from driftloom.plans.drift import NARROW
from driftloom.streaming.alerting import alert_stream, drift_event_stream
from driftloom.streaming.dispatch import budget_stream, counter_stream, handoff_to_synthesis
from driftloom.streaming.scoring import once, score_stream

SF = "/root/testdata/sf0.001"
SMALL = replace(CFG, calibration_events=50)


def run(df, path, mode="append"):
    q = (
        df.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{path}/out")


def in_files(df, path, n, order="ts_us"):
    """Writes df as n files in order, so that state crosses micro-batches."""
    rows = df.count()
    ranked = df.withColumn("_i", F.row_number().over(__import__("pyspark").sql.Window.orderBy(order)))
    for i in range(n):
        part = ranked.filter(
            (F.col("_i") > i * rows // n) & (F.col("_i") <= (i + 1) * rows // n)
        ).drop("_i")
        part.coalesce(1).write.mode("append").parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option(
        "latestFirst", "false"
    ).parquet(path)


@pytest.fixture(scope="module")
def scored_table(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("stream"))
    src = in_files(signals(spark, SF).select(*NARROW), f"{base}/in", 4)
    return run(score_stream(once(src), SMALL), f"{base}/scored")


def test_scores_match_batch(spark, scored_table):
    batch = drift.adaptive_scores(signals(spark, SF).select(*NARROW), cfg=SMALL)
    cols = ["request_id", F.round("composite", 9).alias("c"), "dominant_dimension"]
    a, b = batch.select(*cols), scored_table.filter("not late").select(*cols)
    assert a.count() == b.count() == 500
    assert a.exceptAll(b).count() == 0


def test_levels_and_events_match_batch(spark, scored_table, tmp_path):
    scored = scored_table.drop("late")
    leveled = drift.with_alert_level(scored, SMALL)
    want = drift.drift_events(leveled, SMALL)
    src = in_files(scored_table, f"{tmp_path}/in", 3)
    got = run(drift_event_stream(src, SMALL), f"{tmp_path}/events")
    cols = ["event_id", "alert_level", "drift_type", "affected_request_fraction",
            "evidence_request_ids"]
    assert want.count() == got.count() > 0
    assert want.select(*cols).exceptAll(got.select(*cols)).count() == 0
    src = spark.readStream.schema(scored_table.schema).parquet(f"{tmp_path}/in")
    levels = run(alert_stream(src, SMALL), f"{tmp_path}/levels")
    pair = ["request_id", "alert_level"]
    assert leveled.select(*pair).exceptAll(levels.select(*pair)).count() == 0


def test_late_rows_are_kept_apart(spark, tmp_path):
    s = signals(spark, SF).select(*NARROW)
    top = s.agg(F.max("ts_us")).first()[0]
    early, rest = s.filter(F.col("ts_us") <= top - 10**9), s.filter(F.col("ts_us") > top - 10**9)
    path = f"{tmp_path}/in"
    rest.coalesce(1).write.mode("append").parquet(path)
    early.limit(5).coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = run(score_stream(src, SMALL), f"{tmp_path}/o")
    keys = rest.select("model_version", "tenant_id").distinct()
    expected = early.limit(5).join(keys, ["model_version", "tenant_id"], "left_semi").count()
    assert out.filter("late").count() == expected


def test_budget_stream_matches_batch(spark, tmp_path):
    a = alerts(spark, SF)
    got = run(budget_stream(in_files(a, f"{tmp_path}/in", 3)), f"{tmp_path}/o")
    want = alert_budget(a).select("alert_id", "dispatched")
    assert want.exceptAll(got.select("alert_id", "dispatched")).count() == 0


def test_counter_stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type"
    )
    src = in_files(e, f"{tmp_path}/in", 3, "ts")
    got = run(counter_stream(src, "ts", ["event_type"], "1 hour"), f"{tmp_path}/o")
    last = got.agg(F.max("bucket_start")).first()[0]
    want = e.filter(F.date_trunc("hour", "ts") <= F.lit(last)).groupBy(
        F.date_trunc("hour", "ts").alias("bucket_start"), "event_type"
    ).agg(F.count(F.lit(1)).alias("total"))
    assert want.count() > 100
    assert want.exceptAll(got.select("bucket_start", "event_type", "total")).count() == 0


def test_handoff_runs_once_per_batch(spark, tmp_path):
    from driftloom.catalog.sources import event_messages
    from driftloom.sources.signals import decode_drift_events, encode_drift_events

    events, _ = decode_drift_events(encode_drift_events(event_messages(spark, SF)))
    src = in_files(events, f"{tmp_path}/in", 2, "event_id")
    requests = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").cast("string").alias("request_id"), "text"
    )
    jobs = []
    q = handoff_to_synthesis(
        src, requests, lambda f, job: jobs.append((job, f.count())), f"{tmp_path}/cp"
    ).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(jobs) == 2 and len({j for j, _ in jobs}) == 2
    assert all(0 < n <= requests.count() for _, n in jobs)


def test_replayed_batch_adds_nothing(spark, tmp_path):
    from driftloom.catalog.sources import messages
    from driftloom.streaming.ingest import commits, committed, ingest_batch

    rows = messages(spark, SF).select("key", "value")
    folder = f"{tmp_path}/tables"
    ingest_batch(rows, 0, folder, 10**9)
    first = {n: committed(spark, folder, n).count() for n in ("signals", "rejects", "late")}
    assert first["late"] == 0 and first["rejects"] > 0
    ingest_batch(rows.limit(3), 0, folder, 10**9)  # the same batch again, whatever it holds
    spark.read.parquet(f"{folder}/signals/batch=0").limit(9).write.parquet(f"{folder}/signals/batch=7")  # not committed
    assert {n: committed(spark, folder, n).count() for n in first} == first
    ingest_batch(rows, 1, folder, 10**9)
    late = committed(spark, folder, "late").count()
    assert late > 0
    assert committed(spark, folder, "signals").count() + late == 2 * first["signals"]
    assert [r.batch for r in commits(spark, folder).orderBy("batch").collect()] == [0, 1]


def test_events_are_released_in_order(spark, tmp_path):
    """Shuffled rows over several micro-batches give each key's order; nothing waits at the end."""
    from driftloom.catalog.streams import key_order

    got = key_order(signals(spark, SF))
    rows = got.select("model_version", "tenant_id", "ts_us", "request_id", "position").collect()
    assert len(rows) == 1000
    by_key = {}
    for r in sorted(rows, key=lambda r: (r.ts_us, r.request_id)):
        by_key.setdefault((r.model_version, r.tenant_id), []).append(r.position)
    assert all(p == list(range(len(p))) for p in by_key.values())


def test_alert_state_does_not_grow_with_the_rate(spark, tmp_path):
    """20 000 rows in 20 seconds leave 21 ticks and 499 rows of evidence; silence frees the windows."""
    from driftloom.config import DIMENSIONS
    from driftloom.streaming.run import dealt_stream

    rows = spark.range(20_000).selectExpr(
        "cast(id as string) as request_id", "1700000000000000 + id * 1000 as ts_us", "'m' as model_version",
        "'t' as tenant_id", *[f"0.0D as z_{d}" for d in DIMENSIONS], "3.0D + (id % 3) / 10.0D as composite", "false as late",
    )
    later = rows.limit(1).withColumns(
        {"request_id": F.lit("x"), "model_version": F.lit("other"), "ts_us": F.col("ts_us") + 9_000_000_000}
    )
    both = rows.withColumn("_at", F.floor(F.col("request_id").cast("long") / 4000)).unionByName(later.withColumn("_at", F.lit(5)))
    feed = dealt_stream(both, F.col("_at"), 6).drop("_at")

    def held(path):
        state = spark.read.format("statestore").load(path).filter("key.model_version = 'm'")
        value = "value.groupState." if "groupState" in state.schema["value"].dataType.fieldNames() else "value."
        return state.select(*[F.size(value + c) for c in ("w_tick", "e_id")], value + "seen").first()

    q = (
        alert_stream(feed, SMALL).writeStream.format("parquet").outputMode("append").option("path", f"{tmp_path}/o")
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/o")
    assert out.count() == 20_001
    first = spark.read.format("statestore").option("batchId", 4).load(f"{tmp_path}/cp").filter("key.model_version = 'm'")
    name = "value.groupState." if "groupState" in first.schema["value"].dataType.fieldNames() else "value."
    assert tuple(first.select(*[F.size(name + c) for c in ("w_tick", "e_id")], name + "seen").first()) == (20, 499, 20_000)
    assert tuple(held(f"{tmp_path}/cp")) == (0, 499, 20_000)
    want = drift.with_alert_level(rows.drop("late"), SMALL).select("request_id", "alert_level")
    got = out.filter("model_version = 'm'").select("request_id", "alert_level")
    assert want.exceptAll(got).count() == 0


def test_feeds_bring_bounded_batches(spark):
    """A part is one micro-batch of any number of files, and a key's batch does not grow with the table."""
    from driftloom.streaming.run import dealt_stream, timed_stream

    rows = spark.range(1000).withColumn("ts", F.col("id") * F.col("id"))

    def batches(feed):
        seen = []
        each = feed.writeStream.foreachBatch(lambda b, _: seen.append(sorted(r["id"] for r in b.collect())))
        each.trigger(availableNow=True).start().awaitTermination()
        return [b for b in seen if b]

    part = F.when(F.col("id") < 900, 0).otherwise(2)
    feed = dealt_stream(rows, part, 3, file_rows=300)
    assert batches(feed) == [list(range(900)), list(range(900, 1000))]
    timed = batches(timed_stream(rows, "ts", batch_rows=100))
    assert sum(timed, []) == list(range(1000)) and max(map(len, timed)) <= 110


def test_rows_reach_the_ordered_scorer_in_bundles(spark):
    """Rows of a partition travel as a few binary cells, each of one key, and come out as they were."""
    from collections import Counter

    from driftloom.config import DIMENSIONS
    from driftloom.streaming.ordered import BUNDLED, bundled, rows_of

    rows = spark.range(0, 30_000, 1, 1).selectExpr(
        "cast(id as string) as request_id", "id * 7 % 1000 as ts_us", "nullif(concat('m', id % 3), 'm2') as model_version",
        "concat('t', id % 2) as tenant_id", *[f"cast(id as double) as {d}" for d in DIMENSIONS],
    )
    found = rows.mapInArrow(bundled, BUNDLED).collect()
    assert len(found) <= 12  # at most two of each of six keys
    got = Counter()
    for r in found:
        for x in rows_of([bytes(r.bundle)]).to_pylist():
            got[(x["request_id"], x["ts_us"], r.model_version, r.tenant_id, x[DIMENSIONS[0]], x[DIMENSIONS[4]])] += 1
    assert got == Counter(tuple(r[:6]) for r in rows.drop(*DIMENSIONS[1:4]).select(
        "request_id", "ts_us", "model_version", "tenant_id", DIMENSIONS[0], DIMENSIONS[4]).collect())


def test_rows_of_null_keys_wait_and_are_released(spark, tmp_path):
    """What waits is kept over micro-batches as bundles, for null keys too."""
    from driftloom.config import DIMENSIONS
    from driftloom.streaming.ordered import ordered_scores, rocksdb_state

    rows = spark.range(0, 600, 1, 1).selectExpr(
        "cast(id as string) as request_id", "1700000000000000 + id * 1000000 as ts_us", "nullif(concat('m', id % 2), 'm1') as model_version",
        "'t' as tenant_id", *[f"cast(id % 13 as double) as {d}" for d in DIMENSIONS],
    )
    last = rows.limit(1).withColumns({"request_id": F.lit("end"), "model_version": F.lit("end"), "ts_us": F.lit(1_700_009_000_000_000)})
    src = in_files(rows.unionAll(last), f"{tmp_path}/in", 4)
    with rocksdb_state(spark):
        got = run(ordered_scores(src, SMALL, "3 minutes"), f"{tmp_path}/o").filter("request_id <> 'end'").collect()
    assert len(got) == 600
    assert all(r.position == int(r.request_id) // 2 for r in got)
    waited = spark.read.format("statestore").option("path", f"{tmp_path}/o/cp").option("batchId", 1).option("operatorId", 0).option(
        "stateVarName", "waiting").load()
    assert waited.count() == 2  # one bundle of each key


def test_feed_parts_are_written_by_many_tasks(spark):
    from driftloom.streaming.run import dealt_stream

    feed = dealt_stream(spark.range(0, 400_000, 1, 8), F.col("id") % 2, 2)
    seen = []
    each = feed.writeStream.foreachBatch(lambda b, _: seen.append((b.select(F.input_file_name()).distinct().count(), b.count())))
    each.trigger(availableNow=True).start().awaitTermination()
    assert [n for _, n in seen if n] == [200_000, 200_000] and min(f for f, n in seen if n) > 1


def test_levels_do_not_depend_on_the_number_of_rows(spark, tmp_path):
    """Window means that hover at a threshold, over 12 000 times in an hour, as of the batch job; null tenants too."""
    from driftloom.config import DIMENSIONS

    rows = spark.range(0, 24_000, 1, 1).selectExpr(
        "cast(id as string) as request_id", "1700000000123000 + (id div 2) * 300000 as ts_us", "'m' as model_version",
        "if(id % 2 = 0, 't', null) as tenant_id", *[f"0.0D as z_{d}" for d in DIMENSIONS],
        "2.0D + pmod(xxhash64(id), 2001) / 1000.0D as composite", "false as late",
    )
    got = run(alert_stream(in_files(rows, f"{tmp_path}/in", 5), SMALL), f"{tmp_path}/o").select("request_id", "alert_level")
    want = drift.with_alert_level(rows.drop("late"), SMALL).select("request_id", "alert_level")
    assert want.groupBy("alert_level").count().count() > 1
    assert want.exceptAll(got).count() == 0
