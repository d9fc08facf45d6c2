"""Null keys, odd values and repeated updates leave no row behind."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.operators.folds import ordered_fold
from driftloom.operators.timeline import trailing_means
from driftloom.sources.tables import updated_status


@pytest.mark.parametrize("fold_rows", [30, 100_000])
def test_fold_keeps_null_and_odd_keys(spark, fold_rows):
    def _count(rows, start):
        seen = [start["n"] + i + 1 for i in range(len(rows))]
        return {"place": seen}, {"n": seen[-1]}

    df = spark.range(400).select(
        F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit(7)).cast("long").alias("k"),
        F.when(F.col("id") % 4 < 2, F.lit(None)).otherwise(F.lit("\x00")).alias("s"),
        (F.col("id") * 1_000_000).alias("ts_us"), "id",
    )
    state = T.StructType([T.StructField("n", T.LongType())])
    added = T.StructType([T.StructField("place", T.LongType())])
    out = ordered_fold(df, ["k", "s"], ["ts_us", "id"], _count, {"n": 0}, state, added, fold_rows)
    got = {(r["k"], r["s"]): (r["n"], r["m"]) for r in out.groupBy("k", "s").agg(
        F.count(F.lit(1)).alias("n"), F.max("place").alias("m")).collect()}
    assert got == {(k, s): (100, 100) for k in (None, 7) for s in (None, "\x00")}


def test_means_skip_nan_and_keep_large_values(spark):
    rows = [("a", 0, "1", 5e15), ("a", 1, "2", float("nan")), ("a", 2, "3", 1.0), ("b", 0, "4", float("inf"))]
    df = spark.createDataFrame(rows, "k string, t long, request_id string, x double").withColumn("ts_us", F.col("t") * 1_000_000)
    got = {r["request_id"]: r["avg_m"] for r in trailing_means(df, ["k"], "x", {"m": 60}).collect()}
    assert got["1"] == 5e15 and got["2"] == 5e15 and got["3"] == (5e15 + 1) / 2 and got["4"] is None


def test_last_update_wins(spark):
    nodes = spark.createDataFrame([("a", "NEW"), ("b", "NEW")], "adapter_id string, status string")
    updates = spark.createDataFrame([("a", 2, "P"), ("a", 1, "Q"), ("z", 1, "P")], "adapter_id string, seq int, status string")
    got = sorted(tuple(r) for r in updated_status(nodes, updates).collect())
    assert got == [("a", "P"), ("b", "NEW")]


@pytest.mark.parametrize("fold_rows", [900, 100_000])
def test_fold_hands_over_parts_of_a_chunk(spark, fold_rows):
    """A step gets no more rows at a time than an Arrow batch holds, however large its key is."""

    def step(rows, start):
        seen = [*start["seen"], len(rows)][-3:]
        return {"most": [max(seen)] * len(rows), "place": [start["n"] + i for i in range(1, len(rows) + 1)]}, {
            "n": start["n"] + len(rows), "seen": seen}

    state = T.StructType([T.StructField("n", T.LongType()), T.StructField("seen", T.ArrayType(T.LongType()))])
    added = T.StructType([T.StructField("most", T.LongType()), T.StructField("place", T.LongType())])
    df = spark.range(2000).select((F.col("id") % 2).alias("k"), (F.col("id") * 1_000_000).alias("ts_us"), "id")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        out = ordered_fold(df, ["k"], ["ts_us", "id"], step, {"n": 0, "seen": []}, state, added, fold_rows)
        got = sorted((r["id"], r["place"], r["most"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert [g[:2] for g in got] == [(i, i // 2 + 1) for i in range(2000)]
    assert max(g[2] for g in got) <= 64
