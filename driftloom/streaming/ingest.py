"""Signal messages of a stream as three tables: signals, rejects and late rows.

Each micro-batch writes its part of every table into a folder of its own number and then one commit
row. Readers see committed parts only, and a batch that is run again replaces its parts, so replays
add nothing. A row is late when its event time is older than the newest one of all batches before
it, minus the delay; that time is taken from the commits, so it survives restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from driftloom.session import broadcast_if_small
from driftloom.sources.signals import decode_signals, prepared

TABLES = ("signals", "rejects", "late")
MOST_COMMITS = 1_000_000
COMMIT = "batch long, newest_us long, signals long, rejects long, late long"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each finished micro-batch."""
    if not _exists(spark, f"{folder}/commits"):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).parquet(f"{folder}/commits/*")


def ingest_batch(batch: DataFrame, number: int, folder: str, delay_us: int) -> None:
    """Writes one micro-batch of messages (key, value) and commits it."""
    spark = batch.sparkSession
    done = commits(spark, folder)
    if not done.filter(F.col("batch") == number).isEmpty():
        return
    newest = done.filter(F.col("batch") < number).agg(F.max("newest_us")).first()[0]
    batch = batch.persist()
    try:
        rows, rejects = decode_signals(batch)
        rows = prepared(rows)
        late = F.lit(False) if newest is None else F.col("ts_us") < newest - delay_us
        parts = {"signals": rows.filter(~late), "rejects": rejects, "late": rows.filter(late)}
        counts = []
        for name in TABLES:
            path = f"{folder}/{name}/batch={number}"
            parts[name].write.mode("overwrite").parquet(path)
            counts.append(spark.read.schema(parts[name].schema).parquet(path).count())
        top = rows.agg(F.max("ts_us")).first()[0]
        top = max((x for x in (top, newest) if x is not None), default=None)
        commit = spark.createDataFrame([(number, top, *counts)], COMMIT)
        commit.coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/batch={number}")
    finally:
        batch.unpersist()


def ingest(messages: DataFrame, folder: str, checkpoint: str, delay_us: int = 600_000_000) -> DataStreamWriter:
    """Writer of a stream of messages into the three tables below `folder`."""
    return messages.writeStream.foreachBatch(
        lambda batch, number: ingest_batch(batch, number, folder, delay_us)
    ).option("checkpointLocation", checkpoint)


def committed(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of one of the tables, with the number of their `batch`."""
    rows = spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}/batch=*")
    rows = rows.withColumn("batch", F.col("batch").cast("long"))
    done = broadcast_if_small(commits(spark, folder).select("batch"), MOST_COMMITS)
    return rows.join(done, "batch", "left_semi")
