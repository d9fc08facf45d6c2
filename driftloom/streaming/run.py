"""Runs a stream over everything that is there now, for backfills and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from driftloom.session import run_folder, stage

#: Rows of one file of a feed, which one task writes, and of one micro-batch of a feed by time.
FILE_ROWS = 125_000
BATCH_ROWS = 1_000_000


def table_stream(df: DataFrame, name: str = "feed") -> DataFrame:
    """Stream over the written rows of a batch table."""
    spark = df.sparkSession
    path = run_folder(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def dealt_stream(df: DataFrame, part: Column, parts: int, name: str = "feed", file_rows: int = FILE_ROWS) -> DataFrame:
    """Stream over the rows of a batch table, one micro-batch for each value of `part` from 0.

    The table is worked out once, by all tasks, and laid down by part. A part is then copied into the
    feed as the same number of files as every other, so a micro-batch of that many files is one part;
    a file is written by one task and gets about `file_rows` rows of the largest part.
    """
    spark = df.sparkSession
    laid, path = run_folder(spark, f"{name}-parts"), run_folder(spark, name)
    wanted = part.cast("int")
    df.withColumn("_part", wanted).filter(F.col("_part").between(0, parts - 1)).write.partitionBy("_part").parquet(laid)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(laid)
    sizes = {r["_part"]: r["count"] for r in rows.groupBy("_part").count().collect()}
    files = max(1, -(-max(sizes.values(), default=0) // file_rows))
    for i in range(parts):
        own = rows.filter(F.col("_part") == i).drop("_part")
        own.coalesce(files).write.mode("append").parquet(path)
        # A part of few blocks fills fewer files; files without rows make up the number.
        while len(spark.read.schema(df.schema).parquet(path).inputFiles()) < files * (i + 1):
            spark.createDataFrame([], df.schema).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("latestFirst", "false")
    return source.parquet(path)


def timed_parts(rows: DataFrame, ts: str, batch_rows: int = BATCH_ROWS, least: int = 1) -> tuple[Column, int]:
    """(part, number of parts): parts in the order of `ts`, of about `batch_rows` rows, `least` at least.

    Rows of one time stay together. Give it a written table: it is counted and its quantiles are taken.
    """
    parts = max(least, -(-rows.count() // batch_rows))
    if parts == 1:
        return F.lit(0), 1
    shares = F.array(*[F.lit((i + 1) / parts) for i in range(parts - 1)])
    found = rows.agg(F.percentile_approx(ts, shares, F.lit(max(10_000, 100 * parts)))).first()[0]
    cuts = sorted(set(found or []))
    if not cuts:
        return F.lit(0), 1
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col(ts))), len(cuts) + 1


def timed_stream(df: DataFrame, ts: str, name: str = "feed", batch_rows: int = BATCH_ROWS, least: int = 1) -> DataFrame:
    """Stream over the rows of a batch table in the order of `ts`, see `timed_parts`: what a
    micro-batch brings to one key does not grow with the table."""
    rows = stage(df, f"{name}-rows")
    return dealt_stream(rows, *timed_parts(rows, ts, batch_rows, least), name)


def drain(stream: DataFrame, name: str = "drained", folder: str | None = None) -> DataFrame:
    """Processes all available input and returns what was appended. Rows and progress are kept in
    `folder`, a new one if it is not given."""
    spark = stream.sparkSession
    path = folder or run_folder(spark, name)
    writer: DataStreamWriter = stream.writeStream.format("parquet").outputMode("append")
    query = (
        writer.option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
