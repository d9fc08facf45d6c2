"""Session defaults and the two places where a plan is cut or checked."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frees the shuffle files behind a written table at once.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "driftloom", master: str | None = None, **conf) -> SparkSession:
    """Session with UTC time, adaptive plans and Arrow; `conf` keys use `_` for `.`."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    defaults.update({k.replace("_", "."): str(v) for k, v in conf.items()})
    for k, v in defaults.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Reliable folder of the cluster; a local one only where none is set (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    made = tempfile.mkdtemp(prefix="driftloom-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Cuts a plan reliably: loops go on from here, also after executor loss.

    A written table, as `stage` makes, knows its real size. A checkpoint keeps the estimate of the
    plan it came from, and estimates of joins are products, so over the rounds of a loop they grow to
    numbers of millions of digits. Checkpoints are left for what a table cannot hold.
    """
    if all(f.dataType != T.NullType() for f in df.schema) and len(set(map(str.lower, df.columns))) == len(df.columns):
        return stage(df, "cut")
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes a table to the shared folder and reads it back: later steps read only the columns
    they need, and do not repeat the work behind them."""
    spark = df.sparkSession
    path = run_folder(spark, name)
    old = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, old)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more, through Spark's own file system layer."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
            if folder.getParent().toUri().getPath().rstrip("/") == root.toUri().getPath().rstrip("/"):
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint behind a row count; a larger table is joined by shuffling instead.

    Give it a written table: its count comes from the file footers.
    """
    return F.broadcast(df) if df.count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a handful of files over all cores; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < min(cores, 64) else df


def run_folder(spark: SparkSession, name: str) -> str:
    """New subfolder path below the shared folder."""
    import uuid

    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
