"""Written tables below the shared folder: plans are cut there and survive lost executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftloom.session import run_folder

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
MOST_ROWS = 1000


class Scratch:
    """One run's folder; tables that later steps no longer read are dropped to free disk."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = run_folder(spark, name)
        self.made = 0
        # texts go to Python in small batches, so that their size bounds a task's memory
        if int(spark.conf.get(BATCH_ROWS)) not in range(1, MOST_ROWS + 1):
            spark.conf.set(BATCH_ROWS, str(MOST_ROWS))

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.root}/{name}-{self.made}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table and reads it back; the shuffle files behind it are freed at once."""
        path = self.path(name)
        old = self.spark.conf.get(FREE_SHUFFLES, "false")
        self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(FREE_SHUFFLES, old)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables made by `write`, through Spark's own file system layer."""
        for table in tables:
            for file in table.inputFiles()[:1]:
                self.drop_path(file.rsplit("/", 1)[0])

    def drop_path(self, path: str) -> None:
        """Deletes a folder of this run."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if self.root.rstrip("/").rsplit("/", 1)[-1] in folder.toString():
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def checked_broadcast(spark: SparkSession, value, size: int, most: int):
    """Broadcast variable of a value whose size in bytes was proven to be at most `most`."""
    if size > most:
        raise ValueError(f"{size} bytes are not to be broadcast, {most} are allowed")
    return spark.sparkContext.broadcast(value)
