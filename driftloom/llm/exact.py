"""Exact deduplication as a stream with keyed state that never expires.

A written table of the rows (part, row, doc_id, digest, source; one file for each part) is both the
feed and the content store. The stream reads the narrow columns. Its state, kept by RocksDB on disk
and saved to the shared folder, has one entry per digest: the stable identifier to keep (the
largest doc_id so far), the content locator (part and row) of its text, and how many rows came.
Every micro-batch writes the entries it changed to a table of its own, overwritten if it reruns.

A hit, a row whose digest the state has already, is checked on full bytes: its text is compared
with the text behind the locator. The text of a hot digest is copied once for every `share_rows`
of its rows, so no task gets a whole group. Rows of digests for which a check fails (two texts, one
digest) are grouped by their texts instead.

Texts are equal when identical after `normal` (nothing by default); null counts as empty. A null
doc_id ranks below all others; ties go to the row written first. Repeated rows are copies of each
other: one stays. Other columns, whatever their names, travel in one struct and come back as they
were. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftloom.llm.scratch import Scratch
from driftloom.session import broadcast_if_small

#: Tables of at most so many short rows may be broadcast.
SMALL_ROWS = 200_000
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


@contextmanager
def _settings(spark, values: dict[str, str]):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _state(scratch: Scratch, feed: DataFrame) -> DataFrame:
    """The last entry of each digest: (digest, best, n)."""
    spark = scratch.spark
    entries = feed.groupBy("digest").agg(
        F.max(F.struct(
            F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rank"), (-F.col("row")).alias("first"),
            "doc_id", "part", "row",
        )).alias("best"),
        F.count(F.lit(1)).alias("n"),
    )
    changed, progress = scratch.path("changed"), scratch.path("progress")
    spark.createDataFrame([], entries.schema).write.parquet(f"{changed}/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changed}/batch={number}")

    with _settings(spark, STATE):
        run = (
            entries.writeStream.outputMode("update").foreachBatch(put)
            .option("checkpointLocation", progress).trigger(availableNow=True).start()
        )
        run.awaitTermination()
    # counts only grow, so the entry with the most rows is the last one
    seen = spark.read.schema(entries.schema).parquet(changed)
    last = seen.groupBy("digest").agg(F.max(F.struct("n", "best")).alias("e"))
    state = scratch.write(last.select("digest", "e.best", "e.n"), "state")
    scratch.drop_path(progress)
    scratch.drop_path(changed)
    return state


class ExactDedup:
    """Decides over the rows of docs (doc_id, text, ...) once; see `decisions` and `kept`."""

    def __init__(
        self,
        docs: DataFrame,
        normal: Callable[[Column], Column] = lambda c: c,
        digest: Callable[[Column], Column] = lambda c: F.sha2(c, 256),
        share_rows: int = 1000,
        files_per_batch: int = 64,
    ):
        spark = docs.sparkSession
        self.normal, self.share_rows = normal, share_rows
        self.scratch = scratch = Scratch(spark, "exact")
        rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            digest(self._content("text")).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
            F.spark_partition_id().alias("part"),
            F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("source"),
        )
        path = scratch.path("store")
        rows.write.parquet(path)
        schema: StructType = rows.schema
        self.store = spark.read.schema(schema).parquet(path)
        feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
        state = _state(scratch, feed.select("doc_id", "digest", "row", "part"))
        self.hits = scratch.write(state.where("n > 1"), "hits")
        self.mixed = self._mixed()

    def _content(self, column) -> Column:
        return self.normal(F.coalesce(F.col(column).cast("string"), F.lit("")))

    def _mixed(self) -> DataFrame:
        """Digests under which there is more than one text: full bytes of every hit are compared."""
        hits = self.hits.select(
            "digest", F.col("best.part").alias("at_part"), F.col("best.row").alias("at_row"),
            F.ceil(F.col("n") / self.share_rows).cast("int").alias("shares"),
        )
        small = broadcast_if_small(hits, SMALL_ROWS)
        found = self.store.join(small, "digest").select(
            "digest", "row", "part", "at_row", "at_part", "shares", self._content("source.text").alias("content")
        )
        located = found.where("row = at_row and part = at_part").select(
            "digest", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
            F.col("content").alias("held"),
        )
        hit = found.where("row != at_row").withColumn("share", F.pmod("row", "shares").cast("int"))
        differ = hit.join(located, ["digest", "share"]).where("content != held")
        return self.scratch.write(differ.select("digest").distinct(), "mixed")

    def decisions(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, digest, row) of every row."""
        narrow = self.store.select("doc_id", "digest", "row")
        state = self.hits.select(
            "digest", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n"
        ).join(self.mixed, "digest", "left_anti")
        clean = narrow if self.mixed.isEmpty() else narrow.join(self.mixed, "digest", "left_anti")
        clean = clean.join(broadcast_if_small(self.scratch.write(state, "clean"), SMALL_ROWS), "digest", "left")
        out = clean.select(
            "doc_id",
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).alias("group_size"),
            (F.col("n").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
            "digest", "row",
        )
        if self.mixed.isEmpty():
            return out
        texts = self.store.join(self.mixed, "digest").select(
            "doc_id", "digest", "row", self._content("source.text").alias("content")
        )
        rank = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("rank"), (-F.col("row")).alias("first"), "doc_id", "row")
        groups = texts.groupBy("digest", "content").agg(F.max(rank).alias("best"), F.count(F.lit(1)).alias("n"))
        apart = texts.join(groups, ["digest", "content"]).select(
            "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
            (F.col("row") == F.col("best.row")).alias("kept"), "digest", "row",
        )
        return out.unionAll(apart)

    def kept(self) -> DataFrame:
        """The rows that stay, with the columns of docs."""
        gone = self.scratch.write(self.decisions().where("not kept").select("row"), "gone")
        return self.store.join(broadcast_if_small(gone, SMALL_ROWS), "row", "left_anti").select("source.*")
