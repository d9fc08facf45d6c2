"""Signal and drift-event messages: decoding, rejects, encoding, Kafka options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.config import TOPICS
from driftloom.functions.signals import with_dimensions
from driftloom.operators.timeline import whole_part
from driftloom.schemas import DRIFT_EVENT, SIGNAL
from driftloom.session import broadcast_if_small

#: Requests are an id and the few columns asked of them, some 100 bytes.
BROADCAST_REQUESTS = 200_000
REQUIRED = [f.name for f in SIGNAL.fields]


def kafka_stream(
    spark: SparkSession, servers: str, topic: str = TOPICS["signals"], per_trigger: int = 1_000_000
) -> DataFrame:
    """Stream of message values; needs the Kafka connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", per_trigger)
        .load()
        .select(F.col("key").cast("string"), F.col("value").cast("string"))
    )


def complete(value: Column, schema: T.StructType, required: list[str]) -> Column:
    """The parsed message in an array of one, or an empty array when it is unusable.

    The array keeps the parser to one call per row.
    """

    def filled(r: Column) -> Column:
        ok = r.isNotNull()
        for name in required:
            ok = ok & r[name].isNotNull()
        return ok

    return F.filter(F.array(F.from_json(value, schema)), filled)


def decode(messages: DataFrame, schema: T.StructType, required: list[str], value: str = "value"):
    """(rows, rejects) of JSON messages. Null messages are skipped, bad ones are kept apart."""
    given = messages.filter(F.col(value).isNotNull())
    parsed = complete(F.col(value), schema, required)
    return given.select(F.inline(parsed)), given.filter(F.size(parsed) == 0)


def decode_signals(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(signals, rejects); every field of a signal is required."""
    return decode(messages, SIGNAL, REQUIRED, value)


def prepared(signals: DataFrame) -> DataFrame:
    """Decoded signals with event time in micros and the derived dimension."""
    return with_dimensions(signals).withColumn(
        "ts_us", whole_part(F.col("timestamp_ns"), 1000)
    )


def encode_signals(signals: DataFrame) -> DataFrame:
    """Signals as messages keyed by model version."""
    body = F.to_json(F.struct(*[F.col(n) for n in REQUIRED]))
    return signals.select(F.col("model_version").alias("key"), body.alias("value"))


def encode_drift_events(events: DataFrame) -> DataFrame:
    """Drift events as messages; the key keeps the events of one model in order."""
    body = F.to_json(
        F.struct(*[F.col(f.name) for f in DRIFT_EVENT.fields]), {"ignoreNullFields": "false"}
    )
    return events.select(F.col("model_version").alias("key"), body.alias("value"))


def decode_drift_events(messages: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    return decode(messages, DRIFT_EVENT, ["event_id", "qualification_status"], value)


def evidence_requests(events: DataFrame) -> DataFrame:
    """One row per evidence id of every qualified event; events without ids vanish."""
    return events.filter(F.col("qualification_status") == "QUALIFIED").select(
        "event_id", "model_version", "detected_at",
        F.explode("evidence_request_ids").alias("request_id"),
    )


def evidence_failures(asked: DataFrame, requests: DataFrame) -> DataFrame:
    """Each asked evidence id with the requests found under it, or once with `missing` true.

    One join, of which `asked`, the side that grows with the events, is never the built one. Give it a
    written table of requests: it is counted, and while it is small nothing is shuffled or sorted.
    """
    known = broadcast_if_small(requests.withColumn("missing", F.lit(False)), BROADCAST_REQUESTS)
    return asked.join(known, "request_id", "left").withColumn("missing", F.coalesce("missing", F.lit(True)))
