"""Failure records and training sets as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.text import chat_text, strip
from driftloom.schemas import DPO_ROW, FAILURE_ROW, SFT_ROW
from driftloom.sources.signals import complete


def failure_records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of loosely filled failure rows (all columns strings).

    A missing id is a digest of the row, a missing log-probability 0.0, a missing timestamp
    empty. Rows without prompt or response, or with a non-numeric log-probability, are rejects.
    """
    number = F.col("mean_logprob").try_cast("double")
    good = (
        F.col("prompt").isNotNull()
        & F.col("response").isNotNull()
        & (F.col("mean_logprob").isNull() | number.isNotNull())
    )
    digest = F.sha2(F.to_json(F.struct(*[f.name for f in FAILURE_ROW.fields])), 256)
    records = raw.filter(good).select(
        F.coalesce("request_id", digest).alias("request_id"),
        "prompt",
        "response",
        F.coalesce(number, F.lit(0.0)).alias("mean_logprob"),
        F.coalesce("timestamp", F.lit("")).alias("timestamp"),
    )
    return records, raw.filter(~good)


def parse_lines(lines: DataFrame, schema: T.StructType, value: str = "value"):
    """(rows, rejects) of JSON lines; blank lines are skipped, incomplete rows rejected."""
    filled = lines.filter(strip(F.col(value)) != "")
    parsed = complete(F.col(value), schema, schema.fieldNames())
    return filled.select(F.inline(parsed)), filled.filter(F.size(parsed) == 0)


def sft_rows(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """({prompt, response, text}, rejects): supervised rows with their chat text."""
    rows, bad = parse_lines(lines, SFT_ROW, value)
    return rows.withColumn("text", chat_text(F.col("prompt"), F.col("response"))), bad


def dpo_rows(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """({prompt, chosen, rejected}, rejects): preference rows."""
    return parse_lines(lines, DPO_ROW, value)


def _strict(rows: DataFrame, bad: DataFrame, path: str) -> DataFrame:
    first = bad.head(1)
    if first:
        raise ValueError(f"incomplete record in {path}: {first[0].value[:200]}")
    return rows


def load_sft(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    rows, bad = sft_rows(spark.read.text(path))
    return _strict(rows, bad, path) if strict else rows


def load_dpo(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    rows, bad = dpo_rows(spark.read.text(path))
    return _strict(rows, bad, path) if strict else rows


def sft_output(pairs: DataFrame) -> DataFrame:
    return pairs.filter("passed_gate").select("prompt", F.col("chosen").alias("response"))


def dpo_output(pairs: DataFrame) -> DataFrame:
    return pairs.filter("passed_gate").select("prompt", "chosen", "rejected")


def write_training_sets(pairs: DataFrame, folder: str, job_id: str) -> tuple[str, str]:
    """Writes both sets below folder/job_id; the same job id overwrites its earlier run."""
    sft, dpo = f"{folder}/{job_id}/sft_data.jsonl", f"{folder}/{job_id}/dpo_data.jsonl"
    sft_output(pairs).write.mode("overwrite").json(sft)
    dpo_output(pairs).write.mode("overwrite").json(dpo)
    return sft, dpo
