"""Training-set preparation: load, split, validate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.config import TrainingConfig
from driftloom.operators.timeline import ranked
from driftloom.sources.datasets import load_dpo, load_sft

CFG = TrainingConfig()
SLOTS = 1_000_000


def split_by_hash(
    df: DataFrame, columns: list[str], eval_fraction: float = CFG.eval_fraction, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, eval) by a hash threshold: no order, no shuffle, repeatable."""
    slot = F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(SLOTS))
    is_eval = slot < int(round(eval_fraction * SLOTS))
    return df.filter(~is_eval), df.filter(is_eval)


def split_exact(
    df: DataFrame, id_col: str, eval_fraction: float = CFG.eval_fraction, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """(train, eval) with exactly ceil(n*fraction) evaluation rows; `id_col` is unique."""
    slot = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(SLOTS))
    placed = ranked(df.withColumn("_slot", slot), [], ["_slot", id_col], "_slot", 100, "_rn")
    n = df.count()
    wanted = -(-int(round(n * eval_fraction * 1_000_000)) // 1_000_000)
    out = placed.withColumn("_eval", F.col("_rn") < wanted).drop("_slot", "_rn")
    return out.filter(~F.col("_eval")).drop("_eval"), out.filter("_eval").drop("_eval")


def dataset_stats(df: DataFrame, text: str = "text", group: list[str] = []) -> DataFrame:
    n = F.char_length(text)
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.avg(n).alias("avg_text_length"),
        F.min(n).cast("long").alias("min_text_length"),
        F.max(n).cast("long").alias("max_text_length"),
        F.count_if(n == 0).alias("empty_records"),
    )


def validate_dataset(df: DataFrame, text: str = "text") -> dict:
    """Statistics as a dict; raises on an empty set or empty records."""
    stats = dataset_stats(df, text).first().asDict()
    if stats["total_records"] == 0:
        raise ValueError("dataset is empty")
    if stats["empty_records"]:
        raise ValueError(f"dataset has {stats['empty_records']} empty records")
    return stats


def prepare_training_set(
    spark: SparkSession, path: str, eval_fraction: float = CFG.eval_fraction
) -> tuple[DataFrame, DataFrame, dict]:
    """(train, eval, statistics) of a supervised JSON-lines set."""
    rows = load_sft(spark, path)
    train, held = split_by_hash(rows, ["prompt", "response"], eval_fraction)
    return train, held, validate_dataset(rows)


def prepare_preference_set(
    spark: SparkSession, path: str, eval_fraction: float = CFG.eval_fraction
) -> tuple[DataFrame, DataFrame, dict]:
    """(train, eval, statistics by column) of a JSON-lines set of preference pairs.

    Incomplete records, an empty set and empty prompts or answers raise, as for supervised sets.
    """
    rows = load_dpo(spark, path)
    columns = ["prompt", "chosen", "rejected"]
    train, held = split_by_hash(rows, columns, eval_fraction)
    texts = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("text")) for c in columns])))
    stats = {r["name"]: {k: v for k, v in r.asDict().items() if k != "name"} for r in dataset_stats(texts, group=["name"]).collect()}
    if not stats:
        raise ValueError("dataset is empty")
    for name, found in stats.items():
        if found["empty_records"]:
            raise ValueError(f"dataset has {found['empty_records']} empty values of {name}")
    return train, held, stats
