"""The corpus pipeline: documents without toxic ones and copies, mixed by source and packed.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again
as the docs of the next one. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.exact import ExactDedup
from driftloom.llm.jaccard import jaccard_groups, row_key
from driftloom.llm.mixing import emitted
from driftloom.llm.packing import pack
from driftloom.llm.queries import tokenizer_path, training_labels
from driftloom.llm.scratch import Scratch
from driftloom.llm.toxicity import fit, scored


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half."""
    model = fit(docs, training_labels(spark, sf_dir))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("rest")  # columns of any names
    kept = scored(docs.select("text", rest), model).where("predicted = 0")
    return kept.select([F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return ExactDedup(docs).kept()


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id.

    Documents without words are in no group and stay; columns of the caller may have any names.
    """
    rows = jaccard_groups(docs).where("component is not null").select("doc_id", "row", "component")
    rows = Scratch(spark, "near-copies").write(rows, "rows")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    best = rows.groupBy("component").agg(F.min(order).alias("best"))
    name = "gone" + "_" * max(len(c) for c in docs.columns)  # longer than any column of the caller
    gone = rows.join(best, "component").where("row != best.row").select(F.col("row").alias(name))
    return docs.join(gone, row_key() == F.col(name), "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return emitted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("mixing", mix),
    ("packing", pack_sequences),
]

#: Nearest neighbours, tokens and a genetic search have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
