"""Pluggable models: embedders, answer writers, judges. Defaults are plain columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.text import JUDGE_DIMENSIONS, words

# Replies of the default oracle and the default judge scores.
ANSWER_PREFIX = "This is a correct response to: "
VARIANT_PREFIX = "Synthetic variant prompt "
DEFAULT_SCORES = (0.85, 0.90, 0.80, 0.85)


def hashed_embedding(df: DataFrame, text: str, out: str = "embedding", dim: int = 64) -> DataFrame:
    """Unit vectors of hashed word counts; needs no model."""
    tokens = df.withColumn("_tokens", words(F.lower(F.col(text))))
    counts = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_tf").transform(tokens)
    unit = Normalizer(p=2.0, inputCol="_tf", outputCol="_unit").transform(counts)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop(
        "_tokens", "_tf", "_unit"
    )


def model_embedding(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64):
    """Column function of a model: `load()` runs once per task, texts go in batches."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in parts:
            rows = []
            for i in range(0, len(texts), batch):
                m = np.asarray(encode(texts[i : i + batch].tolist()), dtype=np.float32)
                n = np.linalg.norm(m, axis=1, keepdims=True)
                rows.extend(np.divide(m, n, out=np.zeros_like(m), where=n > 0).tolist())
            yield pd.Series(rows)

    return embed


def answer(prompt: Column) -> Column:
    return F.concat(F.lit(ANSWER_PREFIX), F.substring(prompt, 1, 50))


def variants(archetype: Column, count: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.lit(count)),
        lambda i: F.concat(F.lit(VARIANT_PREFIX), i.cast("string")),
    )


def repeated_archetype(archetype: Column, count: int) -> Column:
    """What stands in for variants where the model gave none."""
    return F.array_repeat(archetype, count)


def constant_scores(prompt, chosen, rejected, description, values=DEFAULT_SCORES) -> Column:
    return F.struct(*[F.lit(v).alias(d) for d, v in zip(JUDGE_DIMENSIONS, values)])


def model_judge(load: Callable[[], Callable[[list[str]], list[str]]]):
    """Column function of a judge model: prompts in, raw replies out (parse with judge_scores)."""

    @F.pandas_udf(T.StringType())
    def reply(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ask = load()
        for prompts in parts:
            yield pd.Series(ask(prompts.tolist()))

    return reply
