"""Signal summaries from token log-probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p99": 0.99}


def signal_summaries(tokens: DataFrame, spike_below: float = -10.0) -> DataFrame:
    """One row per request from rows of request_id, position, logprob, entropy.

    Variance is the sample variance (0 for one token); spikes are the positions below the
    threshold, in order. A request is as long as its context window, so its group is small.
    """
    cuts = F.percentile("logprob", F.array(*[F.lit(p) for p in PERCENTILES.values()]))
    spike = F.when(F.col("logprob") < spike_below, F.struct("position", "logprob"))
    out = tokens.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("output_token_count"),
        F.avg("logprob").alias("mean_logprob"),
        F.min("logprob").alias("min_logprob"),
        F.avg("entropy").alias("logprob_entropy_mean"),
        F.coalesce(F.var_samp("logprob"), F.lit(0.0)).alias("logprob_variance"),
        F.array_sort(F.collect_list(spike)).alias("token_uncertainty_spikes"),
        cuts.alias("_cuts"),
    )
    shaped = F.struct(*[F.col("_cuts")[i].alias(p) for i, p in enumerate(PERCENTILES)])
    return out.withColumn("sequence_logprob_percentiles", shaped).drop("_cuts")
