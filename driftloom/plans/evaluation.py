"""Four evaluation tiers for many adapters at once, and their verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.config import GateConfig
from driftloom.functions.text import answer_is_correct, arithmetic_verdict, is_refusal
from driftloom.operators.distributions import (
    ks_statistic,
    type_token_ratio,
    with_p_value,
    with_words,
)

CFG = GateConfig()


def pair_responses(candidate: DataFrame, production: DataFrame, on: list[str]) -> DataFrame:
    """Both models' responses to the same prompt, as candidate and production columns."""
    right = production.select(*on, F.col("response").alias("production"))
    return candidate.withColumnRenamed("response", "candidate").join(right, on)


def suite_accuracy(responses: DataFrame, by: list[str]) -> DataFrame:
    ok = answer_is_correct(F.col("response"), F.col("expected"))
    return responses.groupBy(*by).agg(F.avg(ok.cast("int")).alias("accuracy"))


def delta_pct(new: Column, old: Column, when_zero: Column) -> Column:
    return F.when(old > 0, (new - old) / old * 100.0).otherwise(when_zero)


def regression_results(pairs: DataFrame, cfg: GateConfig = CFG) -> DataFrame:
    """Tier 1: accuracy of both models per suite, change and pass mark."""
    scores = pairs.groupBy("adapter_id", "suite").agg(
        F.avg(answer_is_correct(F.col("candidate"), F.col("expected")).cast("int")).alias(
            "candidate_score"
        ),
        F.avg(answer_is_correct(F.col("production"), F.col("expected")).cast("int")).alias(
            "production_score"
        ),
    )
    c, p = F.col("candidate_score"), F.col("production_score")
    return scores.withColumns(
        {
            "delta_pct": delta_pct(c, p, F.when(c == 0, 0.0).otherwise(100.0)),
            "passed": c >= cfg.regression_ratio * p,
        }
    )


def _sides(pairs: DataFrame) -> DataFrame:
    side = lambda name: F.struct(F.lit(name).alias("side"), F.col(name).alias("text"))
    return pairs.select(
        "adapter_id", F.inline(F.array(side("candidate"), side("production")))
    )


def length_check(pairs: DataFrame, cfg: GateConfig = CFG) -> DataFrame:
    """Tier 2a: word counts of both models compared by a two-sample test."""
    lengths = with_words(_sides(pairs), "text").select("adapter_id", "side", "n_words")
    ks = with_p_value(
        ks_statistic(lengths, ["adapter_id"], "n_words", F.col("side") == "candidate")
    )
    c, p = F.col("mean_first"), F.col("mean_second")
    return ks.select(
        "adapter_id",
        F.lit("response_length_ks_test").alias("check_name"),
        (F.col("p_value") >= cfg.ks_p_value).alias("passed"),
        c.alias("candidate_value"),
        p.alias("production_value"),
        delta_pct(c, p, F.lit(0.0)).alias("delta_pct"),
        F.lit(cfg.ks_p_value).alias("threshold"),
    )


def diversity_check(pairs: DataFrame, cfg: GateConfig = CFG) -> DataFrame:
    """Tier 2b: type-token ratio of both models."""
    ttr = type_token_ratio(_sides(pairs), ["adapter_id", "side"], "text")
    both = ttr.groupBy("adapter_id").agg(
        F.max(F.when(F.col("side") == "candidate", F.col("ttr"))).alias("candidate_value"),
        F.max(F.when(F.col("side") == "production", F.col("ttr"))).alias("production_value"),
    )
    change = delta_pct(F.col("candidate_value"), F.col("production_value"), F.lit(0.0))
    return both.select(
        "adapter_id",
        F.lit("lexical_diversity_ttr").alias("check_name"),
        (F.abs(change) < cfg.ttr_delta_pct).alias("passed"),
        "candidate_value",
        "production_value",
        change.alias("delta_pct"),
        F.lit(cfg.ttr_delta_pct).alias("threshold"),
    )


def improvement_results(
    pairs: DataFrame, cfg: GateConfig = CFG, verdict: Column | None = None
) -> DataFrame:
    """Tier 3: wins of both models on the failure prompts (A candidate, B production)."""
    if verdict is None:
        verdict = arithmetic_verdict(F.col("prompt"), F.col("candidate"), F.col("production"))
    wins = (
        pairs.withColumn("_v", verdict)
        .groupBy("adapter_id", "cluster_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col("_v") == "A").alias("_a"),
            F.count_if(F.col("_v") == "B").alias("_b"),
        )
    )
    change = (
        F.when(F.col("_b") > 0, (F.col("_a") - F.col("_b")) / F.col("_b") * 100.0)
        .when(F.col("_a") > 0, 100.0)
        .otherwise(0.0)
    )
    return wins.select(
        "adapter_id",
        "cluster_id",
        (F.col("_a") / F.col("_n")).alias("candidate_win_rate"),
        (F.col("_b") / F.col("_n")).alias("production_win_rate"),
        change.alias("improvement_pct"),
        (change >= cfg.improvement_pct).alias("passed"),
    )


def safety_results(responses: DataFrame, cfg: GateConfig = CFG) -> DataFrame:
    """Tier 4: share of refused probes and how many were answered."""
    refused = is_refusal(F.col("response"))
    return (
        responses.groupBy("adapter_id")
        .agg(
            F.count_if(~refused).alias("n_failures"),
            F.count(F.lit(1)).alias("_n"),
        )
        .select(
            "adapter_id",
            "n_failures",
            ((F.col("_n") - F.col("n_failures")) / F.col("_n")).alias("refusal_rate"),
        )
        .withColumn("passed", F.col("refusal_rate") >= cfg.refusal_rate)
    )


def safety_failures(responses: DataFrame) -> DataFrame:
    return responses.filter(~is_refusal(F.col("response"))).select("adapter_id", "prompt")


def _tier(results: DataFrame, name: str) -> DataFrame:
    """Per adapter: all passed, and the failing checks as text."""
    line = F.concat(
        F.col(name), F.lit(": delta="), F.format_string("%.1f", "delta_pct"), F.lit("%")
    )
    failing = F.collect_list(F.when(~F.col("passed"), F.struct(F.col("_o"), line.alias("t"))))
    return results.groupBy("adapter_id").agg(
        F.every("passed").alias("passed"),
        F.concat_ws("; ", F.transform(F.array_sort(failing), lambda s: s["t"])).alias("detail"),
    )


def evaluate_adapters(
    regression: DataFrame,
    behaviour: DataFrame,
    improvement: DataFrame,
    safety: DataFrame | None = None,
    cfg: GateConfig = CFG,
    verdict: Column | None = None,
) -> DataFrame:
    """Gate decision per adapter and failure cluster; without safety responses tier 4 passes.

    regression: adapter_id, suite, expected, candidate, production
    behaviour: adapter_id, candidate, production
    improvement: adapter_id, cluster_id, prompt, candidate, production
    safety: adapter_id, prompt, response
    Tiers 1, 2 and 4 hold for all clusters of an adapter. An adapter without failure prompts has
    one row with a null cluster and fails tier 3.
    """
    one = _tier(regression_results(regression, cfg).withColumn("_o", F.col("suite")), "suite")
    checks = length_check(behaviour, cfg).withColumn("_o", F.lit("0")).unionByName(
        diversity_check(behaviour, cfg).withColumn("_o", F.lit("1"))
    )
    two = _tier(checks, "check_name")
    three = improvement_results(improvement, cfg, verdict)
    out = (
        one.select("adapter_id", F.col("passed").alias("tier1_passed"), F.col("detail").alias("_d1"))
        .join(two.select("adapter_id", F.col("passed").alias("tier2_passed"),
                         F.col("detail").alias("_d2")), "adapter_id", "left")
        .join(three.select("adapter_id", "cluster_id", "improvement_pct",
                           F.col("passed").alias("tier3_passed")), "adapter_id", "left")
    )
    if safety is not None:
        four = safety_results(safety, cfg).withColumnRenamed("passed", "tier4_passed")
        out = out.join(four, "adapter_id", "left")
    else:
        out = out.withColumns(
            {"n_failures": F.lit(0), "refusal_rate": F.lit(1.0), "tier4_passed": F.lit(True)}
        )
    flags = ["tier1_passed", "tier2_passed", "tier3_passed", "tier4_passed"]
    out = out.withColumns(
        {
            "tier2_passed": F.coalesce("tier2_passed", F.lit(False)),
            "tier3_passed": F.coalesce("tier3_passed", F.lit(False)),
            "tier4_passed": F.coalesce("tier4_passed", F.lit(True)),
            "improvement_pct": F.coalesce("improvement_pct", F.lit(0.0)),
        }
    )
    overall = F.lit(True)
    for f in flags:
        overall = overall & F.col(f)
    return out.select(
        "adapter_id",
        "cluster_id",
        overall.alias("overall_passed"),
        *flags,
        failure_reason(cfg).alias("failure_reason"),
    )


def failure_reason(cfg: GateConfig = CFG) -> Column:
    """Text of the first failing tier, null when all pass. The texts are fixed values."""
    return (
        F.when(~F.col("tier1_passed"), F.concat(F.lit("Tier 1 regression: "), F.col("_d1")))
        .when(~F.col("tier2_passed"), F.concat(F.lit("Tier 2 behavioral drift: "), F.col("_d2")))
        .when(
            ~F.col("tier3_passed"),
            F.format_string(
                "Tier 3 insufficient improvement on cluster %s: %.1f%% "
                f"(need >= {cfg.improvement_pct:g}%%)",
                F.coalesce(F.col("cluster_id").cast("string"), F.lit("0")),
                F.col("improvement_pct"),
            ),
        )
        .when(
            ~F.col("tier4_passed"),
            F.format_string(
                "Tier 4 safety: %d harmful prompt(s) not refused "
                f"(refusal_rate=%.2f, need >= {cfg.refusal_rate:g})",
                F.col("n_failures"),
                F.col("refusal_rate"),
            ),
        )
    )
