"""From failure records to judged training pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftloom.config import ClusterConfig, SynthesisConfig
from driftloom.functions import hooks
from driftloom.functions.text import JUDGE_DIMENSIONS, STOP_WORDS, passes_judge
from driftloom.functions.vectors import euclidean
from driftloom.operators.density import density_clusters
from driftloom.operators.timeline import ranked
from driftloom.session import broadcast_if_small, cut, release, stage
from driftloom.sources.datasets import write_training_sets

CFG = SynthesisConfig()
CLUSTERS = ClusterConfig()


def split_noise(labelled: DataFrame, label: str = "cluster_id") -> tuple[DataFrame, DataFrame]:
    """(clustered, noise): disjoint, and together the whole input."""
    return labelled.filter(F.col(label) >= 0), labelled.filter(F.col(label) < 0)


def cluster_sizes(labelled: DataFrame, label: str = "cluster_id") -> DataFrame:
    return labelled.groupBy(label).agg(F.count(F.lit(1)).alias("member_count"))


def centroids(labelled: DataFrame, label: str = "cluster_id", vec: str = "embedding") -> DataFrame:
    """Raw mean vector per cluster, not normalised again."""
    mean = Summarizer.mean(array_to_vector(F.col(vec).cast("array<double>")))
    return labelled.groupBy(label).agg(mean.alias("_m")).select(
        label,
        F.transform(vector_to_array("_m"), lambda x: x.cast("float")).alias("centroid_embedding"),
    )


def representatives(
    labelled: DataFrame, k: int = CLUSTERS.archetype_samples, label: str = "cluster_id",
    vec: str = "embedding", id_col: str = "request_id",
) -> DataFrame:
    """The k members closest to their centroid, with `distance` and `rank`."""
    near = W.partitionBy(label).orderBy("distance", id_col)
    means = broadcast_if_small(stage(centroids(labelled, label, vec), "centroids"), 20_000)
    return (
        labelled.join(means, label)
        .withColumn("distance", euclidean(F.col(vec), F.col("centroid_embedding")))
        .drop("centroid_embedding")
        .withColumn("rank", F.row_number().over(near))
        .filter(F.col("rank") <= k)
    )


def top_keywords(
    samples: DataFrame, text: str, order: str, label: str = "cluster_id",
    k: int = CLUSTERS.archetype_keywords,
) -> DataFrame:
    """Most frequent words per cluster: keyword, n, rank; ties go to the word seen first.

    `order` is an integer column. It is packed with the position into one number, so that the
    counts are hashed and reduced before the shuffle.
    """
    first = F.col(order).cast("decimal(38,0)") * F.lit(1 << 31) + F.col("_pos")
    found = samples.select(
        label, order,
        F.posexplode(
            F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z][a-z0-9]*)"), F.lit(1))
        ).alias("_pos", "keyword"),
    ).filter((F.length("keyword") > 2) & ~F.col("keyword").isin(*STOP_WORDS))
    counted = found.groupBy(label, "keyword").agg(
        F.count(F.lit(1)).alias("n"), F.min(first.cast("decimal(38,0)")).alias("_first")
    )
    w = W.partitionBy(label).orderBy(F.desc("n"), F.asc("_first"))
    return (
        counted.withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .drop("_first")
    )


def descriptions(
    sizes: DataFrame, samples: DataFrame, text: str = "prompt", order: str = "rank",
    label: str = "cluster_id",
) -> DataFrame:
    """One sentence per cluster from its samples, with a fallback for each thing missing."""
    top = top_keywords(samples, text, order, label)
    words = top.groupBy(label).agg(
        F.concat_ws(
            ", ", F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))),
                              lambda s: s["keyword"])
        ).alias("_words")
    )
    sampled = samples.select(label).distinct().withColumn("_sampled", F.lit(True))
    head = F.concat(F.lit("Cluster of "), F.col("member_count").cast("string"), F.lit(" failures"))
    return (
        sizes.join(words, label, "left").join(sampled, label, "left")
        .select(
            label,
            "member_count",
            F.when(F.col("_sampled").isNull(), F.concat(head, F.lit(" (no representative samples)")))
            .when(F.col("_words").isNotNull(),
                  F.concat(head, F.lit(" involving: "), F.col("_words")))
            .otherwise(F.concat(head, F.lit(" (cluster_id="), F.col(label).cast("string"),
                                F.lit(")")))
            .alias("archetype_description"),
        )
    )


#: Samples of clusters that are broadcast to the rows whose texts they name.
BROADCAST_SAMPLES = 200_000


def cluster_table(
    labelled: DataFrame, scores: DataFrame | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """One row per cluster: size, persistence, centroid, samples, description; most stable first.

    `labelled` has request_id, prompt, response, mean_logprob, embedding, cluster_id. With `texts`, prompt,
    response and mean_logprob are there instead, by `_row`, and only those of samples are fetched.
    """
    members, _ = split_noise(labelled)
    reps = representatives(members)
    if texts is not None:
        named = stage(reps.drop("embedding"), "samples")
        texts = texts.select("_row", "prompt", "response", "mean_logprob")
        reps = stage(texts.join(broadcast_if_small(named, BROADCAST_SAMPLES), "_row"), "samples")
    samples = reps.groupBy("cluster_id").agg(
        F.array_sort(
            F.collect_list(F.struct("rank", "request_id", "prompt", "response", "mean_logprob"))
        ).alias("representative_samples")
    )
    out = (
        descriptions(cluster_sizes(members), reps)
        .join(centroids(members), "cluster_id")
        .join(samples, "cluster_id")
    )
    if scores is None:
        out = out.withColumn("persistence_score", F.lit(0.0))
    else:
        out = out.join(
            scores.select("cluster_id", "persistence_score"), "cluster_id", "left"
        ).withColumn("persistence_score", F.coalesce("persistence_score", F.lit(0.0)))
    return out


def stable_order(clusters: DataFrame) -> DataFrame:
    return clusters.orderBy(F.desc("persistence_score"), F.asc("cluster_id"))


def stable_positions(clusters: DataFrame) -> DataFrame:
    """Position of each cluster in the stable order (0 first)."""
    slot = F.floor((1.0 - F.least("persistence_score", F.lit(1.0))) * 1000).cast("long")
    order = ["_slot", "_down", "cluster_id"]
    rows = clusters.withColumns({"_slot": slot, "_down": -F.col("persistence_score")})
    return ranked(rows, [], order, "_slot", 10, "position").select("cluster_id", "position")


def cluster_quality(clusters: DataFrame) -> DataFrame:
    """Persistence per cluster as (cluster, quality) rows."""
    return clusters.select(
        F.col("cluster_id").cast("string").alias("cluster"), F.col("persistence_score").alias("quality")
    )


def keep_stable(clusters: DataFrame, min_persistence: float = 0.1) -> DataFrame:
    return clusters.filter(F.col("persistence_score") >= min_persistence)


def find_clusters(
    embedded: DataFrame, cfg: ClusterConfig = CLUSTERS, id_col: str = "request_id"
) -> tuple[DataFrame, DataFrame]:
    """(cluster table, noise) of embedded failures, through density clustering.

    Ids are numbered first, in id order, so that any id type can be clustered. Texts are written once and
    wait there until the samples are known.
    """
    rows = stage(embedded.withColumn("_row", F.monotonically_increasing_id()), "failures")
    spread = rows.select("_row", id_col, "embedding").withColumn("_h", F.pmod(F.xxhash64(id_col), F.lit(1_000_000)))
    numbered = cut(ranked(spread, [], ["_h", id_col], "_h", 100_000, "_id").drop("_h"))
    labels, scores = density_clusters(numbered, "_id", "embedding", cfg)
    labelled = cut(numbered.join(labels.withColumnRenamed("id", "_id"), "_id").drop("_id"))
    scores = cut(scores)
    release(numbered)
    table = keep_stable(cluster_table(labelled, scores, rows), cfg.min_persistence)
    noise = split_noise(labelled)[1].select("_row", "cluster_id")
    return table, rows.join(noise, "_row").drop("_row")


def synthetic_pairs(
    clusters: DataFrame,
    job_id: str,
    cfg: SynthesisConfig = CFG,
    answer: Callable[[Column], Column] = hooks.answer,
    variants: Callable[[Column, int], Column] = hooks.variants,
    judge: Callable[..., Column] = hooks.constant_scores,
) -> DataFrame:
    """`pairs_per_cluster` judged pairs per cluster.

    Variant lists that are too short are padded with the archetype, longer ones cut. Rejected
    answers cycle through the samples' responses.
    """
    n = cfg.pairs_per_cluster
    first = F.try_element_at("representative_samples", F.lit(1))["prompt"]
    archetype = F.coalesce(F.nullif("archetype_description", F.lit("")), first)
    rows = (
        clusters.withColumn("_archetype", archetype)
        .withColumn("_variants", F.coalesce(
            variants(F.col("_archetype"), n),
            hooks.repeated_archetype(F.col("_archetype"), n)))
        .withColumn("_responses", F.transform("representative_samples", lambda s: s["response"]))
        .withColumn("_responses", F.when(
            F.size("_responses") == 0, F.array(F.lit("(no response)"))).otherwise(
            F.col("_responses")))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pair_no"))
    )
    prompt = F.coalesce(F.get("_variants", F.col("pair_no")), F.col("_archetype"))
    rejected = F.element_at("_responses", F.pmod("pair_no", F.size("_responses")) + 1)
    pairs = rows.select(
        F.sha2(F.concat_ws("|", F.lit(job_id), "cluster_id", "pair_no"), 256).alias("pair_id"),
        F.col("cluster_id").alias("source_cluster_id"),
        "member_count",
        "archetype_description",
        "pair_no",
        prompt.alias("prompt"),
        rejected.alias("rejected"),
    ).withColumn("chosen", answer(F.col("prompt")))
    subject = F.coalesce(
        F.nullif("archetype_description", F.lit("")),
        F.concat(F.lit("cluster "), F.col("source_cluster_id").cast("string"),
                 F.lit(" failure mode")),
    )
    judged = pairs.withColumn(
        "judge_scores", judge(F.col("prompt"), F.col("chosen"), F.col("rejected"), subject)
    )
    return judged.withColumn(
        "passed_gate",
        passes_judge([F.col("judge_scores")[d] for d in JUDGE_DIMENSIONS], cfg.judge_threshold),
    ).withColumn("oracle_model", F.lit(cfg.oracle_model))


def amplification(pairs: DataFrame, cfg: SynthesisConfig = CFG) -> DataFrame:
    """Per cluster: pairs, passing pairs, cost, passing per pair and passing per failure."""
    passing = F.count_if("passed_gate")
    total = F.count(F.lit(1))
    return pairs.groupBy("source_cluster_id").agg(
        total.alias("pairs_synthesized"),
        passing.alias("pairs_passing"),
        (passing / total).alias("factor_of_pairs"),
        F.try_divide(passing, F.max("member_count")).alias("factor_of_failures"),
        (total * F.lit(cfg.cost_per_pair_usd)).alias("cost_usd"),
    )


def job_totals(pairs: DataFrame, failures: DataFrame, cfg: SynthesisConfig = CFG) -> DataFrame:
    """One row per job, also when there are no clusters."""
    per = amplification(pairs, cfg).select(
        F.lit(1).alias("clusters"), "pairs_synthesized", "pairs_passing", "cost_usd",
        F.lit(0).cast("long").alias("failures"),
    )
    inputs = failures.groupBy().agg(F.count(F.lit(1)).alias("failures")).select(
        F.lit(0).alias("clusters"), F.lit(0).cast("long").alias("pairs_synthesized"),
        F.lit(0).cast("long").alias("pairs_passing"), F.lit(0.0).alias("cost_usd"), "failures",
    )
    both = per.unionByName(inputs).groupBy().agg(
        F.sum("clusters").alias("clusters_processed"),
        F.sum("pairs_synthesized").alias("pairs_synthesized"),
        F.sum("pairs_passing").alias("pairs_passing"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("failures").alias("failures_input"),
    )
    factor = F.when(F.col("failures_input") > 0, F.col("pairs_passing") / F.col("failures_input"))
    return both.withColumn("overall_factor", F.coalesce(factor, F.lit(0.0)))


def synthesize(
    failures: DataFrame,
    job_id: str,
    folder: str | None = None,
    clusters: ClusterConfig = CLUSTERS,
    cfg: SynthesisConfig = CFG,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    **models,
) -> tuple[DataFrame, DataFrame]:
    """(pairs, totals) of one job; with `folder` both training sets are written there too."""
    embedded = (embed or (lambda d: hooks.hashed_embedding(d, "prompt")))(failures)
    table, _ = find_clusters(embedded, clusters)
    pairs = cut(synthetic_pairs(table, job_id, cfg, **models))
    if folder is not None:
        write_training_sets(pairs, folder, job_id)
    return pairs, job_totals(pairs, failures, cfg)
