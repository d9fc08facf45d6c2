"""Similarity, clustering, amplification and judging queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog.density_sql import CLUSTERS, LABELS, TREE
from driftloom.catalog.fixtures import table
from driftloom.catalog.registry import query
from driftloom.catalog.sources import TURNS_SQL, turns
from driftloom.config import ClusterConfig
from driftloom.functions import hooks
from driftloom.functions import text as X
from driftloom.functions.vectors import norm
from driftloom.operators.density import density_clusters
from driftloom.operators.neighbors import core_distances, nearest
from driftloom.plans import synthesis as S

STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


def failures(spark, sf):
    """Embedded failures: vectors with the document of the same id; label 9 counts as noise."""
    e = table(spark, sf, "embeddings")
    # the join deals the texts out; there is no need to do so before
    d = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("doc_id", "vec_id")
    return e.join(d, "vec_id").select(
        "vec_id", F.col("vec_id").cast("string").alias("request_id"),
        F.col("text").alias("prompt"), F.concat_ws(" ", "source", "lang").alias("response"),
        (-F.col("n_chars") / 1000.0).alias("mean_logprob"), "embedding",
        F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("long").alias("cluster_id"),
    )


FAILURES_SQL = """
failures AS MATERIALIZED (
  SELECT vec_id, CAST(vec_id AS VARCHAR) AS request_id, text AS prompt,
         source || ' ' || lang AS response, -n_chars / 1000e0 AS mean_logprob, embedding,
         CASE WHEN label = 9 THEN -1 ELSE CAST(label AS BIGINT) END AS cluster_id
  FROM embeddings JOIN documents ON doc_id = vec_id)
"""
CENTROIDS_SQL = """
parts AS (
  SELECT cluster_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos
  FROM failures WHERE cluster_id >= 0),
centroids AS MATERIALIZED (
  SELECT cluster_id, list(CAST(m AS FLOAT) ORDER BY pos) AS c FROM (
    SELECT cluster_id, pos, avg(CAST(x AS DOUBLE)) AS m FROM parts GROUP BY 1, 2) GROUP BY 1)
"""
REPS_SQL = """
reps AS MATERIALIZED (
  SELECT * FROM (
    SELECT f.*, d AS distance,
           row_number() OVER (PARTITION BY cluster_id ORDER BY d, request_id) AS rank
    FROM (SELECT f.*, list_distance(CAST(f.embedding AS DOUBLE[]), CAST(c.c AS DOUBLE[])) AS d
          FROM failures f JOIN centroids c USING (cluster_id)) f)
  WHERE rank <= 10)
"""
KEYWORDS_SQL = f"""
words AS (
  SELECT cluster_id, rank AS r, generate_subscripts(w, 1) AS pos, unnest(w) AS keyword
  FROM (SELECT cluster_id, rank, regexp_extract_all(lower(prompt), '[a-z][a-z0-9]*') AS w FROM reps)),
keywords AS MATERIALIZED (
  SELECT cluster_id, keyword, n, rank FROM (
    SELECT cluster_id, keyword, count(*) AS n, row_number() OVER (PARTITION BY cluster_id
           ORDER BY count(*) DESC, min({{'r': r, 'p': pos}})) AS rank
    FROM words WHERE length(keyword) > 2 AND keyword NOT IN ({STOP_SQL}) GROUP BY 1, 2)
  WHERE rank <= 5)
"""
TABLE_SQL = f"{FAILURES_SQL}, {CENTROIDS_SQL}, {REPS_SQL}, {KEYWORDS_SQL}" + """,
clusters AS MATERIALIZED (
  SELECT cluster_id, n AS member_count, 'Cluster of ' || n || ' failures' ||
         coalesce(' involving: ' || kw, ' (cluster_id=' || cluster_id || ')')
           AS archetype_description
  FROM (SELECT cluster_id, count(*) AS n FROM failures WHERE cluster_id >= 0 GROUP BY 1)
  LEFT JOIN (SELECT cluster_id, string_agg(keyword, ', ' ORDER BY rank) AS kw FROM keywords
             GROUP BY 1) USING (cluster_id))
"""


# --- Similarity ----------------------------------------------------------------------------


@query(
    "jon7_similar_to_centroids",
    f"WITH {FAILURES_SQL}, {CENTROIDS_SQL} SELECT cluster_id AS query_id, vec_id AS id, "
    "CAST(rank AS INTEGER) AS rank, round(score, 5) AS score FROM (SELECT *, row_number() OVER "
    "(PARTITION BY cluster_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT cluster_id, "
    f"e.vec_id, {DOT.format('c', 'e.embedding')} / sqrt({DOT.format('c', 'c')}) AS score "
    "FROM centroids, embeddings e)) WHERE rank <= 5",
)
def jon7(spark, sf):
    members, _ = S.split_noise(failures(spark, sf))
    out = nearest(
        table(spark, sf, "embeddings"), S.centroids(members), 5, "vec_id", "embedding",
        "cluster_id", "centroid_embedding",
    )
    return out.withColumn("score", F.round("score", 5))


@query(
    "jon8_nearest_distances",
    "SELECT a_id AS query_id, b_id AS id, CAST(rank AS INTEGER) AS rank, round(1 - score, 5) AS "
    "distance FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) AS "
    f"rank FROM (SELECT a.vec_id AS a_id, b.vec_id AS b_id, {DOT.format('a.embedding', 'b.embedding')}"
    f" / sqrt({DOT.format('a.embedding', 'a.embedding')}) / "
    f"sqrt({DOT.format('b.embedding', 'b.embedding')}) AS score FROM embeddings a, embeddings b "
    "WHERE a.vec_id <> b.vec_id)) WHERE rank <= 3",
)
def jon8(spark, sf):
    e = table(spark, sf, "embeddings")
    out = nearest(
        e, e, 3, "vec_id", "embedding", "vec_id", "embedding", normalise_vectors=True,
        skip_same_id=True,
    )
    return out.select("query_id", "id", "rank", F.round(1 - F.col("score"), 5).alias("distance"))


@query(
    "clu1_core_distances",
    "SELECT a_id AS id, round(greatest(1 - score, 0), 5) AS core FROM (SELECT *, row_number() OVER "
    "(PARTITION BY a_id ORDER BY score DESC) AS rank FROM (SELECT a.vec_id AS a_id, "
    f"{DOT.format('a.embedding', 'b.embedding')} / "
    f"sqrt({DOT.format('a.embedding', 'a.embedding')}) / "
    f"sqrt({DOT.format('b.embedding', 'b.embedding')}) AS score FROM embeddings a, embeddings b "
    "WHERE a.vec_id <> b.vec_id)) WHERE rank = 3",
)
def clu1(spark, sf):
    out = core_distances(table(spark, sf, "embeddings"), 3, "vec_id", "embedding")
    return out.withColumn("core", F.round("core", 5))


# --- Clusters ------------------------------------------------------------------------------


@query("clu2_density_labels", LABELS)
def clu2(spark, sf):
    labels, _ = density_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return labels


@query("clu3_persistence", CLUSTERS)
def clu3(spark, sf):
    _, clusters = density_clusters(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return clusters.withColumn("persistence_score", F.round("persistence_score", 6))


@query(
    "agg4_centroids",
    f"WITH {FAILURES_SQL}, {CENTROIDS_SQL} SELECT cluster_id, generate_subscripts(c, 1) - 1 AS "
    "pos, round(CAST(unnest(c) AS DOUBLE), 6) AS x FROM centroids",
)
def agg4(spark, sf):
    members, _ = S.split_noise(failures(spark, sf))
    return S.centroids(members).select(
        "cluster_id", F.posexplode("centroid_embedding").alias("pos", "_x")
    ).select("cluster_id", F.col("pos").cast("long").alias("pos"),
             F.round(F.col("_x").cast("double"), 6).alias("x"))


@query(
    "agg5_cluster_sizes",
    f"WITH {FAILURES_SQL} SELECT cluster_id, count(*) AS member_count FROM failures GROUP BY 1",
)
def agg5(spark, sf):
    return S.cluster_sizes(failures(spark, sf))


@query(
    "set1_noise_partition",
    f"WITH {FAILURES_SQL} SELECT count(*) FILTER (WHERE cluster_id >= 0) AS clustered, "
    "count(*) FILTER (WHERE cluster_id < 0) AS noise, count(*) AS total FROM failures",
)
def set1(spark, sf):
    members, noise = S.split_noise(failures(spark, sf))
    both = members.select(F.lit(0).alias("n")).unionByName(noise.select(F.lit(1).alias("n")))
    return both.agg(
        F.count_if(F.col("n") == 0).alias("clustered"), F.count_if(F.col("n") == 1).alias("noise"),
        F.count(F.lit(1)).alias("total"),
    )


@query(
    "clu4_noise_points",
    f"WITH {FAILURES_SQL} SELECT request_id FROM failures WHERE cluster_id = -1",
)
def clu4(spark, sf):
    return S.split_noise(failures(spark, sf))[1].select("request_id")


@query(
    "win6_representatives",
    f"WITH {FAILURES_SQL}, {CENTROIDS_SQL}, {REPS_SQL} SELECT cluster_id, request_id, "
    "CAST(rank AS INTEGER) AS rank, round(distance, 5) AS distance FROM reps",
)
def win6(spark, sf):
    members, _ = S.split_noise(failures(spark, sf))
    return S.representatives(members).select(
        "cluster_id", "request_id", "rank", F.round("distance", 5).alias("distance")
    )


@query(
    "agg6_top_keywords",
    f"WITH {FAILURES_SQL}, {CENTROIDS_SQL}, {REPS_SQL}, {KEYWORDS_SQL} SELECT cluster_id, keyword,"
    " n, CAST(rank AS INTEGER) AS rank FROM keywords",
)
def agg6(spark, sf):
    members, _ = S.split_noise(failures(spark, sf))
    return S.top_keywords(S.representatives(members), "prompt", "rank")


@query(
    "agg6_document_keywords",
    "SELECT lang, keyword, n, CAST(rank AS INTEGER) AS rank FROM (SELECT lang, keyword, count(*) "
    "AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, min({'d': doc_id, 'p': "
    "pos})) AS rank FROM (SELECT lang, doc_id, generate_subscripts(w, 1) AS pos, unnest(w) AS "
    "keyword FROM (SELECT lang, doc_id, regexp_extract_all(lower(text), '[a-z][a-z0-9]*') AS w "
    f"FROM documents)) WHERE length(keyword) > 2 AND keyword NOT IN ({STOP_SQL}) GROUP BY 1, 2) "
    "WHERE rank <= 5",
)
def agg6_documents(spark, sf):
    return S.top_keywords(table(spark, sf, "documents"), "text", "doc_id", "lang")


@query(
    "exp19_descriptions",
    f"WITH {TABLE_SQL} SELECT cluster_id, member_count, archetype_description FROM clusters",
)
def exp19(spark, sf):
    members, _ = S.split_noise(failures(spark, sf))
    return S.descriptions(S.cluster_sizes(members), S.representatives(members))


def given_scores(spark, sf):
    """A stand-in persistence per label, so that order and filters can be compared."""
    return S.cluster_sizes(failures(spark, sf)).filter("cluster_id >= 0").select(
        "cluster_id", (F.col("member_count") % 7 / 7.0).alias("persistence_score")
    )


def given_clusters(spark, sf):
    return S.cluster_table(failures(spark, sf), given_scores(spark, sf))


@query(
    "clu5_cluster_table",
    f"WITH {TABLE_SQL} SELECT c.cluster_id, member_count, archetype_description, "
    "round((member_count % 7) / 7e0, 6) AS persistence_score, samples FROM clusters c JOIN "
    "(SELECT cluster_id, string_agg(request_id, ',' ORDER BY rank) AS samples FROM reps GROUP BY "
    "1) USING (cluster_id)",
)
def clu5(spark, sf):
    ids = F.transform("representative_samples", lambda s: s["request_id"])
    return S.stable_order(given_clusters(spark, sf)).select(
        "cluster_id", "member_count", "archetype_description",
        F.round("persistence_score", 6).alias("persistence_score"),
        F.concat_ws(",", ids).alias("samples"),
    )


@query(
    "srt1_stable_order",
    f"WITH {FAILURES_SQL}, s AS (SELECT cluster_id, count(*) % 7 AS p FROM failures WHERE "
    "cluster_id >= 0 GROUP BY 1) SELECT cluster_id, row_number() OVER (ORDER BY p DESC, "
    "cluster_id) - 1 AS position FROM s",
)
def srt1(spark, sf):
    return S.stable_positions(given_scores(spark, sf))


@query(
    "set4_stable_clusters",
    f"WITH {FAILURES_SQL} SELECT cluster_id FROM failures WHERE cluster_id >= 0 GROUP BY 1 "
    "HAVING (count(*) % 7) / 7e0 >= 0.3e0",
)
def set4(spark, sf):
    return S.keep_stable(given_scores(spark, sf), 0.3).select("cluster_id")


@query(
    "agg7_cluster_quality",
    f"WITH {FAILURES_SQL} SELECT CAST(cluster_id AS VARCHAR) AS cluster, round((count(*) % 7) / "
    "7e0, 6) AS quality FROM failures WHERE cluster_id >= 0 GROUP BY cluster_id",
)
def agg7(spark, sf):
    return S.cluster_quality(given_scores(spark, sf)).withColumn("quality", F.round("quality", 6))


# --- Amplification and judging -------------------------------------------------------------

PAIRS_SQL = TABLE_SQL + """,
answered AS (SELECT cluster_id, list(response ORDER BY rank) AS responses FROM reps GROUP BY 1),
pairs AS (
  SELECT cluster_id AS source_cluster_id, member_count, CAST(i AS INTEGER) AS pair_no,
         'Synthetic variant prompt ' || (i + 1) AS prompt,
         'This is a correct response to: Synthetic variant prompt ' || (i + 1) AS chosen,
         responses[i % len(responses) + 1] AS rejected,
         CASE WHEN i % 2 = 0 THEN 0.9e0 ELSE 0.3e0 END AS clarity
  FROM clusters JOIN answered USING (cluster_id), range(20) AS t(i))
"""


def alternating(prompt, chosen, rejected, description):
    """A judge that fails every second variant."""
    number = F.regexp_extract(prompt, r"(\d+)$", 1).cast("int")
    return F.struct(
        F.when(number % 2 == 1, 0.9).otherwise(0.3).alias("preference_clarity"),
        *[F.lit(0.9).alias(d) for d in X.JUDGE_DIMENSIONS[1:]],
    )


def given_pairs(spark, sf):
    return S.synthetic_pairs(given_clusters(spark, sf), "job-1", judge=alternating)


@query(
    "jon9_variant_pairs",
    f"WITH {PAIRS_SQL} SELECT source_cluster_id, pair_no, prompt, chosen, rejected FROM pairs",
)
def jon9(spark, sf):
    return given_pairs(spark, sf).select(
        "source_cluster_id", "pair_no", "prompt", "chosen", "rejected"
    )


@query(
    "exp14_judge_gate",
    f"WITH {PAIRS_SQL} SELECT source_cluster_id, pair_no, clarity >= 0.7 AS passed_gate FROM pairs",
)
def exp14(spark, sf):
    return given_pairs(spark, sf).select("source_cluster_id", "pair_no", "passed_gate")


@query(
    "udf4_default_judge",
    f"WITH {PAIRS_SQL} SELECT source_cluster_id, pair_no, 0.85e0 AS clarity, 0.9e0 AS validity, "
    "0.8e0 AS quality, 0.85e0 AS fidelity, TRUE AS passed_gate FROM pairs",
)
def udf4(spark, sf):
    s = "judge_scores."
    return S.synthetic_pairs(given_clusters(spark, sf), "job-1").select(
        "source_cluster_id", "pair_no", F.col(s + "preference_clarity").alias("clarity"),
        F.col(s + "prompt_validity").alias("validity"),
        F.col(s + "response_quality").alias("quality"),
        F.col(s + "amplification_fidelity").alias("fidelity"), "passed_gate",
    )


@query(
    "agg8_amplification",
    f"WITH {PAIRS_SQL} SELECT source_cluster_id, count(*) AS pairs_synthesized, count(*) FILTER "
    "(WHERE clarity >= 0.7) AS pairs_passing, count(*) FILTER (WHERE clarity >= 0.7) / 20e0 AS "
    "factor_of_pairs, round(count(*) FILTER (WHERE clarity >= 0.7) / CAST(max(member_count) AS "
    "DOUBLE), 6) AS factor_of_failures, round(count(*) * 0.01e0, 6) AS cost_usd FROM pairs "
    "GROUP BY 1",
)
def agg8(spark, sf):
    out = S.amplification(given_pairs(spark, sf))
    return out.withColumns(
        {c: F.round(c, 6) for c in ("factor_of_failures", "cost_usd")}
    )


@query(
    "agg9_job_totals",
    f"WITH {PAIRS_SQL} SELECT count(DISTINCT source_cluster_id) AS clusters_processed, count(*) AS "
    "pairs_synthesized, count(*) FILTER (WHERE clarity >= 0.7) AS pairs_passing, round(count(*) * "
    "0.01e0, 6) AS cost_usd, (SELECT count(*) FROM failures) AS failures_input, "
    "round(count(*) FILTER (WHERE clarity >= 0.7) / CAST((SELECT count(*) FROM failures) AS "
    "DOUBLE), 6) AS overall_factor FROM pairs",
)
def agg9(spark, sf):
    out = S.job_totals(given_pairs(spark, sf), failures(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("cost_usd", "overall_factor")})


@query(
    "exp23_oracle_cost",
    f"WITH {FAILURES_SQL} SELECT cluster_id, round(count(*) * 0.01e0, 6) AS cost_usd "
    "FROM failures WHERE cluster_id >= 0 GROUP BY 1",
)
def exp23(spark, sf):
    sizes = S.cluster_sizes(S.split_noise(failures(spark, sf))[0])
    cost = F.col("member_count") * S.CFG.cost_per_pair_usd
    return sizes.select("cluster_id", F.round(cost, 6).alias("cost_usd"))


def replies(spark, sf):
    """Judge replies made from documents: plain, fenced, with trailing text, incomplete, broken."""
    d = table(spark, sf, "documents")
    score = (F.col("n_chars") % 10).cast("string")
    body = F.concat(
        F.lit('{"preference_clarity": 0.'), score, F.lit(', "prompt_validity": 0.9, '
              '"response_quality": "0.8", "amplification_fidelity": 1}'),
    )
    n = F.col("doc_id") % 5
    raw = (
        F.when(n == 0, body)
        .when(n == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(n == 2, F.concat(F.lit("Scores: "), body, F.lit(" because {it} reads well")))
        .when(n == 3, F.lit('{"preference_clarity": 0.9}'))
        .otherwise(F.concat(F.lit("no scores for "), "source"))
    )
    return d.select("doc_id", raw.alias("raw"))


@query(
    "exp15_judge_replies",
    "SELECT doc_id, doc_id % 5 > 2 AS parse_error, CASE WHEN doc_id % 5 <= 2 THEN (n_chars % 10) / "
    "10e0 END AS clarity, CASE WHEN doc_id % 5 <= 2 THEN 0.8e0 END AS quality FROM documents",
)
def exp15(spark, sf):
    s = X.judge_scores(F.col("raw"))
    return replies(spark, sf).select("doc_id", s.alias("s")).select(
        "doc_id", "s.parse_error", F.col("s.preference_clarity").alias("clarity"),
        F.col("s.response_quality").alias("quality"),
    )


@query(
    "exp16_json_lists",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source || '|' || lang || '|7' WHEN 1 THEN lang "
    "ELSE '' END AS items FROM documents",
)
def exp16(spark, sf):
    d = table(spark, sf, "documents")
    n = F.col("doc_id") % 4
    raw = (
        F.when(n == 0, F.concat(F.lit('Here: ["'), "source", F.lit('", "'), "lang",
                                F.lit('", 7] and more')))
        .when(n == 1, F.concat(F.lit('```json\n["'), "lang", F.lit('"]\n```')))
        .when(n == 2, F.lit('["open'))
        .otherwise(F.lit("none"))
    )
    return d.select("doc_id", F.concat_ws("|", X.json_list(raw)).alias("items"))


@query(
    "exp17_chat_text",
    f"WITH {TURNS_SQL} SELECT conv_id, turn, md5('<|im_start|>user' || chr(10) || prompt || "
    "'<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || response || '<|im_end|>') "
    "AS digest FROM turns",
)
def exp17(spark, sf):
    return turns(spark, sf).select(
        "conv_id", "turn", F.md5(X.chat_text(F.col("prompt"), F.col("response"))).alias("digest")
    )


JUDGE_SQL = X.JUDGE_PROMPT.replace("'", "''").split("%s")


@query(
    "exp18_judge_prompts",
    f"WITH {TURNS_SQL} SELECT conv_id, turn, '{JUDGE_SQL[0]}' || prompt || '{JUDGE_SQL[1]}' || "
    f"response || '{JUDGE_SQL[2]}' || 'none' || '{JUDGE_SQL[3]}' || 'cluster 1' || "
    f"'{JUDGE_SQL[4]}' AS judge_prompt FROM turns",
)
def exp18(spark, sf):
    return turns(spark, sf).select(
        "conv_id", "turn",
        X.judge_prompt(
            F.col("prompt"), F.col("response"), F.lit("none"), F.lit("cluster 1")
        ).alias("judge_prompt"),
    )


VARIANT_SQL = X.VARIANT_PROMPT.replace("%d", "20").replace("'", "''").split("%s")


@query(
    "exp18_variant_prompts",
    f"SELECT doc_id, '{VARIANT_SQL[0]}' || CASE WHEN doc_id % 2 = 0 THEN source ELSE text END || "
    f"'{VARIANT_SQL[1]}' AS variant_prompt FROM documents",
)
def exp18_variants(spark, sf):
    archetype = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("")
    return table(spark, sf, "documents").select(
        "doc_id", X.variant_prompt(20, archetype, F.col("text")).alias("variant_prompt")
    )


# --- Hooks ---------------------------------------------------------------------------------


@query(
    "udf1_hashed_embeddings",
    "SELECT doc_id, CAST(64 AS BIGINT) AS dim, 1e0 AS length FROM documents",
)
def udf1(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return hooks.hashed_embedding(d, "text").select(
        "doc_id", F.size("embedding").cast("long").alias("dim"),
        F.round(norm(F.col("embedding")), 4).alias("length"),
    )


@query(
    "udf2_oracle_answers",
    "SELECT doc_id, 'This is a correct response to: ' || substr(text, 1, 50) AS answer "
    "FROM documents",
)
def udf2(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", hooks.answer(F.col("text")).alias("answer")
    )


@query(
    "udf3_variant_lists",
    "SELECT doc_id, CAST(i AS INTEGER) AS position, CASE WHEN doc_id % 10 = 3 THEN source ELSE "
    "'Synthetic variant prompt ' || (i + 1) END AS variant FROM documents, range(3) AS t(i)",
)
def udf3(spark, sf):
    lists = F.when(F.col("doc_id") % 10 == 3, hooks.repeated_archetype(F.col("source"), 3)).otherwise(
        hooks.variants(F.col("source"), 3)
    )
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(lists).alias("position", "variant")
    )


@query(
    "synthesize_job",
    f"WITH {FAILURES_SQL}, {TREE.replace('FROM embeddings', 'FROM failures')} SELECT n AS clusters_processed, "
    "n * 20 AS pairs_synthesized, n * 10 AS pairs_passing, round(n * 0.2e0, 6) AS cost_usd, failures_input, "
    "round(n * 10 / CAST(failures_input AS DOUBLE), 6) AS overall_factor "
    "FROM (SELECT count(*) AS n FROM picked), (SELECT count(*) AS failures_input FROM failures)",
)
def synthesize_job(spark, sf):
    """Whole job on given vectors: density clusters, pairs, totals."""
    f = failures(spark, sf).drop("cluster_id", "vec_id")
    cfg = ClusterConfig()
    _, totals = S.synthesize(f, "job-2", clusters=cfg, embed=lambda d: d, judge=alternating)
    return totals.withColumns({c: F.round(c, 6) for c in ("cost_usd", "overall_factor")})
