"""Queries over clusters of repeated answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import semantic
from .bindings import samples
from .registry import SAMPLES, query

_CLUSTERS = f"(SELECT prompt_id, sample_index, (dense_rank() OVER (PARTITION BY prompt_id ORDER BY first) - 1)::INT AS cluster FROM (SELECT *, min(sample_index) OVER (PARTITION BY prompt_id, response_text) AS first FROM {SAMPLES}))"
_STATS = f"(SELECT prompt_id, sample_index, response_text, list_avg(list_transform(list_zip(l, z), lambda p: p[1] - p[2])) AS mean_like, list_sum(list_transform(list_zip(l, z), lambda p: p[1] - p[2])) AS sum_like, -list_avg(l) AS energy FROM {SAMPLES})"


def _table(like: str) -> str:
    return f"""(SELECT prompt_id, cluster, size, energy, mass / sum(mass) OVER (PARTITION BY prompt_id) AS probability FROM (SELECT prompt_id, cluster, count(*) AS size, sum(energy) AS energy, sum(exp({like} - top)) AS mass FROM
        (SELECT s.*, c.cluster, max({like}) OVER (PARTITION BY s.prompt_id) AS top FROM {_STATS} s JOIN {_CLUSTERS} c USING (prompt_id, sample_index)) GROUP BY prompt_id, cluster))"""


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    s = samples(spark, sf)
    return s, semantic.same_text_clusters(s)


@query(f"SELECT prompt_id, sample_index, cluster, printf('cluster_%03d', cluster) AS name FROM {_CLUSTERS}")
def answer_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters by equal normalised text, numbered in order of creation."""
    _, c = _parts(spark, sf)
    return c.withColumn("name", semantic.cluster_name(F.col("cluster")))


@query(f"SELECT prompt_id, sample_index, cluster FROM {_CLUSTERS}")
def leader_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Leader clustering over a table of directed decisions; with equality as entailment it equals grouping."""
    s = samples(spark, sf)
    return semantic.leader_clusters(s, semantic.ordered_pairs(s))


@query(f"SELECT a.prompt_id, a.sample_index AS premise, b.sample_index AS hypothesis, a.response_text = b.response_text AS entails FROM {SAMPLES} a JOIN {SAMPLES} b USING (prompt_id) WHERE a.sample_index <> b.sample_index")
def entailment_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return semantic.ordered_pairs(samples(spark, sf))


@query(f"SELECT prompt_id, cluster, size, round(probability, 6) AS probability, round(energy, 6) AS energy FROM {_table('mean_like')}")
def cluster_masses(spark: SparkSession, sf: str) -> DataFrame:
    s, c = _parts(spark, sf)
    return semantic.cluster_table(s, c).select("prompt_id", "cluster", "size", F.round("probability", 6).alias("probability"), F.round("energy", 6).alias("energy"))


_FEATURES = f"""(SELECT prompt_id, sum(CASE WHEN probability > 0 THEN -probability * ln(probability) ELSE 0 END) AS semantic_entropy, sum(-share * ln(share)) AS discrete_entropy, count(*) AS n_clusters, sum(size)::BIGINT AS n_samples,
    sum(probability * energy) AS cluster_uncertainty, sum(energy) AS total_cluster_energy, sum(energy) / sum(size) AS sample_energy FROM (SELECT *, size::DOUBLE / sum(size) OVER (PARTITION BY prompt_id) AS share FROM {_table('mean_like')}) GROUP BY prompt_id)"""


@query(
    f"""SELECT f.prompt_id, round(semantic_entropy, 6) AS semantic_entropy, round(discrete_entropy, 6) AS discrete_entropy, n_clusters, n_samples, round(cluster_uncertainty, 6) AS cluster_uncertainty, round(total_cluster_energy, 6) AS total_cluster_energy, round(sample_energy, 6) AS sample_energy,
        round(text_entropy, 6) AS text_entropy, n_distinct_texts FROM {_FEATURES} f JOIN (SELECT prompt_id, sum(-share * ln(share)) AS text_entropy, count(*) AS n_distinct_texts FROM
        (SELECT prompt_id, response_text, c::DOUBLE / sum(c) OVER (PARTITION BY prompt_id) AS share FROM (SELECT prompt_id, response_text, count(*) AS c FROM {SAMPLES} GROUP BY ALL)) GROUP BY prompt_id) t USING (prompt_id)"""
)
def semantic_features(spark: SparkSession, sf: str) -> DataFrame:
    """Entropies and energies of each prompt."""
    s, c = _parts(spark, sf)
    out = semantic.semantic_features(semantic.cluster_table(s, c), s)
    return out.withColumns({k: F.round(k, 6) for k in ("semantic_entropy", "discrete_entropy", "cluster_uncertainty", "total_cluster_energy", "sample_energy", "text_entropy")})


@query(f"SELECT prompt_id, round(sum(CASE WHEN probability > 0 THEN -probability * ln(probability) ELSE 0 END), 6) AS semantic_entropy FROM {_table('sum_like')} GROUP BY prompt_id")
def semantic_entropy_of_sums(spark: SparkSession, sf: str) -> DataFrame:
    """The variant with a sample's likelihood as the sum of its tokens'."""
    s, c = _parts(spark, sf)
    return semantic.semantic_features(semantic.cluster_table(s, c, use="sum"), s).select("prompt_id", F.round("semantic_entropy", 6).alias("semantic_entropy"))


@query(
    f"""SELECT s.prompt_id, round(coalesce(cluster_uncertainty, m), 6) AS energy, cluster_uncertainty IS NULL AS is_fallback FROM (SELECT prompt_id, avg(energy) AS m FROM {_STATS} GROUP BY prompt_id) s
        LEFT JOIN (SELECT * FROM {_FEATURES} WHERE prompt_id % 3 <> 0) f USING (prompt_id)"""
)
def energy_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Every third prompt has no clusters here and takes the mean energy of its samples."""
    s, c = _parts(spark, sf)
    features = semantic.semantic_features(semantic.cluster_table(s, c), s).where("prompt_id % 3 <> 0")
    return semantic.energy_or_fallback(features, s).withColumn("energy", F.round("energy", 6))


@query(f"SELECT prompt_id, sample_index, CASE sample_index % 3 WHEN 0 THEN 'missing' WHEN 1 THEN 'uneven' ELSE 'mean_token_log_likelihood' END AS source FROM {SAMPLES}")
def likelihood_sources(spark: SparkSession, sf: str) -> DataFrame:
    s = samples(spark, sf).withColumn("l", F.when(F.col("sample_index") % 3 == 0, F.slice("selected_token_logits", 1, 0)).when(F.col("sample_index") % 3 == 1, F.slice("selected_token_logits", 1, 3)).otherwise(F.col("selected_token_logits")))
    return s.select("prompt_id", "sample_index", semantic.likelihood_source("l", "logsumexp").alias("source"))
