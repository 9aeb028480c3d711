"""Semantic clusters of repeated answers, their entropy and energy."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_response
from ..functions.tokens import sample_energy, token_stats


def leader_clusters(samples: DataFrame, decisions: DataFrame, prompt: str = "prompt_id", index: str = "sample_index") -> DataFrame:
    """(prompt, index, cluster): in index order each sample joins the first cluster whose first member it entails and is entailed by.

    ``decisions``: (prompt, premise, hypothesis, entails).  This is no
    transitive closure, so it runs as one small task per prompt.
    """
    mutual = decisions.where("entails").select(prompt, F.col("premise").alias("a"), F.col("hypothesis").alias("b"))
    mutual = mutual.join(mutual.select(prompt, F.col("a").alias("b"), F.col("b").alias("a")), [prompt, "a", "b"])
    per = mutual.groupBy(prompt).agg(F.collect_set(F.struct("a", "b")).alias("links"))
    grouped = samples.groupBy(prompt).agg(F.sort_array(F.collect_set(index)).alias("members")).join(per, prompt, "left")

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, members, links in zip(frame[prompt], frame["members"], frame["links"], strict=True):
                linked = {(x["a"], x["b"]) for x in links} if links is not None else set()
                leaders: list = []
                for m in members:
                    at = next((i for i, lead in enumerate(leaders) if (lead, m) in linked), None)
                    if at is None:
                        at = len(leaders)
                        leaders.append(m)
                    rows.append((key, m, at))
            yield pd.DataFrame(rows, columns=[prompt, index, "cluster"])

    types = dict(samples.dtypes)
    return grouped.select(prompt, "members", "links").mapInPandas(assign, f"{prompt} {types[prompt]}, {index} {types[index]}, cluster int")


def same_text_clusters(samples: DataFrame, prompt: str = "prompt_id", index: str = "sample_index", text: str = "response_text") -> DataFrame:
    """Clusters when entailment is equality of normalised text: creation order is that of the first member."""
    rows = samples.select(prompt, index, normalize_response(F.col(text)).alias("_t"))
    first = rows.groupBy(prompt, "_t").agg(F.min(index).alias("_first"))
    first = first.withColumn("cluster", F.row_number().over(Window.partitionBy(prompt).orderBy("_first")) - 1)
    return rows.join(first.drop("_first"), [prompt, "_t"]).select(prompt, index, F.col("cluster").cast("int").alias("cluster"))


def cluster_name(cluster: Column) -> Column:
    return F.format_string("cluster_%03d", cluster)


def likelihood_source(logits: str, lse: str) -> Column:
    """Where a sample's likelihood comes from."""
    return F.when(F.size(logits) == 0, "missing").when(F.size(logits) != F.size(lse), "uneven").otherwise("mean_token_log_likelihood")


def cluster_table(samples: DataFrame, clusters: DataFrame, use: str = "mean", prompt: str = "prompt_id", index: str = "sample_index") -> DataFrame:
    """(prompt, cluster, size, probability, energy): mass by log-sum-exp of members' likelihoods, energy by sum of theirs.

    ``use``: a sample's likelihood is the mean (default) or the sum of its token log probabilities.
    """
    stats = token_stats(F.col("selected_token_logits"), F.col("logsumexp"))
    like = -stats["sample_nll"] if use == "mean" else stats["sample_sequence_log_prob"]
    rows = samples.select(prompt, index, like.alias("like"), sample_energy(F.col("selected_token_logits")).alias("energy")).join(clusters, [prompt, index])
    rows = rows.withColumn("top", F.max("like").over(Window.partitionBy(prompt)))
    mass = rows.groupBy(prompt, "cluster").agg(F.count("*").alias("size"), F.sum(F.exp(F.col("like") - F.col("top"))).alias("mass"), F.sum("energy").alias("energy"))
    return mass.withColumn("probability", F.col("mass") / F.sum("mass").over(Window.partitionBy(prompt))).drop("mass")


def semantic_features(table: DataFrame, samples: DataFrame, prompt: str = "prompt_id", text: str = "response_text") -> DataFrame:
    """Per prompt: likelihood entropy, entropy of cluster sizes, entropy and number of distinct texts, and three energies.

    cluster_uncertainty weighs clusters' energies by probability,
    total_cluster_energy adds them up, sample_energy is the samples' mean.
    """
    xlogx = lambda p: F.when(p > 0, -p * F.ln(p)).otherwise(0.0)
    n = F.sum("size").over(Window.partitionBy(prompt))
    rows = table.withColumn("share", F.col("size") / n)
    out = rows.groupBy(prompt).agg(
        F.sum(xlogx(F.col("probability"))).alias("semantic_entropy"), F.sum(xlogx(F.col("share"))).alias("discrete_entropy"), F.count("*").alias("n_clusters"), F.sum("size").alias("n_samples"),
        F.sum(F.col("probability") * F.col("energy")).alias("cluster_uncertainty"), F.sum("energy").alias("total_cluster_energy"), (F.sum("energy") / F.sum("size")).alias("sample_energy"),
    )
    texts = samples.select(prompt, normalize_response(F.col(text)).alias("_t")).groupBy(prompt, "_t").agg(F.count("*").alias("c"))
    texts = texts.withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(prompt)))
    texts = texts.groupBy(prompt).agg(F.sum(xlogx(F.col("share"))).alias("text_entropy"), F.count("*").alias("n_distinct_texts"))
    return out.join(texts, prompt)


def energy_or_fallback(features: DataFrame, samples: DataFrame, prompt: str = "prompt_id") -> DataFrame:
    """cluster_uncertainty, or the mean sample energy for prompts without clusters."""
    mean = samples.groupBy(prompt).agg(F.avg(sample_energy(F.col("selected_token_logits"))).alias("mean_energy"))
    return mean.join(features.select(prompt, "cluster_uncertainty"), prompt, "left").select(prompt, F.coalesce("cluster_uncertainty", "mean_energy").alias("energy"), F.col("cluster_uncertainty").isNull().alias("is_fallback"))


def ordered_pairs(samples: DataFrame, prompt: str = "prompt_id", index: str = "sample_index", text: str = "response_text") -> DataFrame:
    """Every ordered pair of different samples of a prompt with the text-equality decision."""
    norm = samples.select(prompt, F.col(index).alias("premise"), normalize_response(F.col(text)).alias("_p"))
    other = samples.select(prompt, F.col(index).alias("hypothesis"), normalize_response(F.col(text)).alias("_h"))
    return norm.join(other, prompt).where("premise <> hypothesis").select(prompt, "premise", "hypothesis", (F.col("_p") == F.col("_h")).alias("entails"))
