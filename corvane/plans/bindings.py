"""How the provided tables stand in for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten answers a prompt with token arrays, from embeddings."""
    e = table(spark, sf_dir, "embeddings")
    logits = F.transform("embedding", lambda x: x.cast("double"))
    return e.select(
        F.expr("vec_id div 10").alias("prompt_id"), (F.col("vec_id") % 10).cast("int").alias("sample_index"), F.concat(F.lit("label_"), F.col("label")).alias("response_text"),
        (F.expr("vec_id div 10") % 5).cast("int").alias("dataset"), logits.alias("selected_token_logits"), F.transform(logits, lambda x: F.ln(1 + F.exp(x))).alias("logsumexp"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their label: quality is the outcome, lang the dataset, source the prompt group."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.col("quality").alias("is_correct"), "toxic", "lang", "source", "n_chars", "text")


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows: users are prompts, a purchase is correct."""
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("prompt_id"), F.col("value").alias("s_value"), (F.col("event_id") * 37 % 101).cast("double").alias("s_mod"), (-F.abs(F.col("value") - 50)).alias("s_fold"),
        (F.col("user_id") % 4).cast("int").alias("dataset"), (F.col("event_type") == "purchase").cast("int").alias("is_correct"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer: a user turn and the assistant turn right after it."""
    c = table(spark, sf_dir, "conversations")
    q = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"])


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms to count: two-word beginnings of the benchmark's items, and their single words."""
    w = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]+", ""), " +")
    b = table(spark, sf_dir, "benchmark").select(w.alias("w"))
    return b.select(F.explode(F.array(F.get("w", F.lit(0)), F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2))), F.get("w", F.lit(3)))).alias("term")).where("term is not null").distinct()


def item_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, entities): the same terms, those of an item together."""
    w = F.split(F.regexp_replace(F.lower("text"), "[^a-z0-9 ]+", ""), " +")
    b = table(spark, sf_dir, "benchmark").select("item_id", w.alias("w"))
    found = F.array(F.get("w", F.lit(0)), F.concat_ws(" ", F.get("w", F.lit(1)), F.get("w", F.lit(2))), F.get("w", F.lit(3)))
    return b.select("item_id", F.filter(found, lambda t: t.isNotNull()).alias("entities"))
