"""Data contracts as DataFrames of violations: empty when all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.maths import close
from ..schemas import REQUIRED_CANDIDATE_FIELDS, SCHEMA_VERSION

# Hints of correctness in a feature's source, roles that may not be trained on, and the one feature the hints don't count for.
LEAKAGE_HINTS = ("gold", "correct_answers", "gold_answers", "right_answer", "correctness", "is_hallucination", "label")
PROHIBITED_ROLES = ("label_only", "correctness_derived")
HINTS_ALLOWED = "semantic_energy_proxy"
TEXT_ONLY = "candidate_text"


def with_schema_version(df: DataFrame, version: str = SCHEMA_VERSION) -> DataFrame:
    return df.withColumn("schema_version", F.lit(version))


def wrong_version(df: DataFrame, version: str = SCHEMA_VERSION) -> DataFrame:
    return df.where(~F.col("schema_version").eqNullSafe(F.lit(version)))


def blank_fields(rows: DataFrame, fields: tuple[str, ...] = REQUIRED_CANDIDATE_FIELDS) -> DataFrame:
    """One row per field: how many rows have it null or blank."""
    have = [c for c in fields if c in rows.columns]
    counts = rows.select(*[F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(c) for c in have])
    return counts.unpivot([], have, "field", "violations")


def sample_coverage(samples: DataFrame, n: int = 10, prompt: str = "prompt_id", index: str = "sample_index") -> DataFrame:
    """Prompts whose sample indices are not exactly 0 .. n-1."""
    got = samples.groupBy(prompt).agg(F.count("*").alias("n_samples"), F.sort_array(F.collect_set(index)).alias("indices"))
    return got.where((F.col("n_samples") != n) | (F.col("indices") != F.sequence(F.lit(0), F.lit(n - 1)))).select(prompt, "n_samples")


def uneven_arrays(rows: DataFrame, one: str, two: str) -> DataFrame:
    """Rows whose arrays differ in length or hold a number that is not finite."""
    bad = lambda c: F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size(one) != F.size(two)) | bad(one) | bad(two))


def partition_faults(clusters: DataFrame, n: int = 10, prompt: str = "prompt_id") -> DataFrame:
    """Prompts whose clusters (members, probability, representative) do not split 0 .. n-1 or whose probabilities do not sum to 1."""
    per = clusters.groupBy(prompt).agg(F.sort_array(F.flatten(F.collect_list("members"))).alias("all"), F.sum("probability").alias("total"), F.bool_and(F.array_contains("members", F.col("representative"))).alias("led"))
    return per.where((F.col("all") != F.sequence(F.lit(0), F.lit(n - 1))) | (F.abs(F.col("total") - 1) >= 1e-6) | ~F.col("led")).select(prompt)


def key_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of the inputs has."""
    one, two = a.select(key).distinct(), b.select(key).distinct()
    return one.join(two, key, "left_anti").withColumn("side", F.lit("only_left")).union(two.join(one, key, "left_anti").withColumn("side", F.lit("only_right")))


def key_integrity(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fault): unexpected, duplicate and missing keys, from key columns only."""
    have = rows.select(*keys).groupBy(*keys).agg(F.count("*").alias("_c"))
    want = expected.select(*keys).distinct()
    out = have.join(want, keys, "left_anti").select(*keys, F.lit("unexpected").alias("fault"))
    out = out.union(have.where("_c > 1").select(*keys, F.lit("duplicate").alias("fault")))
    return out.union(want.join(have, keys, "left_anti").select(*keys, F.lit("missing").alias("fault")))


def window_faults(tokens: DataFrame, key: str, position: str) -> DataFrame:
    """Keys whose token positions are not contiguous and unique."""
    per = tokens.groupBy(key).agg(F.count("*").alias("c"), F.countDistinct(position).alias("d"), (F.max(position) - F.min(position) + 1).alias("width"))
    return per.where((F.col("c") != F.col("width")) | (F.col("d") != F.col("c"))).select(key, "c", "width")


def provenance_faults(provenance: DataFrame) -> DataFrame:
    """(feature_name, source, fault): trainable features that depend on correctness, have a prohibited role or a source that hints at a label, and any whose source is the candidate's text alone."""
    source = F.lower("source")
    hinted = F.exists(F.array(*[F.lit(h) for h in LEAKAGE_HINTS]), lambda h: F.contains(source, h))
    faults = [
        ("depends_on_correctness", F.col("trainable") & F.col("depends_on_correctness")),
        ("prohibited_role", F.col("trainable") & F.col("role").isin(*PROHIBITED_ROLES)),
        ("leakage_hint", F.col("trainable") & hinted & (F.col("feature_name") != HINTS_ALLOWED)),
        ("candidate_text", F.contains(source, F.lit(TEXT_ONLY))),
    ]
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in faults]), lambda x: x.isNotNull())
    return provenance.select("feature_name", "source", F.explode(named).alias("fault"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def alias_differences(rows: DataFrame, one: str, two: str) -> DataFrame:
    return rows.where(~F.col(one).eqNullSafe(F.col(two)))


def readiness(samples: DataFrame, n: int = 10, prompt: str = "prompt_id") -> DataFrame:
    """How many prompts have how many samples, and whether that is complete."""
    per = samples.groupBy(prompt).agg(F.count("*").alias("n_samples"))
    return per.groupBy("n_samples").agg(F.count("*").alias("n_prompts")).withColumn("complete", F.col("n_samples") == n)


def nearly_equal(a: Column, b: Column) -> Column:
    return close(a, b)
