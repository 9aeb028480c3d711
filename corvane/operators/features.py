"""Corpus features of candidates: axes, bridge, n-gram coverage, overlap labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.maths import ENTITY_SCALE, LOW_FREQUENCY, NGRAM_CEILING, PAIR_SCALE, corpus_risk, coverage, log_axis, open_log_axis
from ..functions.text import ngrams, normalize_term, overlap_match, space_tokens
from ..shared import written
from .corpus import bridge_pairs, count_entities, count_pairs, entity_pairs


def row_status(n_entities: str, n_bad_backend: str, n_approximate: str, n_missing: str, n_fallback: str):
    """What became of a row's counts, the first case that applies."""
    c = F.col
    return (
        F.when(c(n_entities) == 0, "no_entities").when(c(n_bad_backend) > 0, "disallowed_backend").when(c(n_approximate) > 0, "excluded_approximate_counts")
        .when(c(n_missing) > 0, "excluded_missing_counts").when(c(n_fallback) > 0, "fallback_resolved").otherwise("resolved")
    )


def entity_axes(rows: DataFrame, counts: DataFrame, pair_counts: DataFrame, key: str = "candidate_id", entities: str = "entities") -> DataFrame:
    """Frequency and co-occurrence axes, flags, coverage and risk; all null when any count of the row is missing."""
    terms = rows.select(key, F.explode(F.array_distinct(entities)).alias("term")).join(counts.select("term", F.col("raw_count").alias("n")), "term", "left")
    freq = terms.groupBy(key).agg(F.count("*").alias("n_entities"), F.count("n").alias("n_known"), F.avg("n").alias("f_mean"), F.min("n").alias("f_min"))
    pairs = entity_pairs(rows, entities, [key]).join(pair_counts.select("left", "right", F.col("raw_count").alias("n")), ["left", "right"], "left")
    pair = pairs.groupBy(key).agg(F.count("*").alias("n_pairs"), F.count("n").alias("p_known"), F.avg("n").alias("p_mean"))
    out = rows.select(key).join(freq, key, "left").join(pair, key, "left").na.fill(0, ["n_entities", "n_known", "n_pairs", "p_known"])
    whole = (F.col("n_entities") > 0) & (F.col("n_entities") == F.col("n_known")) & (F.col("n_pairs") == F.col("p_known"))
    pair_mean = F.when(F.col("n_pairs") > 0, F.col("p_mean")).otherwise(0.0)
    out = out.withColumns({"frequency_mean": F.when(whole, F.col("f_mean")), "frequency_min": F.when(whole, F.col("f_min")), "pair_mean": F.when(whole, pair_mean), "counts_complete": whole})
    out = out.withColumns({"frequency_axis": log_axis(F.col("frequency_mean"), ENTITY_SCALE), "pair_axis": log_axis(F.col("pair_mean"), PAIR_SCALE)})
    out = out.withColumns(
        {"coverage_score": coverage(F.col("frequency_axis"), F.col("pair_axis")), "low_frequency_flag": F.col("frequency_min") < LOW_FREQUENCY, "zero_pair_flag": F.when(whole, (F.col("n_pairs") > 0) & (F.col("pair_mean") == 0))}
    )
    risk = corpus_risk(F.col("frequency_axis"), F.col("pair_axis"), F.col("low_frequency_flag"), F.col("zero_pair_flag"), F.col("coverage_score"))
    return out.withColumn("corpus_risk", risk).select(
        key, "n_entities", "n_pairs", "counts_complete", "frequency_mean", "frequency_min", "pair_mean", "frequency_axis", "pair_axis", "low_frequency_flag", "zero_pair_flag", "coverage_score", "corpus_risk"
    )


def bridge_features(rows: DataFrame, corpus: DataFrame, key: str, question: str, answer: str) -> DataFrame:
    """Question-answer entity bridge: pair count, least and mean co-occurrence, axis, any-zero flag.

    Missing counts are left out; with none left everything is 0 and the flag 1.
    """
    pairs = written(bridge_pairs(rows, question, answer, [key]))
    counted = count_pairs(corpus, pairs)
    keyed = pairs.withColumns({"a": F.least("left", "right"), "b": F.greatest("left", "right")}).drop("left", "right")
    joined = keyed.join(counted.select(F.col("left").alias("a"), F.col("right").alias("b"), F.col("raw_count").alias("n")), ["a", "b"], "left").where("n is not null")
    agg = joined.groupBy(key).agg(F.count("*").alias("c"), F.min("n").alias("lo"), F.avg("n").alias("mean"), F.max((F.col("n") == 0).cast("int")).alias("zero"))
    out = rows.select(key).join(agg, key, "left")
    least = F.coalesce("lo", F.lit(0))
    return out.select(
        key, F.coalesce("c", F.lit(0)).cast("long").alias("bridge_pair_count"), least.cast("long").alias("bridge_min"), F.coalesce("mean", F.lit(0.0)).alias("bridge_mean"),
        open_log_axis(least, PAIR_SCALE).alias("bridge_axis"), F.coalesce("zero", F.lit(1)).cast("int").alias("bridge_zero_flag"),
    )


def ngram_coverage(rows: DataFrame, corpus: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (3, 5)) -> DataFrame:
    """Counts of a text's n-grams in the corpus, per n: count, zero_count, min, mean, axis. Missing counts are 0; texts too short are all 0."""
    tokens = rows.select(key, space_tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    out = tokens.select(key, F.size("t").alias("n_tokens"))
    sized = lambda n: F.transform(ngrams(F.col("t"), n), lambda g: F.struct(F.lit(n).alias("size"), g.alias("gram")))
    grams = written(tokens.select(key, F.explode(F.concat(*[sized(n) for n in sizes])).alias("x")).select(key, "x.size", normalize_term(F.col("x.gram")).alias("term")))
    asked = grams.select("term").distinct()
    counts = count_entities(corpus, asked).select("term", "raw_count")
    # Grams are matched by their normalised form; one that has none counts 0.
    joined = grams.join(counts, "term", "left").withColumn("n", F.coalesce("raw_count", F.lit(0)))
    agg = joined.groupBy(key, "size").agg(F.count("*").alias("count"), F.count_if(F.col("n") == 0).alias("zero_count"), F.min("n").alias("min"), F.avg("n").alias("mean"))
    for n in sizes:
        names = {c: f"ngram_{n}_{c}" for c in ("count", "zero_count", "min", "mean")}
        out = out.join(agg.where(F.col("size") == n).select(key, *[F.col(c).alias(x) for c, x in names.items()]), key, "left").na.fill(0, list(names.values()))
        out = out.withColumn(f"ngram_{n}_axis", open_log_axis(F.col(f"ngram_{n}_mean"), NGRAM_CEILING))
    return out


def overlap_labels(samples: DataFrame, gold: DataFrame, key: list[str], group: str = "prompt_id", text: str = "response_text", answer: str = "answer") -> DataFrame:
    """A sample is right when it overlaps any gold answer of its group; samples of groups without one are left out."""
    pairs = samples.select(*key, text, *([group] if group not in key else [])).join(gold.select(group, answer), group)
    return pairs.groupBy(*key).agg(F.max(overlap_match(F.col(text), F.col(answer)).cast("int")).alias("is_correct"), F.count("*").alias("n_candidates"))


def entailment_labels(scores: DataFrame, key: list[str], threshold: float = 0.5) -> DataFrame:
    """From (key, probability) rows over candidates and directions: the largest, 0 for none, and the label."""
    return scores.groupBy(*key).agg(F.coalesce(F.max("probability"), F.lit(0.0)).alias("max_probability")).withColumn("is_correct", (F.col("max_probability") >= threshold).cast("int"))
