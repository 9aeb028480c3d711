"""Explicit schemas of the engine's tables; readers never infer."""

from __future__ import annotations

SCHEMA_VERSION = "corvane_v1"

PROMPTS = "dataset string, split_id string, prompt_id string, pair_id string, question string, prompt string, context string"
CANDIDATES = (
    "candidate_id string, prompt_id string, pair_id string, dataset string, split_id string, candidate_text string, "
    "candidate_role string, question string, context string, is_correct boolean"
)
SAMPLE = (
    "dataset string, prompt_id string, sample_index int, response_text string, "
    "selected_token_logits array<double>, logsumexp array<double>"
)
FREE_SAMPLES = f"artifact_type string, schema_version string, sample_count_per_prompt int, prompt_group_count int, samples array<struct<{', '.join(x.replace(' ', ':', 1) for x in SAMPLE.split(', '))}>>"
CORPUS_COUNTS = "kind string, query string, raw_count bigint, status string, approximate boolean"
PREDICTIONS = "method string, prompt_id string, sample_index int, score double"
FULL_LOGITS = "prompt_id string, sample_index int, token_offset bigint, full_logits array<float>"

#: Fields of a candidate that may not be blank.
REQUIRED_CANDIDATE_FIELDS = ("candidate_id", "prompt_id", "pair_id", "dataset", "split_id", "candidate_text", "candidate_role")
