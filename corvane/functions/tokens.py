"""Statistics of a sample's token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .maths import array_mean, array_sum, array_var_pop, margin


def token_logprobs(logits: Column, lse: Column) -> Column:
    return F.zip_with(logits, lse, lambda a, z: a - z)


def usable(logits: Column, lse: Column) -> Column:
    """Both arrays there, of one length, not empty."""
    return F.coalesce((F.size(logits) > 0) & (F.size(logits) == F.size(lse)), F.lit(False))


def token_stats(logits: Column, lse: Column) -> dict[str, Column]:
    """nll, sequence_log_prob, logit_variance (population), logsumexp_mean: NaN for empty or uneven arrays; n_tokens always."""
    ok, nan = usable(logits, lse), F.lit(float("nan"))
    logprob = token_logprobs(logits, lse)
    pick = lambda c: F.when(ok, c).otherwise(nan)
    return {
        "sample_nll": pick(-array_mean(logprob)),
        "sample_sequence_log_prob": pick(array_sum(logprob)),
        "sample_logit_variance": pick(array_var_pop(logits)),
        "sample_logsumexp_mean": pick(array_mean(lse)),
        "n_tokens": F.coalesce(F.size(logits), F.lit(0)),
    }


def sample_energy(logits: Column) -> Column:
    """Mean of the negated logits; 0 for none."""
    return F.when(F.coalesce(F.size(logits), F.lit(0)) > 0, -array_mean(logits)).otherwise(0.0)


def logit_margin(full: Column) -> Column:
    return margin(full)
