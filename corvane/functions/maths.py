"""Numeric expressions: axes, flags, risk, clipping, array statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on these scales and thresholds.
ENTITY_SCALE = 1_000_000
PAIR_SCALE = 100_000
NGRAM_CEILING = 100_000_000
LOW_FREQUENCY = 1000


def half_up(value: Column, digits: int = 6) -> Column:
    """Rounded half up on the decimal value, whatever the last bits of the double say."""
    return F.round(value.cast("decimal(18,9)"), digits).cast("double")


def log_axis(value: Column, scale: int) -> Column:
    """log1p against log1p(scale), rounded half up to 6 digits, in 0 .. 1; 0 for values of 0 or less."""
    return F.when(value.isNull(), None).when(value <= 0, 0.0).otherwise(F.least(F.round(F.log1p(value) / math.log1p(scale), 6), F.lit(1.0)))


def open_log_axis(value: Column, ceiling: int) -> Column:
    """The same without rounding or upper bound."""
    return F.log1p(F.greatest(value, F.lit(0))) / math.log1p(ceiling)


def coverage(frequency_axis: Column, pair_axis: Column) -> Column:
    return half_up((frequency_axis + pair_axis) / 2)


def corpus_risk(frequency_axis: Column, pair_axis: Column, low: Column, zero: Column, cover: Column) -> Column:
    return half_up(((1 - frequency_axis) + (1 - pair_axis) + low.cast("double") + zero.cast("double") + (1 - cover)) / 5)


def clip(value: Column, eps: float = 1e-6) -> Column:
    return F.greatest(F.least(value, F.lit(1 - eps)), F.lit(eps))


def close(a: Column, b: Column, tol: float = 1e-6) -> Column:
    return F.abs(a - b) <= F.greatest(tol * F.greatest(F.abs(a), F.abs(b)), F.lit(tol))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def array_mean(values: Column) -> Column:
    return array_sum(values) / F.size(values)


def array_var_pop(values: Column) -> Column:
    mean = array_mean(values)
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(values)


def logsumexp(values: Column) -> Column:
    """Shifted by the maximum."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def entropy(probabilities: Column) -> Column:
    return -F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.ln(p)).otherwise(0.0))


def top_two(values: Column) -> Column:
    return F.slice(F.sort_array(values, asc=False), 1, 2)


def margin(values: Column) -> Column:
    """Largest less second largest; null for fewer than two."""
    return F.when(F.size(values) >= 2, F.get(top_two(values), F.lit(0)) - F.get(top_two(values), F.lit(1)))


def spearman_p(rho: Column, n: Column) -> Column:
    """Two-sided p of a rank correlation over n pairs by Student's t with n - 2 degrees of freedom, in closed form.

    With sin(a) = |rho| the distribution is a finite sum of powers of cos(a)^2;
    null for fewer than three pairs.
    """
    d, s = (n - 2).cast("int"), F.least(F.abs(rho), F.lit(1.0))
    c = 1 - s * s
    steps = lambda last: F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def series(first: Column, ratio, last: Column) -> Column:
        zero = F.struct(first.alias("term"), first.alias("total"))
        step = lambda a, k: F.struct((a["term"] * ratio(k) * c).alias("term"), (a["total"] + a["term"] * ratio(k) * c).alias("total"))
        return F.aggregate(steps(last), zero, step)["total"]

    even = s * series(F.lit(1.0), lambda k: (2 * k - 1) / (2.0 * k), F.floor(d / 2).cast("int") - 1)
    odd = F.asin(s) + F.when(d > 1, s * series(F.sqrt(c), lambda k: 2.0 * k / (2 * k + 1), F.floor((d - 3) / 2).cast("int"))).otherwise(0.0)
    inside = F.when(d % 2 == 0, even).otherwise(odd * (2 / math.pi))
    return F.when((d >= 1) & rho.isNotNull(), F.greatest(1 - inside, F.lit(0.0)))
