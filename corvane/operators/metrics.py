"""Grouped, tie-correct evaluation metrics on DataFrames.

All take rows with a score and a 0/1 label and give one row per group of
``by``.  Rows are first summed by distinct score where the metric allows it, so
the ordered part works on far fewer rows; running sums are distributed.
``ranked`` gives all metrics of order from one ordered pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.maths import clip, spearman_p
from ..shared import written
from .ranking import running_sums

#: Up to so many groups a table with a row for each is sent to every task.
BROADCAST_GROUPS = 10_000


def _known(df: DataFrame, score: str, label: str) -> DataFrame:
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull())


def auroc(df: DataFrame, score: str, label: str, by: list[str] | None = None, name: str = "auroc") -> DataFrame:
    """Mann-Whitney with half for ties: by, n_pos, n_neg, ``name``; null where a class is missing."""
    by = by or []
    rows = _known(df, score, label).groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_n"))
    rows = running_sums(rows, by, [F.col(score)], {"_cn": F.col("_n")})
    out = rows.groupBy(*by).agg(
        F.coalesce(F.sum("_p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_neg"), F.sum(F.col("_p") * (F.col("_cn") - F.col("_n")) + F.col("_p") * F.col("_n") * 0.5).alias("_won")
    )
    return out.select(*by, "n_pos", "n_neg", F.try_divide(F.col("_won").cast("double"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias(name))


def ranked(df: DataFrame, score: str, label: str, tie: list[str], by: list[str] | None = None) -> DataFrame:
    """by, n_pos, n_neg, auroc, auprc, aurac from one pass over the rows in order of falling score.

    auroc: Mann-Whitney with half for ties; auprc: average precision with
    distinct scores as thresholds; aurac: mean over k of the accuracy of the k
    highest scores, ties by ``tie``.  Null where a class is missing.
    """
    by = by or []
    rows = _known(df, score, label).select(*by, score, F.col(label).cast("long").alias("_y"), *[t for t in tie if t not in (score, *by)])
    rows = running_sums(rows, by, [-F.col(score), *map(F.col, tie)], {"_hits": F.col("_y"), "_k": F.lit(1).cast("long")})
    cells = rows.groupBy(*by, score).agg(F.sum("_y").alias("_p"), F.count("*").alias("_c"), F.max("_hits").alias("_tp"), F.max("_k").alias("_all"), F.sum(F.col("_hits") / F.col("_k")).alias("_acc"))
    p, n = F.col("_p"), F.col("_c") - F.col("_p")
    out = cells.groupBy(*by).agg(
        F.coalesce(F.sum(p), F.lit(0)).alias("n_pos"), F.coalesce(F.sum(n), F.lit(0)).alias("n_neg"), F.sum(p * (F.col("_all") - F.col("_tp")) - p * n * 0.5).alias("_lost"),
        F.sum(p * F.col("_tp") / F.col("_all")).alias("_precision"), F.sum("_acc").alias("_acc"),
    )
    pos, neg = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    return out.select(
        *by, "n_pos", "n_neg", F.try_divide(pos * neg - F.col("_lost").cast("double"), pos * neg).alias("auroc"), F.try_divide("_precision", pos).alias("auprc"), F.try_divide("_acc", pos + neg).alias("aurac")
    )


def auprc(df: DataFrame, score: str, label: str, by: list[str] | None = None, name: str = "auprc") -> DataFrame:
    """Average precision with distinct scores as thresholds."""
    by = by or []
    rows = _known(df, score, label).groupBy(*by, score).agg(F.count_if(F.col(label) == 1).alias("_p"), F.count("*").alias("_c"))
    rows = running_sums(rows, by, [-F.col(score)], {"_tp": F.col("_p"), "_all": F.col("_c")})
    return rows.groupBy(*by).agg(F.try_divide(F.sum(F.col("_p") * F.col("_tp") / F.col("_all")), F.sum("_p").cast("double")).alias(name))


def aurac(df: DataFrame, score: str, label: str, tie: list[str], by: list[str] | None = None, name: str = "aurac") -> DataFrame:
    """Mean over k of the accuracy of the k highest scores; ties go by ``tie``."""
    by = by or []
    rows = _known(df, score, label).select(*by, score, label, *[t for t in tie if t not in (score, label, *by)])
    rows = running_sums(rows, by, [-F.col(score), *map(F.col, tie)], {"_hits": F.col(label).cast("long"), "_k": F.lit(1).cast("long")})
    return rows.groupBy(*by).agg(F.avg(F.col("_hits") / F.col("_k")).alias(name))


def equal_width_bin(value: Column, bins: int) -> Column:
    """0 .. bins-1 by the edges i * (1 / bins), each bin with its lower edge, of values in [0, 1)."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    return F.size(F.filter(edges, lambda e: e <= value))


def brier_ece(df: DataFrame, score: str, label: str, by: list[str] | None = None, bins: int = 10) -> DataFrame:
    """Mean squared error and expected calibration error of clipped scores over equal-width bins."""
    by = by or []
    rows = _known(df, score, label).withColumn("_s", clip(F.col(score)))
    cells = rows.groupBy(*by, equal_width_bin(F.col("_s"), bins).alias("_bin")).agg(
        F.count("*").alias("_n"), F.avg("_s").alias("_conf"), F.avg(F.col(label).cast("double")).alias("_acc"), F.sum((F.col("_s") - F.col(label)) * (F.col("_s") - F.col(label))).alias("_sq")
    )
    return cells.groupBy(*by).agg((F.sum("_sq") / F.sum("_n")).alias("brier"), (F.sum(F.col("_n") * F.abs(F.col("_conf") - F.col("_acc"))) / F.sum("_n")).alias("ece"))


def _each(df: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The rows with what their group has; the groups' table goes to every task if it is short."""
    if not by:
        return df.crossJoin(F.broadcast(groups))  # one row
    groups = written(groups)
    return df.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, by)


def oriented(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """The score negated in groups where its AUROC lies under one half, with ``flipped``."""
    by = by or []
    area = auroc(df, score, label, by).select(*by, (F.col("auroc") < 0.5).alias("flipped"))
    out = _each(df, area, by)
    return out.withColumn(score, F.when(F.coalesce("flipped", F.lit(False)), -F.col(score)).otherwise(F.col(score)))


def min_max(df: DataFrame, score: str, by: list[str] | None = None) -> DataFrame:
    """(s - min) / (max - min + 1e-9) over each group."""
    by = by or []
    ends = df.groupBy(*by).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    out = _each(df, ends, by)
    return out.withColumn(score, (F.col(score) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)).drop("_lo", "_hi")


def signals_long(df: DataFrame, signals: list[str], keep: list[str]) -> DataFrame:
    """One row per signal; null signals become 0."""
    return df.select(*keep, *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in signals]).unpivot(keep, signals, "method", "score")


def by_bin(df: DataFrame, score: str, label: str, bin_: str, tie: list[str], by: list[str] | None = None, least: int = 30) -> DataFrame:
    """AUROC and AURAC per bin; null under ``least`` rows or with one class; rows without a bin are left out."""
    keys = [*(by or []), bin_]
    out = ranked(df.where(F.col(bin_).isNotNull()), score, label, tie, keys)
    ok = (F.col("n_pos") + F.col("n_neg") >= least) & (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return out.select(*keys, (F.col("n_pos") + F.col("n_neg")).alias("n"), F.when(ok, F.col("auroc")).alias("auroc"), F.when(ok, F.col("aurac")).alias("aurac"))


def spread(df: DataFrame, value: str, by: list[str] | None = None, name: str = "delta", least: int = 1) -> DataFrame:
    """Largest less smallest known value; null with fewer than ``least``."""
    return df.groupBy(*(by or [])).agg(F.when(F.count(value) >= least, F.max(value) - F.min(value)).alias(name), F.count(value).alias("n_bins"))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank with ties sharing the mean rank. For small groups such as bins."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ordered = w.orderBy(value)
    return F.rank().over(ordered) + (F.count("*").over(w.partitionBy(*by, value) if by else Window.partitionBy(value)) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, by: list[str] | None = None, least: int = 3, name: str = "rho") -> DataFrame:
    """Correlation of mean ranks over bin-level rows and its two-sided p; null under ``least`` known pairs."""
    by = by or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.withColumn("_x", average_rank(x, by)).withColumn("_y", average_rank(y, by))
    out = rows.groupBy(*by).agg(F.when(F.count("*") >= least, F.corr("_x", "_y")).alias(name), F.count("*").alias("n_bins"))
    return out.withColumn("p_value", spearman_p(F.col(name), F.col("n_bins")))
