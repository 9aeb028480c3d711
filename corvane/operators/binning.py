"""Rank-quantile, quantile-cut and fixed-cutoff bins, and their ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .ranking import global_rank

# Labels and upper bounds of the cutoff bins.
THREE_BINS = (("low_support", 0.333333), ("medium_support", 0.666667), ("high_support", None))
FIVE_BINS = (("very_low_support", 0.2), ("low_support", 0.4), ("mid_support", 0.6), ("high_support", 0.8), ("very_high_support", None))
TEN_BINS = (
    ("decile_00_10", 0.1), ("decile_10_20", 0.2), ("decile_20_30", 0.3), ("decile_30_40", 0.4), ("decile_40_50", 0.5),
    ("decile_50_60", 0.6), ("decile_60_70", 0.7), ("decile_70_80", 0.8), ("decile_80_90", 0.9), ("decile_90_100", None),
)
#: Up to so many labels their table is sent to every task.
BROADCAST_LABELS = 10_000


def rank_bins(df: DataFrame, score: str, tie: list[str], bins: int, name: str) -> DataFrame:
    """Bins 0 .. bins-1 of nearly equal size by rank; ties go by ``tie``; null scores get a null bin."""
    known = global_rank(df.where(F.col(score).isNotNull()), [F.col(score), *map(F.col, tie)], "_rank")
    n = known.agg(F.count("*").alias("_n"))
    binned = known.crossJoin(F.broadcast(n)).withColumn(name, F.least(F.expr(f"((_rank - 1) * {bins}) div _n"), F.lit(bins - 1)).cast("int")).drop("_rank", "_n")
    return binned.unionByName(df.where(F.col(score).isNull()).withColumn(name, F.lit(None).cast("int")))


def quantile_cut(df: DataFrame, score: str, tie: list[str], bins: int, name: str, least: int = 2) -> DataFrame:
    """Right-closed quantile cut of first-come ranks, in exact integers; null below ``least`` rows or for null scores."""
    known = global_rank(df.where(F.col(score).isNotNull()), [F.col(score), *map(F.col, tie)], "_rank")
    n = known.agg(F.count("*").alias("_n"))
    value = F.when(F.col("_n") >= max(least, 2), F.expr(f"greatest(((_rank - 1) * {bins} + _n - 2) div (_n - 1) - 1, 0)"))
    binned = known.crossJoin(F.broadcast(n)).withColumn(name, value.cast("int")).drop("_rank", "_n")
    return binned.unionByName(df.where(F.col(score).isNull()).withColumn(name, F.lit(None).cast("int")))


def cutoff_bin(value: Column, rules: tuple[tuple[str, float | None], ...]) -> Column:
    """The first rule whose upper bound holds; the last is open; null stays null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for label, upper in rules:
        out = out.otherwise(label) if upper is None else out.when(value <= upper, label)
    return out


def interval_bin(value: Column, intervals: list[dict]) -> Column:
    """The id of the first interval that holds the value; bounds may be open, inclusive by default."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for x in intervals:
        ok = F.lit(True)
        if x.get("lower") is not None:
            ok = ok & ((value >= x["lower"]) if x.get("lower_inclusive", True) else (value > x["lower"]))
        if x.get("upper") is not None:
            ok = ok & ((value <= x["upper"]) if x.get("upper_inclusive", True) else (value < x["upper"]))
        out = out.when(ok, x["id"])
    return out


def label_ordinal(df: DataFrame, label: str, name: str) -> DataFrame:
    """Index of a label among those that occur, in lexicographic order; null stays null."""
    kinds = df.select(label).where(F.col(label).isNotNull()).distinct()
    kinds = written(kinds.withColumn(name, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int")))
    return df.join(F.broadcast(kinds) if kinds.count() <= BROADCAST_LABELS else kinds, label, "left")


def rule_ordinal(label: Column, rules: tuple[tuple[str, float | None], ...]) -> Column:
    """Index of a label in the order of its rules."""
    out = F.lit(None).cast("int")
    for i, (name, _) in enumerate(rules):
        out = F.when(label == name, i).otherwise(out)
    return out
