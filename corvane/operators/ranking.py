"""Distributed ranks and running sums.

A window without a partition key sends all rows to one task.  Here rows are
range-partitioned by the order instead, sums run within each range, and the
totals of the ranges before it, a handful of rows, are added.  The ranges are
written to the shared folder, as two evaluations could draw different borders,
so callers should pass the columns they need and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def running_sums(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds, for each name in ``sums``, the sum over all rows of the group up to and including this one.

    ``order`` should be unique within a group; the order of ties is undefined.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    rows = df.select("*", *[o.alias(k) for o, k in zip(order, keys, strict=True)], *[v.alias(f"_v_{n}") for n, v in sums.items()])
    rows = written(rows.repartitionByRange(*by, *keys).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*by, "_range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    totals = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    rows = rows.withColumns({f"_r_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    match = [rows["_range"] == totals["_range"], *[rows[c].eqNullSafe(totals[c]) for c in by]]
    joined = rows.join(totals, match)
    return joined.select(*[rows[c] for c in df.columns], *[(F.col(f"_r_{n}") + F.col(f"_b_{n}")).alias(n) for n in sums])


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Adds a 1-based row number, within the groups of ``by`` or over all rows."""
    return running_sums(df, by or [], order, {name: F.lit(1).cast("long")})
