"""Buckets and connected components over tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import drop, quoted, written

__all__ = ["buckets", "components", "drop", "quoted", "written"]

#: Links that one task unites (16 bytes each); longer tables are contracted until they are that short.
UNITE = 2_000_000


def buckets(spark: SparkSession, least: int = 8, times: float = 1) -> int:
    """How many buckets to deal keys into: as many as the cluster has shuffle partitions, or some times that for what takes much memory a byte."""
    return max(least, round(times * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for every end of some links."""
    nodes, inverse = np.unique(np.concatenate([u, v]), return_inverse=True)
    one, two = inverse[: len(u)], inverse[len(u) :]
    root = np.arange(len(nodes))
    while len(one):
        a, b = root[one], root[two]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[one] != root[two]
        one, two = one[apart], two[apart]
    return nodes, nodes[root]


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        node, component = united(*map(np.concatenate, zip(*held, strict=True)))
        yield from pa.table({"node": node, "component": component}).to_batches(1 << 16)


def components(links: DataFrame, unite: int = UNITE) -> DataFrame:
    """(node, component) for every end of ``links`` (a, b): the smallest id reachable.

    While there are more than ``unite`` links, every node moves to the
    neighbour (or itself) that comes first in an order drawn anew each round,
    and links between the nodes that stay take the place of the former.  At
    least half the nodes of a chain or tree go in a few rounds; a link always
    moves one of its ends, so this ends.  What is left is united in one task.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    moves: list[DataFrame] = []
    while edges.count() > unite:
        turn = F.lit(len(moves))
        first = lambda x: F.struct(F.xxhash64(x, turn).alias("h"), F.col(x).alias("x"))  # noqa: B023, E731
        both = edges.union(edges.select("v", "u"))
        near = both.groupBy("u").agg(F.min(first("v")).alias("near"))
        moves.append(written(near.select(F.col("u").alias("node"), F.least(first("u"), "near")["x"].alias("to"))))
        to = lambda x: moves[-1].select(F.col("node").alias(x), F.col("to").alias(f"{x}_to"))
        moved = edges.join(to("u"), "u").join(to("v"), "v").where("u_to <> v_to")
        after = written(moved.select(F.greatest("u_to", "v_to").alias("u"), F.least("u_to", "v_to").alias("v")).distinct())
        drop(edges)
        edges = after
    out = written(edges.coalesce(1).mapInArrow(_unite, "node long, component long"))
    drop(edges)
    for move in reversed(moves):
        above = out.select(F.col("node").alias("to"), "component")
        out = move.join(above, "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    if moves:
        least = out.groupBy("component").agg(F.min("node").alias("least"))
        out = out.join(least, "component").select("node", F.col("least").alias("component"))
    return out
