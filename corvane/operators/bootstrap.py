"""Grouped bootstrap: whole prompts are drawn, all their rows follow.

Draws come from a hash of (seed, replicate, slot), so the table of weights is
the same in every run and can be stored or checked with SQL.  Rows are summed by
prompt and score, meet their prompt's weights of all replicates as one row of bytes,
and are ordered once: each range of scores adds up its share for all replicates
at once, and what lies below a range is added afterwards.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .metrics import spread
from .ranking import global_rank

REPLICATES = 500
#: Cells that are weighted at once, times replicates.
CHUNK = 1 << 20
#: Prompts whose weights are put together at once, and draws that are hashed at once.
BLOCK, SLOTS = 1 << 12, 1 << 16


def packed_weights(prompts: DataFrame, replicates: int = REPLICATES, seed: int = 42, prompt: str = "prompt_id") -> DataFrame:
    """(prompt, w): a byte for each replicate, how often the prompt is drawn in it, with replacement, n draws each.

    A task draws whole replicates; blocks of prompts then put theirs together.
    The rows of a prompt add up: there is another for what a byte can't hold.
    """
    numbered = written(global_rank(prompts.select(prompt).distinct(), [F.col(prompt)], "_i").withColumn("_i", F.col("_i") - 1))
    n, spark = numbered.count(), prompts.sparkSession

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep in batch.column(0).to_pylist():
                w, head = np.zeros(n, np.int64), f"{seed}:{rep}:"
                for low in range(0, n, SLOTS):
                    slots = range(low, min(low + SLOTS, n))
                    at = np.fromiter((int(hashlib.md5(f"{head}{i}".encode()).hexdigest()[:12], 16) for i in slots), np.int64, len(slots)) % n
                    w += np.bincount(at, minlength=n)
                for low in range(0, n, BLOCK):
                    for lane, part in enumerate(_bytes(w[low : low + BLOCK])):
                        yield pa.RecordBatch.from_arrays([pa.array([low]), pa.array([lane], pa.int32()), pa.array([rep], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["_low", "_lane", "rep", "w"])

    def turn(block: pa.Table) -> pa.Table:
        low, lane = block.column(0)[0].as_py(), block.column(1)[0].as_py()
        size = len(block.column(3)[0].as_buffer())
        w = np.zeros((size, replicates), np.uint8)
        for rep, part in zip(block.column(2).to_pylist(), block.column(3), strict=True):
            w[:, rep] = np.frombuffer(part.as_buffer(), np.uint8)
        some = np.flatnonzero(w.any(axis=1)) if lane else np.arange(size)
        return pa.table({"_i": pa.array(low + some, pa.int64()), "w": pa.array([w[i].tobytes() for i in some.tolist()], pa.binary())})

    tasks = max(1, min(replicates, 4 * spark.sparkContext.defaultParallelism))
    drawn = spark.range(0, replicates, 1, tasks).mapInArrow(draw, "_low long, _lane int, rep long, w binary") if n else spark.createDataFrame([], "_low long, _lane int, rep long, w binary")
    return written(drawn.groupBy("_low", "_lane").applyInArrow(turn, "_i long, w binary").join(numbered, "_i").select(prompt, "w"))


def _bytes(w: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers as bytes that add up to them, one array at least."""
    while True:
        yield np.minimum(w, 255).astype(np.uint8)
        w = np.maximum(w - 255, 0)
        if not w.any():
            return


def bootstrap_weights(prompts: DataFrame, replicates: int = REPLICATES, seed: int = 42, prompt: str = "prompt_id") -> DataFrame:
    """(rep, prompt, w): how often each prompt is drawn in a replicate, with replacement, n draws each; prompts that are not drawn have no row."""
    packed = packed_weights(prompts, replicates, seed, prompt)
    kind = packed.schema[prompt].dataType.simpleString()

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, CHUNK // replicates)
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                w = _matrix(batch.column(1), replicates)
                row, rep = np.nonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array(rep, pa.int32()), batch.column(0).take(pa.array(row)), pa.array(w[row, rep], pa.int64())], names=["rep", prompt, "w"])

    rows = packed.repartition(max(1, -(-packed.count() // BLOCK)), prompt).mapInArrow(spell, f"rep int, `{prompt}` {kind}, w long")
    return rows if replicates * packed.count() == 0 or not _overfull(packed, prompt) else rows.groupBy("rep", prompt).agg(F.sum("w").alias("w"))


def _overfull(packed: DataFrame, prompt: str) -> bool:
    """Whether a prompt has more than one row."""
    return bool(packed.groupBy(prompt).count().where("count > 1").limit(1).count())


def weight_arrays(weights: DataFrame, replicates: int = REPLICATES, prompt: str = "prompt_id") -> DataFrame:
    """(prompt, w) with bytes, as ``packed_weights`` has them, of (rep, prompt, w) with numbers."""
    if weights.schema["w"].dataType.typeName() == "binary":
        return weights
    kind = weights.schema[prompt].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, drawn in enumerate(batch.column(1).to_pylist()):
                w = np.zeros(replicates, np.int64)
                np.add.at(w, [x["rep"] for x in drawn], [x["w"] for x in drawn])
                for part in _bytes(w):
                    keys.append(i)
                    rows.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(rows, pa.binary())], names=[prompt, "w"])

    return weights.groupBy(prompt).agg(F.collect_list(F.struct("rep", "w")).alias("_m")).mapInArrow(pack, f"`{prompt}` {kind}, w binary")


def _matrix(column: pa.Array, replicates: int) -> np.ndarray:
    """Rows by replicates of a column of bytes."""
    _, off, data = column.buffers()
    at = np.frombuffer(off, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].reshape(-1, replicates)


def _ranges(replicates: int) -> Callable:
    """(group, score, p, n, w) in order to one row a group: its positives, negatives and pairs won within this range, for each replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = lambda: np.zeros(replicates)
        at, last, pos, neg, won, tied_pos, tied_neg = None, None, zero(), zero(), zero(), zero(), zero()
        for whole in batches:
            step = max(1, CHUNK // replicates)
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                group, score = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                w = _matrix(batch.column(4), replicates).astype(float)
                new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (score[1:] != score[:-1])]))
                p, n = (np.add.reduceat(w * batch.column(c).to_numpy()[:, None], new, axis=0) for c in (2, 3))
                group, score, k, i = group[new], score[new], len(new), 0
                if (group[0], score[0]) == (at, last):
                    tied_pos, tied_neg, i = tied_pos + p[0], tied_neg + n[0], 1
                if i == k:
                    continue
                won = won + tied_pos * (neg + tied_neg * 0.5)
                pos, neg = pos + tied_pos, neg + tied_neg
                for a, b in itertools.pairwise([i, *(i + 1 + np.flatnonzero(group[i + 1 :] != group[i:-1])).tolist(), k]):
                    if group[a] != at:
                        if at is not None:
                            yield _range_row(at, pos, neg, won)
                        at, pos, neg, won = int(group[a]), zero(), zero(), zero()
                    some = slice(a, min(b, k - 1))  # the last score may go on in the next batch
                    below = neg + np.cumsum(n[some], axis=0) - n[some] * 0.5
                    won = won + (p[some] * below).sum(axis=0)
                    pos, neg = pos + p[some].sum(axis=0), neg + n[some].sum(axis=0)
                last, tied_pos, tied_neg = score[-1], p[-1], n[-1]
        if at is not None:
            yield _range_row(at, pos + tied_pos, neg + tied_neg, won + tied_pos * (neg + tied_neg * 0.5))

    return run


def _range_row(group: int, *sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in sums)], names=["_g", "_pos", "_neg", "_won"])


def weighted_auroc(rows: DataFrame, weights: DataFrame, score: str, label: str, by: list[str] | None = None, replicates: int = REPLICATES, prompt: str = "prompt_id") -> DataFrame:
    """AUROC for each replicate (and group): by, rep, n_pos, n_neg, auroc, null where a class is missing. ``weights``: (rep, prompt, w), or ``packed_weights``."""
    by = by or []
    y = F.col(label)
    cells = rows.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(*by, prompt, F.col(score).cast("double").alias("_s")).agg(F.count_if(y == 1).alias("_p"), F.count_if(y == 0).alias("_n"))
    group = F.xxhash64(*by) if by else F.lit(0).cast("long")  # a number that names the group for the ordered pass
    drawn = cells.join(weight_arrays(weights, replicates, prompt), prompt).select(group.alias("_g"), "_s", "_p", "_n", "w")
    ranged = drawn.repartitionByRange("_g", "_s").sortWithinPartitions("_g", "_s").mapInArrow(_ranges(replicates), "_g long, _pos array<double>, _neg array<double>, _won array<double>")
    each = ranged.withColumn("_range", F.spark_partition_id()).select("_g", "_range", F.posexplode(F.arrays_zip("_pos", "_neg", "_won")).alias("rep", "x"))
    below = Window.partitionBy("_g", "rep").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("_g", "rep", "x._pos", "x._neg", (F.col("x._won") + F.col("x._pos") * F.coalesce(F.sum("x._neg").over(below), F.lit(0.0))).alias("_won"))
    out = each.groupBy("_g", "rep").agg(F.sum("_pos").cast("long").alias("n_pos"), F.sum("_neg").cast("long").alias("n_neg"), F.sum("_won").alias("_won"))
    if by:
        out = out.join(cells.select(*by).distinct().withColumn("_g", group), "_g")
    return out.select(*by, "rep", "n_pos", "n_neg", F.try_divide("_won", (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("auroc"))


def interval(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Mean, 2.5 and 97.5 percentile, share above 0 over replicates."""
    return values.where(F.col(value).isNotNull()).groupBy(*(by or [])).agg(
        F.avg(value).alias("mean"), F.percentile(value, 0.025).alias("low"), F.percentile(value, 0.975).alias("high"), F.avg((F.col(value) > 0).cast("double")).alias("share_positive"), F.count("*").alias("n_reps")
    )


def spread_difference(rows: DataFrame, weights: DataFrame, score: str, label: str, bin_a: str, bin_b: str, replicates: int = REPLICATES, prompt: str = "prompt_id") -> DataFrame:
    """Per replicate: spread of AUROC over the bins of one axis less that over another's."""
    one = spread(weighted_auroc(rows.where(F.col(bin_a).isNotNull()), weights, score, label, [bin_a], replicates, prompt), "auroc", ["rep"], "da").select("rep", "da")
    two = spread(weighted_auroc(rows.where(F.col(bin_b).isNotNull()), weights, score, label, [bin_b], replicates, prompt), "auroc", ["rep"], "db").select("rep", "db")
    return one.join(two, "rep").select("rep", (F.col("da") - F.col("db")).alias("difference"))


def lift(rows: DataFrame, weights: DataFrame, with_: str, without: str, label: str, by: list[str] | None = None, replicates: int = REPLICATES, prompt: str = "prompt_id") -> DataFrame:
    """Per replicate (and group): AUROC of one score less that of another."""
    keys = [*(by or []), "rep"]
    one = weighted_auroc(rows, weights, with_, label, by, replicates, prompt).select(*keys, F.col("auroc").alias("a"))
    two = weighted_auroc(rows, weights, without, label, by, replicates, prompt).select(*keys, F.col("auroc").alias("b"))
    return one.join(two, keys).select(*keys, (F.col("a") - F.col("b")).alias("lift"))
