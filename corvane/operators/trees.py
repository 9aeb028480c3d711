"""Trees that grow in one task each, a forest, or one after the other in a task a fold, boosting: level by level, on binned columns.

A task holds a byte a value of all rows, and rows' places in the tree it grows;
all nodes of a level are split at once from one histogram, a bounded number of
nodes at a time.  A tree scores its fold as soon as it stands and is let go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: As Spark's own forest has them: trees, levels, bins; leaves are pure or can't be split well before the last level.
TREES, MAX_DEPTH, BINS, SEED = 200, 30, 32, 42
#: Boosting has so many trees of so many levels; all but the first count so much.
ROUNDS, LEVELS, RATE = 150, 3, 0.1
#: Nodes whose histograms are held at once.
NODES = 1 << 14
#: Precision of the borders of bins, as a share of the rows.
BORDER_ERROR = 0.001


def grow(bins: np.ndarray, y: np.ndarray, weight: np.ndarray, scored: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The share of label 1 in the leaf of each row of ``scored``, of a tree grown on rows of ``weight`` > 0. ``bins``: columns by rows."""
    columns = len(bins)
    picked = max(1, int(np.ceil(np.sqrt(columns))))
    rows = np.concatenate([np.flatnonzero(weight), scored])
    train = int(np.count_nonzero(weight))
    w = np.zeros(len(rows))
    w[:train] = weight[rows[:train]]
    w1 = w * (y[rows] == 1)
    node, nodes = np.zeros(len(rows), np.int64), 1
    active = np.arange(len(rows))
    share = np.zeros(len(rows))
    for depth in range(MAX_DEPTH + 1):
        here = node[active]
        total, ones = (np.bincount(here, x[active], nodes) for x in (w, w1))
        impure = (ones > 0) & (ones < total)
        best, column, border = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
        if depth < MAX_DEPTH:
            order = np.argsort(here, kind="stable")
            first = np.searchsorted(here[order], np.arange(0, nodes + NODES, NODES))
            for low in range(0, nodes, NODES):
                part = order[first[low // NODES] : first[low // NODES + 1]]
                part = part[(w[active[part]] > 0) & impure[here[part]]]
                if not len(part):
                    continue
                n = min(NODES, nodes - low)
                some, at = active[part], here[part] - low
                mine = np.argsort(rng.random((n, columns)), axis=1)[:, :picked]
                for k in range(picked):
                    key = at * BINS + bins[mine[at, k], rows[some]]
                    a, b = (np.bincount(key, x[some], n * BINS).reshape(n, BINS).cumsum(axis=1)[:, :-1] for x in (w, w1))
                    t, o = total[low : low + n, None], ones[low : low + n, None]
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = b * b / a + (a - b) ** 2 / a + (o - b) ** 2 / (t - a) + ((t - a) - (o - b)) ** 2 / (t - a) - (o * o + (t - o) ** 2) / t
                    gain = np.where((a > 0) & (a < t), gain, 0)
                    top = gain.argmax(axis=1)
                    value = gain[np.arange(n), top]
                    better = value > np.maximum(best[low : low + n], 1e-12 * t[:, 0])
                    for out, new in ((best, value), (column, mine[:, k]), (border, top)):
                        out[low : low + n] = np.where(better, new, out[low : low + n])
        split = best > 0
        ends = ~split[here]
        share[active[ends]] = (ones / np.maximum(total, 1e-300))[here[ends]]
        active, here = active[~ends], here[~ends]
        if not len(active):
            break
        number = np.cumsum(split) - 1
        node[active] = 2 * number[here] + (bins[column[here], rows[active]] > border[here])
        nodes = 2 * int(split.sum())
    return share[train:]


def split_points(values: np.ndarray) -> np.ndarray:
    """Where a column may be split, in the middle between values: at even shares of the rows, as Spark's trees have it, but judged on all of them."""
    distinct, counts = np.unique(values, return_counts=True)
    middle, most = (distinct[:-1] + distinct[1:]) / 2, min(BINS, len(values)) - 1
    if len(middle) <= most:
        return middle
    seen = np.cumsum(counts)
    around = (seen[:-1] + seen[1:]) / 2
    picked, stride, i = [], len(values) / (most + 1), 0
    while (i := i + int(np.searchsorted(around[i:], (len(picked) + 1) * stride, "right"))) < len(middle):
        picked.append(middle[i])
        i += 1
    return np.array(picked)


def boost(x: list[np.ndarray], y: np.ndarray, train: np.ndarray, scored: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The probability of label 1 of the rows ``scored``: regression trees on the gradient of the logistic loss over the rows ``train``, as Spark boosts."""
    mine, theirs = np.empty((len(x), len(train)), np.uint8), np.empty((len(x), len(scored)), np.uint8)
    for k, values in enumerate(x):
        edges = split_points(values[train])
        mine[k], theirs[k] = np.searchsorted(edges, values[train]), np.searchsorted(edges, values[scored])
    sign = 2.0 * y[train] - 1
    aim, margin, out = sign, np.zeros(len(train)), np.zeros(len(scored))
    for tree in range(rounds):
        at, to = np.zeros(len(train), np.int64), np.zeros(len(scored), np.int64)
        for level in range(LEVELS):
            nodes = 1 << level
            # What can't be split goes on whole, as the lower half.
            best, column, border = np.zeros(nodes), np.zeros(nodes, np.int64), np.full(nodes, BINS)
            for k in range(len(x)):
                key = at * BINS + mine[k]
                a, b = (np.bincount(key, w, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1) for w in (None, aim))
                n, total, a, b = a[:, -1:], b[:, -1:], a[:, :-1], b[:, :-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((a > 0) & (a < n), b * b / a + (total - b) ** 2 / (n - a) - total * total / n, 0)
                top = gain.argmax(axis=1)
                value = gain[np.arange(nodes), top]
                better = value > best
                best, column, border = np.where(better, value, best), np.where(better, k, column), np.where(better, top, border)
            at = 2 * at + (mine[column[at], np.arange(len(at))] > border[at])
            to = 2 * to + (theirs[column[to], np.arange(len(to))] > border[to])
        leaf = (RATE if tree else 1.0) * np.bincount(at, aim, 1 << LEVELS) / np.maximum(np.bincount(at, None, 1 << LEVELS), 1)
        margin, out = margin + leaf[at], out + leaf[to]
        with np.errstate(over="ignore"):
            aim = 4 * sign / (1 + np.exp(2 * sign * margin))
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-2 * out))


def _packed(numbered: DataFrame, inputs: list[Column], y: Column, kind: str) -> DataFrame:
    """(row, fold, y, x): rows as columns of packed numbers, labels and inputs of ``kind``, which go to every task. A task joins the parts in the order of their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in [b.column(0).to_numpy().astype("<i8").tobytes(), np.asarray(b.column(1)).astype(np.uint8).tobytes(), np.asarray(b.column(2)).astype(kind).tobytes(), np.stack([np.asarray(c) for c in b.columns[3:]]).astype(kind).tobytes()]], names=["row", "fold", "y", "x"])

    parts = numbered.select("_row", "fold", y.alias("_y"), *[c.alias(f"_x{i}") for i, c in enumerate(inputs)])
    return written(parts.mapInArrow(run, "row binary, fold binary, y binary, x binary"))


def _joined(table: pa.Table, columns: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, fold, y, x: columns by rows) of packed parts."""
    flat = lambda c, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(c)]
    row, of, y = np.concatenate(flat("row", "<i8")), np.concatenate(flat("fold", np.uint8)), np.concatenate(flat("y", kind))
    x = np.concatenate([p.reshape(columns, -1) for p in flat("x", kind)], axis=1)
    order = np.argsort(row, kind="stable")
    return row[order], of[order], y[order], np.ascontiguousarray(x[:, order])


def forest_scores(clean: DataFrame, keep: list[str], columns: int, folds: int) -> DataFrame:
    """``keep`` and ``score``, the mean share of label 1 over the trees that did not see the row's fold. ``clean``: fold, _y and the inputs _x0, _x1 ..."""
    spark = clean.sparkSession
    names = [f"_x{i}" for i in range(columns)]
    borders = [sorted(set(b)) for b in clean.approxQuantile(names, [i / BINS for i in range(1, BINS)], BORDER_ERROR)]
    over = lambda c, edges: F.size(F.filter(F.array(*[F.lit(float(b)) for b in edges]).cast("array<double>"), lambda b: b < F.col(c))).cast("byte")
    binned = [over(c, edges) for c, edges in zip(names, borders, strict=True)]
    numbered = written(clean.withColumn("_row", F.monotonically_increasing_id()))
    parts = _packed(numbered, binned, F.col("_y").cast("byte"), "u1")
    groups = max(1, min(TREES, 3 * spark.sparkContext.defaultParallelism // folds))
    tasks = spark.range(folds * groups).select((F.col("id") % folds).cast("int").alias("_fold"), F.expr(f"id div {folds}").cast("int").alias("_group"))

    def run(table: pa.Table) -> pa.Table:
        fold, group = table.column("_fold")[0].as_py(), table.column("_group")[0].as_py()
        row, of, y, x = _joined(table, columns, "u1")
        mine, total = np.flatnonzero(of == fold), 0.0
        for tree in range(group, TREES, groups):
            rng = np.random.default_rng([SEED, fold, tree])
            total = total + grow(x, y, np.where(of == fold, 0, rng.poisson(1.0, len(row))), mine, rng)
        return pa.table({"_row": row[mine], "_sum": pa.array(np.broadcast_to(total, len(mine)), pa.float64())})

    sums = parts.crossJoin(F.broadcast(tasks)).repartition(2 * folds * groups, "_fold", "_group").groupBy("_fold", "_group").applyInArrow(run, "_row long, _sum double")
    mean = sums.groupBy("_row").agg((F.sum("_sum") / TREES).alias("score"))
    return numbered.join(mean, "_row").select(*keep, "score")


def boosting_scores(clean: DataFrame, keep: list[str], columns: int, folds: int) -> DataFrame:
    """``keep`` and ``score``, the probability of label 1 by trees that did not see the row's fold; a task boosts for one fold. ``clean``: fold, _y and the inputs _x0, _x1 ..."""
    numbered = written(clean.withColumn("_row", F.monotonically_increasing_id()))
    parts = _packed(numbered, [F.col(f"_x{i}") for i in range(columns)], F.col("_y"), "<f8")
    each = F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_fold")

    def run(table: pa.Table) -> pa.Table:
        fold = table.column("_fold")[0].as_py()
        row, of, y, x = _joined(table, columns, "<f8")
        if not np.isin(y, (0, 1)).all():
            raise ValueError("labels must be 0 or 1")
        mine, rest = np.flatnonzero(of == fold), np.flatnonzero(of != fold)
        if len(mine) and not len(rest):
            raise ValueError(f"no rows to learn from besides fold {fold}")
        score = boost(list(x), y, rest, mine) if len(mine) else np.zeros(0)
        return pa.table({"_row": row[mine], "score": score})

    # Among so many partitions folds seldom meet in one.
    scores = parts.select("*", each).repartition(16 * folds, "_fold").groupBy("_fold").applyInArrow(run, "_row long, score double")
    return numbered.join(scores, "_row").select(*keep, "score")
