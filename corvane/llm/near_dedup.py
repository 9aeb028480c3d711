"""MinHash near-duplicates by trees over pairs of minwise units.

Every distinct shingle set is placed in nodes of ``trees`` independent trees.
Each tree has UNITS units of UNIT minwise coordinates of its own, and a node for
every two units, named by the set's minimal tokens at both: two sets meet in a
tree if they agree in two of its units.  At similarity 0.8 a unit agrees with
probability 0.512, so a tree misses the pair with 0.173 and all 8 with 8.0e-7;
at 0.82 it is 8.1e-8, at 0.85 1.2e-9.  The nodes of a set depend on no other set,
so placing takes one pass.

Each set is first compared with one leader; members that verified links already
join need no further comparison among themselves.  What still lies in different
components of a node is compared exhaustively, within one task, in nodes of
bounded size.  Larger nodes first compare one member of each component with some
of the largest one; if several components are left, the members outside the
largest are dealt into blocks that meet each other block of the node, each two a
node, so that no pair is lost.  Links are looked for
with 64-bit hashes of the shingles and each that is found is confirmed on the
words of both whole texts.

Every step is a job of its own over tables written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import components, drop, written
from .textcore import doc_shingles, slices, splitmix, utf8, word_shingles

UNIT = 3
UNITS = 5
TREES = 8
COORDINATES = UNIT * UNITS * TREES
#: Nodes of up to so many sets and bytes of text are compared in one task.
NODE_SETS = 1024
NODE_BYTES = 16 << 20
#: How many members of its largest component the others of a wide node meet before blocks of them are compared.
STARS = 3
#: Standard errors of the signature's estimate by which a candidate may miss the threshold: 1.7e-8 of pairs at 0.8 miss it by more.
SLACK = 6.0

_A = (splitmix(np.arange(COORDINATES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (splitmix(np.arange(1000, 1000 + COORDINATES, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def signatures(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) minimal token hashes; texts without tokens get the largest value."""
    out = np.full((len(offsets) - 1, COORDINATES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        h = (grams >> np.uint64(32)).astype(np.uint32) ^ grams.astype(np.uint32)
        starts = offsets[:-1][full]
        with np.errstate(over="ignore"):
            for j in range(COORDINATES):
                v = (h ^ _B[j]) * _A[j]
                v ^= v >> np.uint32(15)
                out[full, j] = np.minimum.reduceat(v * np.uint32(0x2C1B3C6D), starts)
    return out


def sketch(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in slices(off):
                grams, at, second = doc_shingles(buf, off[i : j + 1], shingle, lanes=2)
                n = np.diff(at)
                sums = []  # one of each independent hash: 128 bits name a set
                with np.errstate(over="ignore"):
                    for lane in (grams, second):
                        total = np.zeros(len(lane) + 1, np.uint64)
                        np.cumsum(splitmix(lane), out=total[1:])
                        sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), *map(pa.array, sums), pa.array([x.tobytes() for x in signatures(grams, at)], pa.binary())],
                    names=["doc_id", "n", "k1", "k2", "sig"],
                )

    return run


def nodes_of(sig: np.ndarray, tree: int) -> Iterator[np.ndarray]:
    """The node of every set for each two units of a tree."""
    units = []
    for u in range(UNITS):
        x = np.full(len(sig), splitmix(np.uint64(7_000_000 + tree * UNITS + u)), np.uint64)
        for c in range((tree * UNITS + u) * UNIT, (tree * UNITS + u + 1) * UNIT):
            x = splitmix(x ^ sig[:, c].astype(np.uint64))
        units.append(x)
    for i in range(UNITS):
        for j in range(i):
            yield splitmix(units[i] ^ splitmix(units[j]))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def plant(trees: int) -> Callable:
    """The nodes of each set in every tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, ids = _matrix(batch.column(1)), batch.column(0).to_numpy()
            for tree in range(trees):
                for nodes in nodes_of(sig, tree):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(ids)], names=["node", "id"])

    return run


def likely(percent: int) -> Callable:
    """Pairs whose sizes and signatures allow the threshold."""
    p = percent / 100
    least = (p - SLACK * np.sqrt(p * (1 - p) / COORDINATES)) * COORDINATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                agree = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(agree >= least))

    return run


def linked(one: bytes, two: bytes, shingle: int, percent: int) -> bool:
    """Whether the shingles of two whole texts, as words, reach the threshold."""
    a, b = word_shingles(one, shingle), word_shingles(two, shingle)
    shared = len(a & b)
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def confirmed(shingle: int, percent: int) -> Callable:
    """Pairs (a, b, text_a, text_b) whose whole shingle sets reach the threshold: by hashes first, then by words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (one, off1), (two, off2) = utf8(batch.column(2)), utf8(batch.column(3))
            for i, j in slices(off1 + off2):
                (g1, at1), (g2, at2) = doc_shingles(one, off1[i : j + 1], shingle), doc_shingles(two, off2[i : j + 1], shingle)
                n1, n2 = np.diff(at1), np.diff(at2)
                owner = np.concatenate([np.repeat(np.arange(j - i), n1), np.repeat(np.arange(j - i), n2)])
                grams = np.concatenate([g1, g2])
                order = np.lexsort((grams, owner))
                grams, owner = grams[order], owner[order]
                shared = np.bincount(owner[1:][(grams[1:] == grams[:-1]) & (owner[1:] == owner[:-1])], minlength=j - i)
                link = 100 * shared >= percent * (n1 + n2 - shared)
                for d in np.flatnonzero(link):
                    link[d] = linked(one[off1[i + d] : off1[i + d + 1]].tobytes(), two[off2[i + d] : off2[i + d + 1]].tobytes(), shingle, percent)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)], names=["a", "b"]).filter(pa.array(link))

    return run


def by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each node, from batches sorted by their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        node = batch.column(0).to_numpy()
        cuts = np.flatnonzero(node[1:] != node[:-1]) + 1
        if held and held[0].column(0)[0].as_py() != node[0]:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *cuts.tolist(), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(i, j - i))
            if j < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def plausible(percent: int) -> Callable:
    """(node, id, component, n, sig) to the members that sizes and signatures allow a link to another component of the node."""
    p = percent / 100
    least = (p - SLACK * np.sqrt(p * (1 - p) / COORDINATES)) * COORDINATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_node(batches):
            component, n, sig = rows.column(2).to_numpy(), rows.column(3).to_numpy(), _matrix(rows.column(4))
            z = len(n)
            active = np.zeros(z, bool)
            step = max(1, (1 << 22) // (z * COORDINATES))
            for i in range(0, z, step):
                j = min(z, i + step)
                ok = (component[i:j, None] != component) & (100 * np.minimum(n[i:j, None], n) >= percent * np.maximum(n[i:j, None], n))
                if ok.any():
                    ok &= (sig[i:j, None, :] == sig).sum(2) >= least
                    active[i:j] |= ok.any(1)
            if active.any():
                yield from rows.select([0, 1, 2]).filter(pa.array(active)).combine_chunks().to_batches()

    return run


def compared(shingle: int, percent: int) -> Callable:
    """(node, id, component, text) to links between components of each node, on whole sets.

    Every member outside the largest component meets all members of other
    components; links that others already imply within the node are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_node(batches):
            ids, component = rows.column(1).to_numpy(), rows.column(2).to_numpy()
            buf, off = utf8(rows.column(3))
            parts = [(i, *doc_shingles(buf, off[i : j + 1], shingle)) for i, j in slices(off)]
            size = np.concatenate([np.diff(at) for _, _, at in parts])
            owner = np.repeat(np.arange(len(ids)), size)
            _, gram = np.unique(np.concatenate([g for _, g, _ in parts]), return_inverse=True)
            order = np.argsort(gram, kind="stable")
            posting, count = owner[order], np.bincount(gram)
            begin = np.cumsum(count) - count
            at = np.concatenate([[0], np.cumsum(size)])
            _, label, members = np.unique(component, return_inverse=True, return_counts=True)
            links = []
            for i in np.flatnonzero(label != members.argmax()):
                other = label != label[i]
                if not other.any():
                    continue
                mine = gram[at[i] : at[i + 1]]
                spread = np.repeat(begin[mine] - np.cumsum(count[mine]) + count[mine], count[mine]) + np.arange(int(count[mine].sum()))
                shared = np.bincount(posting[spread], minlength=len(ids))
                for j in np.flatnonzero(other & (100 * shared >= percent * (size + size[i] - shared))):
                    if label[j] != label[i] and linked(buf[off[i] : off[i + 1]].tobytes(), buf[off[j] : off[j + 1]].tobytes(), shingle, percent):
                        links.append((ids[i], ids[j]))
                        label[label == label[j]] = label[i]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, trees: int = TREES, node_sets: int = NODE_SETS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their sets of distinct
    ``shingle``-word shingles (ASCII capitals as small letters, words between
    ASCII white space) is ``percent``/100 or more; component_id is the smallest
    doc_id reachable over links, so ties can't arise.  A text with fewer words
    is one shingle; a null, empty or blank text has no shingles and no link.
    Texts of any length are taken whole.  A row without a doc_id can't be named
    by others: its component_id is null and it is kept.  Repeated rows get a
    row each; rows that share a doc_id but no text are each judged by their own
    text.  Other columns are not looked at.  An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = written(docs.mapInArrow(sketch(shingle), "doc_id long, n long, k1 long, k2 long, sig binary"))
    named = "n > 0 and doc_id is not null"
    # Equal sets are one class from here on, whatever their number.
    classes = sketches.where(named).groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n", "sig")).alias("x"))
    classes = written(classes.select("k1", "k2", F.col("x.doc_id").alias("id"), "x.n", "x.sig"))
    walked = classes.select("id", "sig").mapInArrow(plant(trees), "node long, id long")
    shared = walked.groupBy("node").agg(F.count("*").alias("size"), F.min("id").alias("leader")).where("size > 1").drop("size")
    members = written(walked.join(shared, "node"))
    met = written(members.select("id").distinct())
    sets = written(classes.select("id", "n", "sig").join(met, "id"))
    texts = written(docs.join(met.withColumnRenamed("id", "doc_id"), "doc_id").withColumn("bytes", F.octet_length("text")))
    drop(met)

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b), written."""
        sig = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        text = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
        near = pairs.join(sig("a"), "a").join(sig("b"), "b").where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
        near = written(near.select("a", "b", "sig_a", "sig_b").mapInArrow(likely(percent), "a long, b long"))
        out = near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b")
        out = written(out.mapInArrow(confirmed(shingle, percent), "a long, b long"))
        drop(near)
        return out

    def place(members: DataFrame, reached: DataFrame) -> DataFrame:
        """(node, id, component) of the nodes that hold several components, written."""
        placed = members.join(reached, "id", "left").select("node", "id", F.coalesce("component", "id").alias("component"))
        several = placed.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("node")
        return written(placed.join(several, "node"))

    # One link a set first: what that joins needs no comparison among itself.
    links = verified(members.where("id <> leader").groupBy(F.col("id").alias("b")).agg(F.min("leader").alias("a")))
    reached = components(links).withColumnRenamed("node", "id")
    members = members.select("node", "id")
    for last in (False, True):
        placed = place(members, reached)
        sizes = texts.groupBy(F.col("doc_id").alias("id")).agg(F.max("bytes").alias("bytes"))
        nodes = placed.join(sizes, "id").groupBy("node").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes"))
        nodes = written(nodes.withColumn("wide", F.lit(False) if last else (F.col("size") > node_sets) | (F.col("bytes") > NODE_BYTES)))
        close = placed.join(nodes.where("not wide").select("node"), "node").join(sets, "id").select("node", "id", "component", "n", "sig")
        active = written(close.repartition("node").sortWithinPartitions("node").mapInArrow(plausible(percent), "node long, id long, component long"))
        full = active.join(texts.select(F.col("doc_id").alias("id"), "text"), "id").select("node", "id", "component", "text")
        links = links.union(written(full.repartition("node").sortWithinPartitions("node").mapInArrow(compared(shingle, percent), "a long, b long")))
        reached = components(links).withColumnRenamed("node", "id")
        drop(active)
        wide = nodes.where("wide").select("node", F.greatest(F.col("size") / node_sets, F.col("bytes") / NODE_BYTES).alias("fill"), "size")
        if not wide.take(1):
            break
        # The other components of a wide node meet several members of its largest one first: few are left then.
        crowd = placed.join(wide.select("node"), "node")
        for turn in range(STARS):
            crowd = place(crowd.select("node", "id"), reached)
            groups = crowd.groupBy("node", "component").agg(F.count("*").alias("n"), F.min("id").alias("rep"), F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("lead"))
            largest = groups.groupBy("node").agg(F.max(F.struct("n", "component", "lead")).alias("top"))
            stars = groups.join(largest, "node").where("component <> top.component").select(F.col("top.lead").alias("a"), F.col("rep").alias("b"))
            links = links.union(verified(stars.distinct()))
            reached = components(links).withColumnRenamed("node", "id")
        # Blocks of what is left meet all other blocks of the node, two of them, some four fifths of the bounds, being a node;
        # blocks of the largest component need not meet each other.
        crowd = place(crowd.select("node", "id"), reached)
        counts = crowd.groupBy("node", "component").agg(F.count("*").alias("n"))
        largest = counts.groupBy("node").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n")).join(wide, "node")
        share = lambda n: F.ceil(2.5 * F.col("fill") * n / F.col("size")).cast("long")
        largest = largest.select("node", F.col("top.component").alias("major"), share(F.col("top.n")).alias("majors"), share(F.col("n") - F.col("top.n")).alias("minors"))
        dealt = crowd.join(largest, "node").withColumn("is_major", F.col("component") == F.col("major"))
        mine = F.pmod(F.xxhash64("id", F.lit(1)), F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors")))
        others = F.when(F.col("is_major"), F.col("minors")).otherwise(F.col("minors") + F.col("majors"))  # blocks of the largest component are numbered after the rest
        dealt = dealt.withColumn("mine", F.when(F.col("is_major"), F.col("minors")).otherwise(0) + mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
        members = written(dealt.select(F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other")).alias("node"), "id"))
    of_class = classes.select("k1", "k2", "id").join(reached, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component_id"))
    out = sketches.where(named).select("doc_id", "n", "k1", "k2").join(of_class, ["k1", "k2"]).select("doc_id", "n", "component_id")
    out = out.union(sketches.where(f"not ({named})").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))
