"""Exact deduplication with a log-structured merge index of text digests.

Tasks fill memtables (digest -> text, identifier, count; texts are compared
byte by byte on every hit).  A full memtable is flushed as runs, one a digest
range, each sorted and with a Bloom filter.  Compaction merges the runs of a
range tier by tier, keeps one identifier a digest and marks digests that more
than one run holds; those hits are compared byte by byte before they count.

A group of copies enters compaction once a memtable, however large it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import buckets
from .textcore import splitmix

MEMTABLE_BYTES = 16 << 20
MEMTABLE_ROWS = 50_000
FAN_IN = 8
FILTER_BITS = 10
RUN = "part int, run long, digests binary, ids binary, counts binary, filter binary"


def sha256(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def bloom(keys: np.ndarray) -> np.ndarray:
    """A filter of about FILTER_BITS bits a key, three probes each."""
    bits = np.zeros(max(64, 1 << int(np.ceil(np.log2(max(len(keys), 1) * FILTER_BITS)))), bool)
    for i in range(3):
        bits[splitmix(keys + np.uint64(i)) & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits)


def may_hold(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(filter_)
    held = np.ones(len(keys), bool)
    for i in range(3):
        held &= bits[splitmix(keys + np.uint64(i)) & np.uint64(len(bits) - 1)] > 0
    return held


class Run:
    """Sorted digests (rows of four big-endian words) with identifiers, counts, and whether another entry has the digest."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, hit: np.ndarray | None = None, filter_: np.ndarray | None = None):
        order = np.lexsort((ids, *digests.T[::-1]))
        self.digests, self.ids, self.counts = digests[order].astype(">u8"), ids[order], counts[order]
        self.hit = np.zeros(len(ids), bool) if hit is None else hit[order]
        same = (self.digests[1:] == self.digests[:-1]).all(1)
        self.hit[1:] |= same
        self.hit[:-1] |= same
        self.keys = self.digests[:, 0].astype(np.uint64)
        self.filter = bloom(self.keys) if filter_ is None else filter_

    def holds(self, other: Run) -> np.ndarray:
        """Which digests of ``other`` this run has: the filter first, then binary search."""
        out = np.zeros(len(other.ids), bool)
        may = np.flatnonzero(may_hold(self.filter, other.keys))
        at, stop = (np.searchsorted(self.keys, other.keys[may], side) for side in ("left", "right"))
        while len(may):
            live = at < stop
            may, at, stop = may[live], at[live], stop[live]
            out[may] |= (self.digests[at] == other.digests[may]).all(1)
            at = at + 1
        return out


def merged(runs: list[Run]) -> Run:
    """One run of several; digests that two of them hold are hits."""
    out = runs[0]
    for run in runs[1:]:
        old, new = out.hit | run.holds(out), run.hit | out.holds(run)
        both = [np.concatenate([getattr(out, k), getattr(run, k)]) for k in ("digests", "ids", "counts")]
        out = Run(*both, np.concatenate([old, new]))
    return out


def flush(table: dict[bytes, list[list]], run: int, parts: int) -> pa.RecordBatch | None:
    """A memtable's runs, one a digest range that it has rows in."""
    rows = [(d, x[1], x[2]) for d, classes in table.items() for x in classes]
    if not rows:
        return None
    digests = np.frombuffer(b"".join(r[0] for r in rows), ">u8").reshape(-1, 4)
    ids, counts = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    part = (digests[:, 0].astype(np.uint64) >> np.uint64(32)).astype(np.int64) * parts >> 32
    out: dict[str, list] = {k: [] for k in ("part", "run", "digests", "ids", "counts", "filter")}
    for p in np.unique(part):
        r = Run(digests[part == p], ids[part == p], counts[part == p])
        for k, v in zip(out, (int(p), run, r.digests.tobytes(), r.ids.tobytes(), r.counts.tobytes(), r.filter.tobytes()), strict=True):
            out[k].append(v)
    return pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), pa.array(out["run"], pa.int64()), *(pa.array(out[k], pa.binary()) for k in ("digests", "ids", "counts", "filter"))], names=list(out))


def memtables(parts: int, best: Callable[[int, int], int], digest: Callable[[bytes], bytes]) -> Callable:
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        run, table, held, rows = (context.partitionId() if context else 0) << 32, {}, 0, 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                classes = table.setdefault(digest(data), [])
                for x in classes:
                    if x[0] == data:
                        x[1], x[2] = best(x[1], doc.as_py()), x[2] + 1
                        break
                else:
                    classes.append([data, doc.as_py(), 1])
                    held, rows = held + len(data), rows + 1
                if held >= MEMTABLE_BYTES or rows >= MEMTABLE_ROWS:
                    if (out := flush(table, run, parts)) is not None:
                        yield out
                    run, table, held, rows = run + 1, {}, 0, 0
        if (out := flush(table, run, parts)) is not None:
            yield out

    return fill


def compact(pdf: pd.DataFrame) -> pd.DataFrame:
    """The runs of one range as rows (digest, id, n, hit); hit: some other entry has the digest."""
    tier = [
        Run(np.frombuffer(r.digests, ">u8").reshape(-1, 4), np.frombuffer(r.ids, np.int64), np.frombuffer(r.counts, np.int64), None, np.frombuffer(r.filter, np.uint8))
        for r in pdf.sort_values("run").itertuples()
    ]
    while len(tier) > 1:
        tier = [merged(tier[i : i + FAN_IN]) for i in range(0, len(tier), FAN_IN)]
    run = tier[0]
    return pd.DataFrame({"digest": [x.tobytes() for x in np.ascontiguousarray(run.digests)], "id": run.ids, "n": run.counts, "hit": run.hit})


def index(docs: DataFrame, keep: str = "smallest", parts: int | None = None, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """The compacted index of (doc_id, text): digest, id, n, hit."""
    parts = parts or buckets(docs.sparkSession)
    return (
        docs.select("doc_id", "text")
        .mapInArrow(memtables(parts, min if keep == "smallest" else max, digest), RUN)
        .groupBy("part")
        .applyInPandas(lambda pdf: compact(pdf), "digest binary, id long, n long, hit boolean")
    )


def exact_dedup(docs: DataFrame, keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, parts: int | None = None, digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are, after ``normalise``, whatever their
    length.  A null text counts as empty.  Rows without a doc_id belong to
    their group, but give way to any that has one; a group of nothing else has
    no keep_id and is kept.  Rows that share a doc_id and a text stand or fall
    together, so ties need no rule; an empty table gives no rows.  Other
    columns, whatever their names, are not looked at.
    ``digest`` must give 32 bytes; for any but SHA-256, texts that share a
    digest without being equal are told apart by their bytes.
    """
    best = F.min if keep == "smallest" else F.max
    nameless = F.lit((1 << 63) - 1 if keep == "smallest" else -(1 << 63)).cast("long")  # an id that any other beats
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), nameless).alias("doc_id"), (normalise(text) if normalise else text).alias("text"))
    found = index(docs, keep, parts, digest)
    tag = F.unhex(F.sha2("text", 256)) if digest is sha256 else F.udf(digest, "binary")(F.encode("text", "UTF-8"))
    keyed = docs.withColumn("digest", tag)
    alone = found.where("not hit").select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    hits = found.where("hit").groupBy("digest", F.col("id").alias("doc_id")).agg(F.sum("n").alias("n"))
    # Byte verification: grouping on the text itself compares whole texts.
    classes = keyed.join(hits, ["doc_id", "digest"]).groupBy("digest", "text", "doc_id").agg(F.max("n").alias("n"))
    classes = classes.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    digests = classes.groupBy("digest").agg(F.count("*").alias("classes"), best("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    table = alone.union(digests.where("classes = 1").drop("classes"))
    out = keyed.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256")).join(table, "digest").drop("digest")
    if digest is not sha256:  # members of a digest that unequal texts share are told apart by their texts
        mixed = keyed.join(digests.where("classes > 1").select("digest"), "digest", "left_semi")
        exact = mixed.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        out = out.union(mixed.join(exact, ["digest", "text"]).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size"))
    named = lambda c: F.nullif(F.col(c), nameless).alias(c)
    return out.select(named("doc_id"), named("keep_id"), F.col("group_size").cast("long").alias("group_size"), (F.col("doc_id") == F.col("keep_id")).alias("kept"), "text_sha256")
