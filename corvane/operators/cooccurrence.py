"""How many documents, or places in them, two terms share: in blocks of documents times blocks of pairs.

A task holds one block of each: bitmaps of its documents for the terms, or
sorted places of the terms, against which its pairs are counted.  No row is ever
formed for a pair in a document.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents and pairs that a task takes at most.
DOCS, PAIRS = 1 << 16, 1 << 22
#: Documents of one bitmap; bytes of all bitmaps and of gathered ones.
WIDTH, BITMAP_BYTES, STEP_BYTES = 1 << 14, 64 << 20, 8 << 20
#: With so many documents and pairs a task its overhead still doesn't show.
LEAST = 1 << 10


def _flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows one after the other, how many a row has) of a column of packed numbers."""
    rows = [x.as_buffer() for x in column]
    return np.frombuffer(b"".join(rows), kind), np.array([x.size for x in rows], np.int64) // np.dtype(kind).itemsize


def _documents(docs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(number of the document, term) of each distinct occurrence."""
    number = np.asarray(docs.column("doc").combine_chunks().dictionary_encode().indices, np.int64)
    terms, size = _flat(docs.column("t"), "<i4")
    keys = np.unique(np.repeat(number, size) << 32 | terms)
    return keys >> 32, keys & 0xFFFFFFFF


def shared_documents(docs: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair the documents that hold both."""
    doc, term = _documents(docs)
    used, both = np.unique(np.concatenate([left, right]), return_inverse=True)
    left, right = both[: len(left)], both[len(left) :]
    at = np.minimum(np.searchsorted(used, term), len(used) - 1)
    mine = used[at] == term
    doc, term = doc[mine], at[mine]
    out = np.zeros(len(left), np.int64)
    for low in range(0, int(doc[-1]) + 1 if len(doc) else 0, WIDTH):
        i, j = np.searchsorted(doc, [low, low + WIDTH])
        out += _in_bitmaps(doc[i:j] - low, term[i:j], left, right, len(used))
    return out


def _in_bitmaps(doc: np.ndarray, term: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(term, kind="stable")
    doc, term = doc[order], term[order]
    first = np.searchsorted(term, np.arange(n + 1))
    df = np.diff(first)
    out = np.zeros(len(left), np.int64)
    words = WIDTH // 64
    # Bitmaps go to the most frequent terms, from eight documents on; the rest are looked up document by document.
    wide = np.argsort(-df, kind="stable")[: BITMAP_BYTES // (WIDTH // 8)]
    wide = wide[df[wide] >= 8]
    row = np.full(n, -1, np.int64)
    row[wide] = np.arange(len(wide))
    bits = np.zeros((len(wide), words), np.uint64)
    has = row[term] >= 0
    np.bitwise_or.at(bits.reshape(-1), row[term[has]] * words + (doc[has] >> 6), np.uint64(1) << (doc[has] & 63).astype(np.uint64))
    swap = df[left] > df[right]
    rare, other = np.where(swap, right, left), np.where(swap, left, right)
    dense = np.flatnonzero(row[rare] >= 0)
    step = STEP_BYTES // (WIDTH // 8)
    for i in range(0, len(dense), step):
        k = dense[i : i + step]
        out[k] = np.bitwise_count(bits[row[rare[k]]] & bits[row[other[k]]]).sum(axis=1, dtype=np.int64)
    keys = term << 32 | doc
    rest = np.flatnonzero((row[rare] < 0) & (df[rare] > 0))
    room = np.concatenate([[0], np.cumsum(df[rare[rest]])])
    i = 0
    while i < len(rest):
        j = max(i + 1, int(np.searchsorted(room, room[i] + STEP_BYTES // 8, "right")) - 1)
        k, size = rest[i:j], df[rare[rest[i:j]]]
        begins = np.cumsum(size) - size
        d = doc[np.repeat(first[rare[k]] - begins, size) + np.arange(int(size.sum()))]
        o = np.repeat(other[k], size)
        r, hit = row[o], np.zeros(len(o), bool)
        there = r >= 0
        hit[there] = (bits[r[there], d[there] >> 6] >> (d[there] & 63).astype(np.uint64)) & np.uint64(1)
        want = o[~there] << 32 | d[~there]
        hit[~there] = keys[np.minimum(np.searchsorted(keys, want), len(keys) - 1)] == want
        out[k] = np.add.reduceat(hit, begins, dtype=np.int64)
        i = j
    return out


def close_places(window: int) -> Callable:
    """For each pair the places of both at most ``window`` words apart, document by document."""

    def run(docs: pa.Table, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        number = np.asarray(docs.column("doc").combine_chunks().dictionary_encode().indices, np.int64)
        terms, size = _flat(docs.column("t"), "<i4")
        places, _ = _flat(docs.column("position"), "<i8")
        # Documents stand one behind the other, further apart than the window.
        longest = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
        np.maximum.at(longest, np.repeat(number, size), places + window + 1)
        place = places + (np.cumsum(longest) - longest)[np.repeat(number, size)]
        order = np.lexsort((place, terms))
        terms, place = terms[order], place[order]
        used, both = np.unique(np.concatenate([left, right]), return_inverse=True)
        begin, end = np.searchsorted(terms, used), np.searchsorted(terms, used, "right")
        left, right = both[: len(left)], both[len(left) :]
        out = np.zeros(len(left), np.int64)
        for i in np.flatnonzero((end > begin)[left] & (end > begin)[right]).tolist():
            one, two = (place[begin[x] : end[x]] for x in (left[i], right[i]))
            few, many = (one, two) if len(one) <= len(two) else (two, one)
            out[i] = int((np.searchsorted(many, few + window, "right") - np.searchsorted(many, few - window)).sum())
        return out

    return run


def counted(docs: DataFrame, n_docs: int, pairs: DataFrame, n_pairs: int, count: Callable) -> DataFrame:
    """(l, r, n) of the pairs (l, r) with any. ``docs``: (doc, t and, for places, position as packed numbers)."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    p = max(1, -(-n_pairs // PAIRS))
    b = max(1, -(-n_docs // DOCS), min(-(-3 * cores // p), n_docs // LEAST))
    one = docs.where("doc is not null").withColumns({"_b": F.pmod(F.xxhash64("doc"), F.lit(b)).cast("int"), "_p": F.explode(F.sequence(F.lit(0), F.lit(p - 1)))})
    two = pairs.select("l", "r", F.pmod(F.xxhash64("l", "r"), F.lit(p)).cast("int").alias("_p"), F.explode(F.sequence(F.lit(0), F.lit(b - 1))).alias("_b"))

    def run(here: pa.Table, asked: pa.Table) -> pa.Table:
        left, right = (np.asarray(asked.column(c).combine_chunks(), np.int64) for c in ("l", "r"))
        n = count(here, left, right) if here.num_rows and len(left) else np.zeros(len(left), np.int64)
        some = np.flatnonzero(n)
        return pa.table({"l": pa.array(left[some], pa.int32()), "r": pa.array(right[some], pa.int32()), "n": pa.array(n[some], pa.int64())})

    met = one.repartition(2 * b * p, "_b", "_p").groupBy("_b", "_p").cogroup(two.repartition(2 * b * p, "_b", "_p").groupBy("_b", "_p")).applyInArrow(run, "l int, r int, n long")
    return met.groupBy("l", "r").agg(F.sum("n").alias("n"))
