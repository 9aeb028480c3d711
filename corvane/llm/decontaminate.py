"""Benchmark decontamination: SimHash of item-sized windows, multi-index lookup, exact check.

Each benchmark item has a 128-bit SimHash of its weighted word shingles.  A
document's windows of an item's size are fingerprinted with running sums of
bit votes.  Fingerprints are looked up through BLOCKS blocks of eight bits:
two fingerprints within RADIUS bits differ by at most RADIUS // BLOCKS bits in
some block (pigeonhole), so probing every value at that distance in each block
finds all pairs within the radius.  Candidates are confirmed by the exact
weighted Jaccard similarity of their shingles.

Windows that cannot reach the similarity because too few of their shingles
occur in any item are passed over before they are fingerprinted; that test is
a necessary condition and loses nothing.

Items are fingerprinted in tasks.  They reach the documents' tasks in blocks of
bounded size, each a sorted array of what its items hold, and each is scanned
against all documents; a block's copies are given back before the next.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, written
from .textcore import runs, slices, splitmix, utf8, words

BITS = 128
BLOCKS = 16
RADIUS = 38
#: Text of the items of a block; their index takes some three times that.
ITEM_BYTES = 16 << 20
#: Windows by items that are compared at once.
CELLS = 1 << 22

#: Words are runs of letters, digits and bytes above ASCII: punctuation and case do not hide a copy.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[:128] = True
for _first, _last in ((48, 58), (65, 91), (97, 123)):
    SEPARATOR[_first:_last] = False


def votes(grams: np.ndarray) -> np.ndarray:
    """(shingles, BITS) votes of +1 or -1."""
    two = np.column_stack([splitmix(grams), splitmix(grams ^ np.uint64(0x5851F42D4C957F2D))])
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def fingerprint(sums: np.ndarray) -> np.ndarray:
    """(n, BLOCKS) bytes from (n, BITS) sums of votes; a tie is a zero bit."""
    return np.packbits(sums > 0, axis=1)


def text_words(text: bytes) -> np.ndarray:
    return words(np.frombuffer(text, np.uint8), space=SEPARATOR)[0]


def grams_of(hashes: np.ndarray, shingle: int) -> np.ndarray:
    return runs(hashes, min(shingle, len(hashes))) if len(hashes) else hashes


def near_bytes(distance: int) -> np.ndarray:
    """(256, 256): which byte values are within ``distance`` bits of each other."""
    x = np.arange(256, dtype=np.uint8)
    return np.bitwise_count(x[:, None] ^ x) <= distance


NEAR = near_bytes(RADIUS // BLOCKS)
ITEM = "item_id long, block int, size long, print binary, keys binary, counts binary"


def prepared(shingle: int) -> Callable:
    """(item_id, block, text) to one row an item with words: its size, fingerprint, distinct shingles and their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h = text_words((text or "").encode())
                if len(h):
                    g = grams_of(h, shingle)
                    keys, counts = np.unique(g, return_counts=True)
                    rows.append((item, block, len(h), fingerprint(votes(g).sum(0, dtype=np.int64)[None])[0].tobytes(), keys.tobytes(), counts.astype(np.int32).tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["item_id", "block", "size", "print", "keys", "counts"])

    return run


def index_of(rows: list, shingle: int, percent: int) -> dict[str, Any]:
    """The index of a block of prepared items, by size in words."""
    sizes: dict[int, dict[str, Any]] = {}
    for size in sorted({r.size for r in rows}):
        own = sorted((r for r in rows if r.size == size), key=lambda r: (r.item_id is None, r.item_id or 0, r.keys))
        sizes[size] = {
            "ids": [r.item_id for r in own], "prints": np.frombuffer(b"".join(r.print for r in own), np.uint8).reshape(-1, BLOCKS),
            "keys": np.frombuffer(b"".join(r.keys for r in own), np.uint64), "counts": np.frombuffer(b"".join(r.counts for r in own), np.int32), "at": np.cumsum([0, *(len(r.keys) // 8 for r in own)]),
        }
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(of["keys"] for of in sizes.values())]))
    quick = np.zeros(1 << 20, bool)
    quick[known & np.uint64((1 << 20) - 1)] = True
    return {"sizes": sizes, "known": known, "quick": quick, "shingle": shingle, "percent": percent}


def similarity(grams: np.ndarray, of: dict[str, Any], i: int) -> tuple[int, int]:
    """Weighted Jaccard of a window's shingles and those of the i-th item, as (shared, united) weight."""
    own, weight = np.unique(grams, return_counts=True)
    keys, counts = of["keys"][of["at"][i] : of["at"][i + 1]], of["counts"][of["at"][i] : of["at"][i + 1]]
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    shared = int(np.minimum(weight, counts[at])[keys[at] == own].sum())
    return shared, len(grams) + int(counts.sum()) - shared


def windows(index: dict[str, Any], h: np.ndarray, g: np.ndarray, among: np.ndarray, size: int) -> Iterator[tuple[int, int, float]]:
    """(item, first word, similarity) for the windows of one size of a text's words."""
    of, k = index["sizes"][size], index["shingle"]
    span = min(size, len(h))  # a shorter text is one window
    width = max(1, span - k + 1)
    if k > span:  # the window is one shingle of its own length
        g = runs(h, span)
        among = np.isin(g, index["known"])
        width = 1
    least = -(-index["percent"] * max(1, size - k + 1) // 100)
    count = np.concatenate([[0], np.cumsum(among)])
    n = len(g) - width + 1
    if n <= 0 or width < least:
        return
    start = np.flatnonzero(count[width : width + n] - count[:n] >= least)
    step = max(1, min(4096, CELLS // len(of["ids"])))
    for part in np.split(start, range(step, len(start), step)):
        if not len(part):
            continue
        low, high = int(part[0]), int(part[-1]) + width
        if high - low <= 1 << 16:
            sums = np.zeros((high - low + 1, BITS), np.int32)
            np.cumsum(votes(g[low:high]), axis=0, out=sums[1:], dtype=np.int32)
            prints = fingerprint(sums[part - low + width] - sums[part - low])
        else:
            prints = np.concatenate([fingerprint(votes(g[p : p + width]).sum(0, dtype=np.int64)[None]) for p in part])
        found = np.zeros((len(part), len(of["ids"])), bool)
        for b in range(BLOCKS):
            found |= NEAR[prints[:, b]][:, of["prints"][:, b]]
        at, item = np.nonzero(found)
        close = np.bitwise_count(prints[at] ^ of["prints"][item]).sum(1, dtype=np.int64) <= RADIUS
        for w, i in zip(at[close].tolist(), item[close].tolist(), strict=True):
            p = int(part[w])
            shared, united = similarity(g[p : p + width], of, i)
            if 100 * shared >= index["percent"] * united:
                yield of["ids"][i], p, shared / united


def hits(index: dict[str, Any], column: pa.Array) -> Iterator[tuple[int, Iterator[tuple[int, int, float]]]]:
    """(row, its (item, first word, similarity) windows) of the texts that share a shingle with any item."""
    k, short = index["shingle"], any(size < index["shingle"] for size in index["sizes"])
    buf, off = utf8(column)
    for i, j in slices(off):
        base = int(off[i])
        h, s, _ = words(buf[base : int(off[j])], off[i + 1 : j] - base, space=SEPARATOR)
        first = np.searchsorted(s, off[i : j + 1] - base)
        g = runs(h, k)
        among = index["quick"][g & np.uint64((1 << 20) - 1)]
        maybe = np.flatnonzero(among)
        among[maybe] = np.isin(g[maybe], index["known"])
        count = np.concatenate([[0], np.cumsum(among), np.full(k, among.sum())])
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            if b > a and (short or b - a < k or count[max(a, b - k + 1)] > count[a]):
                own = h[a:b]
                grams = grams_of(own, k) if b - a < k else g[a : b - k + 1]
                known = among[a : max(a, b - k + 1)]
                yield i + d, (x for size in index["sizes"] for x in windows(index, own, grams, known, size))


def scan(get: Callable[[], dict[str, Any]]) -> Callable:
    """(doc_id, text) to the best window of each item found, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = get()
        for batch in batches:
            rows: list[tuple] = []
            for row, found in hits(index, batch.column(1)):
                best: dict[int, tuple[int, float, int]] = {}
                for item, p, s in found:
                    at, most, n = best.get(item, (p, -1.0, 0))
                    best[item] = (p, s, n + 1) if s > most else (at, most, n + 1)
                rows += [(batch.column(0)[row].as_py(), item, *x) for item, x in best.items()]
            ids, items, starts, sims, counts = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(starts, pa.int64()), pa.array(sims, pa.float64()), pa.array(counts, pa.int64())], names=["doc_id", "item_id", "first_word", "similarity", "n_windows"])

    return run


def sift(get: Callable[[], dict[str, Any]], text: int) -> Callable:
    """The rows in whose text, the column of that number, no item is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = get()
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for row, found in hits(index, batch.column(text)):
                clean[row] = next(found, None) is None
            yield batch.filter(pa.array(clean))

    return run


def blocks_of(benchmark: DataFrame, shingle: int, percent: int, block_bytes: int) -> Iterator[tuple[dict[str, Any], bool]]:
    """(index, whether it is the last) of each block of items; one without items where there are none."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    of_block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int")
    rows = written(items.select("item_id", of_block.alias("block"), "text").mapInArrow(prepared(shingle), ITEM))
    for block in range(blocks):
        yield index_of(rows.where(F.col("block") == block).collect(), shingle, percent), block == blocks - 1
    drop(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """One row per document and item found in it: doc_id, item_id, first_word, similarity, n_windows.

    first_word and similarity are those of the best window (the earliest of
    equals), n_windows counts the windows that reach ``percent``/100.  Null,
    empty and wordless texts or items match nothing.  A text shorter than an
    item is one window; a long one is searched whole.  Items with fewer words
    than ``shingle`` are one shingle.  Items that differ in id or text are
    reported each; repeated rows, and rows without a doc_id or item_id, get a
    row each.  Other columns are not looked at; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null")
    context, out = docs.sparkSession.sparkContext, None
    for index, last in blocks_of(benchmark, shingle, percent, block_bytes):
        shared = context.broadcast(index)
        found = docs.mapInArrow(scan(lambda shared=shared: shared.value), "doc_id long, item_id long, first_word long, similarity double, n_windows long")
        if not last:
            found = written(found)
            shared.destroy()
        out = found if out is None else out.union(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80, block_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows in which no item was found, with all their columns; nulls, repeated rows and the rest as above."""
    context, names, text = docs.sparkSession.sparkContext, docs.columns, docs.columns.index("text")
    docs = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    for index, last in blocks_of(benchmark, shingle, percent, block_bytes):
        shared = context.broadcast(index)
        found = docs.mapInArrow(sift(lambda shared=shared: shared.value, text), docs.schema)
        if not last:
            after = written(found)
            shared.destroy()
            drop(docs)
            found = after
        docs = found
    return docs.toDF(*names)
