"""Byte-level text kernels shared by the operators: Arrow buffers, words, hashes.

All functions work on whole texts.  Large inputs are walked in pieces cut at
white space, so memory follows the piece, not the text.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 21
#: Runs of more bytes are hashed one by one with BLAKE2.
LONG = 2048
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_TAIL = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def splitmix(x: np.ndarray | np.uint64) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. No copy of the bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, offsets


def slices(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every offset on as a little-endian number, zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes; ``lane`` 1 is independent of lane 0.

    Eight bytes at a time go through a full mixing step, so a collision is as
    likely as chance has it, also for texts with structure.
    """
    odd, eight = _ODD[lane], eights(data)
    size = ends - starts
    with np.errstate(over="ignore"):
        take = lambda at, left: (eight[at] & _TAIL[np.minimum(left, 8)]) * odd if lane else eight[at] & _TAIL[np.minimum(left, 8)]
        out = splitmix(take(starts, size))
        todo = np.flatnonzero((size > 8) & (size <= LONG))
        step = 8
        while len(todo):
            out[todo] = splitmix(out[todo] ^ take(starts[todo] + step, size[todo] - step))
            step += 8
            todo = todo[size[todo] > step]
        for i in np.flatnonzero(size > LONG):
            out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8, person=bytes([lane])).digest(), "little")
        return splitmix(out + size.astype(np.uint64) * odd)


def words(
    buf: np.ndarray, breaks: np.ndarray | None = None, lower: bool = True, space: np.ndarray = IS_SPACE, lanes: int = 1
) -> tuple[np.ndarray, ...]:
    """(hash, start, end) of every run of bytes that are no white space (``space``; ASCII's by default); with two ``lanes`` a second hash at the end.

    ``breaks``: byte positions at which a word ends besides (document starts).
    ASCII capitals count as small letters when ``lower``.
    """
    out: list[tuple[np.ndarray, ...]] = []
    at, n = 0, len(buf)
    while at < n:
        stop = min(n, at + PIECE)
        if stop < n:  # back to a place where no word goes on
            back = np.flatnonzero(space[buf[at:stop]])
            if len(back):
                stop = at + int(back[-1]) + 1
            else:
                while stop < n and not space[buf[stop]]:
                    stop += 1
        piece = buf[at:stop]
        inside = ~space[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        if breaks is not None:
            cut = breaks[(breaks > at) & (breaks < stop)] - at
            first[cut] |= inside[cut]
            last[cut - 1] |= inside[cut - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        if lower:
            piece = LOWER[piece]
        out.append((hashed(piece, s, e), s + at, e + at, *(hashed(piece, s, e, lane) for lane in range(1, lanes))))
        at = stop
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(1, lanes))
    return out[0] if len(out) == 1 else tuple(map(np.concatenate, zip(*out, strict=True)))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    with np.errstate(over="ignore"):
        for i in range(1, k):
            out = splitmix(out * _ODD[0] + hashes[i : i + n])
    return out


def doc_shingles(buf: np.ndarray, offsets: np.ndarray, k: int, lanes: int = 1) -> tuple[np.ndarray, ...]:
    """Sorted distinct k-word shingles of each text: (hashes, offsets into them); with two ``lanes`` second hashes at the end.

    A text of fewer than k words has its whole sequence as one shingle; one
    without words has none.
    """
    base = int(offsets[0])
    h, s, _, *more = words(buf[base : int(offsets[-1])], offsets[1:-1] - base, lanes=lanes)
    first = np.searchsorted(s, offsets - base)
    count = np.diff(first)
    doc = np.repeat(np.arange(len(count)), count)
    keep = doc[: max(len(h) - k + 1, 0)] == doc[k - 1 :] if len(h) >= k else np.zeros(0, bool)
    owner = doc[: len(keep)][keep]
    short = np.flatnonzero((count > 0) & (count < k))
    grams = []
    for x in (h, *more):
        g = runs(x, k)[keep]
        grams.append(np.concatenate([g, np.array([runs(x[first[d] : first[d + 1]], int(count[d]))[0] for d in short], np.uint64)]) if len(short) else g)
    owner = np.concatenate([owner, short])
    order = np.lexsort((grams[0], owner))
    grams, owner = [g[order] for g in grams], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (grams[0][1:] != grams[0][:-1]) | (owner[1:] != owner[:-1])
    grams, owner = [g[new] for g in grams], owner[new]
    return grams[0], np.searchsorted(owner, np.arange(len(count) + 1)), *grams[1:]


def word_shingles(text: bytes, k: int) -> set[tuple[bytes, ...]]:
    """The same shingles as words themselves, for checks on real content."""
    w = text.lower().split()
    return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else {tuple(w)} if w else set()


def release() -> None:
    """Gives freed memory back to the system, where the C library can: large arrays come and go in workers that live on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
