"""Terms found in texts: words are cut and hashed in Arrow buffers, grams looked up in sorted arrays.

A term is named by two independent 64-bit hashes, and found only where both agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Longer terms are looked up by so many first words, and confirmed on the rest.
HEAD_WORDS = 8
#: Bytes of text that are read at once; a longer text goes alone.
PIECE = 1 << 22
_SPACE, _KEPT = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEPT[list(b"abcdefghijklmnopqrstuvwxyz0123456789'-")] = True
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_TAIL = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_SIEVE_BITS = 22


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def string_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each string of a column without nulls."""
    wide = pa.types.is_large_string(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    padded = np.zeros(last - first + 8, np.uint8)
    if last > first:
        padded[:-8] = np.frombuffer(data, np.uint8)[first:last]
    eight = np.ndarray(last - first + 1, "<u8", padded, strides=(1,))
    starts, size = offsets[:-1] - first, np.diff(offsets)
    with np.errstate(over="ignore"):
        head = eight[starts] & _TAIL[np.minimum(size, 8)]
        one, two = mixed(head), mixed(head * _ODD[1])
        todo, step = np.flatnonzero(size > 8), 8
        while len(todo):
            part = eight[starts[todo] + step] & _TAIL[np.minimum(size[todo] - step, 8)]
            one[todo], two[todo] = mixed(one[todo] ^ part), mixed(two[todo] ^ part * _ODD[1])
            step += 8
            todo = todo[size[todo] > step]
        return mixed(one + size.astype(np.uint64) * _ODD[0]), mixed(two + size.astype(np.uint64) * _ODD[1])


def _grown(acc: np.ndarray, words: np.ndarray, lane: int) -> np.ndarray:
    """The hash of runs that are one word longer."""
    with np.errstate(over="ignore"):
        return mixed(acc * _ODD[lane] + words)


class Terms:
    """Sorted hashes of distinct terms, by their number of words; a term's number is its place in ``terms``."""

    def __init__(self, terms: pa.Array) -> None:
        self.n = len(terms)
        words = pc.split_pattern(terms, " ")
        first = np.asarray(words.offsets, np.int64)
        one, two = string_hashes(words.flatten())
        size = np.diff(first)
        full, head = [np.zeros(self.n, np.uint64) for _ in range(2)], [np.zeros(self.n, np.uint64) for _ in range(2)]
        todo = np.flatnonzero(size > 0)
        for lane, h in enumerate((one, two)):
            full[lane][todo] = h[first[todo]]
        step = 1
        while len(todo):
            done = (size[todo] == step) | (step == HEAD_WORDS)
            for lane in range(2):
                head[lane][todo[done]] = full[lane][todo[done]] if step <= HEAD_WORDS else head[lane][todo[done]]
            todo = todo[size[todo] > step]
            for lane, h in enumerate((one, two)):
                full[lane][todo] = _grown(full[lane][todo], h[first[todo] + step], lane)
            step += 1
        self.by_size = {}
        for n in np.unique(size[size > 0]).tolist():
            ids = np.flatnonzero(size == n)
            order = ids[np.argsort(full[0][ids], kind="stable")]
            self.by_size[n] = (_sieve(full[0][order]), full[0][order], full[1][order], order.astype(np.int32))
        heads = np.unique(head[0][size > HEAD_WORDS])
        self.heads = (_sieve(heads), heads)

    def find(self, one: np.ndarray, two: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, term) of every occurrence in the words of rows that begin at ``first``; in no order."""
        ends, places, found = np.repeat(first[1:], np.diff(first)), [], []
        short = [n for n in self.by_size if n <= HEAD_WORDS]
        long = [n for n in self.by_size if n > HEAD_WORDS]
        acc = (one, two)
        for n in range(1, (HEAD_WORDS if long else max(short, default=0)) + 1):
            if n > 1:
                m = max(len(one) - n + 1, 0)
                acc = tuple(_grown(a[:m], h[n - 1 : n - 1 + m], lane) for lane, (a, h) in enumerate(zip(acc, (one, two), strict=True)))
            if n in self.by_size:
                at = np.flatnonzero(self.by_size[n][0][acc[0] >> np.uint64(64 - _SIEVE_BITS)])
                at = at[at + n <= ends[at]]
                at, term = _among(acc[0][at], acc[1][at], self.by_size[n], at)
                places.append(at)
                found.append(term)
        if long:
            at = np.flatnonzero(self.heads[0][acc[0] >> np.uint64(64 - _SIEVE_BITS)])
            at = at[np.isin(acc[0][at], self.heads[1])]
            grown, n = [a[at] for a in acc], HEAD_WORDS
            while len(at) and n < max(long):
                go = at + n < ends[at]
                at, n = at[go], n + 1
                grown = [_grown(a[go], h[at + n - 1], lane) for lane, (a, h) in enumerate(zip(grown, (one, two), strict=True))]
                if n in self.by_size:
                    hit, term = _among(*grown, self.by_size[n], at)
                    places.append(hit)
                    found.append(term)
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate(places), np.concatenate(found)


def _sieve(hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << _SIEVE_BITS, bool)
    out[hashes >> np.uint64(64 - _SIEVE_BITS)] = True
    return out


def _among(one: np.ndarray, two: np.ndarray, terms: tuple, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, sorted_, second, ids = terms
    i = np.minimum(np.searchsorted(sorted_, one), len(sorted_) - 1)
    hit = np.flatnonzero((sorted_[i] == one) & (second[i] == two))
    return at[hit], ids[i[hit]]


def token_slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.Array]]:
    """(rows, where each row's words begin and end, words) of rows with PIECE bytes or one row at a time.

    Words are those of ``normalize_term`` over lower-cased texts without nulls:
    what stands between white space, without other bytes than a-z 0-9 ' and -.
    """
    texts = batch.column(column)
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < batch.num_rows:
        j = min(max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1), batch.num_rows)
        begin = offsets[i : j + 1] - offsets[i]
        piece = whole[offsets[i] : offsets[j]]
        at = np.flatnonzero(_KEPT[piece])
        gap = np.cumsum(_SPACE[piece], dtype=np.int32)
        new = np.ones(len(at), bool)
        new[1:] = gap[at[1:]] != gap[at[:-1]]
        bound = np.searchsorted(at, begin)
        new[bound[bound < len(at)]] = True
        starts = np.flatnonzero(new)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(at)).astype(np.int32)), pa.py_buffer(piece[at]))
        yield batch.slice(i, j - i), np.searchsorted(starts, bound), words
        i = j
