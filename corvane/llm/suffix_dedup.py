"""Removal of repeated byte strings with suffix arrays.

A byte is removed when some string of ``length`` bytes that covers it also
starts earlier in the corpus (smaller doc_id, or earlier in the document).

Every string of ``length`` bytes picks the least hash among its ``GRAM``-byte
grams, so equal strings pick the same gram at the same place.  Neighbouring
strings that pick one gram form a segment.  Segments meet by their gram:

- equal segments need one comparison: all but the first are removed whole;
- unequal segments of one gram go to a shard, of bounded size, that builds the
  suffix array of their bytes by Larsson-Sadakane refinement, common prefixes
  by Kasai's rule in its permuted form, and finds equal strings as runs of
  prefixes of ``length`` or more;
- grams whose segments would overfill a shard are taken apart: their strings
  travel as sorted runs of 128-bit hashes, dealt out evenly, and runs are
  merged by binary search.  The most frequent grams, which would overfill a
  bucket already, are known from a sample, which only decides where rows go.

What repeats within a block of documents is settled there and travels once, so
copies, however many, do not gather in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import FOUND, PACKED, SEGMENT, SPAN, WINDOW, column, deal, first_of_equal, found, packed_batch, packed_rows, strung, unplanes
from .store import buckets
from .textcore import eights, hashed, slices, splitmix, utf8

LENGTH = 100
GRAM = 32
BLOCK = 1 << 20
SHARD_BYTES = 1 << 19
#: One document in so many is looked at for hot grams; fewer sampled places than LEAST don't make one.
SAMPLE = 16
LEAST = 50
_POSITION = np.uint64(0xFFFFFF)


# --- suffix arrays -----------------------------------------------------------


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order. Symbols are 0 .. 256; refinement doubles the sorted prefix of groups that are not yet single."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([symbols.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])
    for i in range(7):
        key = (key << np.uint64(9)) | padded[i : i + n]
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = start
    h = 7
    while True:
        single = new & np.append(new[1:], True)
        slots = np.flatnonzero(~single)
        if not len(slots):
            return sa
        group, after = rank[sa[slots]], rank[np.minimum(sa[slots] + h, n)]
        order = np.argsort(group * (n + 1) + after + 1, kind="stable")
        sa[slots] = sa[slots][order]
        group, after = group[order], after[order]
        new[slots[1:]] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        new[slots[0]] = True
        rank[sa[slots]] = np.maximum.accumulate(np.where(new[slots], slots, 0))
        h *= 2


def common_prefixes(symbols: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each slot of the suffix array the common prefix with the slot before it.

    Kasai's rule says that the value at a position is at least that at the
    position before less one, with equality where the symbols before agree;
    only the other positions are compared, all of them at once.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.arange(n)
    agree = (before > 0) & (at > 0)
    agree[agree] = symbols[at[agree] - 1] == symbols[before[agree] - 1]
    own = np.flatnonzero(~agree)
    value = np.zeros(n, np.int64)
    active = own[before[own] >= 0]
    while len(active):
        i, j = active + value[active], before[active] + value[active]
        ok = np.maximum(i, j) < n
        ok[ok] = symbols[i[ok]] == symbols[j[ok]]
        active = active[ok]
        value[active] += 1
    end = np.where(agree, 0, value + at)
    owner = np.maximum.accumulate(np.where(agree, 0, at))
    return (end[owner] - at)[sa].clip(0)


def repeats(parts: list[bytes], order: np.ndarray, length: int) -> list[np.ndarray]:
    """For each part the offsets whose string of ``length`` bytes occurs earlier.

    ``order`` (parts, 2): doc_id and offset of each part, which say what is earlier.
    """
    if not parts:
        return []
    sizes = np.array([len(p) for p in parts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    symbols = np.zeros(starts[-1], np.int16)
    flat = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    symbols[:] = flat
    symbols += 1
    symbols[starts[1:] - 1] = 0
    sa = suffix_array(symbols)
    prefix = common_prefixes(symbols, sa)
    part = np.repeat(np.arange(len(parts)), sizes + 1)[sa]
    offset = sa - starts[part]
    group = np.cumsum(prefix < length)
    whole = offset + length <= sizes[part]
    group, part, offset = group[whole], part[whole], offset[whole]
    doc, place = order[part, 0], order[part, 1] + offset
    turn = np.lexsort((place, doc, group))
    g, d, p = group[turn], doc[turn], place[turn]
    lead = np.ones(len(g), bool)
    lead[1:] = g[1:] != g[:-1]
    first = np.maximum.accumulate(np.where(lead, np.arange(len(g)), 0))
    later = (d != d[first]) | (p != p[first])
    owner, off = part[turn][later], offset[turn][later]
    turn = np.lexsort((off, owner))
    owner, off = owner[turn], off[turn]
    cut = np.searchsorted(owner, np.arange(len(parts) + 1))
    return [off[cut[i] : cut[i + 1]] for i in range(len(parts))]


def intervals(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The union of [s, s + length) over sorted starts."""
    if not len(starts):
        return starts, starts
    new = np.ones(len(starts), bool)
    new[1:] = np.diff(starts) > length
    begin = starts[new]
    end = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)] + length
    return begin, end


#: Columns of what goes to shards (bytes) and buckets (packed: kind in doc_id, x in bytes).
CUT = ["shard", "doc_id", "place", "bytes", "y", "doc", "at", "n"]


# --- segments ----------------------------------------------------------------


def segments(piece: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, content hashes of two lanes, first string, strings) of a piece; ``bounds`` are its documents' offsets."""
    n = len(piece)
    # Windows of eight bytes, then of twice as many until they cover a gram.
    grams, size = splitmix(eights(piece)[: n - 7]), 8
    while size < gram:
        step = min(size, gram - size)
        with np.errstate(over="ignore"):
            grams = splitmix(grams[:-step] * np.uint64(0xC2B2AE3D27D4EB4F) + grams[step:])
        size += step
    least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    width, reach = length - gram + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if width > reach:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    pick = (least & _POSITION).astype(np.int64)  # of the string at each offset
    inside = np.zeros(len(pick) + 1, np.int32)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= length:
            inside[a] += 1
            inside[b - length + 1] -= 1
    ok = np.cumsum(inside[:-1]) > 0
    new = ok.copy()
    new[1:] &= (pick[1:] != pick[:-1]) | ~ok[:-1]
    heads = np.zeros(len(pick), bool)
    heads[bounds[:-1][bounds[:-1] < len(pick)]] = True
    new |= heads & ok
    first = np.flatnonzero(new)
    stop = np.flatnonzero(ok & ~np.append(ok[1:] & ~new[1:], False)) + 1
    return grams[pick[first]], hashed(piece, first, stop + length - 1), hashed(piece, first, stop + length - 1, 1), first, stop - first


def named(gram: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 128 bits that travel for a segment: 32 of its gram, 96 of its content."""
    high = np.uint64(0xFFFFFFFF00000000)
    return (gram & high) | (two >> np.uint64(32)), one


def strings(piece: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each string of ``length`` bytes that begins at ``at``."""
    return hashed(piece, at, at + length), hashed(piece, at, at + length, 1)


def pieces(buf: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, rows, offset of each bound in its document); long documents in overlapping pieces."""
    for i, j in slices(off, BLOCK):
        if off[j] - off[i] <= 2 * BLOCK:
            base = int(off[i])
            yield buf[base : int(off[j])], off[i : j + 1] - base, np.arange(i, j), np.zeros(j - i, np.int64)
        else:  # one long document
            at = int(off[i])
            while at < off[j]:
                stop = min(int(off[j]), at + BLOCK)
                yield buf[at:stop], np.array([0, stop - at]), np.array([i]), np.array([at - int(off[i])])
                if stop == off[j]:
                    break
                at = stop - length + 1


def split(parts: int, length: int, gram: int, hot: Callable[[], np.ndarray]) -> Callable:
    """Documents to packed segments, strings of hot grams, and spans settled within a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = hot()
        for batch in batches:
            buf, off = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for piece, bounds, rows, shift in pieces(buf, off, length):
                if len(piece) < length:
                    continue
                g, one, two, first, n = segments(piece, bounds, length, gram)
                f, c = named(g, one, two)
                owner = np.searchsorted(bounds, first, "right") - 1
                doc, place = ids[rows[owner]], first - bounds[owner] + shift[owner]
                order, lead, head = first_of_equal(f, c, doc, place)
                out: list[tuple] = []
                g, f, c, doc, place, n, first = (v[order] for v in (g, f, c, doc, place, n, first))
                later = ~lead & ((doc != doc[head]) | (place != place[head]))
                z = np.zeros(int(later.sum()), np.uint64)
                out += packed_rows(deal(splitmix(doc[later].astype(np.uint64)), parts), SPAN, z, z, doc[later], place[later], n[later])
                full = np.isin(g, crowded) & lead if len(crowded) else np.zeros(len(f), bool)
                rest = lead & ~full
                out += packed_rows(deal(splitmix(g[rest]), parts), SEGMENT, f[rest], c[rest], doc[rest], place[rest], n[rest])  # picked grams have small hashes: mixed again
                if full.any():
                    count = n[full]
                    step = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                    out += apart(*strings(piece, np.repeat(first[full], count) + step, length), np.repeat(doc[full], count), np.repeat(place[full], count) + step, parts)
                yield packed_batch(out)

    return run


def apart(x: np.ndarray, y: np.ndarray, doc: np.ndarray, place: np.ndarray, parts: int) -> list[tuple]:
    """Packed rows of single strings: those that repeat here as spans, the first of each kind as a sorted run for each bucket."""
    order, lead, head = first_of_equal(x, y, doc, place)
    x, y, doc, place = (v[order] for v in (x, y, doc, place))
    later = ~lead & ((doc != doc[head]) | (place != place[head]))
    sdoc, splace, sn = strung(doc[later], place[later])
    z = np.zeros(len(sdoc), np.uint64)
    out = list(packed_rows(deal(splitmix(sdoc.astype(np.uint64)), parts), SPAN, z, z, sdoc, splace, sn))
    return out + list(packed_rows(deal(x[lead], parts), WINDOW, x[lead], y[lead], doc[lead], place[lead], np.ones(int(lead.sum()), np.int64)))


def merged_runs(runs: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs (x, y, doc, place), each sorted by (x, y): the (doc, place) of every string that another run, or its own, has earlier.

    Runs are merged two by two; each looks its strings up in the other by
    binary search, and the earlier place stays.
    """
    late: list[tuple[np.ndarray, np.ndarray]] = []
    turn = [(r[0], r[1], r[2], r[3]) for r in runs]
    while len(turn) > 1:
        nxt = []
        for a, b in zip(turn[::2], turn[1::2], strict=False):
            lo, hi = np.searchsorted(b[0], a[0], "left"), np.searchsorted(b[0], a[0], "right")
            at = lo.copy()
            while True:  # equal first words: on to the equal second one
                move = (at < hi) & (b[1][np.minimum(at, len(b[1]) - 1)] < a[1]) if len(b[1]) else np.zeros(len(a[0]), bool)
                if not move.any():
                    break
                at[move] += 1
            same = np.flatnonzero((at < hi) & (b[1][np.minimum(at, max(len(b[1]) - 1, 0))] == a[1])) if len(b[1]) else np.zeros(0, np.int64)
            other = at[same]
            mine = (a[2][same] < b[2][other]) | ((a[2][same] == b[2][other]) & (a[3][same] <= b[3][other]))
            equal = (a[2][same] == b[2][other]) & (a[3][same] == b[3][other])
            drop_a, drop_b = same[~mine], other[mine]
            late.append((a[2][drop_a], a[3][drop_a]))
            gone = other[mine & ~equal]
            late.append((b[2][gone], b[3][gone]))
            keep_a, keep_b = np.ones(len(a[0]), bool), np.ones(len(b[0]), bool)
            keep_a[drop_a], keep_b[drop_b] = False, False
            both = [np.concatenate([u[keep_a], v[keep_b]]) for u, v in zip(a, b, strict=True)]
            order = np.lexsort((both[1], both[0]))
            nxt.append(tuple(v[order] for v in both))
        turn = nxt + ([turn[-1]] if len(turn) % 2 else [])
    docs, places = zip(*late, strict=True) if late else ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])
    return np.concatenate(docs), np.concatenate(places)


def settle(length: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A bucket's packed rows to spans (removed) and segments that a shard has to compare."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = pdf[pdf.kind == SPAN]
        out.append(found(SPAN, column(rows, "doc", "<i8"), column(rows, "place", "<i8"), column(rows, "n", "<i4")))
        rows = pdf[pdf.kind == WINDOW]
        if len(rows):
            doc, place = merged_runs([(unplanes(r.x, "<u8"), unplanes(r.y, "<u8"), unplanes(r.doc, "<i8"), unplanes(r.place, "<i8")) for r in rows.itertuples()])
            out.append(found(SPAN, *strung(doc, place)))
        rows = pdf[pdf.kind == SEGMENT]
        if len(rows):
            f, c = column(rows, "x", "<u8"), column(rows, "y", "<u8")
            doc, place, n = column(rows, "doc", "<i8"), column(rows, "place", "<i8"), column(rows, "n", "<i4")
            order, lead, head = first_of_equal(f, c, doc, place)
            f, doc, place, n = (v[order] for v in (f, doc, place, n))
            later = ~lead & ((doc != doc[head]) | (place != place[head]))
            out.append(found(SPAN, doc[later], place[later], n[later]))
            f, doc, place, n = (v[lead] for v in (f, doc, place, n))
            f = f >> np.uint64(32)  # the gram
            new = np.ones(len(f), bool)
            new[1:] = f[1:] != f[:-1]
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1  # unequal segments of one gram
            f, doc, place, n, group = (v[many] for v in (f, doc, place, n, group))
            if len(f):
                filled = np.cumsum(n.astype(np.int64) + length - 1)
                lead = np.ones(len(group), bool)
                lead[1:] = group[1:] != group[:-1]
                first = np.maximum.accumulate(np.where(lead, np.arange(len(group)), 0))
                begin = filled[first] - n[first] - length + 1
                shard = begin // SHARD_BYTES  # by where its gram begins
                # A gram that fills shards alone is compared string by string.
                wide = np.maximum.reduceat(filled, np.flatnonzero(lead))[np.cumsum(lead) - 1] - begin > SHARD_BYTES
                out.append(found(SEGMENT, doc, place, n, np.where(wide, -1, (int(pdf.bucket.iloc[0]) << 32) + shard)))
        return pd.concat(out, ignore_index=True)

    return run


def cut_out(length: int, parts: int) -> Callable:
    """(doc_id, text, list of (place, n, shard)) to one row a segment with its bytes, for shards; of segments without a shard, packed strings for buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            flat, cuts = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
            place, n, shard = (flat.field(i).to_numpy() for i in range(3))
            row = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            begin = off[row] + place
            few = np.flatnonzero(shard >= 0)
            held = [buf[a : a + k + length - 1].tobytes() for a, k in zip(begin[few], n[few], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard[few]), pa.array(ids[row[few]]), pa.array(place[few]), pa.array(held, pa.binary()), *[pa.nulls(len(few), pa.binary())] * 4], names=CUT)
            for i in range(0, len(many := np.flatnonzero(shard < 0)), 4096):
                of = many[i : i + 4096]
                size = n[of] + length - 1
                piece = np.concatenate([buf[a : a + k] for a, k in zip(begin[of], size, strict=True)])
                step = np.arange(int(n[of].sum())) - np.repeat(np.cumsum(n[of]) - n[of], n[of])
                rows = apart(*strings(piece, np.repeat(np.cumsum(size) - size, n[of]) + step, length), np.repeat(ids[row[of]], n[of]), np.repeat(place[of], n[of]) + step, parts)
                cols = [[-1 - r[0] for r in rows], [r[1] for r in rows], [0] * len(rows), *([r[k] for r in rows] for k in (2, 3, 4, 5, 6))]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.binary()) for c in cols[3:])], names=CUT)

    return run


def sorted_shard(length: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.shard.iloc[0] < 0:
            spans = pdf[pdf.doc_id == SPAN]
            runs = [(unplanes(r.bytes, "<u8"), unplanes(r.y, "<u8"), unplanes(r.doc, "<i8"), unplanes(r.at, "<i8")) for r in pdf[pdf.doc_id == WINDOW].itertuples()]
            late = strung(*merged_runs(runs)) if runs else (np.zeros(0, np.int64),) * 3
            both = [np.concatenate([column(spans, k, t).astype(np.int64), v]) for k, t, v in zip(("doc", "at", "n"), ("<i8", "<i8", "<i4"), late, strict=True)]
            return pd.DataFrame(dict(zip(("doc_id", "place", "n"), both, strict=True)))
        order = pdf[["doc_id", "place"]].to_numpy(np.int64)
        docs, begins, sizes = [], [], []
        for (doc, place), starts in zip(order, repeats(list(pdf["bytes"]), order, length), strict=True):
            if len(starts):
                begin, end = intervals(starts, length)
                docs.append(np.full(len(begin), doc))
                begins.append(begin + place)
                sizes.append(end - begin - length + 1)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"doc_id": join(docs), "place": join(begins), "n": join(sizes)})

    return run


def removal(length: int) -> Callable:
    """(doc_id, text, list of (place, n)) to counts, spans and what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            lists = batch.column(2)
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                data = buf[off[i] : off[i + 1]]
                if lists[i].is_valid and len(lists[i].values):
                    place, n = (lists[i].values.field(k).to_numpy() for k in range(2))
                    mark = np.zeros(len(data) + 1, np.int64)
                    np.add.at(mark, place, 1)
                    np.add.at(mark, place + n + length - 1, -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    kept = data[~gone].tobytes()
                    rows.append((len(data), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest(), edge.astype(np.int64)))
                else:
                    rows.append((len(data), 0, 0, hashlib.sha256(data.tobytes()).hexdigest(), np.zeros(0, np.int64)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string()), pa.array(list(cols[4]), pa.list_(pa.int64()))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "edges"],
            )

    return run


def hot_grams(docs: DataFrame, length: int, gram: int, parts: int) -> np.ndarray:
    """Grams with more places than a quarter of a bucket's share, at most 4 * ``parts`` of them, from a sample of the documents: it decides only where rows go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            seen = [np.zeros(0, np.uint64)]
            for piece, bounds, _, _ in pieces(buf, off, length):
                if len(piece) >= length:
                    f, c, *_ = segments(piece, bounds, length, gram)
                    seen.append(np.unique(np.column_stack([f, c]), axis=0)[:, 0] if len(f) else f)
            f, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(f[n > 1].view(np.int64), 0)), pa.array(np.append(n[n > 1], n.sum())), pa.array(np.append(np.zeros((n > 1).sum(), np.int32), np.int32(1)))], names=["f", "n", "all"])

    counts = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).mapInArrow(run, "f long, n long, all int").groupBy("f", "all").agg(F.sum("n").alias("n"))
    counts = counts.where((F.col("n") >= LEAST) | (F.col("all") == 1)).orderBy(F.desc("all"), F.desc("n")).limit(4 * parts + 1).collect()
    total = sum(r.n for r in counts if r["all"])
    return np.array(sorted(r.f for r in counts if not r["all"] and r.n * 4 * parts >= total), np.int64).view(np.uint64)


def removed_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, edges.

    ``edges`` lists the beginning and end of each removed run in turn.  Texts
    are taken as UTF-8 bytes, whole; a null text counts as empty; a text shorter
    than ``length`` keeps all its bytes.  Rows that share a doc_id count as the
    same place, so neither is earlier, and must share a text, or spans of one
    are cut from the other too.  Rows without a doc_id have no place in the
    order: they keep their bytes and make no other's repeated.
    Other columns are not looked at.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    same = docs.schema["doc_id"].dataType.simpleString() == "bigint"  # a cast to itself would keep Spark from shuffling the texts once only
    docs = docs.select("doc_id" if same else F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    nulls, docs = docs.where("doc_id is null"), docs.where("doc_id is not null")
    parts = buckets(spark, times=3)
    crowded = spark.sparkContext.broadcast(hot_grams(docs, length, gram, parts))
    packed = docs.mapInArrow(split(parts, length, gram, lambda: crowded.value), PACKED)
    done = settle(length)
    # Read twice below; Spark reuses the exchange, so only the settling is done again.
    settled = packed.groupBy("bucket").applyInPandas(lambda pdf: done(pdf), FOUND)
    open_ = settled.where(F.col("kind") == SEGMENT).groupBy("doc_id").agg(F.collect_list(F.struct("place", "n", "shard")).alias("open"))
    cut = docs.join(open_, "doc_id").select("doc_id", "text", "open").mapInArrow(cut_out(length, parts), "shard long, doc_id long, place long, bytes binary, y binary, doc binary, at binary, n binary")
    compared = sorted_shard(length)
    more = cut.groupBy("shard").applyInPandas(lambda pdf: compared(pdf), "doc_id long, place long, n long")
    spans = settled.where(F.col("kind") == SPAN).select("doc_id", "place", "n").union(more)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("spans"))
    whole = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    whole = whole.union(nulls.select("doc_id", "text", F.lit(None).cast("array<struct<place:bigint,n:bigint>>")))
    return whole.mapInArrow(removal(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, edges array<long>")
