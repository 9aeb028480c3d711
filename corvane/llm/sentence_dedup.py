"""Substring dedup over sliding sentence spans.

Every run of RUN or more consecutive sentences with WORDS words or more is
looked for over the whole corpus by hash (128 bits), and sentences that some
run covers which is not the first of its kind are removed.  Shorter runs
("THE!! END!!") coincide between unrelated texts.  A run repeats exactly where
the shortest such runs that begin and end at each of its sentences do, so only
these are hashed: they slide over the text and stand for all longer ones.

A sentence ends with a word that ends in . ! or ?, after the marks of scripts
that put no space behind them, or at a line's end.  One of more than LONG words
ends after every word of LONG_WORD characters or more as well, so that what
repeats within it is found wherever it begins.

What repeats within a block of documents is settled there and travels once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import FOUND, PACKED, SEGMENT, SPAN, column, deal, first_of_equal, found, packed_batch, packed_rows
from .store import buckets
from .suffix_dedup import removal
from .textcore import release, slices, splitmix, utf8, words

RUN = 2
WORDS = 16
LONG = 30
LONG_WORD = 10
BLOCK = 2 << 20
IS_END = np.zeros(256, bool)
IS_END[list(b".!?")] = True
#: Marks after which a sentence ends without white space.
MARKS = ("。", "！", "？")


def after_marks(piece: np.ndarray) -> np.ndarray:
    """The offsets right behind each of MARKS."""
    out = [np.zeros(0, np.int64)]
    for a, b, c in (m.encode() for m in MARKS):
        out.append(np.flatnonzero((piece[:-2] == a) & (piece[1:-1] == b) & (piece[2:] == c)) + 3)
    return np.sort(np.concatenate(out))


def sentences(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, start in it, end, words, two hashes) of each sentence of some texts, with the white space behind it."""
    base = int(off[0])
    piece, bounds = buf[base : int(off[-1])], off - base
    marks = after_marks(piece)
    h, s, e, h2 = words(piece, np.union1d(bounds[1:-1], marks[marks < len(piece)]), lanes=2)
    if not len(h):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    text = np.searchsorted(bounds, s, "right") - 1
    lines = np.cumsum(np.append(False, piece == 10), dtype=np.int32)
    closes = IS_END[piece[e - 1]] | np.isin(e, marks)
    closes[:-1] |= (lines[s[1:]] > lines[e[:-1]]) | (text[1:] != text[:-1])
    sized = lambda: (first := np.flatnonzero(np.concatenate([[True], closes[:-1]])), np.diff(np.append(first, len(h))))
    _, size = sized()
    chars = np.cumsum(np.append(False, (piece & 0xC0) != 0x80), dtype=np.int32)
    closes |= np.repeat(size > LONG, size) & (chars[e] - chars[s] >= LONG_WORD)
    first, size = sized()
    place = splitmix((np.arange(len(h)) - np.repeat(first, size)).astype(np.uint64))
    with np.errstate(over="ignore"):  # a word is mixed with its place before it is added
        one, two = (splitmix(np.add.reduceat(splitmix(x + place), first) + size.astype(np.uint64)) for x in (h, h2))
    text = text[first]
    start = s[first]
    end = np.append(start[1:], 0)
    last = np.append(text[1:] != text[:-1], True)
    end[last] = bounds[text[last] + 1]
    return text, start - bounds[text], end - bounds[text], size, one, two


def spans(text: np.ndarray, size: np.ndarray, run: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(first sentence, how many) of the shortest runs of ``run`` sentences and ``least`` words that begin or end at each sentence."""
    i, total = np.arange(len(text)), np.concatenate([[0], np.cumsum(size)])
    stop = np.maximum(np.searchsorted(total, total[:-1] + least), i + run)
    begin = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, i + 1 - run)
    on, back = stop <= np.searchsorted(text, text, "right"), begin >= np.searchsorted(text, text)
    wide = max(run, least) + 1  # a sentence has a word at least, so no run is longer
    both = np.unique(np.append(i[on] * wide + stop[on] - i[on], begin[back] * wide + i[back] + 1 - begin[back]))
    return both // wide, both % wide


def split(parts: int, run: int, least: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in slices(off, BLOCK):
                text, start, end, size, one, two = sentences(buf, off[i : j + 1])
                at, many = spans(text, size, run, least)
                if not len(at):
                    continue
                x, y = many.astype(np.uint64), many.astype(np.uint64)
                with np.errstate(over="ignore"):
                    for k in range(int(many.max())):
                        on = many > k
                        x[on], y[on] = splitmix(x[on] * np.uint64(3) + one[at[on] + k]), splitmix(y[on] * np.uint64(5) + two[at[on] + k])
                place, n, doc = start[at], end[at + many - 1] - start[at], ids[i + text[at]]
                order, lead, head = first_of_equal(x, y, doc, place)
                x, y, doc, place, n = (v[order] for v in (x, y, doc, place, n))
                later = ~lead & ((doc != doc[head]) | (place != place[head]))
                z = np.zeros(int(later.sum()), np.uint64)
                yield packed_batch(
                    [
                        *packed_rows(deal(splitmix(doc[later].astype(np.uint64)), parts), SPAN, z, z, doc[later], place[later], n[later]),
                        *packed_rows(deal(x[lead], parts), SEGMENT, x[lead], y[lead], doc[lead], place[lead], n[lead]),
                    ]
                )
                release()

    return work


def settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's runs to the spans that are not the first of their kind."""
    rows = pdf[pdf.kind == SPAN]
    out = [found(SPAN, column(rows, "doc", "<i8"), column(rows, "place", "<i8"), column(rows, "n", "<i4"))]
    rows = pdf[pdf.kind == SEGMENT]
    x, y, doc, place, n = column(rows, "x", "<u8"), column(rows, "y", "<u8"), column(rows, "doc", "<i8"), column(rows, "place", "<i8"), column(rows, "n", "<i4")
    order, lead, head = first_of_equal(x, y, doc, place)
    doc, place, n = doc[order], place[order], n[order]
    later = ~lead & ((doc != doc[head]) | (place != place[head]))
    out.append(found(SPAN, doc[later], place[later], n[later]))
    return pd.concat(out, ignore_index=True)


def removed_sentences(docs: DataFrame, run: int = RUN, least: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, edges.

    Runs of ``run`` or more sentences with ``least`` or more words are equal
    when their sentences have the same words, ASCII capitals as small letters,
    whatever the white space.  The
    first is the one with the smallest doc_id, then the earliest.  n_removed
    counts bytes, n_spans maximal removed stretches, ``edges`` lists where they
    begin and end.  A null text counts as empty; texts with too few sentences
    for a run keep them; long texts are taken whole.  Rows that share a doc_id
    count as one place and must share a text, or spans of one are cut from the
    other too.  Rows without a doc_id have no place in the order: they keep
    their text and make no other's repeated.  Other columns are not looked at.
    An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    nulls, docs = docs.where("doc_id is null"), docs.where("doc_id is not null")
    spans = docs.mapInArrow(split(buckets(docs.sparkSession), run, least), PACKED).groupBy("bucket").applyInPandas(lambda pdf: settle(pdf), FOUND)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("place", "n")).alias("spans"))
    whole = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans")
    whole = whole.union(nulls.select("doc_id", "text", F.lit(None).cast("array<struct<place:bigint,n:bigint>>")))
    return whole.mapInArrow(removal(1), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, edges array<long>")
