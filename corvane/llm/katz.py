"""LM scoring with a Katz backoff model of words.

Bigrams back off to unigrams and these to the unknown word.  Counts are
discounted after Good and Turing; what a history's bigrams give up goes to the
words not seen after it, in proportion to their unigram probability, with
weights that make each distribution sum to 1 exactly.

Tables and texts meet without shipping texts.  A block of documents sends each
bucket of words its distinct bigrams (h, w) with the documents they occur in,
packed (hot words are spread over several buckets by history); the bucket, which is the partition of the model's tables for its words
w, counts, discounts and sends back

- to the block, one row of sums for each document (finished terms and counts
  of terms whose discount is not yet known),
- to the bucket of each history h, which of its bigrams have which small count and how frequent
  their words are, and which documents need its backoff weight.

Every bucket sends its totals and counts of counts along with each of these
rows, to every block and bucket, so the receivers know the corpus-wide discounts without another pass; what
depends on them travels as the number of terms of each small count.  The log
probability is a sum, so the terms of one token may be added in different
places; that is the recursion, unrolled over the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import deal, planes, unplanes
from .store import buckets
from .textcore import release, slices, splitmix, utf8, words

#: Counts up to here are discounted after Good and Turing.
SMALL = 5
#: One document in so many is looked at for hot words.
SAMPLE = 16
#: Larger counts give up this part of one occurrence, so that no history is without backoff mass.
TAIL = 0.05
#: Tokens that travel together.
BLOCK = 800_000
#: Fixed point of sums that travel.
POINT = float(1 << 32)
END = splitmix(np.uint64(0xE4D))
START = splitmix(np.uint64(0x57A))
LOG10 = np.log(10.0)
#: Stands for a missing doc_id where ids travel as numbers.
NAMELESS = -(1 << 63)


def discounts(n: np.ndarray) -> np.ndarray:
    """What remains of counts 1 .. SMALL and of larger ones, as counts: r* for r = 1 .. SMALL.

    ``n``: how many types have count 1 .. SMALL + 1.  Katz's r* where it lies
    in (0, r); r - 1/2 where counts of counts are too uneven for it.
    """
    r = np.arange(1, SMALL + 1, dtype=float)
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        turing = (r + 1) * n[1:] / n[:-1]
        common = (SMALL + 1) * n[SMALL] / n[0]
        star = (turing - r * common) / (1 - common)
    good = np.isfinite(star) & (star > 0) & (star < r)
    return np.where(good, star, r - 0.5)


def reduced(counts: np.ndarray, star: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    small = counts <= SMALL
    return np.where(small, star[np.clip(counts, 1, SMALL) - 1], counts - TAIL)


def tokens_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, word before, text) of every token of some texts, their ends included."""
    base = int(off[0])
    n = len(off) - 1
    h, s, _ = words(buf[base : int(off[-1])], off[1:-1] - base)
    first = np.searchsorted(s, off - base)
    size = np.diff(first) + 1
    stop = np.cumsum(size)
    word = np.empty(int(stop[-1]) if n else 0, np.uint64)
    inner = np.ones(len(word), bool)
    inner[stop - 1] = False
    word[inner], word[stop - 1] = h, END
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[stop - size] = START
    return word, before, np.repeat(np.arange(n), size)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_id, learn, word, word before, document) for blocks of BLOCK tokens or somewhat more."""
    held: list[tuple] = []
    docs = size = 0
    for batch in batches:
        buf, off = utf8(batch.column(1))
        ids, learn = batch.column(0).to_numpy(), np.asarray(batch.column(2).to_pylist(), bool)
        for i, j in slices(off):
            word, before, doc = tokens_of(buf, off[i : j + 1])
            held.append((ids[i:j], learn[i:j], word, before, (doc + docs).astype(np.uint32)))
            docs, size = docs + j - i, size + len(word)
            if size >= BLOCK:
                full = tuple(map(np.concatenate, zip(*held, strict=True)))
                held, docs, size = [], 0, 0
                yield full
                del full
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


class Unigrams:
    """Discounted unigram counts; ``unknown`` is the count that is left for the one unknown word."""

    def __init__(self, total: int, types: int, texts: int, n: np.ndarray):
        self.total, self.types, self.texts = total, types, texts
        self.star = discounts(n)
        given = float((n[:SMALL] * (np.arange(1, SMALL + 1) - self.star)).sum()) + TAIL * (types - n[:SMALL].sum())
        self.unknown = given if total and given > 0 else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, reduced(np.maximum(counts, 1), self.star), self.unknown) / max(self.total, 1)


def stamp_of(bigram_counts: np.ndarray, word_counts: np.ndarray, texts: int) -> bytes:
    """A bucket's share of the corpus totals."""
    few = lambda c: np.bincount(np.minimum(c[c > 0], SMALL + 2), minlength=SMALL + 3)[1 : SMALL + 2]
    return np.concatenate([few(bigram_counts), few(word_counts), [word_counts.sum(), (word_counts > 0).sum(), texts]]).astype(np.float64).tobytes()


def totals(stamps: list[bytes]) -> tuple[np.ndarray, Unigrams]:
    """(discounted bigram counts, unigrams) from the stamps of all buckets."""
    x = np.sum([np.frombuffer(v, np.float64) for v in stamps], axis=0)
    k = SMALL + 1
    return discounts(x[:k]), Unigrams(int(x[2 * k]), int(x[2 * k + 1]), int(x[2 * k + 2]), x[k : 2 * k])


# One row of the exchange between blocks and buckets.
ROW = "kind int, key long, source long, data array<binary>"
_SCHEMA = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("source", pa.int64()), ("data", pa.list_(pa.binary()))])
HEAD, BIGRAMS, SUMS, HISTORY, WEIGHTS, TABLE = range(6)
WAITS = 2 * SMALL + 3


def _emit(rows: list[tuple[int, int, int, list[bytes]]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _frame(rows: list[tuple[int, int, int, list[bytes]]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "key", "source", "data"]).astype({"kind": np.int32, "key": np.int64, "source": np.int64})


class Hot:
    """Words too frequent for one bucket, and over how many buckets each is spread, by its histories.

    Every bucket of such a word gets the word's own count from every block; the
    first one, its home, answers for it in the corpus totals.
    """

    def __init__(self, words_: np.ndarray, spread: np.ndarray, parts: int):
        order = np.argsort(words_)
        self.words, self.spread, self.parts = words_[order], spread[order].astype(np.int64), parts
        owner = np.repeat(np.arange(len(self.words)), self.spread)
        salt = np.arange(len(owner)) - np.repeat(np.cumsum(self.spread) - self.spread, self.spread)
        places = np.unique(np.column_stack([self.place(self.words[owner], salt), owner]), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
        self.bucket, self.owner = places[:, 0], places[:, 1]
        self.places = [self.bucket[self.owner == i] for i in range(len(self.words))]
        self.home = self.place(self.words, np.zeros(len(self.words), np.int64))

    def place(self, word: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return deal(splitmix(word ^ splitmix(salt.astype(np.uint64))), self.parts)

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of each word, whether it is hot)."""
        if not len(self.words):
            return np.zeros(len(word), np.int64), np.zeros(len(word), bool)
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return at, self.words[at] == word

    def everywhere(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, bucket): every bucket of each word, one for most."""
        at, hot = self.find(word)
        index, bucket = [np.flatnonzero(~hot)], [deal(word[~hot], self.parts)]
        for i in np.unique(at[hot]):
            mine = np.flatnonzero(hot & (at == i))
            index.append(np.repeat(mine, len(self.places[i])))
            bucket.append(np.tile(self.places[i], len(mine)))
        return np.concatenate(index), np.concatenate(bucket)

    def deal(self, word: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The bucket of each bigram, or of another pair of a word and what it is spread by."""
        out = deal(word, self.parts)
        at, hot = self.find(word)
        if hot.any():
            out[hot] = self.place(word[hot], (splitmix(before[hot]) % self.spread[at[hot]].astype(np.uint64)).astype(np.int64))
        return out


def hot_words(rows: DataFrame, parts: int) -> Hot:
    """Words with more tokens than half a bucket's share, the beginning of texts among them, from a sample of the documents: it decides only where rows go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in slices(off):
                keys, n = np.unique(np.append(tokens_of(buf, off[i : j + 1])[0], np.full(j - i, START)), return_counts=True)
                often = n * 8 * parts > n.sum()  # a piece's own shares vary, so it keeps some that are less hot
                yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[often].view(np.int64), 0)), pa.array(np.append(n[often], n.sum())), pa.array(np.append(np.zeros(int(often.sum()), np.int32), np.int32(1)))], names=["w", "n", "all"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInArrow(run, "w long, n long, all int").groupBy("w", "all").agg(F.sum("n").alias("n"))
    got = counts.orderBy(F.desc("all"), F.desc("n")).limit(4 * parts + 1).collect()
    total = sum(r.n for r in got if r["all"])
    hot = [(r.w, r.n / total) for r in got if not r["all"] and r.n * 2 * parts > total]
    return Hot(np.array([w for w, _ in hot], np.int64).view(np.uint64), np.array([min(parts, int(2 * parts * x) + 1) for _, x in hot], np.int64), parts)


def send_bigrams(parts: int, hot: Hot) -> Callable:
    """Blocks of documents to packed distinct bigrams for each bucket, of the second word unless that is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 24
        for ids, learn, word, before, doc in _blocks(batches):
            n_tokens = np.bincount(doc, minlength=len(ids)).astype(np.uint32)
            where = hot.deal(word, before)
            at, crowded = hot.find(word)
            mine = np.bincount(at[crowded], learn[doc[crowded]], minlength=len(hot.words)).astype(np.uint32)
            send = mine[hot.owner] > 0
            hot_bucket, hot_word, hot_count = hot.bucket[send], hot.words[hot.owner[send]], mine[hot.owner[send]]
            hot_cuts = np.searchsorted(hot_bucket, np.arange(parts + 1))
            del at, crowded
            order = np.lexsort((before, word, where))  # stable: documents stay in order
            word, before, doc, where = word[order], before[order], doc[order], where[order]
            del order
            new_word = np.ones(len(word), bool)
            new_word[1:] = (word[1:] != word[:-1]) | (where[1:] != where[:-1])
            new_pair = new_word.copy()
            new_pair[1:] |= before[1:] != before[:-1]
            new_doc = new_pair.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            at_doc = np.flatnonzero(new_doc)
            times = np.diff(np.append(at_doc, len(word)))
            at_pair, at_word = np.flatnonzero(new_pair), np.flatnonzero(new_word)
            docs_of_pair = np.diff(np.append(np.searchsorted(at_doc, at_pair), len(at_doc)))
            pairs_of_word = np.diff(np.append(np.searchsorted(at_pair, at_word), len(at_pair)))
            rows = [(HEAD, block, block, [planes(ids), learn.tobytes(), planes(n_tokens)])]
            cuts = np.searchsorted(where[at_word], np.arange(parts + 1))
            pair_cut = np.append(0, np.cumsum(pairs_of_word))
            doc_cut = np.append(0, np.cumsum(docs_of_pair))
            flags = learn.tobytes()
            for b in range(parts):
                w0, w1 = cuts[b], cuts[b + 1]
                more = slice(hot_cuts[b], hot_cuts[b + 1])
                p0, p1 = pair_cut[w0], pair_cut[w1]
                d0, d1 = doc_cut[p0], doc_cut[p1]
                # Also to buckets that get no bigram: a block needs the totals of all.
                rows.append((BIGRAMS, b, block, [planes(word[at_word[w0:w1]]), planes(pairs_of_word[w0:w1].astype(np.uint32)), planes(before[at_pair[p0:p1]]), planes(docs_of_pair[p0:p1].astype(np.uint32)), planes(doc[at_doc[d0:d1]]), planes(times[d0:d1].astype(np.uint32)), flags if d1 > d0 else b"", planes(hot_word[more]), planes(hot_count[more])]))
            batch = _emit(rows)
            del rows
            yield batch
            del batch
            release()
            block += 1

    return run


def unpacked(rows: list) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[int]]:
    """Word, word before, training count and number of each packed row's bigrams."""
    word, before, train, sizes = [], [], [], []
    for r in rows:
        word.append(np.repeat(unplanes(r.data[0], "<u8"), unplanes(r.data[1], "<u4")))
        before.append(unplanes(r.data[2], "<u8"))
        per = unplanes(r.data[3], "<u4").astype(np.int64)
        doc, times = unplanes(r.data[4], "<u4"), unplanes(r.data[5], "<u4")
        learned = times * np.frombuffer(r.data[6], bool)[doc]
        train.append(np.add.reduceat(learned, np.cumsum(per) - per).astype(np.int64) if len(per) else np.zeros(0, np.int64))
        sizes.append(len(word[-1]))
    return word, before, train, sizes


def crowd_counts(rows: list, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Hot words and their training counts over all rows, from the columns ``first`` and the next."""
    w = np.concatenate([np.zeros(0, np.uint64), *(unplanes(r.data[first], "<u8") for r in rows)])
    c = np.concatenate([np.zeros(0, np.int64), *(unplanes(r.data[first + 1], "<u4").astype(np.int64) for r in rows)])
    keys, inverse = np.unique(w, return_inverse=True)
    return keys, np.bincount(inverse, c, minlength=len(keys)).astype(np.int64)


def stored_hot(tables: DataFrame, parts: int | None) -> Hot:
    """The buckets and hot words that stored tables were dealt by: they stand in every row."""
    row = tables.select("data").first()
    if row is None:
        return Hot(np.zeros(0, np.uint64), np.zeros(0, np.int64), parts or 8)
    own = int.from_bytes(row.data[8], "little")
    if parts not in (None, own):
        raise ValueError(f"the stored tables have {own} buckets, not {parts}")
    return Hot(unplanes(row.data[6], "<u8"), unplanes(row.data[7], "<i8"), own)


def stored_table(pdf: pd.DataFrame, hot: Hot) -> pd.DataFrame:
    """A bucket's part of the model as one row: its words, how many bigrams each ends, their histories and counts, and the hot words and number of buckets."""
    rows = list(pdf[pdf.kind == BIGRAMS].itertuples())
    if not rows:
        return _frame([])
    w, h, c = map(np.concatenate, unpacked(rows)[:3])
    order = np.lexsort((h, w))
    w, h, c = w[order], h[order], c[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    w, h, c = w[first], h[first], np.add.reduceat(c, first)
    w, h, c = w[c > 0], h[c > 0], c[c > 0]
    words_, pairs = np.unique(w, return_counts=True)
    crowd, counts = crowd_counts(rows, 7)
    return _frame([(TABLE, int(pdf.key.iloc[0]), 0, [planes(words_), planes(pairs.astype(np.uint32)), planes(h), planes(c), planes(crowd), planes(counts.astype(np.uint32)), planes(hot.words), planes(hot.spread), hot.parts.to_bytes(8, "little")])])


def bucket_tables(parts: int, hot: Hot, learns: bool = True) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A bucket's tables from its bigrams; sums for blocks, and counts and requests for histories."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int, list[bytes]]] = [(HEAD, r.key, r.source, list(r.data)) for r in pdf[pdf.kind == HEAD].itertuples()]
        rows = list(pdf[pdf.kind == BIGRAMS].itertuples())
        if not rows and not (pdf.kind == TABLE).any():
            return _frame(out)
        stored = list(pdf[pdf.kind == TABLE].itertuples())
        word, before, train, sizes = unpacked(rows)
        if not learns:
            train = [np.zeros_like(x) for x in train]
        for r in stored:
            word.append(np.repeat(unplanes(r.data[0], "<u8"), unplanes(r.data[1], "<u4")))
            before.append(unplanes(r.data[2], "<u8"))
            train.append(unplanes(r.data[3], "<i8"))
        w, h, c = np.concatenate(word), np.concatenate(before), np.concatenate(train)
        del word, before, train
        order = np.lexsort((h, w))
        w, h = w[order], h[order]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (h[1:] != h[:-1])
        pair = np.empty(len(w), np.int32)
        pair[order] = np.cumsum(new, dtype=np.int32) - 1
        del order
        count = np.bincount(pair, c, minlength=int(new.sum())).astype(np.int64)  # training count of each distinct bigram
        pair_w, pair_h = w[new], h[new]
        del w, h, c
        new = np.ones(len(pair_w), bool)
        new[1:] = pair_w[1:] != pair_w[:-1]
        owner = np.cumsum(new) - 1
        own = np.bincount(owner, count).astype(np.int64)  # training count of each word
        first = np.flatnonzero(new)
        crowd, crowd_count = crowd_counts(rows, 7) if learns else crowd_counts(stored, 4)
        at, crowded = hot.find(pair_w[first])
        if crowded.any():  # of hot words this bucket has but some bigrams
            at = np.minimum(np.searchsorted(crowd, pair_w[first][crowded]), max(len(crowd) - 1, 0))
            own[crowded] = np.where(crowd[at] == pair_w[first][crowded], crowd_count[at], 0) if len(crowd) else 0
        of_word = own[owner]
        home = hot.home[hot.find(crowd)[0]] == int(pdf.key.iloc[0]) if len(hot.words) else np.zeros(len(crowd), bool)
        answered = np.concatenate([pair_w[first][~crowded], crowd[home]]), np.concatenate([own[~crowded], crowd_count[home]])
        seen = count > 0
        kinds = np.where(seen, np.minimum(count, SMALL + 1), 0).astype(np.int8)
        ends = pair_w == END
        stamp = stamp_of(count, answered[1], int(answered[1][answered[0] == END].sum()))
        # Finished parts of each occurrence; the discounts of small counts come later.
        top = np.where(seen, count, of_word)
        term = np.where(top > SMALL, np.log(np.maximum(top - TAIL, 1.0)), 0.0)
        term -= np.where((of_word > 0) & ~ends, np.log(np.maximum(of_word, 1)), 0.0)  # as the next token's history
        base = np.log(of_word + 0.5)
        # Which later discount an occurrence waits for: 1 .. SMALL of a bigram, then 0 .. SMALL + 1 of the word of one not seen.
        waits = np.where(seen, np.where(kinds > SMALL, 0, kinds), SMALL + 1 + np.minimum(of_word, SMALL + 1)).astype(np.int8)
        need_h, need_block, need_doc, need_times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
        at = 0
        for r, n in zip(rows, sizes, strict=True):
            mine = pair[at : at + n]
            at += n
            per = unplanes(r.data[3], "<u4")
            doc, times = unplanes(r.data[4], "<u4"), unplanes(r.data[5], "<u4").astype(np.float64)
            each = np.repeat(mine, per)
            docs, slot = np.unique(doc, return_inverse=True)
            add = lambda v, slot=slot, times=times, docs=docs: np.bincount(slot, v * times, minlength=len(docs))
            fixed = lambda v: planes(np.rint(v * POINT).astype(np.int64))
            known = add(of_word[each] > 0).astype(np.uint32)
            later = np.bincount(slot * WAITS + waits[each], times, minlength=len(docs) * WAITS).reshape(-1, WAITS)[:, 1:].astype(np.uint32)
            out.append((SUMS, r.source, int(pdf.key.iloc[0]), [planes(docs), fixed(add(term[each])), fixed(add(base[each])), planes(known), planes(np.ascontiguousarray(later.T).ravel()), stamp]))
            miss = ~seen[each]
            need_h.append(pair_h[each[miss]])
            need_block.append(np.full(int(miss.sum()), r.source))
            need_doc.append(doc[miss])
            need_times.append(times[miss].astype(np.uint32))
        # For the histories: what this bucket's words take of each, to every bucket of a hot one, whose requests are spread by document.
        sh, sk, sc = pair_h[seen], kinds[seen], of_word[seen]
        nh, nb, nd, nt = map(np.concatenate, (need_h, need_block, need_doc, need_times))
        order = np.lexsort((sc, sk, sh))
        sh, sk, sc = sh[order], sk[order].astype(np.uint8), sc[order].astype(np.uint32)
        # Alike bigrams of a history travel as one with their number: a hot history has few kinds.
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (sk[1:] != sk[:-1]) | (sc[1:] != sc[:-1])
        alike = np.diff(np.append(np.flatnonzero(new), len(sh))).astype(np.uint32)
        sh, sk, sc = sh[new], sk[new], sc[new]
        index, where = hot.everywhere(sh)
        order = np.lexsort((index, where))  # histories stay in order
        index, where = index[order], where[order]
        sh, sk, sc, alike = sh[index], sk[index], sc[index], alike[index]
        target = hot.deal(nh, splitmix(nb.astype(np.uint64)) ^ nd.astype(np.uint64))
        order = np.lexsort((nh, target))
        nh, nb, nd, nt, target = nh[order], nb[order], nd[order], nt[order], target[order]
        cut, ncut = np.searchsorted(where, np.arange(parts + 1)), np.searchsorted(target, np.arange(parts + 1))
        blocks, nb = np.unique(nb, return_inverse=True)
        for b in range(parts):
            s, t = slice(cut[b], cut[b + 1]), slice(ncut[b], ncut[b + 1])
            each_h, times_h = np.unique(sh[s], return_counts=True)
            out.append((HISTORY, b, int(pdf.key.iloc[0]), [planes(each_h), planes(times_h.astype(np.uint32)), sk[s].tobytes(), planes(sc[s]), planes(alike[s]), planes(nh[t]), blocks.astype(np.int64).tobytes(), planes(nb[t].astype(np.uint32)), planes(nd[t]), planes(nt[t]), stamp]))
        frame = _frame(out)
        release()
        return frame

    return run


def backoff_weights(pdf: pd.DataFrame) -> pd.DataFrame:
    """A bucket's histories: the logarithm of each backoff weight, times the history's count, to who asked.

    The count is what the history's token already subtracted in its document.
    """
    rows = list(pdf[pdf.kind == HISTORY].itertuples())
    star, uni = totals([r.data[-1] for r in rows])
    h = np.concatenate([np.repeat(unplanes(r.data[0], "<u8"), unplanes(r.data[1], "<u4")) for r in rows])
    kind = np.concatenate([np.frombuffer(r.data[2], np.uint8) for r in rows])
    p1 = uni.probability(np.concatenate([unplanes(r.data[3], "<u4") for r in rows]).astype(np.int64))
    alike = np.concatenate([unplanes(r.data[4], "<u4") for r in rows])
    keys, inverse = np.unique(h, return_inverse=True)
    given = np.append(np.arange(1, SMALL + 1) - star, TAIL)  # of a count 1 .. SMALL, and of a larger one
    free = np.bincount(inverse, alike * given[kind.astype(np.int64) - 1], minlength=len(keys))
    rest = 1.0 - np.bincount(inverse, alike * p1, minlength=len(keys))
    with np.errstate(divide="ignore", invalid="ignore"):
        log_weight = np.log(free) - np.log(np.maximum(rest, 1e-12))  # log(count * alpha); the count cancels in the document
    sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for r in rows:
        nh = unplanes(r.data[5], "<u8")
        if not len(nh) or not len(keys):
            continue
        blocks = np.frombuffer(r.data[6], np.int64)
        nb, nd, nt = unplanes(r.data[7], "<u4"), unplanes(r.data[8], "<u4"), unplanes(r.data[9], "<u4")
        at = np.minimum(np.searchsorted(keys, nh), len(keys) - 1)
        value = np.where(keys[at] == nh, log_weight[at], 0.0) * nt  # an unknown history backs off whole
        for b in np.unique(nb):
            mine = nb == b
            sums.setdefault(int(blocks[b]), []).append((nd[mine], value[mine]))
    out = []
    for block, parts in sums.items():
        docs, slot = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        out.append((WEIGHTS, block, 0, [planes(docs), planes(np.bincount(slot, np.concatenate([p[1] for p in parts])))]))
    return _frame(out)


def gathered(pdf: pd.DataFrame) -> pd.DataFrame:
    """Second exchange: sums of one block become its documents' scores but for the backoff weights, histories give those."""
    if (pdf.kind == HISTORY).any():
        return backoff_weights(pdf)
    head, rows = pdf[pdf.kind == HEAD].iloc[0], list(pdf[pdf.kind == SUMS].itertuples())
    n_tokens = unplanes(head.data[2], "<u4")
    star, uni = totals([r.data[-1] for r in rows])
    log_later = np.concatenate([np.log(star), [np.log(uni.unknown)], np.log(uni.star), [0.0]])
    unseen = np.concatenate([np.zeros(SMALL), np.ones(SMALL + 2)])  # these are counts, not yet probabilities
    log_later = log_later - unseen * np.log(max(uni.total, 1))
    score, base, known = np.zeros(len(n_tokens)), np.zeros(len(n_tokens)), np.zeros(len(n_tokens), np.int64)
    for r in rows:
        docs = unplanes(r.data[0], "<u4")
        later = unplanes(r.data[4], "<u4").reshape(WAITS - 1, -1)
        score[docs] += unplanes(r.data[1], "<i8") / POINT + log_later @ later
        base[docs] += unplanes(r.data[2], "<i8") / POINT
        known[docs] += unplanes(r.data[3], "<u4")
    score -= np.log(max(uni.texts, 1))  # the history of first tokens
    base -= n_tokens * np.log(max(uni.total + 0.5 * (uni.types + 1), 1e-300))
    return _frame([(SUMS, head.key, uni.total, [*head.data, planes(score), planes(base), planes(known)])])


def finished(pdf: pd.DataFrame) -> pd.DataFrame:
    """A block's documents with the backoff weights added."""
    row = pdf[pdf.kind == SUMS].iloc[0]
    ids, learn, n_tokens = unplanes(row.data[0], "<i8"), np.frombuffer(row.data[1], bool), unplanes(row.data[2], "<u4")
    score, base, known = unplanes(row.data[3], "<f8").copy(), unplanes(row.data[4], "<f8"), unplanes(row.data[5], "<i8")
    for r in pdf[pdf.kind == WEIGHTS].itertuples():
        score[unplanes(r.data[0], "<u4")] += unplanes(r.data[1], "<f8")
    return pd.DataFrame({"doc_id": ids, "held_out": ~learn, "n_tokens": n_tokens.astype(np.int64), "n_known": known, "train_tokens": int(row.source), "base_score": base / LOG10, "score": score / LOG10})


def _rows(docs: DataFrame, learn: Column) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS).cast("long")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))


def katz_tables(docs: DataFrame, learn: Column, parts: int) -> DataFrame:
    """The model's tables, a row a bucket of words (key, data), to write and score with later.

    Words are dealt into ``parts`` buckets by hash; the tables know how many.
    """
    rows = _rows(docs, learn).where("learn")
    hot = hot_words(rows, parts)
    sent = rows.mapInArrow(send_bigrams(parts, hot), ROW).where(F.col("kind") == BIGRAMS)
    return sent.groupBy("key").applyInPandas(lambda pdf: stored_table(pdf, hot), ROW)


def katz_scores(docs: DataFrame, learn: Column, parts: int | None = None, tables: DataFrame | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents that ``learn`` holds for and scores all.  Words
    stand between ASCII white space, ASCII capitals as small letters; each text
    closes with an end token, so a null or empty text has that one.  base_score
    is the add-one-half unigram score, score the Katz model's, both in log10.
    With stored ``tables`` these are the model, and ``learn`` only names rows;
    their number of buckets holds.  Texts are read whole, however long.  Rows
    without a doc_id are scored like others; whether they teach is for
    ``learn`` to say, and null means no.  Repeated rows get, and teach, a row
    each.  Without training text all tokens are unknown words of probability 1.
    Other columns are not looked at, but by ``learn``; an empty table gives no rows.
    """
    rows = _rows(docs, learn)
    hot = hot_words(rows, parts or buckets(docs.sparkSession, times=1.5)) if tables is None else stored_hot(tables, parts)
    parts = hot.parts
    settle = bucket_tables(parts, hot, tables is None)
    sent = rows.mapInArrow(send_bigrams(parts, hot), ROW)
    if tables is not None:
        sent = sent.union(tables)
    # The key of a head row is its block: any bucket passes it on.
    answered = sent.groupBy(F.when(F.col("kind") == HEAD, -1 - F.col("key")).otherwise(F.col("key")).alias("k")).applyInPandas(lambda pdf: settle(pdf), ROW)
    collected = answered.groupBy((F.col("kind") == HISTORY).alias("of_history"), "key").applyInPandas(lambda pdf: gathered(pdf), ROW)
    out = collected.groupBy("key").applyInPandas(lambda pdf: finished(pdf), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NAMELESS).cast("long")))
