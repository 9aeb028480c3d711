"""Language identification with interpolated Kneser-Ney character models.

One model a language, over characters of lower-cased words padded by a word
mark.  The n-grams of all languages share sorted hash arrays that hold the
finished log probability for each language, so one binary search serves all;
n-grams that no language has seen back off through stored context weights.
The language with the lowest cross-entropy a character wins.  Words are scored
once a slice of texts, however often they occur.

The models are fitted on a bounded sample of labelled rows: at most
``sample_docs`` whole texts a language, of at most ``sample_chars`` characters,
picked by a hash of doc_id.  A language that has only longer texts gives its
shortest ones, up to as many characters in all, and one at least.  One task fits
and calibrates the models; the driver only passes them on.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import drop, quoted, written
from .textcore import IS_SPACE, hashed, release, slices, splitmix, utf8

ORDER = 5
SAMPLE_DOCS = 300
SAMPLE_CHARS = 8000
#: Up to so many languages their counts are sent to every task.
BROADCAST_LANGS = 10_000
SLICE = 3 << 19
MARK = np.uint64(32)
UNDETERMINED = "und"
_tables: dict[str, np.ndarray] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and the small letter of each."""
    if not _tables:
        _tables["letter"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        small = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(_tables["letter"]):
            low = chr(c).lower()
            if len(low) == 1:
                small[c] = ord(low)
        _tables["small"] = small
    return _tables["letter"], _tables["small"]


def word_table(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of some texts: (symbols, word starts in them, word of each token, text of each token, length of each word).

    Symbols hold each distinct word with a mark before and after it.
    """
    letter, small = _letters()
    base = int(offsets[0])
    piece = buf[base : int(offsets[-1])]
    heads = np.zeros(len(piece) + 1, np.int64)
    np.cumsum((piece & 0xC0) != 0x80, out=heads[1:])
    cuts = heads[offsets - base]
    points = small[np.frombuffer(piece.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
    inside = letter[points]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    inner = cuts[1:-1][(cuts[1:-1] > 0) & (cuts[1:-1] < len(points))]
    first[inner] |= inside[inner]
    last[inner - 1] |= inside[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(s):
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z, z
    h = hashed(points.view(np.uint8), 4 * s, 4 * e)
    _, sample, token = np.unique(h, return_index=True, return_inverse=True)
    length = e[sample] - s[sample]
    starts = np.r_[0, np.cumsum(length + 2)]
    symbols = np.full(int(starts[-1]), MARK, np.uint64)
    flat = np.arange(int(length.sum())) + np.repeat(s[sample] - np.r_[0, np.cumsum(length)[:-1]], length)
    place = np.arange(int(length.sum())) + np.repeat(starts[:-1] + 1 - np.r_[0, np.cumsum(length)[:-1]], length)
    symbols[place] = points[flat]
    return symbols, starts, token, np.searchsorted(cuts, s, "right") - 1, length


def _grams(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(position in word, hash of the k symbols that end here for k = 0 .. ORDER)."""
    pos = np.arange(len(symbols)) - np.repeat(starts[:-1], np.diff(starts))
    own = splitmix(symbols + np.uint64(1 << 32))
    grams = [np.zeros(len(symbols), np.uint64)]
    for k in range(1, ORDER + 1):
        before = np.zeros(len(symbols), np.uint64)
        before[1:] = grams[-1][:-1]
        grams.append(splitmix(before ^ (own + np.uint64(k))))
    return pos, grams


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def fit(samples: dict[str, list[str]]) -> dict[str, Any]:
    """Sorted hash arrays of all languages' models from whole sample texts."""
    langs = sorted(samples)
    streams = []
    for lang in langs:
        data = [t.encode() for t in samples[lang]]
        off = np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int64)
        symbols, starts, token, _, _ = word_table(np.frombuffer(b"".join(data), np.uint8), off)
        streams.append((symbols, starts, np.bincount(token, minlength=len(starts) - 1) if len(token) else np.zeros(0, np.int64)))
    if not any(len(x[0]) for x in streams):
        return {"langs": [], "grams": [], "contexts": [], "floor": 0.0}
    parts = [(*_grams(s, st), np.repeat(c, np.diff(st))) for s, st, c in streams if len(s)]
    floor = float(-np.log(len(np.unique(np.concatenate([x[0] for x in streams]))) + 1))
    # What each language counts: (gram, context, suffix) rows for each order.
    counts: list[list[tuple[np.ndarray, np.ndarray, float, np.ndarray, np.ndarray, np.ndarray]]] = []
    union: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(1, ORDER + 1):
        per, rows = [], []
        for (pos, g, weight), (symbols, starts, _) in zip(parts, [x for x in streams if len(x[0])], strict=True):
            ok = (pos >= max(1, k - 1))
            gram, ctx, suffix, w = g[k][ok], np.r_[np.uint64(0), g[k - 1][:-1]][ok], g[k - 1][ok], weight[ok].astype(float)
            keys, sample, inverse = np.unique(gram, return_index=True, return_inverse=True)
            adjusted = np.bincount(inverse, w)
            if k < ORDER:  # continuation counts, but for grams that begin a word
                longer = pos >= max(1, k)
                _, one = np.unique(g[k + 1][longer], return_index=True)
                kinds = np.bincount(np.searchsorted(keys, g[k][longer][one]), minlength=len(keys)).astype(float)
                starts_word = (pos[ok] == k - 1)[sample]
                adjusted = np.where(starts_word | (kinds == 0), adjusted, kinds)
            n1, n2 = (adjusted == 1).sum(), (adjusted == 2).sum()
            discount = float(np.clip(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1, 0.95))
            ckeys, cinv = np.unique(ctx[sample], return_inverse=True)
            per.append((keys, adjusted, discount, ckeys, np.bincount(cinv, adjusted), np.bincount(cinv, np.minimum(adjusted, discount))))
            rows.append((keys, ctx[sample], suffix[sample]))
        keys, one = np.unique(np.concatenate([r[0] for r in rows]), return_index=True)
        union.append((keys, np.concatenate([r[1] for r in rows])[one], np.concatenate([r[2] for r in rows])[one]))
        counts.append(per)
    grams, contexts = [], []
    below: tuple[np.ndarray, np.ndarray] | None = None
    for k, (keys, ctx, suffix) in enumerate(union, 1):
        prior = np.full((len(keys), len(parts)), np.exp(floor)) if below is None else below[1][_find(below[0], suffix)[0]]
        table = np.empty_like(prior)
        ckeys = np.unique(ctx)
        weights = np.zeros((len(ckeys), len(parts)))
        for i, (own, adjusted, discount, own_ctx, total, taken) in enumerate(counts[k - 1]):
            at, has = _find(own, keys)
            c = np.where(has, adjusted[at], 0.0)
            at, seen = _find(own_ctx, ctx)
            table[:, i] = np.where(seen, np.maximum(c - discount, 0) / total[at] + taken[at] / total[at] * prior[:, i], prior[:, i])
            at, seen = _find(own_ctx, ckeys)
            weights[:, i] = np.where(seen, np.log(taken[at] / total[at]), 0.0)
        below = keys, table
        grams.append((keys, np.log(table).astype(np.float32)))
        contexts.append((ckeys, weights.astype(np.float32)))
    return {"langs": [x for x, s in zip(langs, streams, strict=True) if len(s[0])], "grams": grams, "contexts": contexts, "floor": floor}


def word_scores(model: dict[str, Any], symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(words, languages) log probabilities."""
    pos, g = _grams(symbols, starts)
    out = np.zeros((len(symbols), len(model["langs"])), np.float64)
    active = np.flatnonzero(pos >= 1)
    for k in range(ORDER, 0, -1):
        can = pos[active] >= k - 1
        here = active[can]
        keys, table = model["grams"][k - 1]
        at, hit = _find(keys, g[k][here])
        out[here[hit]] += table[at[hit]]
        miss = here[~hit]
        ckeys, weights = model["contexts"][k - 1]
        at, hit = _find(ckeys, g[k - 1][miss - 1])
        out[miss[hit]] += weights[at[hit]]
        active = np.sort(np.r_[active[~can], miss])
    out[active] += model["floor"]
    return np.add.reduceat(out, starts[:-1], axis=0) if len(starts) > 1 else np.zeros((0, len(model["langs"])))


def text_scores(model: dict[str, Any], buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log probability of each text for each language, characters of each text)."""
    n = len(offsets) - 1
    if n == 1 and offsets[1] - offsets[0] > 2 * SLICE:  # a long text goes in pieces cut at white space
        total, size, at = np.zeros((1, len(model["langs"]))), np.zeros(1), int(offsets[0])
        while at < offsets[1]:
            stop = min(int(offsets[1]), at + SLICE)
            while stop < offsets[1] and not IS_SPACE[buf[stop]]:
                stop += 1
            if stop - at > 2 * SLICE:  # one enormous word, or a script without spaces: between two characters
                stop = at + SLICE
                while (buf[stop] & 0xC0) == 0x80:
                    stop += 1
            part, k = text_scores(model, buf, np.array([at, stop]))
            total, size, at = total + part, size + k, stop
        return total, size
    symbols, starts, token, text, length = word_table(buf, offsets)
    if not len(token):
        return np.zeros((n, len(model["langs"]))), np.zeros(n)
    by_word = word_scores(model, symbols, starts)
    total = np.column_stack([np.bincount(text, by_word[token, i], minlength=n) for i in range(by_word.shape[1])])
    return total, np.bincount(text, length[token] + 1, minlength=n).astype(float)


def calibrate(model: dict[str, Any], samples: dict[str, list[str]]) -> dict[str, Any]:
    """Adds temperature and rejection bound from texts that the counts have not seen.

    The bound: cross-entropy above which a text is unlike every language, as
    the 99th percentile of the unseen sample texts plus as much again as that
    lies above their median, with an allowance for short texts.
    """
    margins, right, entropy, sizes = [], [], [], []
    for i, lang in enumerate(model["langs"]):
        data = [t.encode() for t in samples.get(lang, [])]
        if not data:
            continue
        total, n = text_scores(model, np.frombuffer(b"".join(data), np.uint8), np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int64))
        ok = n > 0
        margins.append(total[ok] - total[ok].max(1, keepdims=True))
        right.append(np.full(ok.sum(), i))
        entropy.append(-total[ok].max(1) / n[ok])
        sizes.append(n[ok])
    if not margins:
        return model | {"temperature": 1.0, "bound": np.inf, "short": 0.0}
    m, y, h, n = map(np.concatenate, (margins, right, entropy, sizes))
    best, temperature = np.inf, 1.0
    for t in (1, 2, 5, 10, 20, 50, 100, 200, 500):
        p = np.exp(m / t)
        loss = -np.log(np.clip(p[np.arange(len(y)), y] / p.sum(1), 1e-12, 1)).mean()
        if loss < best:
            best, temperature = loss, float(t)
    mid = float(np.median(h))
    long = h[n >= 50] if (n >= 50).any() else h
    high = float(np.quantile(long, 0.99))
    return model | {"temperature": temperature, "bound": high + max(high - mid, 1.0), "short": 4.0}


def predict(model: dict[str, Any], carry: list[str]) -> Callable:
    names = ["doc_id", "lang_pred", "score", "cross_entropy", "rejected", *(c for c in carry if c != "doc_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array(model["langs"], object)
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in slices(off, SLICE):
                total, n = text_scores(model, buf, off[i : j + 1]) if len(langs) else (np.zeros((j - i, 0)), np.zeros(j - i))
                if len(langs):
                    p = np.exp((total - total.max(1, keepdims=True)) / model["temperature"])
                    best, sure = total.argmax(1), p.max(1) / p.sum(1)
                    name = np.where(n > 0, langs[best], UNDETERMINED)
                    entropy = np.where(n > 0, -total.max(1) / np.maximum(n, 1), np.nan)
                else:
                    name, sure, entropy = np.full(j - i, UNDETERMINED, object), np.zeros(j - i), np.full(j - i, np.nan)
                known = (n > 0) & bool(len(langs))
                rejected = ~known | (np.nan_to_num(entropy) > model["bound"] + model["short"] / np.sqrt(np.maximum(n, 1)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(name.tolist(), pa.string()), pa.array(np.where(known, sure, 0.0)), pa.array(np.where(known, entropy, 0.0)), pa.array(rejected), *(batch.column(c).slice(i, j - i) for c in names[5:])],
                    names=names,
                )

    return run


def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of a whole sample (lang, turn, text); every fifth text of a language only calibrates."""
    rows = sorted((r["lang"], r["turn"], r["text"]) for b in batches for r in b.to_pylist())
    part = lambda held: {lang: [t for x, turn, t in rows if x == lang and (turn % 5 == 0) == held] for lang in {r[0] for r in rows}}
    model = pickle.dumps(calibrate(fit(part(False)), part(True)))
    release()
    yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])


def train(docs: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, Any]:
    """A model from the rows of (doc_id, text, lang) that ``learn`` holds for; rows without a language or text teach nothing."""
    size = F.length("text")
    labelled = docs.where(learn & F.col("lang").isNotNull() & (size > 0)).select("doc_id", "text", "lang", size.alias("size"))
    counts = written(labelled.groupBy("lang").agg(F.count_if(F.col("size") <= sample_chars).alias("short"), F.count("*").alias("all")))
    few = counts.count() <= BROADCAST_LANGS
    rows = labelled.join(F.broadcast(counts) if few else counts, "lang").where((F.col("size") > sample_chars) == (F.col("short") == 0))
    # A hash thins each language to some times its sample before rows are ordered, so no task orders a language.
    key = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = (4.0 * sample_docs + 100.0) / F.when(F.col("short") > 0, F.col("short")).otherwise(F.col("all"))
    rows = rows.where(key < share * float(1 << 30))
    order = Window.partitionBy("lang").orderBy(F.when(F.col("short") == 0, F.col("size")).otherwise(0), key, "doc_id", F.xxhash64("text"))
    rows = rows.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= sample_docs)
    rows = rows.withColumn("taken", F.sum("size").over(order)).where((F.col("turn") == 1) | (F.col("taken") <= sample_docs * sample_chars))
    got = rows.select("lang", "turn", "text").repartition(1).mapInArrow(fitted, "model binary").first()
    drop(counts)
    return pickle.loads(got.model) if got else calibrate(fit({}), {})  # noqa: S301  the task's own bytes


def identify(docs: DataFrame, model: dict[str, Any], carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, cross_entropy, rejected, and the columns in ``carry``.

    Null texts and texts without a letter are ``und`` with score 0 and
    rejected.  Rejected are also texts whose cross-entropy a character lies
    above the calibrated bound.  score is the winner's share of the calibrated
    likelihoods.  Ties go to the first language by name; without any labelled
    text everything is ``und``.  Repeated rows and rows without a doc_id get a
    row each, an empty table gives none.  Long texts are scored whole, in
    pieces cut between words.  Columns that are not carried are not looked at;
    doc_id and text may be carried, other names must not clash with the above.
    """
    carry = carry or []
    shared = docs.sparkSession.sparkContext.broadcast(model)
    more = [c for c in carry if c not in ("doc_id", "text")]
    own = T.StructType.fromDDL("doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")
    schema = T.StructType([*own, *(docs.schema[c] for c in carry if c != "doc_id")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from predict(shared.value, carry)(batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *map(quoted, more)).mapInArrow(run, schema)
