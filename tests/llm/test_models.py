"""Katz scores, language identification, token counts, decontamination, mixing and secrets."""

import base64
import bz2
import gzip
import hashlib
import itertools
import lzma
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import quote

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontaminate as dec
from corvane.llm import katz, language_id, secrets
from corvane.llm.mixing import mixed
from corvane.llm.token_counts import Automaton, token_counts

ODD = [(1, None), (2, ""), (3, " \n "), (4, "the"), (5, "The THE the"), (6, "x" * 5000), (7, "a b c " * 4000)]


def remainder(mod):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


# --- Katz ------------------------------------------------------------------------


class Brute:
    def __init__(self, rows):
        self.tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in rows}
        self.held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in self.tokens}
        self.c1, self.c2 = Counter(), Counter()
        for i, ws in self.tokens.items():
            if not self.held[i]:
                self.c1.update(ws)
                self.c2.update(zip([b" S"] + ws[:-1], ws, strict=True))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        few = lambda c: np.array([sum(v == r for v in c.values()) for r in range(1, 7)], float)
        self.s1, self.s2 = katz.discounts(few(self.c1)), katz.discounts(few(self.c2))
        self.unknown = sum(c - self.cut(c, self.s1) for c in self.c1.values()) / self.n
        self.after = defaultdict(list)
        for (h, w), c in self.c2.items():
            self.after[h].append((w, c))
        self.size = {h: sum(c for _, c in x) for h, x in self.after.items()}
        self.alpha = {h: sum(c - self.cut(c, self.s2) for _, c in x) / self.size[h] / (1 - sum(self.p1(w) for w, _ in x)) for h, x in self.after.items()}

    def cut(self, c, star):
        return star[c - 1] if c <= katz.SMALL else c - katz.TAIL

    def p1(self, w):
        return self.cut(self.c1[w], self.s1) / self.n if w in self.c1 else self.unknown

    def p2(self, h, w):
        if h not in self.after:
            return self.p1(w)
        c = self.c2.get((h, w), 0)
        return self.cut(c, self.s2) / self.size[h] if c else self.alpha[h] * self.p1(w)


@pytest.mark.parametrize("block", [200, 2_000_000])
def test_katz_equals_brute_force(make, texts, block, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK", block)
    rows = ODD + [(100 + i, t) for i, t, _ in texts]
    b = Brute(rows)
    got = {r.doc_id: r for r in katz.katz_scores(make(rows), remainder(5) != 1).collect()}
    for i, ws in b.tokens.items():
        base = sum(math.log10((b.c1[w] + 0.5) / (b.n + 0.5 * (b.v + 1))) for w in ws)
        score = sum(math.log10(b.p2(h, w)) for h, w in zip([b" S"] + ws[:-1], ws, strict=True))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (b.held[i], len(ws), sum(w in b.c1 for w in ws), b.n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-6)


def test_katz_totals_reach_blocks_of_one_short_document(spark, make, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK", 1)
    rows = [(i, f"w{i} the w{i % 5} of") for i in range(12)] + [(100, None), (101, ""), (102, "the")]
    b, docs = Brute(rows), make(rows, 15)
    tables = spark.createDataFrame(katz.katz_tables(docs, remainder(5) != 1, 60).collect(), katz.ROW)
    for scored in (katz.katz_scores(docs, remainder(5) != 1, 60), katz.katz_scores(docs, remainder(5) != 1, 60, tables)):
        for r in scored.collect():
            ws = b.tokens[r.doc_id]
            base = sum(math.log10((b.c1[w] + 0.5) / (b.n + 0.5 * (b.v + 1))) for w in ws)
            score = sum(math.log10(b.p2(h, w)) for h, w in zip([b" S"] + ws[:-1], ws, strict=True))
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in b.c1 for w in ws), b.n)
            assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-6) and math.isclose(r.score, score, rel_tol=1e-9, abs_tol=1e-6)


def test_katz_spreads_hot_words(spark, make, texts, monkeypatch):
    monkeypatch.setattr(katz, "SAMPLE", 1)
    monkeypatch.setattr(katz, "BLOCK", 3000)
    rows = [(i, f"hot hot hot w{i % 7} " * 20) for i in range(60)] + [(100 + i, t) for i, t, _ in texts[:60]] + [(1000 + i, t) for i, t in ODD[:6]]
    docs = make(rows)
    hot = katz.hot_words(katz._rows(docs, F.lit(True)), 40)
    assert len(hot.words) >= 3 and hot.spread.max() > 3
    b = Brute(rows)
    scored = katz.katz_scores(docs, remainder(5) != 1, 40)
    tables = spark.createDataFrame(katz.katz_tables(docs, remainder(5) != 1, 40).collect(), katz.ROW)
    for got in (scored.collect(), katz.katz_scores(docs, remainder(5) != 1, 40, tables).collect()):
        got = {r.doc_id: r for r in got}
        for i, ws in b.tokens.items():
            base = sum(math.log10((b.c1[w] + 0.5) / (b.n + 0.5 * (b.v + 1))) for w in ws)
            score = sum(math.log10(b.p2(h, w)) for h, w in zip([b" S"] + ws[:-1], ws, strict=True))
            assert (got[i].n_known, got[i].train_tokens) == (sum(w in b.c1 for w in ws), b.n)
            assert math.isclose(got[i].base_score, base, rel_tol=1e-9, abs_tol=1e-6) and math.isclose(got[i].score, score, rel_tol=1e-9, abs_tol=1e-6)


def good_turing(n):
    """Katz's r* for r = 1 .. 5 from how many types have count 1 .. 6, as in his paper; r - 1/2 where that is not in (0, r)."""
    out = []
    for r in range(1, 6):
        star = None
        if n[r - 1] and n[0] and n[0] != 6 * n[5]:
            ratio = 6 * n[5] / n[0]
            star = ((r + 1) * n[r] / n[r - 1] - r * ratio) / (1 - ratio)
        out.append(star if star is not None and 0 < star < r else r - 0.5)
    return np.array(out)


def test_katz_discounts_are_good_turing():
    for n in ([100, 40, 20, 12, 8, 5], [5, 9, 1, 0, 3, 0], [0, 0, 0, 0, 0, 0], [10, 3, 9, 1, 1, 4]):
        assert np.allclose(katz.discounts(np.array(n)), good_turing(n))


def test_katz_weights_normalise_every_history(texts):
    import pandas as pd
    import pyarrow as pa

    rows = [(i, t) for i, t, _ in texts[:50]]
    b = Brute(rows)
    few = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
    b.s1, b.s2 = good_turing(few(b.c1)), good_turing(few(b.c2))
    b.unknown = sum(c - b.cut(c, b.s1) for c in b.c1.values()) / b.n
    learn = [not b.held[i] for i, _ in rows]
    histories = [h for h in b.after if h not in (b" S",)][:300]
    probes = ["unseenword", *(h.decode() + " unseenword" for h in histories)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows) + len(probes))), pa.array([t or "" for _, t in rows] + probes), pa.array(learn + [False] * len(probes))], names=["doc_id", "text", "learn"])
    hot = katz.Hot(np.zeros(0, np.uint64), np.zeros(0, np.int64), 1)
    sent = pd.concat([x.to_pandas() for x in katz.send_bigrams(1, hot)([batch])])
    answered = katz.bucket_tables(1, hot)(sent[sent.kind == katz.BIGRAMS])
    weights = katz.backoff_weights(answered[answered.kind == katz.HISTORY])
    got = dict(zip(katz.unplanes(weights.data.iloc[0][0], "<u4").tolist(), katz.unplanes(weights.data.iloc[0][1], "<f8").tolist(), strict=True))
    start = got[len(rows)]
    checked = 0
    for k, h in enumerate(histories, len(rows) + 1):
        # log(count * alpha): the probe asked for the beginning's too where no text begins with h
        alpha = math.exp(got[k] - (0.0 if (b" S", h) in b.c2 else start)) / b.size[h]
        seen = sum(b.cut(c, b.s2) / b.size[h] for _, c in b.after[h])
        assert math.isclose(seen + alpha * (1 - sum(b.p1(w) for w, _ in b.after[h])), 1, rel_tol=1e-9)
        checked += 1
    assert checked > 100
    assert math.isclose(sum(b.p1(w) for w in b.c1) + b.unknown, 1, rel_tol=1e-9)


@pytest.mark.parametrize("n", [1024, 4096])
def test_structured_words_are_told_apart(spark, make, n):
    one, two = ("".join(x[bin(i).count("1") & 1] for i in range(n)) for x in ("ab", "ba"))
    r = {r.doc_id: r for r in katz.katz_scores(make([(1, one), (2, two)]), F.col("doc_id") == 1).collect()}
    assert (r[1].n_known, r[2].n_known) == (2, 1)
    v = [bytes([i]) for i in range(256)] + [one[:6].encode(), b"abb"]
    got = {r.doc_id: r.n_tokens for r in token_counts(make([(1, f"{one} {two}"), (2, two)]), v).collect()}
    assert got == {1: greedy(b" " + one.encode(), set(v)) + greedy(b" " + two.encode(), set(v)), 2: greedy(b" " + two.encode(), set(v))}
    items = [(1, f"{one} a b c d e f")]
    rows = [(1, f"x {one} a b c d e f y"), (2, f"x {two} q r s t u v y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in dec.contaminated(make(rows), bench).collect()} == {d for d, _ in brute_leaks(rows, items)} == {1}


def test_katz_beats_the_base_on_held_out_copies(make, texts):
    rows = [(i, t) for i, t, _ in texts] + [(10_000 + i, t) for i, t, _ in texts]
    held = [r for r in katz.katz_scores(make(rows), remainder(5) != 1).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_katz_odd_tables(make):
    assert katz.katz_scores(make([]), F.lit(True)).count() == 0
    r = katz.katz_scores(make([(1, "a b")]), F.lit(False)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.score)
    got = katz.katz_scores(make([(1, "a"), (1, "a"), (None, "b")]), F.lit(True)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.n_known) for r in got) == [(0, 2, 2), (1, 2, 2), (1, 2, 2)] and {r.train_tokens for r in got} == {6}


# --- language identification -------------------------------------------------------


def test_held_out_accuracy(spark, texts):
    df = spark.createDataFrame([(i, t, x) for i, t, x in texts], "doc_id long, text string, lang string")
    model = language_id.train(df, remainder(5) != 0)
    found = language_id.identify(df, model).join(df.select("doc_id", "lang"), "doc_id").where(remainder(5) == 0).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found) and not any(r.rejected for r in found)


def test_language_odd_texts(make, texts):
    df = make(ODD + [(8, "123 !?"), (100, "the and that with", "en", "s"), (101, "le les des une", "fr", "s"), (102, None, "fr", "s")])
    model = language_id.train(df, F.lit(True))
    assert model["langs"] == ["en", "fr"]
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected for i in (1, 2, 3, 8, 102))
    assert got[4].lang_pred == "en" and got[101].lang_pred == "fr"
    empty = language_id.train(make([(1, "x")]), F.lit(True))
    assert language_id.identify(make([(1, "x")]), empty).first().lang_pred == "und"
    assert language_id.identify(make([]), model).count() == 0


def test_long_text_in_pieces(monkeypatch):
    model = language_id.fit({"a": ["abba abc cab"], "b": ["été où là"]})
    text = ("abba été où " * 300).encode()
    buf, off = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = language_id.text_scores(model, buf, off)
    for size in (100, 37):
        monkeypatch.setattr(language_id, "SLICE", size)
        parts = language_id.text_scores(model, buf, off)
        assert np.allclose(whole[0], parts[0]) and whole[1] == parts[1]
    long = ("é" * 500).encode()
    assert language_id.text_scores(model, np.frombuffer(long, np.uint8), np.array([0, len(long)]))[1] > 0


def test_zstandard_layer():
    import zstandard

    text = b64(zstandard.ZstdCompressor().compress(SECRET.encode()))
    assert any(s[0] == "assign" for s in secrets.all_spans(text)[1])


class KneserNey:
    """Interpolated Kneser-Ney over words padded by a mark, order by order from plain dictionaries."""

    def __init__(self, text, order=5):
        self.order = order
        words = [f" {w} " for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()]
        self.symbols = {c for w in words for c in w}
        raw = [Counter(w[p - k + 1 : p + 1] for w in words for p in range(max(1, k - 1), len(w))) for k in range(1, order + 1)]
        self.counts, self.discount, self.total, self.taken = [], [], [], []
        for k in range(1, order + 1):
            counts = dict(raw[k - 1])
            if k < order:
                kinds = Counter(g[1:] for g in raw[k])
                counts = {g: c if (k > 1 and g[0] == " ") or not kinds[g] else kinds[g] for g, c in counts.items()}
            n1, n2 = (sum(c == n for c in counts.values()) for n in (1, 2))
            d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.1), 0.95)
            total, taken = Counter(), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
                taken[g[:-1]] += min(c, d)
            self.counts.append(counts)
            self.discount.append(d)
            self.total.append(total)
            self.taken.append(taken)

    def p(self, symbol, context):
        context = context[-(self.order - 1) :]
        k = len(context) + 1
        below = self.p(symbol, context[1:]) if context else 1 / (len(self.symbols) + 1)
        total = self.total[k - 1][context]
        return max(self.counts[k - 1].get(context + symbol, 0) - self.discount[k - 1], 0) / total + self.taken[k - 1][context] / total * below if total else below

    def word(self, w):
        w = f" {w} "
        return sum(math.log(self.p(w[i], w[:i])) for i in range(1, len(w)))


def test_kneser_ney_equals_brute_force(texts):
    samples = {lang: [t for _, t, x in texts if x == lang][:3] for lang in ("en", "fr")}
    model = language_id.fit(samples)
    probes = sorted({w for t in samples["en"] for w in re.findall("[a-z]+", t.lower())})[:60] + ["zzz", "qxqx", "unbekannt", "été", "s", "thethethe", "żółć"]
    for i, lang in enumerate(model["langs"]):
        one = language_id.fit({lang: samples[lang]})  # the floor is that of this language's own symbols
        brute = KneserNey(" ".join(samples[lang]))
        for w in probes:
            word = np.array([32, *map(ord, w), 32], np.uint64)
            got = language_id.word_scores(one, word, np.array([0, len(word)]))[0, 0]
            assert math.isclose(got, brute.word(w), rel_tol=1e-5, abs_tol=1e-4), (lang, w)
        for context in (" ", " t", " th", "qq", "e", " le"):
            assert abs(sum(brute.p(c, context) for c in brute.symbols) + brute.p("\0", context) - 1) < 1e-9
        assert model["langs"][i] == lang


def test_other_languages_code_and_noise_are_rejected(spark, texts):
    rng = random.Random(8)
    foreign = {
        1: "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. " * 2,
        2: "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. " * 2,
        3: "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待" * 4,
        4: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(9)) for _ in range(60)),
        5: "void xq(int**p){for(;;)if(!*p++)x^=1<<k;}#define ZQ(k)((k)&0xff)\nfn zzk<'a>(&mut sq:Vec<u8>)->Rxk{sq.pq();}" * 4,
        6: "7342 9951 -- 88 :: 11 !! 0",
    }
    df = spark.createDataFrame([(1000 + i, t, x) for i, t, x in texts] + [(k, t, None) for k, t in foreign.items()], "doc_id long, text string, lang string")
    got = {r.doc_id: r.rejected for r in language_id.identify(df, language_id.train(df, F.lit(True))).collect()}
    assert [k for k in foreign if not got[k]] == []
    assert not any(v for k, v in got.items() if k >= 1000)


def test_language_of_long_texts_only_is_learnt(make, texts):
    some = {x: next(t for _, t, y in texts if y == x and 300 < len(t)) for x in ("en", "fr")}
    rows = [(i, some["en"], "en", "s") for i in range(10)] + [(100 + i, (some["fr"] + " ") * (60 + i), "fr", "s") for i in range(8)]
    model = language_id.train(make(rows), F.lit(True), sample_chars=len(some["fr"]) * 10)
    assert model["langs"] == ["en", "fr"]
    assert language_id.identify(make([(1, some["fr"])]), model).first().lang_pred == "fr"


# --- token counts --------------------------------------------------------------------


def greedy(word, vocabulary):
    n = at = 0
    while at < len(word):
        size = next((k for k in range(min(len(word) - at, 6), 0, -1) if word[at : at + k] in vocabulary), 0)
        if not size:
            return -1
        at, n = at + size, n + 1
    return n


def test_automaton_equals_greedy():
    rng = random.Random(1)
    for _ in range(300):
        v = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        a = Automaton.build(sorted(v))
        for _ in range(40):
            w = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            assert a.count(w) == greedy(w, v)


def test_token_counts_of_texts(make, texts):
    v = [bytes([i]) for i in range(256)] + [b" t", b" the", b"he", b"the", b" a", b"en", b"nde", b"er"]
    rows = ODD + [(100 + i, t) for i, t, _ in texts]
    got = {r.doc_id: (r.n_words, r.n_tokens, r.n_unknown) for r in token_counts(make(rows), v).collect()}
    assert got == {i: (len(w := (t or "").encode().split()), sum(greedy(b" " + x, set(v)) for x in w), 0) for i, t in rows}
    assert token_counts(make([]), v).count() == 0
    r = token_counts(make([(1, "ab zz ab")]), [b" ", b"a", b"b"]).first()
    assert (r.n_words, r.n_tokens, r.n_unknown) == (3, 7, 1)


# --- decontamination ------------------------------------------------------------------


def brute_leaks(rows, items, percent=80):
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else [])
    out = {}
    for d, t in rows:
        for item, it in items:
            w, own = split(t), split(it)
            if not w or not own:
                continue
            bag, span = Counter(grams(own)), min(len(own), len(w))
            for p in range(len(w) - span + 1):
                c = Counter(grams(w[p : p + span]))
                shared = sum((c & bag).values())
                united = sum(c.values()) + sum(bag.values()) - shared
                if 100 * shared >= percent * united:
                    at, best, n = out.get((d, item), (p, -1.0, 0))
                    out[d, item] = (p, shared / united, n + 1) if shared / united > best else (at, best, n + 1)
    return out


def test_leaks(spark, make):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((40, 14, 60, 3, 1, 40))] + [(6, None), (7, ""), (8, "same same same same same same same")]
    noise = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, t) for i, t in ODD if i != 7] + [(10 + i, f"{noise(30)} {t} {noise(20)}") for i, t in items if t]
    rows += [(30, items[0][1].upper().replace(" ", ", ")), (31, " ".join(items[2][1].split()[:55])), (32, items[0][1].replace(items[0][1].split()[20], "zzzzz")), (33, noise(200)), (34, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(5))
    for size in (1 << 20, 200):  # the second in several blocks of items
        got = {(r.doc_id, r.item_id): (r.first_word, r.similarity, r.n_windows) for r in dec.contaminated(make(rows), bench, block_bytes=size).collect()}
        assert got == brute_leaks(rows, items)
    kept = dec.decontaminated(make(rows), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert dec.contaminated(make([]), bench).count() == 0 and dec.contaminated(make(rows), bench.limit(0)).count() == 0


def test_every_fingerprint_within_the_radius_shares_a_near_block():
    rng = np.random.default_rng(3)
    near = dec.near_bytes(dec.RADIUS // dec.BLOCKS)
    for _ in range(300):
        a = rng.integers(0, 256, dec.BLOCKS).astype(np.uint8)
        bits = np.unpackbits(a)
        flip = rng.choice(dec.BITS, dec.RADIUS, replace=False)
        bits[flip] ^= 1
        b = np.packbits(bits)
        assert any(near[a[i], b[i]] for i in range(dec.BLOCKS))


# --- mixing -----------------------------------------------------------------------------


def fill(budget, children):
    """Water level by bisection: children (supply, weight) to shares."""
    if budget >= sum(s for s, w in children if w > 0):
        return [s if w > 0 else 0 for s, w in children]
    lo, hi = 0.0, 1e18
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(s, mid * w) for s, w in children) < budget else (lo, mid)
    return [min(s, hi * w) for s, w in children]


def test_mixing_budgets_and_prefixes(make):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 30))), rng.choice(["en", "en", "fr", None]), rng.choice(["src0", "src1", "src5", None, "src2"])) for i in range(400)]
    weights = {"domain": {"dom0": 5.0, "dom1": 1.0, "dom2": 0.0}, "lang": {"en": 3.0}}
    got = mixed(make(rows), 0.5, 2.0, weights).collect()
    leaf, docs = defaultdict(int), defaultdict(list)
    for i, t, lang, source in rows:
        n = int(re.search("[0-9]+", source)[0]) % 4 if source else 0
        key = (f"dom{n}", lang or "unknown", source or "unknown")
        leaf[key] += len(t.split())
        docs[key].append((i, len(t.split())))
    tree = defaultdict(lambda: defaultdict(list))
    for k in leaf:
        tree[k[0]][k[1]].append(k)
    total, budget = sum(leaf.values()) * 0.5, {}
    domains = sorted(tree)
    for d, share in zip(domains, fill(total, [(2.0 * sum(leaf[k] for x in tree[d].values() for k in x), weights["domain"].get(d, 1.0)) for d in domains]), strict=True):
        langs = sorted(tree[d])
        for x, part in zip(langs, fill(share, [(2.0 * sum(leaf[k] for k in tree[d][x]), weights["lang"].get(x, 1.0)) for x in langs]), strict=True):
            for k, b in zip(tree[d][x], fill(part, [(2.0 * leaf[k], 1.0) for k in tree[d][x]]), strict=True):
                budget[k] = b
    by = defaultdict(dict)
    for r in got:
        by[r.mix_domain, r.mix_lang, r.mix_source][r.doc_id] = r
    assert set(by) == set(leaf) and len(got) == len(rows)
    for k, b in budget.items():
        rs = by[k]
        given = next(iter(rs.values())).mix_budget
        assert abs(given - b) <= 1.001
        full = given // leaf[k] if leaf[k] else 0
        order = sorted(docs[k], key=lambda x: (hashlib.md5(f"7:{full}:{x[0]}".encode()).hexdigest(), x[0]))
        used = 0
        for i, n in order:
            used += n
            assert rs[i].mix_copies == full + (used <= given - full * leaf[k])


def test_mixing_empty(make):
    assert mixed(make([])).count() == 0


# --- secrets -----------------------------------------------------------------------------


def b64(x):
    return base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()


SECRET = 'api_key = "Zk3+abc/def_9"'


@pytest.mark.parametrize(
    "wrap",
    [
        b64, lambda s: b64(b64(s)), lambda s: b64(gzip.compress(s.encode())), lambda s: b64(zlib.compress(s.encode())), lambda s: b64(bz2.compress(s.encode())), lambda s: b64(gzip.compress(b64(s).encode())),
        lambda s: "".join(f"%{c:02x}" for c in s.encode()), lambda s: "".join(f"%25{c:02X}" for c in s.encode()), lambda s: "".join(f"\\u{ord(c):04x}" for c in s), lambda s: "".join(f"&#{ord(c)};" for c in s),
        lambda s: b64("".join(f"%{c:02x}" for c in s.encode())),
    ],
)
def test_wrapped_secret_is_found_at_its_place(wrap):
    code = wrap(SECRET)
    text = f"é before {code} after"
    base, spans, layers, _ = secrets.all_spans(text)
    assert base == [] and layers >= 1
    hits = [s for s in spans if s[0] == "assign"]
    assert hits and all(9 <= a < b <= 9 + len(code) for _, a, b in hits)


def wrapped(x, n=76):
    code = b64(x)
    return "\n".join(code[i : i + n] for i in range(0, len(code), n))


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, bz2.compress, lzma.compress])
def test_compressed_secret_in_any_writing(pack):
    rng = random.Random(1)
    data = pack(b"nothing here\n") + pack(f"{rng.randbytes(60).hex().upper()} {SECRET}\n".encode())
    for code in (b64(data), "".join(f"%{c:02X}" for c in data), quote(data), "".join(f"\\x{c:02x}" for c in data), repr(data)[2:-1], "".join(f"&#{c};" for c in data), wrapped(data), "abc" + b64(data)):
        text = f"é before {code} after"
        hits = [s for s in secrets.all_spans(text)[1] if s[0] == "assign"]
        assert hits and all(9 <= a < b <= 9 + len(code) for _, a, b in hits), code[:40]


def test_secret_over_a_line_break_and_beyond_a_window(monkeypatch):
    text = "x" * 40 + SECRET + "y" * 90
    assert any(s[0] == "assign" for s in secrets.all_spans("key:\n" + wrapped(text, 64) + "\nend")[1])
    monkeypatch.setattr(secrets, "LAYER_BYTES", 5000)
    monkeypatch.setattr(secrets, "OVERLAP", 300)
    monkeypatch.setattr(secrets, "PIECE", 700)
    for fill in ("é", "é "):
        for pack in (gzip.compress, bz2.compress, lzma.compress, zlib.compress, lambda x: gzip.compress(gzip.compress(x))):
            assert any(s[0] == "assign" for s in secrets.all_spans(b64(pack((fill * 9001 + SECRET).encode())))[1])


@pytest.mark.parametrize("lead", ["dir_", "d_", "/", "a/b/", "x-", "ab_c-"])
def test_secret_behind_other_characters_of_the_alphabet(lead):
    for code in (b64(SECRET), b64(gzip.compress(SECRET.encode())), b64(b"\x00\x01\xff\xfe" * 9 + SECRET.encode() + b"\x80\x00" * 20)):
        assert any(s[0] == "assign" for s in secrets.all_spans(f"see {lead}{code} there")[1])


def test_deep_and_circular_layers_end():
    data = SECRET.encode()
    for _ in range(20):
        data = gzip.compress(data)
    assert any(s[0] == "assign" for s in secrets.all_spans(b64(data))[1]) and secrets.all_spans(b64(data))[3] == 0
    for _ in range(60):
        data = gzip.compress(data)
    assert secrets.all_spans(b64(data))[3] > 0
    # %25 turns into % again and again; each layer is shorter, so this ends, and equal layers are taken up once.
    assert secrets.all_spans("%25" * 40 + b64(b64(b64("nothing to see here, really nothing"))))[2] < 200


def test_missing_library_is_reported(monkeypatch):
    import sys

    import zstandard

    text = b64(zstandard.ZstdCompressor().compress(SECRET.encode()))
    assert secrets.all_spans(text)[3] == 0
    monkeypatch.setitem(sys.modules, "zstandard", None)
    assert secrets.all_spans(text)[3] > 0


def test_decoding_stops_and_base_spans_stay():
    assert secrets.all_spans("%25" * 50 + "&amp;" + "\\u005c" * 9)[0] == []
    text = "token=password: token: abcdefgh1 AKIA" + "A" * 12 + " AKIASHORT " + "0123456789abcdef" * 2 + " PASSWD='abcdefgh'"
    want = []
    for m in secrets.ASSIGN.finditer(text):
        if len(m[2]) >= 8:
            want.append(("assign", *m.span()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 16:
            want.append(("access", *m.span()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 32:
            want.append(("hex", *m.span()))
    base, spans, *_ = secrets.all_spans(text)
    assert sorted(base) == sorted(want) and set(base) <= set(spans)
    assert secrets.scan("\u017fecret=abcdefghij to\u212aen: abcdefghi") == []  # only ASCII letters count in either case


def test_secret_query(make):
    rows = [*ODD, (10, "token = abcdefgh12"), (11, b64("token = abcdefgh12"))]
    got = {r.doc_id: r for r in secrets.scanned(make(rows)).collect()}
    assert got[10].spans == "assign:0:18" and got[10].base_sha256 == hashlib.sha256(b"assign:0:18").hexdigest()
    assert got[11].n_assign == 0 and got[11].n_decoded == 1
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert len(got) == len(rows) and secrets.scanned(make([])).count() == 0


def test_katz_with_stored_tables(spark, make, texts, tmp_path):
    docs = make([(i, t) for i, t, _ in texts[:60]] + ODD)
    katz.katz_tables(docs, remainder(5) != 1, 6).write.partitionBy("key").parquet(str(tmp_path / "tables"))
    tables = spark.read.parquet(str(tmp_path / "tables")).select("kind", F.col("key").cast("long").alias("key"), "source", "data")
    one = {r.doc_id: r for r in katz.katz_scores(docs, remainder(5) != 1, 6).collect()}
    two = {r.doc_id: r for r in katz.katz_scores(docs, remainder(5) != 1, tables=tables).collect()}  # whatever the session's partitions
    with pytest.raises(ValueError, match="buckets"):
        katz.katz_scores(docs, remainder(5) != 1, 7, tables)
    assert set(one) == set(two)
    assert all((one[i].n_known, one[i].train_tokens, one[i].held_out) == (two[i].n_known, two[i].train_tokens, two[i].held_out) and math.isclose(one[i].score, two[i].score, rel_tol=1e-9) for i in one)
