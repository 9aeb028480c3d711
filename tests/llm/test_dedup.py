"""Exact, near, suffix-array and sentence dedup against brute force, with the awkward cases."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm.exact_dedup import Run, exact_dedup, may_hold
from corvane.llm import near_dedup
from corvane.llm.near_dedup import near_duplicates
from corvane.llm.sentence_dedup import removed_sentences
from corvane.llm.store import components
from corvane.llm.suffix_dedup import common_prefixes, merged_runs, removed_repeats, repeats, suffix_array

LONG = " ".join(f"word{i % 977} x{i}" for i in range(20000))
AWKWARD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "One"), (6, LONG), (7, LONG), (8, "é" * 300), (9, "\0" * 250), (10, "a b c d e f g h"), (11, "a b c d e f g h"), (12, "a  b c d e\tf g h")]


def test_exact_groups(make, texts):
    rows = AWKWARD + [(100 + i, t) for i, t, _ in texts]
    for keep, best in (("largest", max), ("smallest", min)):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(make(rows), keep=keep).collect()}
        groups = defaultdict(list)
        for i, t in rows:
            groups[t or ""].append(i)
        want = {i: (best(g), len(g), i == best(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
        assert got == want


def test_exact_repeated_rows_and_null_ids(make):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(make([(1, "x"), (1, "x"), (2, "x"), (None, "x"), (3, "y"), (None, None)]), keep="largest").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] is None))
    assert got == [(1, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (3, 3, 1, True), (None, 2, 4, False), (None, None, 1, True)]
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(make([(None, "x"), (4, "x"), (5, "x")])).collect()}
    assert got == {(None, 4, False), (4, 4, True), (5, 4, False)}


def test_exact_empty_table(make):
    assert exact_dedup(make([])).count() == 0


def test_exact_tells_equal_digests_apart(make):
    weak = lambda data: bytes([len(data) % 2]) * 32
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(make([(1, "a"), (2, "b"), (3, "a"), (4, "cc"), (5, "dd")]), keep="largest", digest=weak).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1), 5: (5, 1)}


def test_runs_filter_and_search():
    rng = np.random.default_rng(1)
    d = rng.integers(0, 2**63, (500, 4), dtype=np.uint64).astype(">u8")
    run, other = Run(d[:300], np.arange(300), np.ones(300, int)), Run(d[200:], np.arange(200, 500), np.ones(300, int))
    assert may_hold(run.filter, run.keys).all()
    assert run.holds(other).sum() == 100


def jaccard_components(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def edited(words, rate, rng):
    return " ".join(w if rng.random() > rate else f"edit{rng.randrange(10**9)}" for w in words)


@pytest.mark.parametrize("k", [2, 5])
def test_near_components(make, texts, k):
    rng = random.Random(k)
    rows = list(AWKWARD) + [(100 + i, t) for i, t, _ in texts if len(t) < 3000]
    base = [f"w{i}" for i in range(150)]
    rows += [(1000 + i, edited(base, rng.choice([0.01, 0.03, 0.05, 0.08]), rng)) for i in range(60)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make(rows), shingle=k).collect()}
    assert got == jaccard_components(rows, k)


def test_near_large_nodes_branch_and_agree(make):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, edited(base, rng.choice([0.02, 0.05, 0.1]), rng)) for i in range(80)]
    got = {r.doc_id: r.component_id for r in near_duplicates(make(rows), shingle=2, node_sets=10).collect()}
    assert got == {i: v[1] for i, v in jaccard_components(rows, 2).items()}


def test_near_nodes_part_no_pair_at_the_threshold():
    rng = np.random.default_rng(5)
    z, shared, own = 20_000, 80, 10  # 80 of 100 in common
    grams = rng.integers(0, 1 << 64, (z, shared + 2 * own), np.uint64)
    one, two = (near_dedup.signatures(np.ascontiguousarray(x).ravel(), np.arange(z + 1) * (shared + own)) for x in (grams[:, :-own], grams[:, own:][:, ::-1]))
    ids = np.arange(z)
    met = np.zeros(z, bool)
    agree = (one == two).mean(0)
    assert abs(agree - 0.8).max() < 0.015
    for batch in zip(*(near_dedup.plant(near_dedup.TREES)([pa.RecordBatch.from_arrays([pa.array(ids), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "sig"])]) for x in (one, two)), strict=True):
        a, b = ({*zip(x.column(1).to_pylist(), x.column(0).to_pylist(), strict=True)} for x in batch)
        met[[i for i, _ in a & b]] = True
    assert met.all()


def test_near_wide_nodes_lose_no_link(make):
    rng = random.Random(4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, edited(base, 0.12, rng)) for i in range(150)]  # most are unlike the leader, few link
    want = {i: v[1] for i, v in jaccard_components(rows, 1).items()}
    assert 1 < len(set(want.values())) < 150
    assert {r.doc_id: r.component_id for r in near_duplicates(make(rows), shingle=1, node_sets=10).collect()} == want


def test_near_empty_table(make):
    assert near_duplicates(make([])).count() == 0


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_suffix_array_and_prefixes():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(1, 60))]
        sa = suffix_array(np.array(s, np.int16))
        assert list(sa) == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = common_prefixes(np.array(s, np.int16), sa)
        for x, (i, j) in zip(lcp[1:], zip(sa[:-1], sa[1:], strict=True), strict=True):
            n = 0
            while max(i, j) + n < len(s) and s[i + n] == s[j + n]:
                n += 1
            assert x == n


def test_repeats_in_parts():
    rng = random.Random(4)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(40))) for _ in range(12)]
    order = np.array([(rng.randrange(3), 100 * i) for i in range(12)])
    places = {}
    for (d, p), t in zip(order.tolist(), parts, strict=True):
        for i in range(len(t) - 4):
            places.setdefault(t[i : i + 5], []).append((d, p + i))
    want = [[i for i in range(len(t) - 4) if min(places[t[i : i + 5]]) < (d, p + i)] for (d, p), t in zip(order.tolist(), parts, strict=True)]
    assert [x.tolist() for x in repeats(parts, order, 5)] == want


def test_merged_runs():
    rng = np.random.default_rng(5)
    runs, first = [], {}
    for r in range(5):
        x, y = np.sort(rng.choice(30, 12, replace=False)).astype(np.uint64) // 3, np.zeros(12, np.uint64)
        keep = np.r_[True, x[1:] != x[:-1]]
        x, y, doc = x[keep], y[keep], rng.integers(0, 50, keep.sum())
        runs.append((x, y, doc, np.full(len(x), r)))
        for k, d in zip(x.tolist(), doc.tolist(), strict=True):
            first.setdefault(k, []).append((d, r))
    doc, place = merged_runs(runs)
    want = sorted(p for ps in first.values() for p in ps if p != min(ps))
    assert sorted(zip(doc.tolist(), place.tolist(), strict=True)) == want


def brute_bytes(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows), key=lambda r: r[0]):
        b = (t or "").encode()
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                m[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        out[i] = (len(b), sum(m), sum(1 for j in range(len(m)) if m[j] and not (j and m[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


def short_rows(texts):
    rows = [(i, t if t is None or len(t) < 5000 else t[:3000]) for i, t in AWKWARD] + [(100 + i, t) for i, t, _ in texts if len(t) < 2500][:90]
    passage = "This passage is repeated in several documents of the table, with other words before and after it, again and again, to be found."
    return rows + [(1000 + i, f"Start {i * 7919} {passage} end {i * 104729}.") for i in range(8)]


@pytest.mark.parametrize("hot", [False, True])
def test_repeated_bytes(make, texts, hot, monkeypatch):
    import corvane.llm.suffix_dedup as module

    if hot:
        monkeypatch.setattr(module, "LEAST", 2)
        monkeypatch.setattr(module, "SAMPLE", 1)
    rows = short_rows(texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed_repeats(make(rows)).collect()}
    assert got == brute_bytes(rows)


def test_repeated_bytes_in_small_pieces(make, monkeypatch):
    import corvane.llm.suffix_dedup as module

    monkeypatch.setattr(module, "BLOCK", 1000)
    rng = random.Random(6)
    unit = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(1, unit + "x" + unit + "yz" + unit[50:650]), (2, unit[::-1] + unit), (3, "a" * 3000)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed_repeats(make(rows, 1)).collect()}
    assert got == brute_bytes(rows)


def test_repeated_bytes_empty_table_and_repeated_row(make):
    assert removed_repeats(make([])).count() == 0
    twice = removed_repeats(make([(1, "x" * 50 + "y" * 100), (1, "x" * 50 + "y" * 100)])).collect()
    assert [r.n_removed for r in twice] == [0, 0]


CLOSE = re.compile(rb"[.!?][\x20\x09-\x0D]+|[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)[\x20\x09-\x0D]*")


def brute_sentences(rows, k=2, least=16):
    """Every run of k sentences or more with that many words, each length looked at for itself."""
    tables = {}
    for i, t in rows:
        b = (t or "").encode()
        at = len(b) - len(b.lstrip())
        cuts = [at, *(m.end() for m in CLOSE.finditer(b, at) if m.end() < len(b)), len(b)]
        pieces = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            more = [m.end() for m in re.finditer(rb"\S+\s+", b[x:y]) if len(m[0].split()[0].decode()) >= 10 and m.end() < y - x] if len(b[x:y].split()) > 30 else []
            pieces += zip([x, *(x + m for m in more)], [*(x + m for m in more), y], strict=True)
        tables[i] = b, [(x, y, tuple(b[x:y].lower().split())) for x, y in pieces if y > x]
    gone = {i: bytearray(len(b)) for i, (b, _) in tables.items()}
    for size in range(k, 1 + max((len(p) for _, p in tables.values()), default=0)):
        seen = set()
        for i in sorted(tables):
            pieces = tables[i][1]
            for j in range(len(pieces) - size + 1):
                key = tuple(p[2] for p in pieces[j : j + size])
                if sum(map(len, key)) < least:
                    continue
                if key in seen:
                    x, y = pieces[j][0], pieces[j + size - 1][1]
                    gone[i][x:y] = b"\1" * (y - x)
                seen.add(key)
    out = {}
    for i, m in gone.items():
        kept = bytes(x for x, y in zip(tables[i][0], m, strict=True) if not y)
        out[i] = (len(m), sum(m), sum(1 for j in range(len(m)) if m[j] and not (j and m[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_sentence_spans(make, texts):
    rng = random.Random(3)
    rows = short_rows(texts) + [(2000 + i, "Shared one here now. Shared two over there. Shared three at the end of it. " + "Own " * i) for i in range(3)]
    rows += [(2100 + i, f" \n{i} A b. A b.  A b.\tA b. c?! ... d\r\n\r\nA B.\nc?! end") for i in range(2)]
    rows += [(2200 + i, f"{i}。第一句在这里。第二句在那里！第三句 x？" + ("完" * i)) for i in range(3)]
    for most in (1, 3):
        passage = "\n".join(" ".join(f"s{rng.randrange(10**6)}" for _ in range(rng.randint(1, most))) for _ in range(20))
        rows += [(2300 + 10 * most + i, f"Own {i * 77}!\n{passage}\nEnd {i}") for i in range(2)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed_sentences(make(rows)).collect()}
    assert got == brute_sentences([r for r in rows if len(r[1] or "") < 10_000]) | {i: v for i, v in got.items() if i in (6, 7)}
    assert got[6][1] == 0 and got[7][1] == 0  # a sentence each, without long words, is no run
    for run, least in ((3, 16), (2, 0), (3, 5)):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed_sentences(make(rows[-12:]), run, least).collect()}
        assert got == brute_sentences(rows[-12:], run, least)
    assert removed_sentences(make([])).count() == 0


def test_repeated_rows_and_null_ids_everywhere(make):
    text = " ".join(f"w{i}" for i in range(60)) + ". Second sentence of some words here. Third one with a few words more."
    rows = [(5, text), (5, text), (7, text), (None, text), (9, text.replace("w7 ", "z7 "))]
    near = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_duplicates(make(rows), shingle=2).collect())
    assert near == [(0, None, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]
    bytes_ = sorted((r.doc_id or 0, r.n_removed == r.n_bytes) for r in removed_repeats(make(rows)).collect())
    assert [x[0] for x in bytes_] == [0, 5, 5, 7, 9] and [x[1] for x in bytes_] == [False, False, False, True, False]
    spans = sorted((r.doc_id or 0, r.n_removed > 0) for r in removed_sentences(make(rows)).collect())
    assert spans == [(0, False), (5, False), (5, False), (7, True), (9, False)]  # 9 shares two sentences of 14 words only


def test_near_ties_and_many_equal_sets(make):
    rows = [(i, "a b c d e f") for i in range(40, 0, -1)] + [(100, "A  B c d E f"), (101, "x y z u v w")]
    got = {r.doc_id: r.component_id for r in near_duplicates(make(rows), shingle=5).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 1, 101: 101}


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_near_tells_structured_words_apart(make, n):
    one, two = thue_morse(n), thue_morse(n, "ba")
    rows = [(1, f"{one} x"), (2, f"{two} x"), (3, f"{two} x"), (4, one), (5, two)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make(rows), shingle=2).collect()}
    assert got == jaccard_components(rows, 2)
    rows = [(1, one), (2, two), (3, one)]
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed_repeats(make(rows)).collect()} == brute_bytes(rows)


def test_components_contract_long_tables_of_links(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 60)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)]
    df = spark.createDataFrame(links, "a long, b long")
    one, two = ({r.node: r.component for r in components(df, unite).collect()} for unite in (10**6, 40))
    assert one == two and one[300] == 0 and one[1059] == 1000


def test_wide_grams_are_compared_string_by_string(make, monkeypatch):
    import corvane.llm.suffix_dedup as module

    monkeypatch.setattr(module, "SHARD_BYTES", 600)
    line = "One line of some sixty characters that many documents share so"
    rows = [(i, f"{i * 7919 % 977} own words {i} {line} {i * 104729 % 991} and {'again' if i % 3 else 'more'} what follows is shared by some of them only, not by all of them, as it is longer than the hundred bytes that a string has here") for i in range(40)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in removed_repeats(make(rows)).collect()}
    assert got == brute_bytes(rows) and sum(v[1] for v in got.values()) > 1000
