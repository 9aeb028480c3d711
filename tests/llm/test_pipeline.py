"""The pipeline's stages, each on its own input."""

import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm.store import written


@pytest.fixture(scope="module")
def staged(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir))
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(staged):
    for name, before, after in staged[:-1]:
        assert after.dtypes == before.dtypes, name
    assert set(staged[-1][1].columns) < set(staged[-1][2].columns)


def test_language_stage_drops_only_what_is_no_text(spark, sf_dir, staged):
    before, after = rows(staged[0][1]), rows(staged[0][2])
    assert set(before) == set(after)
    odd = staged[0][1].limit(3).withColumn("text", F.lit("0101 !! 22")).withColumn("doc_id", F.col("doc_id") + 10**6)
    kept = corpus_pipeline.language_id(spark, staged[0][1].unionByName(odd), sf_dir)
    assert {r.doc_id for r in kept.collect()} == set(before)


def test_exact_stage_keeps_the_largest_of_equals(spark, sf_dir, staged):
    before, after = rows(staged[1][1]), rows(staged[1][2])
    best = {}
    for i, t in before.items():
        best[t] = max(i, best.get(t, -1))
    assert after == {i: t for t, i in best.items()}
    doubled = staged[1][1].union(staged[1][1])
    assert corpus_pipeline.exact_copies(spark, doubled, sf_dir).count() == len(best)


def shingles(text, k=5):
    w = text.encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_near_stage_keeps_one_of_each_group(staged):
    before, after = rows(staged[2][1]), rows(staged[2][2])
    sets, parent = {i: shingles(t) for i, t in before.items()}, {i: i for i in before}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert set(after) == {i for i in before if find(i) == i}


def test_leak_stage_drops_documents_with_items(spark, sf_dir, staged):
    before, after = rows(staged[3][1]), rows(staged[3][2])
    words = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t.encode().lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    items = [words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    known = {g for w in items for g in grams(w)}
    gone = set()
    for i, t in before.items():
        w = words(t)
        if known.isdisjoint(grams(w)):
            continue
        for own in items:
            bag, span = Counter(grams(own)), min(len(own), len(w))
            for p in range(len(w) - span + 1):
                c = Counter(grams(w[p : p + span]))
                shared = sum((c & bag).values())
                if 100 * shared >= 80 * (sum(c.values()) + sum(bag.values()) - shared):
                    gone.add(i)
                    break
    assert gone and set(after) == set(before) - gone


def test_mix_follows_its_budgets(staged):
    out = staged[4][2].collect()
    assert all(r.mix_copies > 0 for r in out)
    used = Counter()
    for r in out:
        used[r.mix_domain, r.mix_lang, r.mix_source] += r.mix_tokens * r.mix_copies
    assert all(used[r.mix_domain, r.mix_lang, r.mix_source] <= r.mix_budget for r in out)
    total = sum(len(t.encode().split()) for t in rows(staged[4][1]).values())
    assert 0.4 * total < sum(used.values()) <= 0.6 * total + 1


def test_run_equals_the_stages(spark, sf_dir, staged):
    got = {r.doc_id: r.mix_copies for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {r.doc_id: r.mix_copies for r in staged[4][2].collect()}
