"""Hand-checked fixtures and properties of the operators."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.functions import maths, text, tokens
from corvane.operators import binning, bootstrap, corpus, features, metrics, semantic, validate
from corvane.operators.fusion import grouped_folds, out_of_fold


def one(df):
    return df.first()


def test_auroc_counts_half_for_ties(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (2.0, 1)], "s double, y int")
    assert one(metrics.auroc(df, "s", "y")).auroc == 0.75


def test_auroc_of_negated_score_is_the_rest(spark):
    df = spark.range(300).select((F.col("id") * 17 % 23).cast("double").alias("s"), (F.col("id") * 7 % 5 < 2).cast("int").alias("y"), (F.col("id") % 3).alias("g")).withColumn("m", -F.col("s"))
    a = {r.g: r.auroc for r in metrics.auroc(df, "s", "y", ["g"]).collect()}
    b = {r.g: r.auroc for r in metrics.auroc(df, "m", "y", ["g"]).collect()}
    assert all(abs(a[g] + b[g] - 1) < 1e-12 for g in a)


def test_auroc_null_groups_and_single_class(spark):
    df = spark.createDataFrame([(None, 1.0, 1), (None, 0.5, 0), ("a", 1.0, 1)], "g string, s double, y int")
    out = {r.g: (r.n_pos, r.n_neg, r.auroc) for r in metrics.auroc(df, "s", "y", ["g"]).collect()}
    assert out == {None: (1, 1, 1.0), "a": (1, 0, None)}


def test_aurac(spark):
    df = spark.createDataFrame([(3.0, 1, 1), (2.0, 0, 2), (1.0, 1, 3)], "s double, y int, id int")
    assert abs(one(metrics.aurac(df, "s", "y", ["id"])).aurac - (1 + 1 / 2 + 2 / 3) / 3) < 1e-12


def test_rank_bins_sizes(spark):
    df = spark.range(23).select("id", F.col("id").cast("double").alias("s"))
    sizes = [r["count"] for r in binning.rank_bins(df, "s", ["id"], 10, "b").groupBy("b").count().orderBy("b").collect()]
    assert sizes == [3, 2, 2, 3, 2, 2, 3, 2, 2, 2]
    sizes = [r["count"] for r in binning.quantile_cut(df, "s", ["id"], 10, "b").groupBy("b").count().orderBy("b").collect()]
    assert sizes == [3, 2, 2, 2, 3, 2, 2, 2, 2, 3]


def test_bins_of_null_scores_are_null(spark):
    df = spark.createDataFrame([(1, None), (2, 1.0)], "id int, s double")
    assert {r.id: r.b for r in binning.rank_bins(df, "s", ["id"], 3, "b").collect()} == {1: None, 2: 0}


def test_quantile_cut_needs_enough_rows(spark):
    df = spark.range(5).select("id", F.col("id").cast("double").alias("s"))
    assert binning.quantile_cut(df, "s", ["id"], 10, "b", least=10).where("b is not null").count() == 0


def test_leader_clustering_is_no_closure(spark):
    s = spark.createDataFrame([(1, i) for i in (1, 2, 3)], "prompt_id int, sample_index int")
    d = spark.createDataFrame([(1, a, b, {a, b} != {1, 3}) for a in (1, 2, 3) for b in (1, 2, 3) if a != b], "prompt_id int, premise int, hypothesis int, entails boolean")
    got = {r.sample_index: r.cluster for r in semantic.leader_clusters(s, d).collect()}
    assert got == {1: 0, 2: 0, 3: 1}


def test_token_stats(spark):
    df = spark.createDataFrame([([1.0, 3.0], [2.0, 5.0]), ([1.0], [2.0]), ([1.0], []), ([], [])], "l array<double>, z array<double>")
    stats = tokens.token_stats(F.col("l"), F.col("z"))
    a, b, c, d = (tuple(r) for r in df.select(*[v.alias(k) for k, v in stats.items()]).collect())
    assert a == (1.5, -3.0, 1.0, 3.5, 2)
    assert b[2] == 0.0
    assert all(math.isnan(x) for x in c[:4]) and c[4] == 1
    assert all(math.isnan(x) for x in d[:4]) and d[4] == 0


def test_entropy_and_energy_of_two_equal_clusters(spark):
    t = spark.createDataFrame([(1, 0, 1, 0.5, -4.0), (1, 1, 1, 0.5, -2.0)], "prompt_id int, cluster int, size int, probability double, energy double")
    s = spark.createDataFrame([(1, "a"), (1, "b")], "prompt_id int, response_text string")
    r = one(semantic.semantic_features(t, s))
    assert abs(r.semantic_entropy - math.log(2)) < 1e-12 and r.cluster_uncertainty == -3.0 and r.total_cluster_energy == -6.0


def test_overlap(spark):
    df = spark.createDataFrame([("the red cat", "red cat sat"), ("", "x"), ("a b", "zzz")], "s string, c string")
    assert [r.m for r in df.select(text.overlap_match(F.col("s"), F.col("c")).alias("m")).collect()] == [True, False, False]


def test_short_text_has_no_grams(spark):
    docs = corpus.corpus_tokens(spark.createDataFrame([(1, "a b c d")], "doc_id int, text string"))
    r = one(features.ngram_coverage(spark.createDataFrame([(1, "x y")], "k int, t string"), docs, "k", "t", (3,)))
    assert (r.n_tokens, r.ngram_3_count, r.ngram_3_zero_count, r.ngram_3_min, r.ngram_3_axis) == (2, 0, 0, 0, 0.0)


def test_counts_and_pairs(spark):
    docs = corpus.corpus_tokens(spark.createDataFrame([(1, "New York, new york"), (2, "york minster"), (3, None)], "doc_id int, text string"))
    t = spark.createDataFrame([("New York",), ("york",), ("absent",), ("!!",)], "term string")
    assert {r.term: r.raw_count for r in corpus.count_entities(docs, t).collect()} == {"new york": 2, "york": 3, "absent": 0, "": None}
    p = spark.createDataFrame([("york", "new york"), ("minster", "new york"), ("minster", "york")], "left string, right string")
    assert {(r.left, r.right): r.raw_count for r in corpus.count_pairs(docs, p).collect()} == {("new york", "york"): 1, ("minster", "new york"): 0, ("minster", "york"): 1}
    assert {(r.left, r.right): r.raw_count for r in corpus.count_pairs(docs, p, "window", 1).collect()}[("minster", "york")] == 1


def test_corpus_counts_terms_of_any_length(spark):
    long = " ".join(f"w{i}" for i in range(12))
    docs = corpus.corpus_tokens(spark.createDataFrame([(1, f"a {long} b {long}"), (2, long), (3, long[:-1])], "doc_id long, text string"))
    t = spark.createDataFrame([(long,), (f"absent {long}",), ("b",)], "term string")
    assert {r.term: r.raw_count for r in corpus.count_entities(docs, t).collect()} == {long: 3, f"absent {long}": 0, "b": 1}
    p = spark.createDataFrame([("b", long)], "left string, right string")
    assert [r.raw_count for r in corpus.count_pairs(docs, p).collect()] == [1]


def test_pairs_meet_in_blocks_as_in_brute_force(spark, monkeypatch):
    """Bitmaps, rare terms, blocks of documents and pairs, repeated documents: no pair is formed in a document, none is lost."""
    from corvane.operators import cooccurrence

    monkeypatch.setattr(cooccurrence, "PAIRS", 100)
    monkeypatch.setattr(cooccurrence, "LEAST", 40)
    draw = random.Random(3)
    texts = [[f"w{int(40 * draw.random() ** 3)}" for _ in range(draw.randrange(30))] for _ in range(120)]
    rows = [(i % 110, " ".join(t).replace("w1", "W\u00e91.")) for i, t in enumerate(texts)] + [(None, "w0 w1 w2")]
    docs = corpus.corpus_tokens(spark.createDataFrame(rows, "doc_id int, text string"))
    pairs = [(f"w{a}", f"w{b}") for a in range(40) for b in range(a + 1, 40)]
    asked = spark.createDataFrame(pairs, "left string, right string")
    held, places = defaultdict(set), defaultdict(list)
    for i, t in enumerate(texts):
        for p, w in enumerate(t):
            held[w].add(i % 110)
            places[w, i % 110].append(p)
    for unit, want in (("document", lambda a, b: len(held[a] & held[b])), ("window", lambda a, b: sum(abs(p - q) <= 5 for d in range(110) for p in places.get((a, d), []) for q in places.get((b, d), [])))):
        got = {(r.left, r.right): r.raw_count for r in corpus.count_pairs(docs, asked, unit, 5).collect()}
        assert got == {(min(p), max(p)): want(*p) for p in pairs}


def test_corpus_words_are_those_of_normalised_text(spark):
    import pyarrow as pa

    from corvane.functions import packed
    from corvane.functions.text import normalize_term

    raw = ["", "A\u00a0b  c\td.e -- it's", "\u212aelvin \u0130x\n\nx", "...", " y"]
    lowered = spark.createDataFrame([(r,) for r in raw], "t string").select(F.lower("t"), normalize_term(F.col("t"))).collect()
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in lowered])], names=["text"])
    part, first, words = next(packed.token_slices(batch, 0))
    words = words.to_pylist()
    assert [words[first[i] : first[i + 1]] for i in range(len(raw))] == [[w for w in r[1].split(" ") if w] for r in lowered]


@pytest.mark.parametrize("most", [0, 1000])
def test_frequent_values_are_counted_exactly_with_and_without_broadcast(spark, monkeypatch, most):
    monkeypatch.setattr(corpus, "BROADCAST_HASHES", most)
    rows = spark.range(400).select(F.when(F.col("id") < 60, "often").when(F.col("id") < 80, "just not").otherwise(F.col("id").cast("string")).alias("v"))
    assert [(r.v, r.n) for r in corpus.frequent(rows, "v", 20).collect()] == [("often", 60)]


def test_missing_count_nulls_the_row(spark):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"]), ("c", [])], "candidate_id string, entities array<string>")
    counts = spark.createDataFrame([("x", 10)], "term string, raw_count long")
    pairs = spark.createDataFrame([], "left string, right string, raw_count long")
    out = {r.candidate_id: r for r in features.entity_axes(rows, counts, pairs).collect()}
    assert out["a"].frequency_mean is None and out["a"].corpus_risk is None
    assert out["b"].frequency_mean == 10 and out["b"].pair_mean == 0.0 and out["b"].zero_pair_flag is False
    assert out["c"].counts_complete is False


def test_bridge_without_counts(spark):
    rows = spark.createDataFrame([(1, ["q"], ["q"])], "k int, q array<string>, a array<string>")
    docs = corpus.corpus_tokens(spark.createDataFrame([(1, "q")], "doc_id int, text string"))
    r = one(features.bridge_features(rows, docs, "k", "q", "a"))
    assert (r.bridge_pair_count, r.bridge_min, r.bridge_mean, r.bridge_axis, r.bridge_zero_flag) == (0, 0, 0.0, 0.0, 1)


def test_axes(spark):
    r = one(spark.range(1).select(maths.log_axis(F.lit(0), 100).alias("a"), maths.log_axis(F.lit(1000), 100).alias("b"), maths.log_axis(F.lit(None).cast("long"), 100).alias("c"), maths.clip(F.lit(2.0)).alias("d")))
    assert (r.a, r.b, r.c, r.d) == (0.0, 1.0, None, 1 - 1e-6)


def test_bootstrap_weights_sum_to_the_prompts(spark):
    w = bootstrap.bootstrap_weights(spark.range(30).withColumnRenamed("id", "prompt_id"), 4)
    assert {r.rep: r.s for r in w.groupBy("rep").agg(F.sum("w").alias("s")).collect()} == dict.fromkeys(range(4), 30)


def test_folds_keep_prompts_together_and_even(spark):
    rows = grouped_folds(spark.range(100).select("id", (F.col("id") % 20).alias("prompt_id")))
    assert rows.groupBy("prompt_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert [r["count"] for r in rows.groupBy("fold").count().collect()] == [20] * 5


def test_fusion_separates(spark):
    rows = spark.range(200).select((F.col("id") % 40).alias("prompt_id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 * 2.0 + F.col("id") % 7 * 0.1).alias("x"))
    assert one(metrics.auroc(out_of_fold(rows, ["x", "none"], "y", "logistic"), "score", "y")).auroc > 0.95


def test_forest_grows_whole_trees_on_other_folds(spark):
    """200 trees a fold, each row scored once by trees that split an exclusive or; the scores don't follow the row's own label."""
    rows = spark.range(600).select("id", (F.col("id") % 60).alias("prompt_id"), (F.col("id") * 7 % 13).cast("double").alias("a"), (F.col("id") * 5 % 17).cast("double").alias("b"))
    rows = rows.withColumn("y", ((F.col("a") > 6) != (F.col("b") > 8)).cast("int"))
    out = out_of_fold(rows, ["a", "b"], "y", "forest").toPandas()
    assert sorted(out.id) == list(range(600)) and out.score.between(0, 1).all()
    assert ((out.score > 0.5) == out.y).mean() > 0.95
    noise = out_of_fold(rows.withColumn("y", (F.xxhash64("id") % 2 == 0).cast("int")), ["a", "b"], "y", "forest")
    assert abs(one(metrics.auroc(noise, "score", "y")).auroc - 0.5) < 0.12


def test_grown_trees_stop_where_leaves_are_pure():
    import numpy as np

    from corvane.operators import trees

    x = np.arange(32, dtype=np.uint8)[None, :]
    y = np.array([0, 1] * 16)
    assert (trees.grow(x, y, np.ones(32), np.arange(32), np.random.default_rng(0)) == y).all()


def test_boosting_is_sparks_own_in_few_jobs(spark):
    """Each round and level of Spark's boosting was a job a fold, some 2,000 in all; the scores stay the same to rounding."""
    import numpy as np
    from pyspark.ml.classification import GBTClassifier

    from corvane.operators import trees

    def job() -> int:
        spark.sparkContext.setJobGroup("boosting", "")
        spark.range(1).count()
        return max(spark.sparkContext.statusTracker().getJobIdsForGroup("boosting"))

    rows = spark.range(600).select("id", (F.col("id") % 60).alias("prompt_id"), (F.col("id") * 7 % 113).cast("double").alias("a"), (F.col("id") * 5 % 7).cast("double").alias("b"))
    rows = rows.withColumn("y", (((F.col("a") > 50) != (F.col("b") > 3)) | (F.col("id") % 11 == 0)).cast("int"))
    before = job()
    out = out_of_fold(rows, ["a", "b"], "y", "boosting").toPandas()
    assert job() - before < 60
    assert sorted(out.id) == list(range(600)) and ((out.score > 0.5) == out.y).mean() > 0.8
    theirs = out_of_fold(rows, ["a", "b"], "y", "boosting", folds=2, estimator=GBTClassifier(maxIter=4, maxDepth=3, stepSize=0.1, seed=42)).toPandas().sort_values("id")
    x, y, fold = [theirs[c].to_numpy(float) for c in "ab"], theirs.y.to_numpy(), theirs.fold.to_numpy()
    for f in range(2):
        ours = trees.boost(x, y, np.flatnonzero(fold != f), np.flatnonzero(fold == f), rounds=4)
        assert np.abs(ours - theirs.score[fold == f]).max() < 1e-9


def test_boosting_splits_what_it_can(spark):
    """No inputs that differ, and no labels that do: the share of label 1 is all there is to learn."""
    import numpy as np

    from corvane.operators import trees

    every = np.arange(8)
    flat = trees.boost([np.zeros(8)], np.array([0, 1, 1, 1] * 2), every, every)
    assert np.ptp(flat) == 0 and abs(flat[0] - 0.75) < 1e-3
    assert (trees.boost([every * 1.0], np.ones(8), every, every) > 0.9).all()
    assert trees.split_points(np.repeat(np.arange(200.0), 3)).size == 31


def test_spearman_p(spark):
    rows = [(0.648, 10), (0.5, 2), (1.0, 5), (0.0, 9), (-0.9, 4), (0.3, 3), (0.4, 11)]
    got = [r.p for r in spark.createDataFrame(rows, "r double, n int").select(maths.spearman_p(F.col("r"), F.col("n")).alias("p")).collect()]
    assert got[1] is None
    # Student's t in closed form for one to three degrees, tables for the rest
    assert abs(got[0] - 0.0426) < 5e-4 and got[2] == 0 and got[3] == 1 and abs(got[4] - 0.1) < 1e-12 and abs(got[5] - (1 - 2 / math.pi * math.asin(0.3))) < 1e-12 and abs(got[6] - 0.2229) < 5e-4


def test_ece_uses_the_edges(spark):
    rows = [(0.25, 0), (0.3, 1)]  # 0.3 lies under the fourth edge, 3 * 0.1
    assert abs(one(metrics.brier_ece(spark.createDataFrame(rows, "s double, y int"), "s", "y")).ece - 0.225) < 1e-12


def test_interval_bins(spark):
    rules = [{"id": "low", "upper": 0.1, "upper_inclusive": False}, {"id": "mid", "lower": 0.1, "upper": 0.4}, {"id": "high", "lower": 0.4, "lower_inclusive": False}]
    got = [r.b for r in spark.createDataFrame([(0.0,), (0.1,), (0.4,), (0.5,), (None,)], "v double").select(binning.interval_bin(F.col("v"), rules).alias("b")).collect()]
    assert got == ["low", "mid", "mid", "high", None]


def test_ranked_equals_the_single_metrics(spark):
    df = spark.range(400).select("id", (F.col("id") * 17 % 23).cast("double").alias("s"), (F.col("id") * 7 % 5 < 2).cast("int").alias("y"), (F.col("id") % 3).alias("g"))
    for by in ([], ["g"]):
        key = lambda r, by=by: tuple(r[c] for c in by)
        got = {key(r): r for r in metrics.ranked(df, "s", "y", ["id"], by).collect()}
        for name, part in (("auroc", metrics.auroc(df, "s", "y", by)), ("auprc", metrics.auprc(df, "s", "y", by)), ("aurac", metrics.aurac(df, "s", "y", ["id"], by))):
            assert all(abs(got[key(r)][name] - r[name]) < 1e-12 for r in part.collect())


def test_bootstrap_equals_repeated_rows(spark):
    rows = [(p, float(i * 7 % 11), (i * 5 + p) % 3 == 0, "ab"[p % 2]) for i in range(90) for p in [i % 13]]
    df = spark.createDataFrame(rows, "prompt_id long, s double, y boolean, g string").withColumn("y", F.col("y").cast("int"))
    w = bootstrap.bootstrap_weights(df, 20)
    weights = {(r.rep, r.prompt_id): r.w for r in w.collect()}
    got = {(r.g, r.rep): r.auroc for r in bootstrap.weighted_auroc(df, w, "s", "y", ["g"], 20).collect()}
    for g in "ab":
        for rep in range(20):
            drawn = [(s, y) for p, s, y, x in rows if x == g for _ in range(weights.get((rep, p), 0))]
            pos, neg = [s for s, y in drawn if y], [s for s, y in drawn if not y]
            want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
            assert got.get((g, rep)) == want or abs(got[g, rep] - want) < 1e-12


def test_bootstrap_packs_weights_a_byte_does_not_hold(spark):
    """Packed weights add up to the drawn ones, whole ranges and single rows give the same area."""
    weights = spark.createDataFrame([(0, 1, 700), (0, 2, 3), (1, 2, 255)], "rep int, prompt_id long, w long")
    packed = bootstrap.weight_arrays(weights, 2)
    assert packed.schema["w"].dataType.typeName() == "binary"
    total = defaultdict(lambda: [0, 0])
    for r in packed.collect():
        total[r.prompt_id] = [a + b for a, b in zip(total[r.prompt_id], r.w, strict=True)]
    assert dict(total) == {1: [700, 0], 2: [3, 255]}
    rows = spark.createDataFrame([(1, 1.0, 1), (1, 2.0, 0), (2, 1.0, 0), (2, 3.0, 1)], "prompt_id long, s double, y int")
    got = {r.rep: (r.n_pos, r.n_neg, r.auroc) for r in bootstrap.weighted_auroc(rows, packed, "s", "y", replicates=2).collect()}
    assert got == {0: (703, 703, (700 * 1.5 + 3 * 703) / 703**2), 1: (255, 255, 1.0)}
    drawn = bootstrap.packed_weights(spark.range(30).withColumnRenamed("id", "prompt_id"), 4).collect()
    assert [sum(r.w[i] for r in drawn) for i in range(4)] == [30] * 4


def test_triplets(spark):
    forms = {
        '[["a b", "is", "c"], ["d"]]': [["a b", "is", "c"], ["d"]], "Entities: [['a', 'b'], ['c', None]]": [["a", "b"], ["c"]], "[('a', 'is', 'b'), ('c',)]": [["a", "is", "b"], ["c"]],
        '["x", " y "]': [["x"], ["y"]], 'Well: [["a"], ["b", "c"]] so': [["a"], ["b", "c"]], "nothing": None, "[]": [],
    }
    df = spark.createDataFrame([(t,) for t in forms], "t string").select("t", text.parse_triplets(F.col("t")).alias("x"))
    assert {r.t: r.x for r in df.collect()} == forms


def test_provenance_lint(spark):
    rows = [("f", "Right_Answer text", True, False, "feature"), ("g", "counts", True, True, "label_only"), ("h", "label", False, False, "label_only"), ("semantic_energy_proxy", "gold", True, False, "x"), ("k", "from candidate_text", False, False, "x")]
    got = {(r.feature_name, r.fault) for r in validate.provenance_faults(spark.createDataFrame(rows, "feature_name string, source string, trainable boolean, depends_on_correctness boolean, role string")).collect()}
    assert got == {("f", "leakage_hint"), ("g", "depends_on_correctness"), ("g", "prohibited_role"), ("k", "candidate_text")}


def test_backends_are_never_swapped(spark):
    assert [corpus.choose_backend(*x) for x in ((True, True), (False, True), (False, False), (True, True, ("corpus",)), (True, False, ("corpus",)))] == ["stored", "corpus", "missing", "corpus", "missing"]
    r = one(corpus.missing_counts(spark.createDataFrame([("x",)], "query string"), "entity_frequency"))
    assert r.raw_count is None and r.excluded and r.status == "local_index_absent"


def test_contracts(spark):
    s = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 0)], "prompt_id int, sample_index int")
    assert [r.prompt_id for r in validate.sample_coverage(s).collect()] == [2]
    c = spark.createDataFrame([(1, [0, 1], 0.5, 0), (1, [2], 0.5, 2), (2, [0, 1, 2], 0.9, 0)], "prompt_id int, members array<int>, probability double, representative int")
    assert [r.prompt_id for r in validate.partition_faults(c, 3).collect()] == [2]
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert {(r.k, r.fault) for r in validate.key_integrity(a, b, ["k"]).collect()} == {(2, "unexpected"), (1, "duplicate"), (3, "missing")}
    u = spark.createDataFrame([(1, [1.0], [1.0]), (2, [1.0], []), (3, [float("nan")], [1.0])], "id int, a array<double>, b array<double>")
    assert sorted(r.id for r in validate.uneven_arrays(u, "a", "b").collect()) == [2, 3]


@pytest.mark.parametrize("n", [0, 1])
def test_empty_and_single_rows(spark, n):
    df = spark.range(n).select("id", F.lit(1.0).alias("s"), F.lit(1).alias("y"))
    r = one(metrics.auroc(df, "s", "y"))
    assert r is None or (r.n_neg == 0 and r.auroc is None)
    assert binning.rank_bins(df, "s", ["id"], 3, "b").count() == n
