"""Ranking, binning, metrics, bootstrap and fusion queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fixed, percent
from ..functions.tokens import token_stats
from ..operators import binning, bootstrap, corpus, features, metrics, semantic
from ..operators.fusion import grouped_folds, numbers, out_of_fold
from ..operators.ranking import global_rank, running_sums
from .bindings import labelled_documents, samples, scored_events, table
from .registry import EVENTS, LABELLED, SAMPLES, query, sql_auprc, sql_aurac, sql_auroc, sql_rank_bins

SIGNALS = ["s_value", "s_mod", "s_fold"]
BINNED_DOCS = sql_rank_bins(LABELLED, "n_chars", "doc_id", 10, "bin")
BINNED_EVENTS = sql_rank_bins(EVENTS, "s_mod", "event_id", 10, "bin")
LONG = f"(SELECT event_id, prompt_id, dataset, is_correct, method, score FROM {EVENTS} e UNPIVOT (score FOR method IN (s_value, s_mod, s_fold)))"


def _binned_docs(spark: SparkSession, sf: str) -> DataFrame:
    return binning.rank_bins(labelled_documents(spark, sf).select("doc_id", "n_chars", "is_correct"), "n_chars", ["doc_id"], 10, "bin")


def _binned_events(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    rows = scored_events(spark, sf)
    return binning.rank_bins(rows.select(*dict.fromkeys(["event_id", "s_mod", *columns])) if columns else rows, "s_mod", ["event_id"], 10, "bin")


def _long(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.signals_long(scored_events(spark, sf), SIGNALS, ["event_id", "prompt_id", "dataset", "is_correct"])


@query(f"SELECT bin, n_pos, n_neg, round(auroc, 6) AS auroc FROM {sql_auroc(BINNED_DOCS, 'n_chars', 'is_correct', ['bin'])}")
def auroc_by_bin(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: how well a signal separates right from wrong in each tenth of the corpus."""
    return metrics.auroc(_binned_docs(spark, sf), "n_chars", "is_correct", ["bin"]).withColumn("auroc", F.round("auroc", 6))


@query(f"SELECT n_pos, n_neg, round(auroc, 6) AS auroc FROM {sql_auroc(LABELLED, 'n_chars', 'is_correct')}")
def auroc_pooled(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auroc(labelled_documents(spark, sf), "n_chars", "is_correct").withColumn("auroc", F.round("auroc", 6))


@query(f"SELECT lang, n_pos, n_neg, round(auroc, 6) AS auroc FROM {sql_auroc(LABELLED, 'n_chars', 'is_correct', ['lang'])}")
def auroc_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auroc(labelled_documents(spark, sf), "n_chars", "is_correct", ["lang"]).withColumn("auroc", F.round("auroc", 6))


_FLIP = f"(SELECT l.* EXCLUDE (score), CASE WHEN a.auroc < 0.5 THEN -score ELSE score END AS score, a.auroc < 0.5 AS flipped FROM {LONG} l JOIN {sql_auroc(LONG, 'score', 'is_correct', ['method'])} a USING (method))"
_SCALED = f"(SELECT * EXCLUDE (score), (score - min(score) OVER m) / (max(score) OVER m - min(score) OVER m + 1e-9) AS score FROM {_FLIP} WINDOW m AS (PARTITION BY method))"
_CLIP = f"(SELECT *, greatest(least(score, 1 - 1e-6), 1e-6) AS s FROM {_SCALED})"
_EDGES = " + ".join(f"(s >= '{i * 0.1!r}'::DOUBLE)::INT" for i in range(1, 10))
_CALIBRATION = f"""(SELECT method, sum(sq) / sum(n) AS brier, sum(n * abs(conf - acc)) / sum(n) AS ece FROM (SELECT method, {_EDGES} AS b, count(*) AS n, avg(s) AS conf, avg(is_correct) AS acc,
    sum((s - is_correct) * (s - is_correct)) AS sq FROM {_CLIP} GROUP BY ALL) GROUP BY method)"""


@query(
    f"""SELECT method, bool_or(flipped) AS flipped, any_value(round(auroc, 6)) AS auroc, any_value(round(auprc, 6)) AS auprc, any_value(round(aurac, 6)) AS aurac, any_value(round(brier, 6)) AS brier, any_value(round(ece, 6)) AS ece
        FROM (SELECT DISTINCT method, flipped FROM {_FLIP}) JOIN {sql_auroc(_SCALED, 'score', 'is_correct', ['method'])} USING (method) JOIN {sql_auprc(_SCALED, 'score', 'is_correct', ['method'])} USING (method)
        JOIN {sql_aurac(_SCALED, 'score', 'is_correct', 'event_id', ['method'])} USING (method) JOIN {_CALIBRATION} USING (method) GROUP BY method"""
)
def single_signal_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Each signal oriented and scaled: AUROC, AUPRC, AURAC, Brier, ECE."""
    long = _long(spark, sf).select("event_id", "is_correct", "method", "score")
    rows = metrics.min_max(metrics.oriented(long, "score", "is_correct", ["method"]), "score", ["method"])
    out = rows.groupBy("method").agg(F.bool_or("flipped").alias("flipped"))
    out = out.join(metrics.ranked(rows, "score", "is_correct", ["event_id"], ["method"]), "method").join(metrics.brier_ece(rows, "score", "is_correct", ["method"]), "method")
    return out.select("method", "flipped", *[F.round(c, 6).alias(c) for c in ("auroc", "auprc", "aurac", "brier", "ece")])


@query(f"SELECT dataset, method, round(brier, 6) AS brier, round(ece, 6) AS ece FROM {_CALIBRATION.replace('method, ', 'dataset, method, ', 2).replace('GROUP BY method', 'GROUP BY dataset, method')}")
def calibration_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.min_max(metrics.oriented(_long(spark, sf), "score", "is_correct", ["method"]), "score", ["method"])
    out = metrics.brier_ece(rows, "score", "is_correct", ["dataset", "method"])
    return out.select("dataset", "method", F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"))


_LONG_BIN = f"(SELECT l.*, b.bin FROM {LONG} l JOIN (SELECT event_id, bin FROM {BINNED_EVENTS}) b USING (event_id))"


@query(
    f"""SELECT method, bin, a.n_pos + a.n_neg AS n, CASE WHEN ok THEN round(auroc, 6) END AS auroc, CASE WHEN ok THEN round(aurac, 6) END AS aurac
        FROM (SELECT *, n_pos + n_neg >= 30 AND n_pos > 0 AND n_neg > 0 AS ok FROM {sql_auroc(_LONG_BIN, 'score', 'is_correct', ['method', 'bin'])}) a
        JOIN {sql_aurac(_LONG_BIN, 'score', 'is_correct', 'event_id', ['method', 'bin'])} USING (method, bin)"""
)
def metrics_by_bin(spark: SparkSession, sf: str) -> DataFrame:
    bins = _binned_events(spark, sf, "event_id").select("event_id", "bin")
    out = metrics.by_bin(_long(spark, sf).join(bins, "event_id"), "score", "is_correct", "bin", ["event_id"], ["method"])
    return out.withColumns({c: F.round(c, 6) for c in ("auroc", "aurac")})


@query(
    f"""SELECT method, dataset, a.n_pos, a.n_neg, round(auroc, 6) AS auroc, round(auprc, 6) AS auprc FROM {sql_auroc(LONG, 'score', 'is_correct', ['method', 'dataset'])} a
        JOIN {sql_auprc(LONG, 'score', 'is_correct', ['method', 'dataset'])} USING (method, dataset)"""
)
def metrics_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.ranked(_long(spark, sf), "score", "is_correct", ["event_id"], ["method", "dataset"]).drop("aurac")
    return out.withColumns({c: F.round(c, 6) for c in ("auroc", "auprc")})


_DS_BIN = sql_auroc(BINNED_EVENTS, "s_value", "is_correct", ["dataset", "bin"])


@query(f"SELECT dataset, round(max(auroc) - min(auroc), 6) AS delta, count(auroc) AS n_bins FROM {_DS_BIN} GROUP BY dataset")
def spread_by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    area = metrics.auroc(_binned_events(spark, sf, "s_value", "is_correct", "dataset"), "s_value", "is_correct", ["dataset", "bin"])
    return metrics.spread(area, "auroc", ["dataset"]).withColumn("delta", F.round("delta", 6))


@query(
    f"""SELECT excluded, round(d, 6) AS delta, round(d / nullif(max(CASE WHEN excluded = -1 THEN d END) OVER (), 0), 6) AS ratio FROM
        (SELECT excluded, max(auroc) - min(auroc) AS d FROM {sql_auroc(f"(SELECT e.*, x.excluded FROM {BINNED_EVENTS} e, (VALUES (-1), (0), (1), (2), (3)) x(excluded) WHERE e.dataset <> x.excluded)", 's_value', 'is_correct', ['excluded', 'bin'])} GROUP BY excluded)"""
)
def sensitivity_to_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Spread over bins with each dataset left out (-1: none), and its ratio to the whole."""
    rows = _binned_events(spark, sf, "s_value", "is_correct", "dataset").withColumn("excluded", F.explode(F.array(*[F.lit(i) for i in range(-1, 4)]))).where("dataset <> excluded")
    out = metrics.spread(metrics.auroc(rows, "s_value", "is_correct", ["excluded", "bin"]), "auroc", ["excluded"])
    whole = out.where("excluded = -1").select(F.col("delta").alias("_w"))
    return out.crossJoin(F.broadcast(whole)).select("excluded", F.round("delta", 6).alias("delta"), F.round(F.try_divide("delta", "_w"), 6).alias("ratio"))


@query(
    f"""WITH a AS (SELECT method, bin, auroc FROM {sql_auroc(_LONG_BIN, 'score', 'is_correct', ['method', 'bin'])} WHERE auroc IS NOT NULL),
        r AS (SELECT method, rank() OVER (PARTITION BY method ORDER BY bin) + (count(*) OVER (PARTITION BY method, bin) - 1) / 2.0 AS x,
              rank() OVER (PARTITION BY method ORDER BY auroc) + (count(*) OVER (PARTITION BY method, auroc) - 1) / 2.0 AS y FROM a),
        c AS (SELECT method, CASE WHEN count(*) >= 3 THEN corr(x, y) END AS rho, count(*) AS n_bins FROM r GROUP BY method), t AS (SELECT *, 1 - rho * rho AS c FROM c)
        SELECT method, round(rho, 6) AS rho, n_bins, round(CASE WHEN n_bins = 10 THEN 1 - abs(rho) * (1 + c / 2 + 3 * c * c / 8 + 5 * c * c * c / 16) END, 6) AS p_value FROM t"""
)
def spearman_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Rank correlation of a bin's number with its AUROC and its p, for every signal in one job."""
    bins = _binned_events(spark, sf, "event_id").select("event_id", "bin")
    area = metrics.auroc(_long(spark, sf).join(bins, "event_id"), "score", "is_correct", ["method", "bin"])
    return metrics.spearman(area, "bin", "auroc", ["method"]).withColumns({c: F.round(c, 6) for c in ("rho", "p_value")})


@query(
    f"""SELECT bin, max(CASE WHEN method = 's_value' THEN r END) AS value_to_fold, max(CASE WHEN method = 's_mod' THEN r END) AS mod_to_fold FROM
        (SELECT l.bin, l.method, round(corr(l.score, e.s_fold), 6) AS r FROM {_LONG_BIN} l JOIN {EVENTS} e USING (event_id) GROUP BY ALL) GROUP BY bin"""
)
def signal_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """How signals move with one another within each bin."""
    rows = _binned_events(spark, sf)
    return rows.groupBy("bin").agg(F.round(F.corr("s_value", "s_fold"), 6).alias("value_to_fold"), F.round(F.corr("s_mod", "s_fold"), 6).alias("mod_to_fold"))


def _sql_draws(reps: int, seed: int = 42) -> str:
    return f"""(SELECT rep, prompt_id, count(*) AS w FROM (SELECT r.rep, ('0x' || substr(md5('{seed}:' || r.rep || ':' || p.i), 1, 12))::BIGINT % p.n AS j
        FROM (SELECT row_number() OVER (ORDER BY prompt_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT prompt_id FROM {EVENTS})) p, range({reps}) r(rep)) d
        JOIN (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) - 1 AS i FROM (SELECT DISTINCT prompt_id FROM {EVENTS})) q ON q.i = d.j GROUP BY ALL)"""


@query(f"SELECT rep::INT AS rep, prompt_id, w FROM {_sql_draws(bootstrap.REPLICATES)}")
def bootstrap_weight_table(spark: SparkSession, sf: str) -> DataFrame:
    return bootstrap.bootstrap_weights(scored_events(spark, sf))


_DRAWN = f"(SELECT e.*, d.rep, d.w FROM {BINNED_EVENTS} e JOIN {_sql_draws(bootstrap.REPLICATES)} d USING (prompt_id))"


@query(f"SELECT round(avg(auroc), 6) AS mean, round(quantile_cont(auroc, 0.025), 6) AS low, round(quantile_cont(auroc, 0.975), 6) AS high, avg((auroc > 0)::INT) AS share_positive, count(*) AS n_reps FROM {sql_auroc(_DRAWN, 's_value', 'is_correct', ['rep'], 'w')}")
def bootstrap_auroc(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_events(spark, sf)
    out = bootstrap.interval(bootstrap.weighted_auroc(rows, bootstrap.packed_weights(rows), "s_value", "is_correct"), "auroc")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


@query(
    f"""WITH a AS (SELECT rep, max(auroc) - min(auroc) AS d FROM {sql_auroc(_DRAWN, 's_value', 'is_correct', ['rep', 'bin'], 'w')} GROUP BY rep),
        b AS (SELECT rep, max(auroc) - min(auroc) AS d FROM {sql_auroc(_DRAWN, 's_value', 'is_correct', ['rep', 'dataset'], 'w')} GROUP BY rep), x AS (SELECT a.d - b.d AS v FROM a JOIN b USING (rep))
        SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, avg((v > 0)::INT) AS share_positive, count(*) AS n_reps FROM x"""
)
def bootstrap_spread_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Spread over one axis less spread over another, with its interval."""
    rows = _binned_events(spark, sf, "prompt_id", "s_value", "is_correct", "dataset")
    out = bootstrap.interval(bootstrap.spread_difference(rows, bootstrap.packed_weights(rows), "s_value", "is_correct", "bin", "dataset"), "difference")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


@query(
    f"""WITH x AS (SELECT bin, a.auroc - b.auroc AS v FROM {sql_auroc(_DRAWN, 's_value', 'is_correct', ['bin', 'rep'], 'w')} a JOIN {sql_auroc(_DRAWN, 's_fold', 'is_correct', ['bin', 'rep'], 'w')} b USING (bin, rep))
        SELECT bin, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high, avg((v > 0)::INT) AS share_positive, count(*) AS n_reps FROM x WHERE v IS NOT NULL GROUP BY bin"""
)
def bootstrap_lift_by_bin(spark: SparkSession, sf: str) -> DataFrame:
    rows = _binned_events(spark, sf, "prompt_id", "s_value", "s_fold", "is_correct")
    out = bootstrap.interval(bootstrap.lift(rows, bootstrap.packed_weights(rows), "s_value", "s_fold", "is_correct", ["bin"]), "lift", ["bin"])
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


@query(f"SELECT doc_id, b3, b5, b10 FROM {sql_rank_bins(sql_rank_bins(sql_rank_bins('documents', 'n_chars', 'doc_id', 3, 'b3'), 'n_chars', 'doc_id', 5, 'b5'), 'n_chars', 'doc_id', 10, 'b10')}")
def rank_quantile_bins(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    for b in (3, 5, 10):
        docs = binning.rank_bins(docs, "n_chars", ["doc_id"], b, f"b{b}")
    return docs.drop("n_chars")


@query("""SELECT doc_id, greatest(((r - 1) * 10 + n - 2) // (n - 1) - 1, 0)::INT AS q10 FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS r, count(*) OVER () AS n FROM documents)""")
def quantile_cut_bins(spark: SparkSession, sf: str) -> DataFrame:
    return binning.quantile_cut(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"], 10, "q10").select("doc_id", "q10")


_CASE = lambda rules: "CASE WHEN v IS NULL THEN NULL " + " ".join(f"WHEN v <= {u} THEN '{n}'" for n, u in rules[:-1]) + f" ELSE '{rules[-1][0]}' END"


@query(
    f"""WITH x AS (SELECT event_id, value / 200.0 AS v FROM events), y AS (SELECT event_id, {_CASE(binning.THREE_BINS)} AS bin_3, {_CASE(binning.FIVE_BINS)} AS bin_5, {_CASE(binning.TEN_BINS)} AS bin_10,
        CASE WHEN v IS NULL THEN NULL WHEN v < 0.1 THEN 'low' WHEN v >= 0.1 AND v <= 0.4 THEN 'mid' WHEN v > 0.4 THEN 'high' END AS interval_id FROM x)
        SELECT *, (dense_rank() OVER (ORDER BY bin_3) - 1)::INT AS lexicographic_3, CASE bin_3 WHEN 'low_support' THEN 0 WHEN 'medium_support' THEN 1 WHEN 'high_support' THEN 2 END AS ordinal_3 FROM y"""
)
def cutoff_bins(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("v")
    x = table(spark, sf, "events").select("event_id", (F.col("value") / 200.0).alias("v"))
    intervals = [{"id": "low", "upper": 0.1, "upper_inclusive": False}, {"id": "mid", "lower": 0.1, "upper": 0.4}, {"id": "high", "lower": 0.4, "lower_inclusive": False}]
    x = x.select("event_id", binning.cutoff_bin(v, binning.THREE_BINS).alias("bin_3"), binning.cutoff_bin(v, binning.FIVE_BINS).alias("bin_5"), binning.cutoff_bin(v, binning.TEN_BINS).alias("bin_10"), binning.interval_bin(v, intervals).alias("interval_id"))
    return binning.label_ordinal(x, "bin_3", "lexicographic_3").withColumn("ordinal_3", binning.rule_ordinal(F.col("bin_3"), binning.THREE_BINS))


@query(f"SELECT doc_id, k, round(sum(is_correct) OVER w / k, 6) AS accuracy FROM (SELECT *, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM {LABELLED}) WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)")
def cumulative_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = running_sums(labelled_documents(spark, sf).select("doc_id", "n_chars", "is_correct"), [], [-F.col("n_chars"), F.col("doc_id")], {"hits": F.col("is_correct").cast("long"), "k": F.lit(1).cast("long")})
    return rows.select("doc_id", "k", F.round(F.col("hits") / F.col("k"), 6).alias("accuracy"))


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def first_of_group(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").withColumn("r", F.row_number().over(w)).where("r = 1").select("source", "doc_id", "n_chars")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def longest_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A top-k report."""
    return table(spark, sf, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(25)


@query("SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 50")
def seeded_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A sampling operator: k rows in seeded hash order."""
    from ..sources.readers import seeded_sample as sample

    return sample(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", 50)


_FOLDS = f"(SELECT e.*, f.fold FROM {EVENTS} e JOIN (SELECT prompt_id, ((row_number() OVER (ORDER BY md5(prompt_id::VARCHAR), prompt_id) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT prompt_id FROM {EVENTS})) f USING (prompt_id))"


@query(f"SELECT fold, count(*) AS n_rows, count(DISTINCT prompt_id) AS n_prompts, sum(is_correct)::BIGINT AS n_correct FROM {_FOLDS} GROUP BY fold")
def grouped_fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = grouped_folds(scored_events(spark, sf))
    return rows.groupBy("fold").agg(F.count("*").alias("n_rows"), F.countDistinct("prompt_id").alias("n_prompts"), F.sum("is_correct").cast("long").alias("n_correct"))


def _fusion(spark: SparkSession, sf: str, kind: str, support: bool = True) -> DataFrame:
    """Out-of-fold scores from all numbers that the signal tables hold, and with ``support`` those of the support tables too."""
    s = samples(spark, sf)
    stats = token_stats(F.col("selected_token_logits"), F.col("logsumexp"))
    rows = s.select("prompt_id", "sample_index", (F.col("response_text") == "label_1").cast("int").alias("is_correct"), *[c.alias(k) for k, c in stats.items() if k != "n_tokens"])
    rows = rows.join(semantic.semantic_features(semantic.cluster_table(s, semantic.same_text_clusters(s)), s).select("prompt_id", "semantic_entropy", "cluster_uncertainty"), "prompt_id")
    if support:
        items = table(spark, sf, "benchmark").select(F.col("item_id").alias("prompt_id"), "text")
        counts = features.ngram_coverage(items, corpus.corpus_tokens(table(spark, sf, "documents")), "prompt_id", "text")
        rows = rows.join(counts.select("prompt_id", *[c for c in counts.columns if c.endswith(("_axis", "_zero_count"))]), "prompt_id", "left")
    out = out_of_fold(rows, numbers(rows, ["prompt_id", "sample_index", "is_correct"]), "is_correct", kind)
    return out.select(F.lit(kind).alias("method"), F.lit(support).alias("with_support"), "prompt_id", "sample_index", "fold", "is_correct", "score")


@query()
def fusion_logistic(spark: SparkSession, sf: str) -> DataFrame:
    return _fusion(spark, sf, "logistic")


@query()
def fusion_logistic_signals(spark: SparkSession, sf: str) -> DataFrame:
    """The same without the support tables."""
    return _fusion(spark, sf, "logistic", support=False)


@query()
def fusion_forest(spark: SparkSession, sf: str) -> DataFrame:
    return _fusion(spark, sf, "forest")


@query()
def fusion_boosting(spark: SparkSession, sf: str) -> DataFrame:
    return _fusion(spark, sf, "boosting")


@query(
    f"""WITH a AS (SELECT auroc FROM {sql_auroc(EVENTS, 's_value', 'is_correct')}), r AS (SELECT aurac FROM {sql_aurac(EVENTS, 's_value', 'is_correct', 'event_id')}),
        d AS (SELECT max(auroc) - min(auroc) AS delta, max(CASE WHEN bin = 0 THEN auroc END) AS low, max(CASE WHEN bin = 9 THEN auroc END) AS high FROM {sql_auroc(BINNED_EVENTS, 's_value', 'is_correct', ['bin'])}),
        n AS (SELECT count(*) AS n_rows, count(DISTINCT prompt_id) AS n_prompts, avg(is_correct) AS accuracy FROM {EVENTS})
        SELECT n_rows, n_prompts, round(accuracy, 6) AS accuracy, round(auroc, 6) AS auroc, round(aurac, 6) AS aurac, round(delta, 6) AS delta, round(low, 6) AS lowest_bin, round(high, 6) AS highest_bin,
               printf('%.3f', auroc) AS auroc_text, printf('%.1f%%', accuracy * 100) AS accuracy_text FROM a, r, d, n"""
)
def headline(spark: SparkSession, sf: str) -> DataFrame:
    """The numbers of a report in one row."""
    rows, binned = scored_events(spark, sf), _binned_events(spark, sf, "s_value", "is_correct")
    at = lambda b: F.max(F.when(F.col("bin") == b, F.col("auroc")))
    bins = metrics.auroc(binned, "s_value", "is_correct", ["bin"]).agg((F.max("auroc") - F.min("auroc")).alias("delta"), at(0).alias("lowest_bin"), at(9).alias("highest_bin"))
    counts = rows.agg(F.count("*").alias("n_rows"), F.countDistinct("prompt_id").alias("n_prompts"), F.avg("is_correct").alias("accuracy"))
    out = counts.crossJoin(metrics.ranked(rows, "s_value", "is_correct", ["event_id"]).select("auroc", "aurac")).crossJoin(bins)
    return out.select("n_rows", "n_prompts", *[F.round(c, 6).alias(c) for c in ("accuracy", "auroc", "aurac", "delta", "lowest_bin", "highest_bin")], fixed(F.col("auroc"), 3).alias("auroc_text"), percent(F.col("accuracy")).alias("accuracy_text"))


@query(f"SELECT prompt_id, sample_index, (row_number() OVER (PARTITION BY prompt_id ORDER BY l[1] DESC, sample_index))::BIGINT AS place FROM {SAMPLES}")
def rank_within_prompt(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf).select("prompt_id", "sample_index", F.get("selected_token_logits", F.lit(0)).alias("x"))
    return global_rank(rows, [-F.col("x"), F.col("sample_index")], "place", ["prompt_id"]).drop("x")
