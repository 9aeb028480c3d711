"""Queries over corpus counts and the features made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_term, phrase_candidates
from ..operators import binning, corpus, features, metrics
from .bindings import item_terms, labelled_documents, table, terms, turns
from .q_text import _first_seen, _phrases
from .registry import LABELLED, TERMS, TURNS, norm, query, response, sql_auroc

_TOKENS = f"(SELECT doc_id AS doc, list_filter(regexp_split_to_array({norm('text')}, ' '), lambda t: t <> '') AS t FROM documents)"


def _occurrences(asked: str) -> str:
    """(term, doc, position) of asked terms (a relation with ``term``), in SQL."""
    return f"""(SELECT a.term, g.doc, g.position FROM (SELECT DISTINCT term, len(regexp_split_to_array(term, ' ')) AS words FROM {asked} WHERE term <> '') a
        JOIN (SELECT doc, n, unnest(range(greatest(len(t) - n + 1, 0))) AS position, unnest(list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda i: array_to_string(t[i:i+n-1], ' '))) AS term
              FROM {_TOKENS}, (SELECT DISTINCT len(regexp_split_to_array(term, ' ')) AS n FROM {asked} WHERE term <> '')) g ON g.term = a.term AND g.n = a.words)"""


_ASKED = f"(SELECT DISTINCT {norm('term')} AS term FROM {TERMS})"
_ITEM_TERMS = """(SELECT item_id, list_distinct([w[1], concat_ws(' ', w[2], w[3]), w[4]]) AS e FROM
    (SELECT item_id, regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]+', '', 'g'), ' +') AS w FROM benchmark))"""
_PAIRS = f'''(SELECT DISTINCT least({norm('l')}, {norm('r')}) AS "left", greatest({norm('l')}, {norm('r')}) AS "right" FROM (SELECT unnest(e) AS l, e FROM {_ITEM_TERMS}), unnest(e) u(r)
    WHERE l < r AND {norm('l')} <> '' AND {norm('r')} <> '' AND {norm('l')} <> {norm('r')})'''
_BOTH = f'(SELECT "left" AS term FROM {_PAIRS} UNION SELECT "right" FROM {_PAIRS})'
_KIND = "'corvane_corpus' AS backend_id, {q} AS query, '{k}' AS query_kind, {s} AS status, 'corpus' AS index_ref, FALSE AS approximate, {x} AS excluded"
_PAIR_KIND = _KIND.format(q="\"left\" || ' && ' || \"right\"", k="entity_pair_cooccurrence", s="'resolved'", x="FALSE")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.corpus_tokens(table(spark, sf, "documents"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs of each benchmark item's terms."""
    return corpus.entity_pairs(item_terms(spark, sf), "entities")


@query(
    f"""SELECT t.term, CASE WHEN t.term <> '' THEN count(o.doc) END AS raw_count, {_KIND.format(q='t.term', k='entity_frequency', s="CASE WHEN t.term <> '' THEN 'resolved' ELSE 'excluded_empty_normalized_query' END", x="t.term = ''")}
        FROM (SELECT DISTINCT term FROM {_ASKED}) t LEFT JOIN {_occurrences(_ASKED)} o USING (term) GROUP BY t.term"""
)
def entity_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of each asked term in the corpus, with their provenance."""
    return corpus.count_entities(_corpus(spark, sf), terms(spark, sf))


@query(
    f"""WITH o AS (SELECT DISTINCT term, doc FROM {_occurrences(_BOTH)}), c AS (SELECT p."left", p."right", count(*) AS n FROM {_PAIRS} p JOIN o x ON x.term = p."left" JOIN o y ON y.term = p."right" AND y.doc = x.doc GROUP BY ALL)
        SELECT p."left", p."right", coalesce(n, 0)::BIGINT AS raw_count, {_PAIR_KIND} FROM {_PAIRS} p LEFT JOIN c USING ("left", "right")"""
)
def pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in which both terms of a pair occur."""
    return corpus.count_pairs(_corpus(spark, sf), _pairs(spark, sf))


@query(
    f"""WITH o AS (SELECT * FROM {_occurrences(_BOTH)}), c AS (SELECT p."left", p."right", count(*) AS n FROM {_PAIRS} p JOIN o x ON x.term = p."left" JOIN o y ON y.term = p."right" AND y.doc = x.doc AND abs(x.position - y.position) <= 100 GROUP BY ALL)
        SELECT p."left", p."right", coalesce(n, 0)::BIGINT AS raw_count, {_PAIR_KIND} FROM {_PAIRS} p LEFT JOIN c USING ("left", "right")"""
)
def pair_counts_in_window(spark: SparkSession, sf: str) -> DataFrame:
    """Position pairs of both terms at most 100 words apart."""
    return corpus.count_pairs(_corpus(spark, sf), _pairs(spark, sf), unit="window")


@query(
    f"""WITH e AS (SELECT conv_id, turn, ({_first_seen(_phrases('answer'))})[1:8] AS e FROM {TURNS})
        SELECT kind, query FROM (SELECT DISTINCT 'entity' AS kind, unnest(e) AS query FROM e) UNION ALL SELECT kind, query FROM (SELECT DISTINCT 'pair' AS kind, l || ' && ' || r AS query FROM (SELECT unnest(e) AS l, e FROM e), unnest(e) u(r) WHERE l < r)"""
)
def terms_to_count(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that has to be counted for a set of rows, once."""
    rows = turns(spark, sf).select("conv_id", "turn", phrase_candidates(F.col("answer")).alias("entities"))
    one, two = corpus.asked_terms(rows, "entities")
    return one.select(F.lit("entity").alias("kind"), F.col("term").alias("query")).union(two.select(F.lit("pair").alias("kind"), F.concat_ws(" && ", "left", "right").alias("query")))


_FIXTURE = f"(SELECT 'entity' AS kind, term AS query, len(term)::BIGINT AS raw_count, CASE WHEN len(term) % 3 = 0 THEN 'api_error' ELSE 'resolved' END AS status, len(term) % 5 = 0 AS approximate FROM {_ASKED} WHERE len(term) % 2 = 0)"


@query(
    f"""SELECT w.term AS query, CASE WHEN NOT x THEN raw_count END AS raw_count, coalesce(status, 'cache_miss') AS status, x AS excluded FROM (SELECT a.term, f.raw_count, f.status, f.raw_count IS NULL OR coalesce(f.status = 'api_error' OR f.approximate, FALSE) AS x
        FROM {_ASKED} a LEFT JOIN {_FIXTURE} f ON f.query = a.term) w"""
)
def stored_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts looked up in a stored table; what is missing, approximate or failed stays null."""
    t = terms(spark, sf).select(normalize_term(F.col("term")).alias("query")).distinct()
    n = F.length("query")
    fixture = t.where(n % 2 == 0).select(F.lit("entity").alias("kind"), "query", n.cast("long").alias("raw_count"), F.when(n % 3 == 0, "api_error").otherwise("resolved").alias("status"), (n % 5 == 0).alias("approximate"))
    return corpus.lookup_counts(t, fixture, "entity")


_ANSWERS = f"(SELECT conv_id * 100 + turn AS id, ({_first_seen(_phrases('answer'))})[1:8] AS a, ({_first_seen(_phrases('question'))})[1:8] AS q, answer FROM {TURNS})"
_A_TERMS = f"(SELECT DISTINCT unnest(a) AS term FROM {_ANSWERS})"
_FREQ = f"(SELECT t.term, count(o.doc) AS n FROM {_A_TERMS} t LEFT JOIN {_occurrences(_A_TERMS)} o USING (term) GROUP BY t.term)"
_ROW_PAIRS = f"(SELECT id, l, r FROM (SELECT id, unnest(a) AS l, a FROM {_ANSWERS}), unnest(a) u(r) WHERE l < r)"
_CO = f"(SELECT x.term AS l, y.term AS r, count(*) AS n FROM (SELECT DISTINCT term, doc FROM {_occurrences(_A_TERMS)}) x JOIN (SELECT DISTINCT term, doc FROM {_occurrences(_A_TERMS)}) y ON x.doc = y.doc AND x.term < y.term GROUP BY ALL)"


def _qa(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), phrase_candidates(F.col("answer")).alias("entities"), phrase_candidates(F.col("question")).alias("asked"), "answer")


@query(
    f"""WITH f AS (SELECT id, count(*) AS n_entities, avg(n) AS fm, min(n) AS fmin FROM (SELECT id, unnest(a) AS term FROM {_ANSWERS}) JOIN {_FREQ} USING (term) GROUP BY id),
        p AS (SELECT id, count(*) AS n_pairs, avg(coalesce(n, 0)) AS pm FROM {_ROW_PAIRS} LEFT JOIN {_CO} USING (l, r) GROUP BY id),
        x AS (SELECT a.id, coalesce(n_entities, 0) AS n_entities, coalesce(n_pairs, 0) AS n_pairs, n_entities IS NOT NULL AS counts_complete, fm, fmin, CASE WHEN n_entities IS NOT NULL THEN coalesce(pm, 0.0) END AS pm FROM {_ANSWERS} a LEFT JOIN f USING (id) LEFT JOIN p USING (id))
        SELECT id, n_entities, n_pairs, counts_complete, round(fm, 6) AS frequency_mean, fmin AS frequency_min, round(pm, 6) AS pair_mean, CASE WHEN fm <= 0 THEN 0.0 ELSE least(round(ln(1 + fm) / ln(1000001.0), 6), 1.0) END AS frequency_axis,
               CASE WHEN pm <= 0 THEN 0.0 ELSE least(round(ln(1 + pm) / ln(100001.0), 6), 1.0) END AS pair_axis, fmin < 1000 AS low_frequency_flag, CASE WHEN counts_complete THEN n_pairs > 0 AND pm = 0 END AS zero_pair_flag FROM x"""
)
def candidate_axes(spark: SparkSession, sf: str) -> DataFrame:
    """Frequency and co-occurrence axes of answers, from direct corpus counts."""
    rows, docs = _qa(spark, sf), _corpus(spark, sf)
    one, two = corpus.asked_terms(rows, "entities")
    places = corpus.postings(docs, one)  # the pairs' terms are among them
    out = features.entity_axes(rows, corpus.count_entities(docs, one, places=places), corpus.count_pairs(docs, two, places=places), "id", "entities")
    return out.select("id", "n_entities", "n_pairs", "counts_complete", F.round("frequency_mean", 6).alias("frequency_mean"), "frequency_min", F.round("pair_mean", 6).alias("pair_mean"), "frequency_axis", "pair_axis", "low_frequency_flag", "zero_pair_flag")


_QA_TERMS = f"(SELECT DISTINCT unnest(list_concat(a, q)) AS term FROM {_ANSWERS})"


@query(
    f"""WITH p AS (SELECT DISTINCT id, l, r FROM (SELECT id, unnest(q) AS l, list_filter(a, lambda v: NOT list_contains(q, v)) AS rest FROM {_ANSWERS}), unnest(rest) u(r)),
        o AS (SELECT DISTINCT term, doc FROM {_occurrences(_QA_TERMS)}), c AS (SELECT l, r, count(*) AS n FROM (SELECT DISTINCT l, r FROM p) p JOIN o x ON x.term = l JOIN o y ON y.term = r AND y.doc = x.doc GROUP BY ALL),
        g AS (SELECT id, count(*) AS k, min(coalesce(n, 0)) AS lo, avg(coalesce(n, 0)) AS mean, max((coalesce(n, 0) = 0)::INT) AS zero FROM p LEFT JOIN c USING (l, r) GROUP BY id)
        SELECT id, coalesce(k, 0)::BIGINT AS bridge_pair_count, coalesce(lo, 0)::BIGINT AS bridge_min, round(coalesce(mean, 0.0), 6) AS bridge_mean, round(ln(1 + coalesce(lo, 0)) / ln(100001.0), 6) AS bridge_axis, coalesce(zero, 1)::INT AS bridge_zero_flag FROM {_ANSWERS} LEFT JOIN g USING (id)"""
)
def bridge(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an answer's entities and its question's meet in the corpus."""
    out = features.bridge_features(_qa(spark, sf), _corpus(spark, sf), "id", "asked", "entities")
    return out.withColumns({c: F.round(c, 6) for c in ("bridge_mean", "bridge_axis")})


def _gram_sql(n: int) -> str:
    grams = f"(SELECT item_id, {norm('gram')} AS term FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - {n - 2}, 1)), lambda i: array_to_string(w[i:i+{n - 1}], ' '))) AS gram FROM (SELECT item_id, regexp_extract_all(text, '\\S+') AS w FROM benchmark)))"
    asked = f"(SELECT DISTINCT term FROM {grams})"
    return f"(SELECT item_id, count(*) AS c, count(*) FILTER (n = 0) AS z, min(n) AS lo, avg(n) AS mean FROM (SELECT g.item_id, coalesce(o.n, 0) AS n FROM {grams} g LEFT JOIN (SELECT term, count(*) AS n FROM {_occurrences(asked)} GROUP BY term) o USING (term)) GROUP BY item_id)"


@query(
    f"""SELECT item_id, len(regexp_extract_all(text, '\\S+'))::INT AS n_tokens, coalesce(a.c, 0) AS ngram_3_count, coalesce(a.z, 0) AS ngram_3_zero_count, coalesce(a.lo, 0) AS ngram_3_min, round(coalesce(a.mean, 0), 6) AS ngram_3_mean, round(ln(1 + coalesce(a.mean, 0)) / ln(100000001.0), 6) AS ngram_3_axis,
        coalesce(b.c, 0) AS ngram_5_count, coalesce(b.z, 0) AS ngram_5_zero_count, coalesce(b.lo, 0) AS ngram_5_min, round(coalesce(b.mean, 0), 6) AS ngram_5_mean, round(ln(1 + coalesce(b.mean, 0)) / ln(100000001.0), 6) AS ngram_5_axis
        FROM benchmark LEFT JOIN {_gram_sql(3)} a USING (item_id) LEFT JOIN {_gram_sql(5)} b USING (item_id)"""
)
def ngram_support(spark: SparkSession, sf: str) -> DataFrame:
    """How often a text's 3- and 5-grams occur in the corpus."""
    out = features.ngram_coverage(table(spark, sf, "benchmark"), _corpus(spark, sf), "item_id", "text")
    return out.withColumns({f"ngram_{n}_{c}": F.round(f"ngram_{n}_{c}", 6) for n in (3, 5) for c in ("mean", "axis")})


_SETS = lambda x: f"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')) AS w, lower(trim(regexp_replace({x}, '\\s+', ' ', 'g'))) AS c"
_OVER = f"""(SELECT s.id, len(s.w) > 0 AND (len(list_intersect(s.w, g.w))::DOUBLE / nullif(len(list_distinct(list_concat(s.w, g.w))), 0) >= 0.5 OR (s.c <> '' AND g.c <> '' AND (contains(s.c, g.c) OR contains(g.c, s.c)))) AS m FROM
    (SELECT conv_id * 100 + turn AS id, conv_id, {_SETS('answer')} FROM {TURNS}) s JOIN (SELECT conv_id, {_SETS('question')} FROM {TURNS}) g USING (conv_id))"""


@query(f"SELECT id, max(coalesce(m, FALSE)::INT) AS is_correct, count(*) AS n_candidates FROM {_OVER} GROUP BY id")
def overlap_correctness(spark: SparkSession, sf: str) -> DataFrame:
    """Answers against all texts that their conversation holds as gold, by token overlap."""
    t = turns(spark, sf)
    s = t.select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("prompt_id"), F.col("answer").alias("response_text"))
    return features.overlap_labels(s, t.select(F.col("conv_id").alias("prompt_id"), F.col("question").alias("answer")), ["id"])


@query(
    """SELECT lang AS dataset, count(*) AS n_rows, round(avg(quality), 6) AS accuracy, count(DISTINCT source) AS n_prompts, count_if(quality <> toxic)::BIGINT AS n_disagree, round(median(n_chars), 6) AS median_chars FROM labels JOIN documents USING (doc_id) GROUP BY lang"""
)
def label_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, means, medians, distinct prompts and disagreements per dataset."""
    return labelled_documents(spark, sf).groupBy(F.col("lang").alias("dataset")).agg(
        F.count("*").alias("n_rows"), F.round(F.avg("is_correct"), 6).alias("accuracy"), F.countDistinct("source").alias("n_prompts"), F.count_if(F.col("is_correct") != F.col("toxic")).alias("n_disagree"), F.round(F.median("n_chars"), 6).alias("median_chars")
    )


@query(
    f"""SELECT prompt_id, sample_index, max(p) AS max_probability, (max(p) >= 0.5)::INT AS is_correct FROM (SELECT x.vec_id // 10 AS prompt_id, x.vec_id % 10 AS sample_index, CASE WHEN x.label = y.label THEN 0.9 WHEN x.label < y.label THEN 0.25 ELSE 0.1 END::DOUBLE AS p
        FROM embeddings x JOIN embeddings y ON x.vec_id // 10 = y.vec_id // 10 AND x.vec_id <> y.vec_id) GROUP BY ALL"""
)
def entailment_correctness(spark: SparkSession, sf: str) -> DataFrame:
    """The largest entailment score over gold candidates and directions, and the label it gives."""
    e = table(spark, sf, "embeddings").select(F.expr("vec_id div 10").alias("prompt_id"), (F.col("vec_id") % 10).alias("sample_index"), "label")
    o = e.select("prompt_id", F.col("sample_index").alias("other"), F.col("label").alias("gold"))
    p = F.when(F.col("label") == F.col("gold"), 0.9).when(F.col("label") < F.col("gold"), 0.25).otherwise(0.1)
    return features.entailment_labels(e.join(o, "prompt_id").where("sample_index <> other").withColumn("probability", p), ["prompt_id", "sample_index"])


@query(
    f"""SELECT count, row_status, count(*) AS n FROM (SELECT event_id % 7 AS count, CASE WHEN event_id % 7 = 0 THEN 'no_entities' WHEN event_id % 11 = 0 THEN 'disallowed_backend' WHEN event_id % 13 = 0 THEN 'excluded_approximate_counts' WHEN event_id % 17 = 0 THEN 'excluded_missing_counts'
        WHEN event_id % 19 = 0 THEN 'fallback_resolved' ELSE 'resolved' END AS row_status FROM events) GROUP BY ALL"""
)
def row_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """The ordered cases that say what became of a row's counts, as a histogram."""
    e = table(spark, sf, "events").select((F.col("event_id") % 7).alias("count"), *[(F.col("event_id") % m == 0).cast("int").alias(n) for n, m in (("bad", 11), ("approx", 13), ("missing", 17), ("fallback", 19))])
    return e.groupBy("count", features.row_status("count", "bad", "approx", "missing", "fallback").alias("row_status")).agg(F.count("*").alias("n"))


_Q_AXIS = f"(SELECT d.source, d.doc_id, d.is_correct, len({response('d.text')})::DOUBLE AS s, f.n FROM {LABELLED} d JOIN (SELECT source, count(*) AS n FROM documents GROUP BY source) f USING (source))"


@query(f"SELECT bin, n_pos, n_neg, round(auroc, 6) AS auroc FROM {sql_auroc(f'(SELECT *, greatest(((dense_rank() OVER (ORDER BY n, source) - 1) * 10 + k - 2) // (k - 1) - 1, 0)::INT AS bin FROM (SELECT *, (SELECT count(DISTINCT source) FROM {LABELLED}) AS k FROM {_Q_AXIS}))', 's', 'is_correct', ['bin'])}")
def prompt_axis_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Bins over prompts by an axis of theirs alone, then AUROC of rows per bin."""
    from ..functions.text import normalize_response

    docs = labelled_documents(spark, sf)
    sizes = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).join(docs.select("source").distinct(), "source")
    bins = binning.quantile_cut(sizes, "n", ["source"], 10, "bin")
    rows = docs.join(bins.select("source", "bin"), "source").withColumn("s", F.length(normalize_response(F.col("text"))).cast("double"))
    return metrics.auroc(rows, "s", "is_correct", ["bin"]).withColumn("auroc", F.round("auroc", 6))
