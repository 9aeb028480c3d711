"""Queries over text, numeric and array expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths, text, tokens
from ..functions.text import STOPWORDS
from ..operators.corpus import frequent
from .bindings import samples, table, turns
from .registry import SAMPLES, TURNS, norm, query, response

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
_WIDE = "[\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1c}-\\x{1f}]"
_WORDS = lambda x: f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9]+'), lambda t: t <> '')"


def _first_seen(values: str) -> str:
    """Distinct in order of appearance, in SQL."""
    return f"list_filter({values}, lambda v_, i_: list_position({values}, v_) = i_)"


def _phrases(x: str) -> str:
    terms = f"""list_transform(list_concat(regexp_extract_all({x}, '"([^"]{{3,}})"', 1), regexp_extract_all(regexp_replace({x}, '[^\\x00-\\x7F]', '_', 'g'), '\\b(?:[A-Z][A-Za-z0-9''\\-]+(?:\\s+[A-Z][A-Za-z0-9''\\-]+){{0,3}})\\b'),
        (list_filter(list_transform(regexp_extract_all({x}, '[A-Za-z0-9'']+'), lambda t: lower(t)), lambda t: len(t) >= 5 AND NOT list_contains([{_STOP}], t)))[1:16]), lambda t: {norm('t')})"""
    return f"list_filter({terms}, lambda t: t <> '' AND NOT list_contains([{_STOP}], t))"


@query(f"""WITH p AS (SELECT item_id, {_phrases('text')} AS t FROM benchmark), q AS (SELECT item_id, {_first_seen('t')} AS t FROM p) SELECT item_id, array_to_string(t[1:8], '|') AS entities, len(t[1:8])::INT AS n_entities FROM q""")
def phrase_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Rule-based entities of each benchmark item."""
    e = text.phrase_candidates(F.col("text"))
    return table(spark, sf, "benchmark").select("item_id", F.array_join(e, "|").alias("entities"), F.size(e).alias("n_entities"))


_TURN_SETS = f"(SELECT conv_id, turn, question, answer, {_first_seen(_WORDS('question'))} AS q, {_first_seen(_WORDS('answer'))} AS a FROM {TURNS})"


@query(
    rf"""SELECT conv_id, turn, len(q)::INT AS n_question, len(a)::INT AS n_answer, round(len(list_intersect(q, a))::DOUBLE / nullif(len(list_distinct(list_concat(q, a))), 0), 6) AS jaccard,
        coalesce(len(a) > 0 AND (len(list_intersect(q, a))::DOUBLE / nullif(len(list_distinct(list_concat(q, a))), 0) >= 0.5 OR (sa <> '' AND sq <> '' AND (contains(sa, sq) OR contains(sq, sa)))), FALSE) AS matches
        FROM (SELECT *, lower(trim(regexp_replace(question, '\s+', ' ', 'g'))) AS sq, lower(trim(regexp_replace(answer, '\s+', ' ', 'g'))) AS sa FROM {_TURN_SETS})"""
)
def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Word-set Jaccard and the overlap match of answers with their questions."""
    q, a = text.word_set(F.col("question")), text.word_set(F.col("answer"))
    return turns(spark, sf).select("conv_id", "turn", F.size(q).alias("n_question"), F.size(a).alias("n_answer"), F.round(text.jaccard(q, a), 6).alias("jaccard"), text.overlap_match(F.col("answer"), F.col("question")).alias("matches"))


@query(rf"""SELECT item_id, {response('text')} AS response, {norm('text')} AS term, trim(regexp_replace(text, '\s+', ' ', 'g')) AS collapsed FROM benchmark""")
def normalised_text(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf, "benchmark").select("item_id", text.normalize_response(t).alias("response"), text.normalize_term(t).alias("term"), text.collapse(t).alias("collapsed"))


@query(
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '{_WIDE}', ' ', 'g'), '\\S+') AS t FROM documents)
        SELECT doc_id, len(t)::INT AS n_tokens, greatest(len(t) - 2, 0)::INT AS n_trigrams, CASE WHEN len(t) >= 3 THEN array_to_string(t[1:3], ' ') END AS first_trigram, CASE WHEN len(t) >= 5 THEN array_to_string(t[len(t)-4:len(t)], ' ') END AS last_fivegram FROM t"""
)
def token_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    t = text.space_tokens(F.col("text"))
    three, five = text.ngrams(F.col("t"), 3), text.ngrams(F.col("t"), 5)
    return table(spark, sf, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(three).alias("n_trigrams"), F.get(three, F.lit(0)).alias("first_trigram"), F.get(five, F.size(five) - 1).alias("last_fivegram"))


@query("""SELECT gram, n FROM (SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: array_to_string(t[i:i+2], ' '))) AS gram FROM
    (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM documents)) GROUP BY gram) WHERE n > 20""")
def frequent_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    t = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda x: x != "")
    grams = table(spark, sf, "documents").select(t.alias("t")).select(F.explode(text.ngrams(F.col("t"), 3)).alias("gram"))
    return frequent(grams, "gram", 20)


_ALIASES = "[question, lower(question), ' ' || question || ' ', answer, '', lower(answer)]"
_CLEAN = rf"list_filter(list_transform({_ALIASES}, lambda v: trim(regexp_replace(v, '\s+', ' ', 'g'))), lambda v: v <> '')"


@query(f"""SELECT conv_id, turn, array_to_string(list_filter(c, lambda v, i: list_position(list_transform(c, lambda w: lower(w)), lower(v)) = i), '|') AS candidates FROM (SELECT conv_id, turn, {_CLEAN} AS c FROM {TURNS})""")
def gold_candidate_union(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of several fields as one list, first spelling kept."""
    q, a = F.col("question"), F.col("answer")
    c = text.gold_candidates(F.array(q, F.lower(q)), F.array(F.concat(F.lit(" "), q, F.lit(" "))), F.array(a, F.lit("")), F.array(F.lower(a)))
    return turns(spark, sf).select("conv_id", "turn", F.array_join(c, "|").alias("candidates"))


@query(
    rf"""WITH e AS (SELECT conv_id, turn, {_phrases('question')} AS q, {_phrases('answer')} AS a, question FROM {TURNS}), m AS (SELECT *, list_concat(({_first_seen('q')})[1:8], ({_first_seen('a')})[1:8]) AS b FROM e)
        SELECT conv_id, turn, array_to_string(({_first_seen('b')})[1:8], '|') AS entities, trim(regexp_replace('Actually, ' || question, '(?i)^(yes, |no, |actually, |actually,|so the answer is |the answer is )', '')) AS statement FROM m"""
)
def merged_entities(spark: SparkSession, sf: str) -> DataFrame:
    q, a = text.phrase_candidates(F.col("question")), text.phrase_candidates(F.col("answer"))
    return turns(spark, sf).select("conv_id", "turn", F.array_join(text.merge_entities(q, a), "|").alias("entities"), text.strip_discourse(F.concat(F.lit("Actually, "), F.col("question"))).alias("statement"))


_TRIPLE = """'[["The ' || replace(w[1], '"', '') || '", "is", "' || replace(w[2], '"', '') || '"], ["' || replace(w[3], '"', '') || '", "of"]]'"""


@query(
    rf"""WITH w AS (SELECT item_id, regexp_split_to_array(regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), ' +') AS w FROM benchmark), e AS (SELECT item_id, CASE WHEN item_id % 4 = 3 THEN ['The ' || w[1], w[2]] ELSE ['The ' || w[1], w[2], w[3]] END AS s, CASE WHEN item_id % 4 = 3 THEN ['The ' || w[1], w[2]] ELSE ['The ' || w[1], w[3]] END AS q FROM w),
        n AS (SELECT item_id, list_transform(s, lambda x: regexp_replace({norm('x')}, '^(a |an |the )', '')) AS s, list_transform(q, lambda x: regexp_replace({norm('x')}, '^(a |an |the )', '')) AS q FROM e)
        SELECT item_id, array_to_string(list_filter({_first_seen('s')}, lambda x: x <> ''), '|') AS statement_entities, array_to_string(list_filter({_first_seen('q')}, lambda x: x <> ''), '|') AS question_entities FROM n"""
)
def triplet_entity_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Entities from triplets in a model's answer: within other text, behind a prefix, as a literal of tuples, as a flat list."""
    w = F.split(F.regexp_replace("text", "[^A-Za-z0-9 ]", ""), " +")
    rows = table(spark, sf, "benchmark").select("item_id", w.alias("w"))
    put = lambda form: F.format_string(form, *[F.get("w", F.lit(i)) for i in range(3)])
    full = '[["The %1$s", "is", "%2$s"], ["%3$s", "of"]]'
    forms = (f"Sure: {full} done", f"Entities: {full}", "[('The %1$s', 'is', '%2$s'), ('%3$s', 'of')]", '["The %1$s", "%2$s"]')
    answer = F.when(F.col("item_id") % 4 == 0, put(forms[0])).when(F.col("item_id") % 4 == 1, put(forms[1])).when(F.col("item_id") % 4 == 2, put(forms[2])).otherwise(put(forms[3]))
    t = text.parse_triplets(answer)
    make = lambda role: F.array_join(text.normalize_entities(text.triplet_entities(t, F.lit(role))), "|")
    return rows.select("item_id", make("declarative").alias("statement_entities"), make("question").alias("question_entities"))


@query(r"""SELECT page_id, trim(CASE WHEN regexp_extract(html, '(?s)<title>\s*(.*?)\s*</title>', 1) <> '' THEN regexp_extract(html, '(?s)<title>\s*(.*?)\s*</title>', 1) ELSE substr(html, 1, 80) END) AS title FROM pages""")
def tagged_answers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", text.tagged_answer(F.col("html"), "<title>", "</title>").alias("title"))


@query(
    rf"""SELECT conv_id, turn, sha256(p) AS prompt_hash, substr(sha1(conv_id || '::' || turn), 1, 12) AS short_id, ('0x' || substr(sha1('7:' || conv_id || ':' || turn), 1, 8))::BIGINT AS seed,
        CASE WHEN question <= answer THEN question || ' && ' || answer ELSE answer || ' && ' || question END AS pair_key, trim(split_part(answer, chr(10), 1)) AS answer_span, regexp_matches(answer, '[.?!。؟！？]') AS ends FROM
        (SELECT *, 'Answer the following question in a single brief but complete sentence.' || chr(10) || 'Question: ' || trim(question) || chr(10) || 'Answer:' AS p FROM {TURNS})"""
)
def prompt_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt text and hash, short ids, seeds, pair keys, answer spans."""
    c = lambda x: F.col(x).cast("string")
    return turns(spark, sf).select(
        "conv_id", "turn", text.prompt_hash(text.prompt_text(F.col("question"))).alias("prompt_hash"), F.substring(text.stable_id(c("conv_id"), c("turn")), -12, 12).alias("short_id"),
        text.item_seed(F.lit("7"), c("conv_id"), c("turn")).alias("seed"), text.pair_key(F.col("question"), F.col("answer")).alias("pair_key"), text.answer_span(F.col("answer")).alias("answer_span"), text.has_terminal_mark(F.col("answer")).alias("ends"),
    )


@query(
    """SELECT event_id, CASE WHEN w IN ('true', '1', 'yes') THEN TRUE WHEN w IN ('false', '0', 'no') THEN FALSE END AS flag, printf('%.2f', value) AS fixed, (json_extract(props, '$.k'))::BIGINT AS k, '{"k":' || (json_extract(props, '$.k'))::VARCHAR || ',"type":"' || event_type || '"}' AS encoded FROM
        (SELECT *, CASE event_id % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'no' WHEN 2 THEN '1' WHEN 3 THEN 'other' ELSE '0' END AS w FROM events)"""
)
def coerced_values(spark: SparkSession, sf: str) -> DataFrame:
    """Booleans from text, fixed-point text, and metadata from and to JSON."""
    e = table(spark, sf, "events")
    word = F.when(F.col("event_id") % 5 == 0, " True").when(F.col("event_id") % 5 == 1, "NO").when(F.col("event_id") % 5 == 2, "1").when(F.col("event_id") % 5 == 3, "other").otherwise("0")
    k = F.from_json("props", "k bigint")["k"]
    return e.select("event_id", text.to_bool(word).alias("flag"), text.fixed(F.col("value"), 2).alias("fixed"), k.alias("k"), F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("type"))).alias("encoded"))


@query(
    f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(text) = '' THEN 'empty' END, CASE WHEN contains(text, chr(10)) THEN 'newline' END, CASE WHEN n > 60 THEN 'too_long' END, CASE WHEN f NOT IN ('eos', 'newline', 'punctuation', 'max_new_tokens') THEN 'finish_reason' END,
        CASE WHEN f = 'max_new_tokens' THEN 'max_new_tokens' END, CASE WHEN regexp_matches(text, '(?i)\\bto answer (?:the|this)\\b') THEN 'forbidden_4' END], lambda x: x IS NOT NULL), ',') AS problems FROM
        (SELECT doc_id, text, len(regexp_split_to_array(text, ' ')) AS n, CASE doc_id % 3 WHEN 0 THEN 'eos' WHEN 1 THEN 'max_new_tokens' ELSE 'other' END AS f FROM documents)"""
)
def answer_rules(spark: SparkSession, sf: str) -> DataFrame:
    finish = F.when(F.col("doc_id") % 3 == 0, "eos").when(F.col("doc_id") % 3 == 1, "max_new_tokens").otherwise("other")
    problems = text.answer_only_problems(F.col("text"), F.split("text", " "), finish, 60)
    return table(spark, sf, "documents").select("doc_id", F.array_join(problems, ",").alias("problems"))


@query(
    """WITH x AS (SELECT event_id, (value * 1000)::BIGINT AS f, (event_id % 400)::BIGINT AS p FROM events), a AS (SELECT *, least(round(ln(1 + f) / ln(1 + 1000000.0), 6), 1.0) AS fa, CASE WHEN p <= 0 THEN 0.0 ELSE least(round(ln(1 + p) / ln(1 + 100000.0), 6), 1.0) END AS pa,
        ln(1 + greatest(0, p)) / ln(1 + 100000.0) AS ba, ln(1 + greatest(0, f)) / ln(1 + 100000000.0) AS na FROM x)
        SELECT event_id, CASE WHEN f <= 0 THEN 0.0 ELSE fa END AS frequency_axis, pa AS pair_axis, round(ba, 6) AS bridge_axis, round(na, 6) AS ngram_axis, round(((CASE WHEN f <= 0 THEN 0.0 ELSE fa END + pa) / 2)::DECIMAL(18,9), 6)::DOUBLE AS coverage, f < 1000 AS low, p = 0 AS zero,
        round((((1 - CASE WHEN f <= 0 THEN 0.0 ELSE fa END) + (1 - pa) + (f < 1000)::INT + (p = 0)::INT + (1 - round(((CASE WHEN f <= 0 THEN 0.0 ELSE fa END + pa) / 2)::DECIMAL(18,9), 6)::DOUBLE)) / 5)::DECIMAL(18,9), 6)::DOUBLE AS risk FROM a"""
)
def support_axes(spark: SparkSession, sf: str) -> DataFrame:
    """The three log axes, flags, coverage and risk from raw counts."""
    x = table(spark, sf, "events").select("event_id", F.round(F.col("value") * 1000).cast("long").alias("f"), (F.col("event_id") % 400).alias("p"))
    x = x.withColumns({"frequency_axis": maths.log_axis(F.col("f"), maths.ENTITY_SCALE), "pair_axis": maths.log_axis(F.col("p"), maths.PAIR_SCALE), "low": F.col("f") < maths.LOW_FREQUENCY, "zero": F.col("p") == 0})
    cover = maths.coverage(F.col("frequency_axis"), F.col("pair_axis"))
    risk = maths.corpus_risk(F.col("frequency_axis"), F.col("pair_axis"), F.col("low"), F.col("zero"), cover)
    return x.select("event_id", "frequency_axis", "pair_axis", F.round(maths.open_log_axis(F.col("p"), maths.PAIR_SCALE), 6).alias("bridge_axis"), F.round(maths.open_log_axis(F.col("f"), maths.NGRAM_CEILING), 6).alias("ngram_axis"), cover.alias("coverage"), "low", "zero", risk.alias("risk"))


@query(
    f"""SELECT prompt_id, sample_index, round(-list_avg(lp), 6) AS sample_nll, round(list_sum(lp), 6) AS sample_sequence_log_prob, round(list_var_pop(l), 6) AS sample_logit_variance, round(list_avg(z), 6) AS sample_logsumexp_mean, len(l)::INT AS n_tokens
        FROM (SELECT *, list_transform(list_zip(l, z), lambda p: p[1] - p[2]) AS lp FROM {SAMPLES})"""
)
def token_statistics(spark: SparkSession, sf: str) -> DataFrame:
    stats = tokens.token_stats(F.col("selected_token_logits"), F.col("logsumexp"))
    return samples(spark, sf).select("prompt_id", "sample_index", *[(c if k == "n_tokens" else F.round(c, 6)).alias(k) for k, c in stats.items()])


@query(
    f"""SELECT prompt_id, round(avg(top1 - top2), 6) AS margin_mean, round(min(top1 - top2), 6) AS margin_min, round(avg(top1), 6) AS top1_mean, round(avg(var), 6) AS variance_mean, round(avg(e), 6) AS energy_mean FROM
        (SELECT prompt_id, list_reverse_sort(l)[1] AS top1, list_reverse_sort(l)[2] AS top2, list_var_pop(l) AS var, -(list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l)))))) AS e FROM {SAMPLES}) GROUP BY prompt_id"""
)
def logit_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Each row's vector as one token's full logits: margin, variance and energy averaged over a sample's tokens."""
    v = F.col("selected_token_logits")
    rows = samples(spark, sf).select("prompt_id", tokens.logit_margin(v).alias("m"), F.get(maths.top_two(v), F.lit(0)).alias("top1"), maths.array_var_pop(v).alias("var"), (-maths.logsumexp(v)).alias("e"))
    return rows.groupBy("prompt_id").agg(F.round(F.avg("m"), 6).alias("margin_mean"), F.round(F.min("m"), 6).alias("margin_min"), F.round(F.avg("top1"), 6).alias("top1_mean"), F.round(F.avg("var"), 6).alias("variance_mean"), F.round(F.avg("e"), 6).alias("energy_mean"))


@query(
    f"""SELECT prompt_id, sample_index, round(avg(-z), 6) AS window_energy, round(avg(-(l - z)), 6) AS window_nll, count(*) AS n_tokens FROM (SELECT prompt_id, sample_index, unnest(l) AS l, unnest(z) AS z, unnest(range(len(l))) AS pos FROM {SAMPLES}) WHERE pos >= 8 + sample_index AND pos <= 40 GROUP BY ALL"""
)
def answer_window_energy(spark: SparkSession, sf: str) -> DataFrame:
    """Energy and likelihood of every candidate over its answer's window of tokens only."""
    l, z = F.col("selected_token_logits"), F.col("logsumexp")  # noqa: E741
    size = F.lit(33) - F.col("sample_index")  # a window of tokens 8 + index .. 40
    inside = samples(spark, sf).select("prompt_id", "sample_index", F.slice(l, 9 + F.col("sample_index"), size).alias("l"), F.slice(z, 9 + F.col("sample_index"), size).alias("z"))
    nll = F.zip_with("l", "z", lambda a, b: b - a)
    return inside.select("prompt_id", "sample_index", F.round(-maths.array_mean(F.col("z")), 6).alias("window_energy"), F.round(maths.array_mean(nll), 6).alias("window_nll"), F.size("l").cast("long").alias("n_tokens"))


@query(
    f"""SELECT prompt_id, sample_index, round(list_sum(list_transform(list_zip(l, z), lambda p: exp(p[1] - p[2]))), 6) AS total_probability, array_to_string(list_transform(l[3:5], lambda x: printf('%.4f', x)), ',') AS part, len(list_concat(l, z))::INT AS flat_size,
        round(greatest(least(l[1], 1 - 1e-6), 1e-6), 6) AS clipped, abs(l[1] - l[2]) <= greatest(1e-6 * greatest(abs(l[1]), abs(l[2])), 1e-6) AS nearly_equal FROM {SAMPLES}"""
)
def array_operations(spark: SparkSession, sf: str) -> DataFrame:
    l, z = F.col("selected_token_logits"), F.col("logsumexp")  # noqa: E741
    one, two = F.get(l, F.lit(0)), F.get(l, F.lit(1))
    return samples(spark, sf).select(
        "prompt_id", "sample_index", F.round(maths.array_sum(F.transform(tokens.token_logprobs(l, z), F.exp)), 6).alias("total_probability"), F.array_join(F.transform(F.slice(l, 3, 3), lambda x: F.format_string("%.4f", x)), ",").alias("part"),
        F.size(F.flatten(F.array(l, z))).alias("flat_size"), F.round(maths.clip(one), 6).alias("clipped"), maths.close(one, two).alias("nearly_equal"),
    )
