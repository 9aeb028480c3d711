"""Queries over joins, grouped statistics, contracts, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import token_stats
from ..operators import semantic, validate
from ..operators.binning import rank_bins
from ..schemas import CANDIDATES, SCHEMA_VERSION
from ..shared import scratch
from ..sources import readers, writers
from ..streaming.incremental import label_rates, missing_items
from .bindings import samples, scored_events, table, turns
from .q_semantic import _FEATURES, _STATS
from .registry import EVENTS, SAMPLES, TURNS, query


@query(
    f"""WITH d AS (SELECT prompt_id, sample_index, round(-mean_like, 6) AS sample_nll FROM {_STATS}), p AS (SELECT prompt_id, max(response_text) AS top_text, count(*) AS n FROM {SAMPLES} WHERE prompt_id % 4 <> 0 GROUP BY prompt_id),
        b AS (SELECT prompt_id, least((row_number() OVER (ORDER BY semantic_entropy, prompt_id) - 1) * 10 // count(*) OVER (), 9)::INT AS bin FROM {_FEATURES})
        SELECT s.prompt_id, s.sample_index, (s.response_text = 'label_1')::INT AS is_correct, s.response_text <> 'label_1' AS is_hallucination, d.sample_nll, round(f.semantic_entropy, 6) AS entropy, round(f.cluster_uncertainty, 6) AS energy, p.top_text, p.n, b.bin
        FROM {SAMPLES} s LEFT JOIN d USING (prompt_id, sample_index) LEFT JOIN {_FEATURES} f USING (prompt_id) LEFT JOIN p USING (prompt_id) LEFT JOIN b USING (prompt_id)"""
)
def wide_features(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with sample, prompt and bin features side by side; prompt values repeat on each sample."""
    s = samples(spark, sf)
    stats = token_stats(F.col("selected_token_logits"), F.col("logsumexp"))
    d = s.select("prompt_id", "sample_index", F.round(stats["sample_nll"], 6).alias("sample_nll"))
    f = semantic.semantic_features(semantic.cluster_table(s, semantic.same_text_clusters(s)), s)
    p = s.where("prompt_id % 4 <> 0").groupBy("prompt_id").agg(F.max("response_text").alias("top_text"), F.count("*").alias("n"))
    b = rank_bins(f.select("prompt_id", "semantic_entropy"), "semantic_entropy", ["prompt_id"], 10, "bin").select("prompt_id", "bin")
    right = (F.col("response_text") == "label_1").alias("is_correct")
    out = s.select("prompt_id", "sample_index", right.cast("int").alias("is_correct"), (~right).alias("is_hallucination")).join(d, ["prompt_id", "sample_index"], "left")
    out = out.join(f.select("prompt_id", F.round("semantic_entropy", 6).alias("entropy"), F.round("cluster_uncertainty", 6).alias("energy")), "prompt_id", "left").join(p, "prompt_id", "left").join(b, "prompt_id", "left")
    return out.select("prompt_id", "sample_index", "is_correct", "is_hallucination", "sample_nll", "entropy", "energy", "top_text", "n", "bin")


@query(f"SELECT event_id, prompt_id, is_correct, max(CASE WHEN method = 'a' THEN score END) AS score_a, max(CASE WHEN method = 'b' THEN score END) AS score_b FROM (SELECT *, 'a' AS method, s_value AS score FROM {EVENTS} UNION ALL SELECT *, 'b', s_mod FROM {EVENTS} WHERE event_id % 2 = 0) GROUP BY ALL HAVING count(DISTINCT method) = 2")
def paired_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of two methods for the same rows: inner self-join on the keys."""
    e = scored_events(spark, sf)
    long = e.select("event_id", "prompt_id", "is_correct", F.lit("a").alias("method"), F.col("s_value").alias("score")).union(e.where("event_id % 2 = 0").select("event_id", "prompt_id", "is_correct", F.lit("b"), "s_mod"))
    one = long.where("method = 'a'").select("event_id", "prompt_id", "is_correct", F.col("score").alias("score_a"))
    two = long.where("method = 'b'").select("event_id", "prompt_id", "is_correct", F.col("score").alias("score_b"))
    return one.join(two, ["event_id", "prompt_id", "is_correct"])


@query(f"SELECT prompt_id, count(*) AS n_rows, round(avg(score), 6) AS mean_score FROM (SELECT e.prompt_id, e.s_value AS score FROM {EVENTS} e JOIN (SELECT event_id FROM {EVENTS} WHERE dataset <> 2) k USING (event_id)) GROUP BY prompt_id")
def keyed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Scores looked up by key; a key without a score fails the job."""
    e = scored_events(spark, sf)
    keys = e.where("dataset <> 2").select("event_id")
    found = keys.join(e.select("event_id", "prompt_id", F.col("s_value").alias("score")), "event_id", "left")
    checked = found.withColumn("score", F.when(F.col("score").isNull(), F.raise_error(F.lit("no score for a key"))).otherwise(F.col("score")))
    return checked.groupBy("prompt_id").agg(F.count("*").alias("n_rows"), F.round(F.avg("score"), 6).alias("mean_score"))


@query("SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM documents WHERE len(regexp_split_to_array(text, ' ')) >= 400 GROUP BY source HAVING count(*) >= 5)")
def truncated_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of prompts with enough samples at the length cap: grouped threshold, then a semi-join."""
    d = table(spark, sf, "documents")
    flagged = d.groupBy("source").agg(F.count_if(F.size(F.split("text", " ")) >= 400).alias("n")).where("n >= 5")
    return d.join(flagged, "source", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_work(spark: SparkSession, sf: str) -> DataFrame:
    """Items that are not done yet."""
    return missing_items(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents d ANTI JOIN labels l USING (doc_id) UNION ALL SELECT doc_id, lang FROM documents d SEMI JOIN labels l USING (doc_id) WHERE lang <> 'en'")
def union_of_parts(spark: SparkSession, sf: str) -> DataFrame:
    d, done = table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels")
    return d.join(done, "doc_id", "left_anti").unionByName(d.join(done, "doc_id", "left_semi").where("lang <> 'en'"))


@query("SELECT lang, source, count(*) AS n_docs, round(avg(n_chars), 6) AS mean_chars, round(median(n_chars), 6) AS median_chars, round(var_pop(n_chars), 4) AS variance FROM documents GROUP BY lang, source")
def grouped_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.round(F.median("n_chars"), 6).alias("median_chars"), F.round(F.var_pop("n_chars"), 4).alias("variance"))


@query(f"SELECT prompt_id, array_to_string(list(response_text ORDER BY sample_index), ',') AS texts, min_by(response_text, sample_index) AS first_text FROM {SAMPLES} GROUP BY prompt_id")
def ordered_groups(spark: SparkSession, sf: str) -> DataFrame:
    """A prompt's samples in order, and its first one."""
    s = samples(spark, sf).groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct("sample_index", "response_text"))).alias("r"), F.min_by("response_text", "sample_index").alias("first_text"))
    return s.select("prompt_id", F.array_join(F.col("r.response_text"), ",").alias("texts"), "first_text")


@query(f"SELECT prompt_id, round(avg((response_text = 'label_1')::INT), 6) AS match_rate, count_if(response_text = 'label_1')::BIGINT AS n_matches FROM {SAMPLES} GROUP BY prompt_id")
def match_rates(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("response_text") == "label_1"
    return samples(spark, sf).groupBy("prompt_id").agg(F.round(F.avg(hit.cast("int")), 6).alias("match_rate"), F.count_if(hit).alias("n_matches"))


@query("SELECT event_id, k, user_id FROM (SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, user_id FROM events) WHERE k IS NOT NULL AND k % 2 = 0")
def flattened_structs(spark: SparkSession, sf: str) -> DataFrame:
    """Nested features flattened, wanted columns kept where they exist, rows with a null left out."""
    e = table(spark, sf, "events").select("event_id", "user_id", F.from_json("props", "k bigint").alias("features"))
    flat = e.select("event_id", "user_id", "features.*")
    want = [c for c in ("event_id", "k", "absent", "user_id") if c in flat.columns]
    return flat.select(*want).na.drop(subset=["k"]).where("k % 2 = 0")


@query(
    """SELECT 'blank_text' AS rule, count_if(trim(coalesce(text, '')) = '')::BIGINT AS violations FROM documents UNION ALL SELECT 'duplicate_doc_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
       UNION ALL SELECT 'sample_coverage', count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) <> max(turn) - min(turn) + 1) UNION ALL SELECT 'unlabelled', count(*) FROM documents ANTI JOIN labels USING (doc_id)
       UNION ALL SELECT 'label_without_document', count(*) FROM labels ANTI JOIN documents USING (doc_id) UNION ALL SELECT 'length_mismatch', count_if(n_chars <> len(text))::BIGINT FROM documents UNION ALL SELECT 'wrong_version', 0::BIGINT
       UNION ALL SELECT 'uneven_arrays', count_if(len(embedding) <> 64)::BIGINT FROM embeddings UNION ALL SELECT 'key_integrity', (SELECT count(*) FROM documents ANTI JOIN labels USING (doc_id)) UNION ALL SELECT 'incomplete_samples', count(*) FROM (SELECT vec_id // 10 AS p FROM embeddings GROUP BY p HAVING count(*) <> 10)"""
)
def contract_report(spark: SparkSession, sf: str) -> DataFrame:
    """Violations per data contract."""
    d, l, s, c = table(spark, sf, "documents"), table(spark, sf, "labels"), samples(spark, sf), table(spark, sf, "conversations")  # noqa: E741
    sides = validate.key_difference(d, l, "doc_id")
    parts = [
        validate.blank_fields(d, ("text",)).select(F.lit("blank_text").alias("rule"), F.col("violations").cast("long").alias("violations")),
        validate.duplicates(d, ["doc_id"]).agg(F.lit("duplicate_doc_id"), F.count("*")),
        validate.window_faults(c, "conv_id", "turn").agg(F.lit("sample_coverage"), F.count("*")),
        sides.where("side = 'only_left'").agg(F.lit("unlabelled"), F.count("*")),
        sides.where("side = 'only_right'").agg(F.lit("label_without_document"), F.count("*")),
        validate.alias_differences(d.withColumn("n", F.length("text").cast("long")), "n", "n_chars").agg(F.lit("length_mismatch"), F.count("*")),
        validate.wrong_version(validate.with_schema_version(d)).agg(F.lit("wrong_version"), F.count("*")),
        validate.uneven_arrays(s, "selected_token_logits", "logsumexp").agg(F.lit("uneven_arrays"), F.count("*")),
        validate.key_integrity(l, d, ["doc_id"]).agg(F.lit("key_integrity"), F.count("*")),
        validate.sample_coverage(s).agg(F.lit("incomplete_samples"), F.count("*")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("SELECT n AS n_samples, count(*) AS n_prompts, n = 2 AS complete FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE role <> 'system' GROUP BY conv_id) GROUP BY n")
def readiness_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return validate.readiness(table(spark, sf, "conversations").where("role <> 'system'"), 2, "conv_id")


@query(
    """SELECT feature_name, source, fault FROM (SELECT CASE item_id % 5 WHEN 4 THEN 'semantic_energy_proxy' ELSE 'f' || item_id END AS feature_name, CASE item_id % 5 WHEN 1 THEN 'Gold answers' WHEN 2 THEN 'candidate_text counts' WHEN 4 THEN 'correctness' ELSE 'corpus counts' END AS source,
        unnest(list_filter([CASE WHEN item_id % 3 <> 0 AND item_id % 7 = 0 THEN 'depends_on_correctness' END, CASE WHEN item_id % 3 <> 0 AND item_id % 4 = 0 THEN 'prohibited_role' END, CASE WHEN item_id % 3 <> 0 AND item_id % 5 = 1 THEN 'leakage_hint' END,
        CASE WHEN item_id % 5 = 2 THEN 'candidate_text' END], lambda x: x IS NOT NULL)) AS fault FROM benchmark)"""
)
def leakage_lint(spark: SparkSession, sf: str) -> DataFrame:
    """Features that correctness, or the candidate's text alone, stands behind."""
    k = F.col("item_id")
    rows = table(spark, sf, "benchmark").select(
        F.when(k % 5 == 4, "semantic_energy_proxy").otherwise(F.concat(F.lit("f"), k)).alias("feature_name"),
        F.when(k % 5 == 1, "Gold answers").when(k % 5 == 2, "candidate_text counts").when(k % 5 == 4, "correctness").otherwise("corpus counts").alias("source"),
        (k % 3 != 0).alias("trainable"), (k % 7 == 0).alias("depends_on_correctness"), F.when(k % 4 == 0, "label_only").otherwise("feature").alias("role"),
    )
    return validate.provenance_faults(rows)


@query(
    f"""SELECT prompt_id FROM (SELECT prompt_id, sum(p) AS total FROM (SELECT prompt_id, response_text, count(*) / any_value(CASE WHEN prompt_id % 4 = 0 THEN 9.0 ELSE 10.0 END) AS p FROM {SAMPLES} GROUP BY prompt_id, response_text) GROUP BY prompt_id) WHERE abs(total - 1) >= 1e-6"""
)
def cluster_partition_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Prompts whose clusters don't split the samples or whose probabilities don't sum to 1: every fourth is made to fail here."""
    s = samples(spark, sf)
    clusters = s.groupBy("prompt_id", "response_text").agg(F.collect_list("sample_index").alias("members"), F.min("sample_index").alias("representative"))
    return validate.partition_faults(clusters.withColumn("probability", F.size("members") / F.when(F.col("prompt_id") % 4 == 0, 9.0).otherwise(10.0)))


@query("SELECT item_id, text FROM benchmark")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as JSON lines and read back with an explicit schema."""
    path = f"{scratch(spark)}/items.jsonl"
    writers.write_jsonl(table(spark, sf, "benchmark"), path)
    return readers.read_jsonl(spark, path, "item_id bigint, text string")


@query(f"SELECT prompt_id::VARCHAR AS prompt_id, sample_index, response_text, len(l)::INT AS n_tokens, round(l[1], 6) AS first_logit FROM {SAMPLES}")
def sample_artifact(spark: SparkSession, sf: str) -> DataFrame:
    """A free-sample document with a checked header, written and read back."""
    s = samples(spark, sf).select(F.col("dataset").cast("string").alias("dataset"), F.col("prompt_id").cast("string").alias("prompt_id"), "sample_index", "response_text", "selected_token_logits", "logsumexp")
    groups = s.agg(F.countDistinct("prompt_id").cast("int").alias("prompt_group_count"))
    parts = writers.listed(s, "samples").crossJoin(F.broadcast(groups))
    doc = parts.select(F.lit("free_samples").alias("artifact_type"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(10).alias("sample_count_per_prompt"), "prompt_group_count", "samples")
    path = f"{scratch(spark)}/samples.json"
    writers.write_document(doc, path)
    return readers.read_free_samples(spark, path).select("prompt_id", "sample_index", "response_text", F.size("selected_token_logits").alias("n_tokens"), F.round(F.get("selected_token_logits", F.lit(0)), 6).alias("first_logit"))


@query(f"SELECT conv_id || ':' || turn AS candidate_id, question, answer AS candidate_text FROM {TURNS}")
def candidate_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates from a JSON document with a candidate_rows list, read by suffix."""
    t = turns(spark, sf)
    rows = t.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("candidate_id"), "question", F.col("answer").alias("candidate_text"))
    path = f"{scratch(spark)}/candidates.json"
    writers.write_document(writers.listed(rows, "candidate_rows"), path)
    return readers.read_candidates(spark, path, CANDIDATES).select("candidate_id", "question", "candidate_text")


@query("SELECT vec_id // 10 AS prompt_id, (vec_id % 10)::INT AS sample_index, len(embedding)::INT AS n FROM embeddings")
def shard_directory(spark: SparkSession, sf: str) -> DataFrame:
    """Rows appended as shards below folders, then read back from all of them."""
    path = f"{scratch(spark)}/shards"
    writers.append_shards(samples(spark, sf).select("prompt_id", "sample_index", F.size("selected_token_logits").alias("n"), (F.col("prompt_id") % 4).alias("shard")), path, "shard")
    return spark.read.schema("prompt_id bigint, sample_index int, n int").option("recursiveFileLookup", True).json(path)


@query(
    f"""SELECT conv_id::VARCHAR AS question_id, 'turn ' || turn AS question_source, trim(question) AS question, trim(answer) AS primary_answer, len(list_distinct([trim(answer), upper(trim(question))]))::INT AS alias_count FROM {TURNS} WHERE trim(question) <> '' AND trim(answer) <> ''"""
)
def dataset_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Question, primary answer, aliases and metadata from a nested answer."""
    t = turns(spark, sf).select(
        F.col("conv_id").alias("question_id"), F.concat(F.lit("turn "), "turn").alias("question_source"), "question",
        F.struct(F.col("answer").alias("value"), F.array(F.upper(F.trim("question")), F.upper(F.trim("question"))).alias("aliases")).alias("answer"),
    )
    return readers.map_trivia(t, bad="drop").select("question_id", "question_source", "question", "primary_answer", "alias_count")


@query("SELECT date_trunc('day', ts) AS day, count(*) AS n_events, round(avg((event_type = 'purchase')::INT), 6) AS purchase_rate FROM events GROUP BY day")
def daily_label_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Windowed rates, the same code for batch and stream."""
    return label_rates(table(spark, sf, "events")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "n_events", F.round("purchase_rate", 6).alias("purchase_rate"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_discount, count(*) AS n_lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count("*").alias("n_lines"))


@query("SELECT n_name, count(DISTINCT o_orderkey) AS n_orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def revenue_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("n_orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
