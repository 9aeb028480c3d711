"""The registered queries of the operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), keep="largest")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed

    return mixed(_table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _remainder(mod: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, _remainder(5) != 0)
    found = identify(docs, model)
    return found.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, percent=80)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import removed_repeats

    return removed_repeats(_table(spark, sf_dir, "documents")).drop("edges")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scanned

    return scanned(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import VOCABULARY, load_vocabulary, token_counts

    return token_counts(_table(spark, sf_dir, "documents"), load_vocabulary(spark.conf.get("corvane.vocabulary", VOCABULARY)))


def op10_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentence_dedup import removed_sentences

    return removed_sentences(_table(spark, sf_dir, "documents")).drop("edges")


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    return katz_scores(_table(spark, sf_dir, "documents"), _remainder(5) != 1)


QUERIES = {"op1_katz": op1_katz, "op7_token_counts": op7_token_counts, "op10_sentence_dedup": op10_sentence_dedup, "op9_secrets": op9_secrets, "op8_suffix_dedup": op8_suffix_dedup, "op2_mixing": op2_mixing, "op4_decontaminate": op4_decontaminate, "op5_language_id": op5_language_id, "op6_near_dedup": op6_near_dedup, "op3_exact_dedup": op3_exact_dedup}

SQL = {
    "op4_decontaminate": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x01-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents), i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x01-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        dg AS (SELECT doc_id, len(w) AS size, unnest(range(greatest(len(w) - 4, 0))) AS p, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda k: array_to_string(w[k:k+4], ' '))) AS g FROM d),
        ig AS (SELECT item_id, n, g, count(*) AS c FROM (SELECT item_id, len(w) AS n, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda k: array_to_string(w[k:k+4], ' '))) AS g FROM i) GROUP BY ALL),
        c AS (SELECT DISTINCT dg.doc_id, dg.size, ig.item_id, ig.n, least(ig.n, dg.size) - 4 AS width FROM dg JOIN ig USING (g)),
        x AS (SELECT c.doc_id, c.item_id, c.n, c.width, s.p, q.g, count(*) AS k FROM c JOIN dg s ON s.doc_id = c.doc_id AND s.p + c.width + 4 <= c.size JOIN dg q ON q.doc_id = c.doc_id AND q.p BETWEEN s.p AND s.p + c.width - 1 GROUP BY ALL),
        y AS (SELECT x.doc_id, x.item_id, x.p, sum(least(x.k, ig.c)) AS shared, any_value(x.width + x.n - 4) AS total FROM x JOIN ig ON ig.item_id = x.item_id AND ig.g = x.g GROUP BY ALL),
        z AS (SELECT *, shared::DOUBLE / (total - shared)::DOUBLE AS similarity FROM y WHERE 100 * shared >= 80 * (total - shared))
        SELECT doc_id, item_id, arg_max(p, (similarity, -p))::BIGINT AS first_word, max(similarity) AS similarity, count(*) AS n_windows FROM z GROUP BY doc_id, item_id
    """,
    "op6_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), t AS (SELECT s.doc_id, s.g, n.n FROM s JOIN n USING (doc_id)),
        e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
        l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
    """,
    "op10_sentence_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*') AS lead FROM documents),
        p AS (SELECT doc_id, lead, list_filter(string_split(regexp_replace(substr(text, len(lead) + 1), '([.!?][\x20\x09-\x0D]+|[\x20\x09\x0B-\x0D]*\n[\x20\x09-\x0D]*|[。！？][\x20\x09-\x0D]*)', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS p FROM d),
        q AS (SELECT doc_id, flatten(list_transform(p, lambda x: CASE WHEN len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) > 30
            THEN list_filter(string_split(regexp_replace(x, '([^\x20\x09-\x0D]{10,}[\x20\x09-\x0D]+)', '\1' || chr(1), 'g'), chr(1)), lambda y: y <> '') ELSE [x] END)) AS p FROM p),
        t AS (SELECT doc_id, p, list_transform(p, lambda x: trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'))) AS w FROM q),
        s AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS piece FROM t),
        r AS (SELECT doc_id, i, k, array_to_string(w[i:i+k-1], chr(1)) AS run FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM t, range(2, 17) g(k))),
        f AS (SELECT doc_id, i, k FROM r WHERE len(regexp_extract_all(run, '[^\x01 ]+')) >= 16 QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1),
        c AS (SELECT s.*, g.i IS NOT NULL AS gone FROM s LEFT JOIN (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS i FROM f) g USING (doc_id, i)),
        e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS opens FROM c),
        a AS (SELECT doc_id, sum(CASE WHEN gone THEN strlen(piece) ELSE 0 END)::BIGINT AS n_removed, count_if(opens)::BIGINT AS n_spans, coalesce(string_agg(CASE WHEN NOT gone THEN piece END, '' ORDER BY i), '') AS kept FROM e GROUP BY doc_id)
        SELECT doc_id, strlen(d.text)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(lead || coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
    """,
    "op8_suffix_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        c AS (SELECT doc_id, n, b, substr(h, 2000 * b + 1, 2198) AS part FROM (SELECT doc_id, n, h, unnest(range(0, (n + 999) // 1000)) AS b FROM d)),
        w AS (SELECT doc_id, 1000 * b + j AS p, md5(substr(part, 2 * j + 1, 200)) AS k FROM (SELECT *, unnest(range(0, greatest(least(1000, n - 99 - 1000 * b), 0))) AS j FROM c)),
        f AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
        g AS (SELECT *, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM f)),
        s AS (SELECT doc_id, island, min(p) AS a, max(p) + 100 AS z FROM g GROUP BY doc_id, island),
        k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM s),
        r AS (SELECT d.doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM k JOIN d USING (doc_id) GROUP BY d.doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
    """,
    "op7_token_counts": r"""
        WITH v AS (SELECT DISTINCT hex(from_base64(t)) AS x FROM read_csv('/opt/tokenizers/byte_bpe_50k.tiktoken', delim = ' ', header = FALSE, quote = '', escape = '', columns = {'t': 'VARCHAR', 'r': 'BIGINT'}) WHERE t <> ''),
        m AS (SELECT max(len(x)) // 2 AS longest FROM v),
        w AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS word FROM documents),
        u AS (SELECT word, hex(encode(' ' || word)) AS x FROM (SELECT DISTINCT word FROM w)),
        p AS (SELECT word, x, unnest(range(len(x) // 2)) AS p FROM u),
        k AS (SELECT word, p, substr(x, 2 * p + 1, 2 * k) AS piece, k FROM (SELECT word, x, p, unnest(range(1, least(longest, len(x) // 2 - p) + 1)) AS k FROM p, m)),
        b AS (SELECT word, p, max(k) AS k FROM k JOIN v ON v.x = k.piece GROUP BY word, p),
        l AS (SELECT word, [{'p': 0::BIGINT, 'k': 0::BIGINT}] || list({'p': p::BIGINT, 'k': k::BIGINT} ORDER BY p) AS s FROM b GROUP BY word),
        r AS (SELECT u.word, list_reduce(s, lambda a, y: CASE WHEN y.p = a.p THEN {'p': a.p + y.k, 'k': a.k + 1} ELSE a END) AS e, len(x) // 2 AS n FROM u LEFT JOIN l USING (word)),
        c AS (SELECT word, CASE WHEN e.p = n THEN e.k ELSE 1 END AS tokens, (e.p IS DISTINCT FROM n)::INT AS unknown FROM r)
        SELECT doc_id, count(c.word) AS n_words, coalesce(sum(tokens), 0)::BIGINT AS n_tokens, coalesce(sum(unknown), 0)::BIGINT AS n_unknown FROM documents LEFT JOIN w USING (doc_id) LEFT JOIN c USING (word) GROUP BY doc_id
    """,
    "op2_mixing": r"""
        WITH d AS (SELECT doc_id, 'dom' || (coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS BIGINT), 0) % 4)::VARCHAR AS domain,
                 coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
                 len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
        leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, sum(tokens) * 2.0::DOUBLE AS supply FROM d GROUP BY ALL),
        top0 AS (SELECT domain, sum(supply) AS supply, (SELECT sum(tokens) FROM leaf) * 0.6::DOUBLE AS budget FROM leaf GROUP BY domain),
        top_w AS (SELECT *, CASE domain WHEN 'dom0' THEN 4.0::DOUBLE WHEN 'dom1' THEN 3.0 WHEN 'dom2' THEN 2.0 WHEN 'dom3' THEN 1.0 ELSE 1.0 END AS w, supply / CASE domain WHEN 'dom0' THEN 4.0::DOUBLE WHEN 'dom1' THEN 3.0 WHEN 'dom2' THEN 2.0 WHEN 'dom3' THEN 1.0 ELSE 1.0 END AS lv FROM top0),
        top_s AS (SELECT *, sum(w) OVER () - sum(w) OVER ( ORDER BY lv RANGE UNBOUNDED PRECEDING) AS wide,
                 sum(supply) OVER ( ORDER BY lv RANGE UNBOUNDED PRECEDING) AS below FROM top_w),
        top_f AS (SELECT *, below + CASE WHEN wide > 1e-12 THEN lv * wide ELSE 0 END <= budget + 1e-9 AS is_full FROM top_s),
        top AS (SELECT *, CASE WHEN is_full THEN supply ELSE least(supply,
                 (budget - sum(CASE WHEN is_full THEN supply ELSE 0 END) OVER ()) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ()) END AS share FROM top_f),
        mid0 AS (SELECT a.domain, a.lang, a.supply, t.share AS budget FROM (SELECT domain, lang, sum(supply) AS supply FROM leaf GROUP BY ALL) a JOIN top t USING (domain)),
        mid_w AS (SELECT *, CASE lang WHEN 'en' THEN 5.0::DOUBLE WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 1.0 ELSE 1.0 END AS w, supply / CASE lang WHEN 'en' THEN 5.0::DOUBLE WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 1.0 ELSE 1.0 END AS lv FROM mid0),
        mid_s AS (SELECT *, sum(w) OVER (PARTITION BY domain) - sum(w) OVER (PARTITION BY domain ORDER BY lv RANGE UNBOUNDED PRECEDING) AS wide,
                 sum(supply) OVER (PARTITION BY domain ORDER BY lv RANGE UNBOUNDED PRECEDING) AS below FROM mid_w),
        mid_f AS (SELECT *, below + CASE WHEN wide > 1e-12 THEN lv * wide ELSE 0 END <= budget + 1e-9 AS is_full FROM mid_s),
        mid AS (SELECT *, CASE WHEN is_full THEN supply ELSE least(supply,
                 (budget - sum(CASE WHEN is_full THEN supply ELSE 0 END) OVER (PARTITION BY domain)) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain)) END AS share FROM mid_f),
        low0 AS (SELECT l.*, m.share AS budget FROM leaf l JOIN mid m USING (domain, lang)),
        low_w AS (SELECT *, 1.0::DOUBLE AS w, supply / 1.0::DOUBLE AS lv FROM low0),
        low_s AS (SELECT *, sum(w) OVER (PARTITION BY domain, lang) - sum(w) OVER (PARTITION BY domain, lang ORDER BY lv RANGE UNBOUNDED PRECEDING) AS wide,
                 sum(supply) OVER (PARTITION BY domain, lang ORDER BY lv RANGE UNBOUNDED PRECEDING) AS below FROM low_w),
        low_f AS (SELECT *, below + CASE WHEN wide > 1e-12 THEN lv * wide ELSE 0 END <= budget + 1e-9 AS is_full FROM low_s),
        low AS (SELECT *, CASE WHEN is_full THEN supply ELSE least(supply,
                 (budget - sum(CASE WHEN is_full THEN supply ELSE 0 END) OVER (PARTITION BY domain, lang)) * w / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY domain, lang)) END AS share FROM low_f),
        b AS (SELECT domain, lang, source, tokens AS supply_tokens, floor(share + 1e-6)::BIGINT AS budget FROM low),
        e AS (SELECT *, CASE WHEN supply_tokens > 0 THEN budget // supply_tokens ELSE 0 END AS n_full FROM b),
        o AS (SELECT d.*, e.budget, e.n_full, e.budget - e.n_full * e.supply_tokens AS rest,
                 md5('7:' || e.n_full::VARCHAR || ':' || d.doc_id::VARCHAR) AS k FROM d JOIN e USING (domain, lang, source))
        SELECT doc_id, domain AS mix_domain, lang AS mix_lang, source AS mix_source, tokens AS mix_tokens, budget AS mix_budget,
               n_full + CASE WHEN sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS mix_copies
        FROM o
    """,
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
}
