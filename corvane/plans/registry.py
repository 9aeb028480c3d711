"""Named queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


EVENTS = """(SELECT event_id, user_id AS prompt_id, value AS s_value, (event_id * 37 % 101)::DOUBLE AS s_mod, -abs(value - 50) AS s_fold,
    (user_id % 4)::INT AS dataset, (event_type = 'purchase')::INT AS is_correct FROM events)"""
LABELLED = """(SELECT d.doc_id, l.quality AS is_correct, l.toxic, d.lang, d.source, d.n_chars, d.text FROM labels l JOIN documents d USING (doc_id))"""
SAMPLES = """(SELECT vec_id // 10 AS prompt_id, (vec_id % 10)::INT AS sample_index, 'label_' || label AS response_text, (vec_id // 10 % 5)::INT AS dataset,
    list_transform(embedding, lambda x: x::DOUBLE) AS l, list_transform(embedding, lambda x: ln(1 + exp(x::DOUBLE))) AS z FROM embeddings)"""
TURNS = """(SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a
    ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant')"""
TERMS = """(SELECT DISTINCT unnest([w[1], concat_ws(' ', w[2], w[3]), w[4]]) AS term FROM
    (SELECT regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]+', '', 'g'), ' +') AS w FROM benchmark))"""


def norm(x: str) -> str:
    """normalize_term in SQL."""
    return rf"trim(regexp_replace(trim(regexp_replace(lower({x}), '\s+', ' ', 'g')), '[^a-z0-9''\- ]+', '', 'g'))"


def response(x: str) -> str:
    """normalize_response in SQL."""
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


def _by(by: list[str]) -> tuple[str, str, str]:
    return "".join(f"{b}, " for b in by), f"PARTITION BY {', '.join(by)}" if by else "", f"GROUP BY {', '.join(by)}" if by else ""


def sql_auroc(src: str, score: str, label: str, by: list[str] | None = None, weight: str = "1", name: str = "auroc") -> str:
    cols, part, group = _by(by or [])
    return f"""(SELECT {cols}sum(p)::BIGINT AS n_pos, sum(n)::BIGINT AS n_neg, sum(p * (cn - n) + p * n * 0.5)::DOUBLE / nullif(sum(p)::DOUBLE * sum(n)::DOUBLE, 0) AS {name}
        FROM (SELECT *, sum(n) OVER ({part} ORDER BY s ROWS UNBOUNDED PRECEDING) AS cn FROM
        (SELECT {cols}{score} AS s, sum(CASE WHEN {label} = 1 THEN {weight} ELSE 0 END) AS p, sum(CASE WHEN {label} = 0 THEN {weight} ELSE 0 END) AS n
         FROM {src} AS src WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY ALL)) {group})"""


def sql_auprc(src: str, score: str, label: str, by: list[str] | None = None) -> str:
    cols, part, group = _by(by or [])
    return f"""(SELECT {cols}sum(p * tp / a) / nullif(sum(p), 0) AS auprc FROM (SELECT *, sum(p) OVER w AS tp, sum(p + n) OVER w AS a FROM
        (SELECT {cols}{score} AS s, sum(CASE WHEN {label} = 1 THEN 1.0::DOUBLE ELSE 0 END) AS p, sum(CASE WHEN {label} = 0 THEN 1.0::DOUBLE ELSE 0 END) AS n
         FROM {src} AS src WHERE {score} IS NOT NULL GROUP BY ALL) WINDOW w AS ({part} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)) {group})"""


def sql_aurac(src: str, score: str, label: str, tie: str, by: list[str] | None = None) -> str:
    cols, part, group = _by(by or [])
    return f"""(SELECT {cols}avg(h::DOUBLE / k) AS aurac FROM (SELECT *, sum({label}) OVER w AS h, row_number() OVER w AS k FROM {src} AS src WHERE {score} IS NOT NULL
        WINDOW w AS ({part} ORDER BY {score} DESC, {tie} ROWS UNBOUNDED PRECEDING)) {group})"""


def sql_rank_bins(src: str, score: str, tie: str, bins: int, name: str) -> str:
    return f"""(SELECT *, CASE WHEN {score} IS NULL THEN NULL ELSE least((row_number() OVER (PARTITION BY {score} IS NULL ORDER BY {score}, {tie}) - 1) * {bins}
        // count(*) OVER (PARTITION BY {score} IS NULL), {bins - 1}) END::INT AS {name} FROM {src} AS src)"""
