"""Corpus counting: terms, document and window co-occurrence.

The engine owns the index.  One pass over the corpus looks the grams of the
asked lengths up by their hashes; terms of any length are found by their first
words and confirmed on the rest.  Occurrences are summed on the spot, or written
as one row a document where pairs are asked; pairs in documents and in windows
are counted in blocks of these rows.  A term that is asked but never found
counts 0; an empty term counts null and says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.packed import Terms, string_hashes, token_slices
from ..functions.text import normalize_term
from ..shared import written
from .cooccurrence import close_places, counted, shared_documents
from .ranking import global_rank

#: Up to so many hashes their table goes to every task (some 60 MB).
BROADCAST_HASHES = 2_000_000
#: Input that is about a task's worth.
SPLIT_BYTES = 128 << 20
BACKEND = "corvane_corpus"
RESOLVED, EMPTY = "resolved", "excluded_empty_normalized_query"
#: A status that begins so rules out its count.
FAILED = "^(api_|timeout|rate_limited|error|excluded_|cache_miss|local_index_absent)"


def spread(docs: DataFrame) -> DataFrame:
    """A small input of fewer files than cores is dealt out to all of them; anything larger stays where it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    small = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= cores * SPLIT_BYTES
    return docs.repartition(cores) if small and 0 < len(docs.inputFiles()) < cores else docs


def corpus_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text): lower-cased texts, whose words are taken as they are read."""
    return spread(docs.select(doc_id, text)).select(F.col(doc_id).alias("doc"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))


@dataclass
class Places:
    """Where asked terms occur: (term, t) names them by numbers from 0, (doc, t, position) holds a document's occurrences as packed numbers."""

    asked: DataFrame
    found: DataFrame


def _numbered(terms: DataFrame, column: str = "term") -> tuple[DataFrame, Terms]:
    """(term, t) of the distinct normalised terms, and the same for lookups."""
    asked = terms.select(normalize_term(F.col(column)).alias("term")).where("term <> ''").distinct()
    asked = written(global_rank(asked, [F.col("term")], "t").select("term", (F.col("t") - 1).cast("int").alias("t")))
    names = asked.orderBy("t").select("term").toArrow().column(0).combine_chunks()
    return asked, Terms(names)


def _scan(corpus: DataFrame, lookup: Terms) -> DataFrame:
    """(doc, t, position) of every document that holds any of the terms: numbers packed as 4 and 8 bytes, in the order of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, tokens in token_slices(batch, 1):
                at, term = lookup.find(*string_hashes(tokens), first)
                order = np.argsort(at, kind="stable")
                at, term = at[order], term[order]
                row = np.searchsorted(first, at, "right") - 1
                ends = np.searchsorted(row, np.arange(part.num_rows + 1))
                some = np.flatnonzero(np.diff(ends))
                where = (at - first[row]).astype("<i8")
                cut = lambda x: pa.array([x[ends[i] : ends[i + 1]].tobytes() for i in some.tolist()], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), cut(term.astype("<i4")), cut(where)], names=["doc", "t", "position"])

    kind = corpus.schema["doc"].dataType.simpleString()
    return corpus.select("doc", "text").mapInArrow(run, f"doc {kind}, t binary, position binary")


def postings(corpus: DataFrame, terms: DataFrame, column: str = "term") -> Places:
    """Every occurrence of the distinct normalised terms, written to the shared folder."""
    asked, lookup = _numbered(terms, column)
    return Places(asked, written(_scan(corpus, lookup)))


def _totals(rows: DataFrame, n: int, batch_terms: Callable) -> DataFrame:
    """(t, n): how often each number occurs; a task gives each number once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for found in batch_terms(batch):
                total += np.bincount(found, minlength=n)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["t", "n"])

    return rows.mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n"))


def frequent(rows: DataFrame, value: str, over: int) -> DataFrame:
    """(value, n) of the values that occur more than ``over`` times: only 32-bit hashes of all are shuffled, then the values whose hashes occur so often."""
    hashes = written(rows.groupBy(F.hash(value).alias("_h")).agg(F.count("*").alias("_n")).where(F.col("_n") > over).select("_h"))
    often = F.broadcast(hashes) if hashes.count() <= BROADCAST_HASHES else hashes
    kept = rows.withColumn("_h", F.hash(value)).join(often, "_h", "left_semi")
    return kept.groupBy(value).agg(F.count("*").alias("n")).where(F.col("n") > over)


def _provenance(query: Column, kind: str, status: Column, index_ref: str) -> list[Column]:
    """Where a count comes from: these are columns of every count."""
    return [
        F.lit(BACKEND).alias("backend_id"), query.alias("query"), F.lit(kind).alias("query_kind"), status.alias("status"), F.lit(index_ref).alias("index_ref"), F.lit(False).alias("approximate"),
        status.rlike(FAILED).alias("excluded"),
    ]


def count_entities(corpus: DataFrame, terms: DataFrame, column: str = "term", places: Places | None = None, index_ref: str = "corpus") -> DataFrame:
    """(term, raw_count and provenance) for each distinct normalised term: its occurrences. ``places``: postings that hold the terms already."""
    if places is None:
        names, lookup = _numbered(terms, column)
        counts = _totals(corpus.select("text"), lookup.n, lambda batch: (lookup.find(*string_hashes(tokens), first)[1] for _, first, tokens in token_slices(batch, 0)))
    else:
        names, n = places.asked, places.asked.count()
        counts = _totals(places.found.select("t"), n, lambda batch: (np.frombuffer(x.as_buffer(), "<i4") for x in batch.column(0)))
    counts = counts.join(names, "t").select("term", "n")
    asked = terms.select(normalize_term(F.col(column)).alias("term")).distinct().join(counts, "term", "left")
    full = F.col("term") != ""
    n = F.when(full, F.coalesce("n", F.lit(0))).cast("long")
    return asked.select("term", n.alias("raw_count"), *_provenance(F.col("term"), "entity_frequency", F.when(full, RESOLVED).otherwise(EMPTY), index_ref))


def distinct_pairs(pairs: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """Normalised, sorted, distinct pairs of different terms."""
    a, b = normalize_term(F.col(left)), normalize_term(F.col(right))
    return pairs.select(F.least(a, b).alias("left"), F.greatest(a, b).alias("right")).where("left <> '' and right <> '' and left <> right").distinct()


def count_pairs(corpus: DataFrame, pairs: DataFrame, unit: str = "document", window: int = 100, places: Places | None = None, index_ref: str = "corpus") -> DataFrame:
    """(left, right, raw_count and provenance) for distinct pairs: documents with both terms, or position pairs at most ``window`` words apart."""
    asked = written(distinct_pairs(pairs))
    both = asked.select("left").union(asked.select("right")).withColumnRenamed("left", "term")
    places = postings(corpus, both) if places is None else places
    named = lambda c, t: places.asked.select(F.col("term").alias(c), F.col("t").alias(t))
    numbered = asked.join(named("left", "l"), "left").join(named("right", "r"), "right")
    if unit == "document":
        found, count = places.found.select("doc", "t"), shared_documents
    else:
        found, count = places.found, close_places(window)
    counts = counted(found, found.count(), numbered.select("l", "r"), asked.count(), count)
    counts = numbered.join(counts, ["l", "r"]).select("left", "right", "n")
    out = asked.join(counts, ["left", "right"], "left")
    query = F.concat_ws(" && ", "left", "right")
    return out.select("left", "right", F.coalesce("n", F.lit(0)).cast("long").alias("raw_count"), *_provenance(query, "entity_pair_cooccurrence", F.lit(RESOLVED), index_ref))


def choose_backend(stored: bool, corpus: bool, allowed: tuple[str, ...] = ("stored", "corpus")) -> str:
    """Which backend answers, in order: stored counts, the corpus itself, none; a backend that isn't allowed is never taken in place of another."""
    for name, there in (("stored", stored), ("corpus", corpus)):
        if there and name in allowed:
            return name
    return "missing"


def missing_counts(wanted: DataFrame, kind: str) -> DataFrame:
    """What the missing backend says of each ``query``: no count, and that nothing stood in for it."""
    return wanted.select("query", F.lit(None).cast("long").alias("raw_count"), F.lit("missing").alias("backend_id"), F.lit(kind).alias("query_kind"), F.lit("local_index_absent").alias("status"), F.lit(None).cast("string").alias("index_ref"), F.lit(False).alias("approximate"), F.lit(True).alias("excluded"))


def lookup_counts(wanted: DataFrame, fixture: DataFrame, kind: str, allow_approximate: bool = False) -> DataFrame:
    """Counts for ``query`` from a stored table, fail-closed: what is missing, approximate or failed stays null with its status."""
    stored = fixture.where(F.col("kind") == kind).select("query", F.col("raw_count").alias("_n"), F.col("status").alias("_s"), F.col("approximate").alias("_a"))
    out = wanted.join(stored, "query", "left")
    bad = F.col("_s").rlike(FAILED) | (F.coalesce("_a", F.lit(False)) & F.lit(not allow_approximate))
    excluded = F.col("_n").isNull() | F.coalesce(bad, F.lit(False))
    return out.select(*wanted.columns, F.when(~excluded, F.col("_n")).alias("raw_count"), F.coalesce("_s", F.lit("cache_miss")).alias("status"), excluded.alias("excluded"))


def asked_terms(rows: DataFrame, entities: str) -> tuple[DataFrame, DataFrame]:
    """Distinct entities and sorted pairs over all rows, for counting in one job."""
    terms = rows.select(F.explode(entities).alias("term")).distinct()
    return terms, entity_pairs(rows, entities).select("left", "right").distinct()


def entity_pairs(rows: DataFrame, entities: str, keep: list[str] | None = None) -> DataFrame:
    """All unordered pairs of a row's distinct entities, smaller first; entity lists are short by construction."""
    keep = keep or []
    sorted_ = F.array_sort(F.array_distinct(entities))
    one = rows.select(*keep, sorted_.alias("_all")).select(*keep, "_all", F.explode("_all").alias("left"))
    return one.select(*keep, "left", F.explode(F.filter("_all", lambda x: x > F.col("left"))).alias("right"))


def bridge_pairs(rows: DataFrame, question: str, answer: str, keep: list[str]) -> DataFrame:
    """Question entity by answer entity, without answers that are also question entities."""
    only = F.array_except(F.transform(answer, lambda x: F.lower(F.trim(x))), F.transform(question, lambda x: F.lower(F.trim(x))))
    one = rows.select(*keep, F.explode(F.array_distinct(F.transform(question, lambda x: F.lower(F.trim(x))))).alias("left"), only.alias("_a"))
    return one.select(*keep, "left", F.explode("_a").alias("right")).distinct()
