"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns of any name, for every operator and stage."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm.decontaminate import contaminated, decontaminated
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.katz import katz_scores
from corvane.llm.language_id import identify, train
from corvane.llm.mixing import mixed
from corvane.llm.near_dedup import near_duplicates
from corvane.llm.secrets import scanned
from corvane.llm.sentence_dedup import removed_sentences
from corvane.llm.suffix_dedup import removed_repeats
from corvane.llm.token_counts import token_counts

LONG = " ".join(f"word{i % 977} of {i}" for i in range(15000))
ROWS = [
    (1, None, "en", "src1"), (2, "", "en", "src1"), (3, " \n\t ", None, None), (4, LONG, "en", "src2"), (5, "the same text here", "en", "src1"), (5, "the same text here", "en", "src1"),
    (6, "the same text here", "fr", "src1"), (None, "the same text here", "en", None), (None, None, None, None), (None, "a text of its own", "en", "src9"), (7, "le chat et la souris", "fr", "src3"), (8, "x", "en", "src1"),
]
ONE_ROW_EACH = {
    "op1": lambda d: katz_scores(d, F.col("doc_id") % 2 == 1),
    "op2": lambda d: mixed(d),
    "op3": lambda d: exact_dedup(d, keep="largest"),
    "op5": lambda d: identify(d, train(d, F.lit(True))),
    "op6": lambda d: near_duplicates(d, shingle=2),
    "op7": lambda d: token_counts(d, [bytes([i]) for i in range(256)]),
    "op8": lambda d: removed_repeats(d),
    "op9": lambda d: scanned(d),
    "op10": lambda d: removed_sentences(d),
}


def odd(df):
    """Columns whose names mean something to Spark, Python or the code."""
    return df.withColumns({n: F.lit("mine") for n in ("_id", "_sha", "_turn", "row", "sha", "a.b", "select", "_tokens", "shard", "_c0", "text_sha256", "keep_id", "size", "turn")})


@pytest.mark.parametrize("name", sorted(ONE_ROW_EACH, key=lambda x: int(x[2:])))
def test_every_row_has_a_result(name, make):
    got = ONE_ROW_EACH[name](odd(make(ROWS))).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ROWS)
    same = [r.asDict() for r in got if r.doc_id == 5]
    assert same[0] == same[1]
    assert ONE_ROW_EACH[name](odd(make([]))).count() == 0


def test_decontamination_of_odd_rows(spark, make):
    bench = spark.createDataFrame([(1, "word5 of 5 word6 of 6 word7 of 7"), (2, None), (2, ""), (None, "a text of its own"), (3, "le chat et la souris"), (3, "le chat et la souris")], "item_id long, text string").withColumn("a.b", F.lit(1))
    docs = odd(make(ROWS))
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(4, 1), (None, None), (7, 3)}
    kept = decontaminated(docs, bench)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in ROWS if r[1] not in (LONG, "a text of its own", "le chat et la souris"))
    assert decontaminated(docs, bench, block_bytes=20).count() == kept.count()
    assert contaminated(docs.limit(0), bench).count() == 0 and decontaminated(docs, bench.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_odd_rows_and_columns(name, spark, make, sf_dir):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd(make(ROWS))
    out = stage(spark, docs, sf_dir)
    assert out.columns[: len(docs.columns)] == docs.columns
    rows = out.collect()
    assert all(r["_id"] == "mine" and r["a.b"] == "mine" and r["_turn"] == "mine" for r in rows)
    ids = Counter(r.doc_id for r in rows)
    want = {
        "language_id": Counter(r[0] for r in ROWS if (r[1] or "").strip()),  # texts without a letter go
        "exact_dedup": Counter([2, 3, 4, 6, 7, 8, None]),  # 2 is the group of empty texts, 6 that of equal ones
        "near_dedup": Counter([1, 2, 3, 4, 5, 5, 7, 8, None, None, None]),  # 6 is a copy of 5
        "decontaminate": Counter(r[0] for r in ROWS),
    }
    if name in want:
        assert ids == want[name]
    else:
        assert {r.mix_copies for r in rows} <= {1, 2} and ids[5] in (0, 2)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_mixing_replaces_columns_of_its_own_names(make):
    out = mixed(make(ROWS).withColumn("mix_copies", F.lit("old")), carry=["doc_id", "text", "mix_copies"])
    assert out.columns == ["doc_id", "text", "mix_domain", "mix_lang", "mix_source", "mix_tokens", "mix_budget", "mix_copies"] and dict(out.dtypes)["mix_copies"] == "bigint"
