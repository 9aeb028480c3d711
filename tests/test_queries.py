"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from corvane.plans import q_corpus, q_metrics, q_relational, q_semantic, q_text  # noqa: F401
from corvane.plans.registry import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if value is None or value != value:
        return "NULL"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def rows_of(frame):
    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    ours, theirs = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(SQL[name]).to_arrow_table().to_pandas()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_fusion_scores_are_out_of_fold(spark, sf_dir):
    rows = QUERIES["fusion_logistic"](spark, sf_dir).toPandas()
    assert rows.score.between(0, 1).all()
    assert (rows.groupby("prompt_id").fold.nunique() == 1).all()
    assert not rows.duplicated(["prompt_id", "sample_index"]).any()


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
