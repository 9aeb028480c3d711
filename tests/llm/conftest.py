import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows over several partitions, with columns whose names clash with the operators' own."""

    def build(rows, parts=3):
        from pyspark.sql import functions as F

        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts, "doc_id")
        return df.withColumns({"id": F.lit("clash"), "n": F.lit(-1), "kept": F.lit("x"), "score": F.lit(0), "component": F.lit(7), "node": F.lit(1), "digest": F.lit("d"), "domain": F.lit("w"), "tokens": F.lit(3), "bucket": F.lit(2)})

    return build


@pytest.fixture(scope="session")
def texts(sf_dir):
    """(doc_id, text, lang) of the smallest table's documents."""
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    return [(r["doc_id"], r["text"], r["lang"]) for r in t]
