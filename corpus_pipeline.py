"""From raw documents to a training mix: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents; the last adds mix_* columns, with mix_copies saying
how many times a document enters the mix.  A stage leaves every row that it
has no decision against as it is, with its other columns, whatever they are
called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from corvane.llm.decontaminate import decontaminated
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.language_id import identify, train
from corvane.llm.mixing import mixed
from corvane.llm.near_dedup import near_duplicates
from corvane.llm.store import drop, quoted, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that are unlike every language or have no letter.

    So null, empty and blank texts go; rows without a doc_id or language and
    repeated rows are judged like others, each by its own whole text.  An empty
    table, or one without a labelled text, has no language to be like and comes
    out empty.
    """
    own = {c: "text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(quoted(c)).alias(x) for c, x in own.items()])
    found = identify(rows, train(docs, F.lit(True)), carry=list(own.values())).where("not rejected")
    return found.select(*[F.col(x).alias(c) for c, x in own.items()])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id.

    Null and empty texts are one group.  Repeated rows are one document; a row
    without a doc_id stays only where no equal text has one.
    """
    named = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("id")
    kept = exact_dedup(docs, keep="largest").where("kept").select(named, F.unhex("text_sha256").alias("sha")).distinct()
    rows = docs.select(named, F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("sha"), F.struct("*").alias("row"))
    rows = rows.join(kept, ["id", "sha"], "left_semi")
    once = Window.partitionBy("id", "sha").orderBy("id")  # rows that share an id and a text
    return rows.withColumn("turn", F.row_number().over(once)).where("turn = 1").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.

    Texts without words, rows without a doc_id and repeated rows of the
    document that stays are left alone.
    """
    gone = near_duplicates(docs, shingle=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like an item of the benchmark.

    A text without words matches nothing and stays, as does everything where
    the benchmark is empty; rows without a doc_id and repeated rows are judged
    like others.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the source weights take, with the number of copies of each.

    Texts without words cost nothing and enter with the prefix that their key
    falls into; rows that share a doc_id enter together.
    """
    return mixed(docs, carry=docs.columns).where("mix_copies > 0")


STAGES = [("language_id", language_id), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontaminate", benchmark_leaks), ("mixing", source_mix)]

#: The first stage is a trained model: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir))
        drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
