"""Writers. Spark's committers make each job's output appear at once or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import drop, written

#: Rows of one document at most.
DOCUMENT_ROWS = 10_000


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def listed(df: DataFrame, name: str) -> DataFrame:
    """The rows as lists of DOCUMENT_ROWS at most, one list at least: each becomes a document of its own."""
    rows = df.select(F.struct(*df.columns).alias("_x")).withColumn("_id", F.monotonically_increasing_id())
    part = F.struct(F.shiftright("_id", 33).alias("task"), F.floor(F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) / DOCUMENT_ROWS).alias("part"))
    lists = rows.groupBy(part.alias("_part")).agg(F.collect_list("_x").alias(name)).select(name)
    none = df.sparkSession.range(1).join(rows.select(F.lit(1).alias("_any")).limit(1), F.lit(True), "left").where("_any is null")
    return lists.union(none.select(F.array().cast(lists.schema[name].dataType).alias(name)))


def write_document(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON documents below one path, a file each: a row is a whole document, header and all, so that readers share them out."""
    docs = written(df.select(F.to_json(F.struct(*df.columns)).alias("value")))
    docs.repartition(max(1, docs.count())).write.mode(mode).option("maxRecordsPerFile", 1).text(path)
    drop(docs)


def write_full_logits(df: DataFrame, path: str, vocabulary: int, column: str = "full_logits", mode: str = "errorifexists") -> None:
    """Zstandard Parquet; vectors of another length than the vocabulary fail the job."""
    ok = F.size(column) == vocabulary
    checked = df.withColumn(column, F.when(ok, F.col(column)).otherwise(F.raise_error(F.lit("ragged logits"))))
    checked.write.mode(mode).option("compression", "zstd").parquet(path)


def split_provenance(df: DataFrame, key: str, heavy: list[str]) -> tuple[DataFrame, DataFrame]:
    """(lean table, side table of the heavy nested columns)."""
    return df.drop(*heavy), df.select(key, *heavy)


def append_shards(df: DataFrame, path: str, shard: str) -> None:
    """Adds rows below one folder per shard value; task commits keep half-written shards out."""
    df.write.mode("append").partitionBy(shard).json(path)


def macro_lines(row: DataFrame, digits: int = 3) -> DataFrame:
    """A one-row table of numbers as (name, text) lines of a report."""
    long = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns]).unpivot([], row.columns, "name", "value")
    return long.select("name", F.coalesce(F.format_number("value", digits), F.lit("--")).alias("text"))
