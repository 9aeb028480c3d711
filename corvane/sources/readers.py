"""Readers with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import CANDIDATES, FREE_SAMPLES


def read_jsonl(spark: SparkSession, path: str, schema: str, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines; blank lines are skipped. FAILFAST raises on a bad row, DROPMALFORMED leaves it out."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def read_candidates(spark: SparkSession, path: str, schema: str = CANDIDATES) -> DataFrame:
    """Candidate rows by suffix: .parquet, .jsonl, or one .json document that is a list or has candidate_rows or rows."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    item = "struct<" + ", ".join(x.strip().replace(" ", ":", 1) for x in schema.split(",")) + ">"
    text = spark.read.option("wholetext", True).text(path)
    listed = F.when(F.trim("value").startswith("["), F.from_json("value", f"array<{item}>"))
    boxed = F.from_json("value", f"candidate_rows array<{item}>, rows array<{item}>")
    rows = text.select(F.coalesce(listed, boxed["candidate_rows"], boxed["rows"]).alias("r"))
    return rows.select(F.explode("r").alias("r")).select("r.*")


def read_free_samples(spark: SparkSession, path: str, expect: int = 10) -> DataFrame:
    """Samples of an artifact document with its header checked: a wrong type, version or count raises when read."""
    doc = spark.read.schema(FREE_SAMPLES).option("multiLine", True).option("mode", "FAILFAST").json(path)
    ok = (F.col("artifact_type") == "free_samples") & (F.col("sample_count_per_prompt") == expect) & F.col("schema_version").isNotNull()
    return doc.withColumn("samples", F.when(F.coalesce(ok, F.lit(False)), F.col("samples")).otherwise(F.raise_error(F.lit("not a free-sample artifact of the expected shape")))).select(F.explode("samples").alias("s")).select("s.*")


def read_optional(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table if it is there, in whatever store Spark reads."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def read_shards(spark: SparkSession, path: str, schema: str, name: str = "shard.json") -> tuple[DataFrame, DataFrame]:
    """(good rows, one row per unreadable shard) of every file of that name below a folder."""
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).text(path)
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = text.select(parsed.alias("r"), F.input_file_name().alias("shard"))
    good = F.col("r").isNotNull() & F.col("r._bad").isNull()
    return rows.where(good).select("r.*", "shard").drop("_bad"), rows.where(~good).select("shard")


def read_half_floats(spark: SparkSession, path: str, columns: dict[str, str], batch_rows: int = 1024) -> DataFrame:
    """Parquet with float16 arrays, which Spark's own reader refuses: files come through Spark, values leave as float32.

    ``columns``: name -> Spark type of the result, arrays of halves as array<float>.
    """
    names = list(columns)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        for batch in batches:
            for content in batch.column(0):
                for part in pq.ParquetFile(pa.BufferReader(content.as_buffer())).iter_batches(batch_size=batch_rows, columns=names):
                    out = []
                    for c in names:
                        col = part.column(part.schema.get_field_index(c))
                        if pa.types.is_list(col.type) and pa.types.is_float16(col.type.value_type):
                            col = pa.ListArray.from_arrays(col.offsets, col.values.cast(pa.float32()))
                        out.append(col)
                    yield pa.RecordBatch.from_arrays(out, names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("content")
    return files.mapInArrow(decode, ", ".join(f"{n} {t}" for n, t in columns.items()))


def seeded_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows in the order of a seeded hash of their key: the same in every run."""
    return df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")).cast("binary"))).orderBy("_h", key).limit(k).drop("_h")


def map_trivia(rows: DataFrame, bad: str = "raise") -> DataFrame:
    """(question, answer struct<value, aliases>) to question, primary_answer, aliases and metadata."""
    return _mapped(rows, F.trim("answer.value"), F.coalesce(F.col("answer.aliases"), F.array().cast("array<string>")), ("question_id", "question_source"), bad)


def map_extractive(rows: DataFrame, answers: str = "answers.text", bad: str = "raise", metadata: tuple[str, ...] = ("id", "title")) -> DataFrame:
    """(question, list of answers): the first is primary."""
    clean = F.filter(F.transform(answers, lambda x: F.trim(x)), lambda x: x != "")
    return _mapped(rows, F.get(clean, F.lit(0)), clean, metadata, bad)


def map_open(rows: DataFrame, bad: str = "raise") -> DataFrame:
    return map_extractive(rows, "answer", bad, ())


def map_arithmetic(rows: DataFrame, bad: str = "raise") -> DataFrame:
    """(Body, Question, Answer): the body goes before the question."""
    q = F.trim(F.concat_ws(" ", F.when(F.trim("Body") != "", F.trim("Body")), F.trim("Question")))
    return _mapped(rows.withColumn("question", q), F.trim(F.col("Answer").cast("string")), F.array().cast("array<string>"), ("ID", "Type", "Equation"), bad)


def map_tagged(rows: DataFrame, bad: str = "raise") -> DataFrame:
    """(question, text with a tagged answer); says how long the text was and whether it had the tags."""
    from ..functions.text import has_tagged_answer, tagged_answer

    more = rows.withColumns({"text_length": F.length("text"), "parsed_with_tag": has_tagged_answer(F.col("text"))})
    return _mapped(more, tagged_answer(F.col("text")), F.array().cast("array<string>"), ("text_length", "parsed_with_tag"), bad)


def _mapped(rows: DataFrame, primary: Column, aliases: Column, metadata: tuple[str, ...], bad: str) -> DataFrame:
    """question, primary_answer, aliases, alias_count, the row's ids and what it has of ``metadata``.

    A row without a question or an answer fails the job; with ``bad`` "drop" it is left out.
    """
    clean = F.array_sort(F.array_distinct(F.filter(F.transform(aliases, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))
    full = F.when(F.array_contains(clean, primary), clean).otherwise(F.concat(F.array(primary), clean))
    keep = [c for c in rows.columns if c.endswith("_id") or c in metadata]
    out = rows.select(*[F.col(c).cast("string").alias(c) if c in metadata else c for c in keep], F.trim("question").alias("question"), primary.alias("primary_answer"), full.alias("aliases"))
    good = F.coalesce((F.col("question") != "") & (F.col("primary_answer") != ""), F.lit(False))
    if bad == "drop":
        out = out.where(good)
    else:
        out = out.withColumn("question", F.when(good, F.col("question")).otherwise(F.raise_error(F.lit("a row has no question or no answer"))))
    return out.withColumn("alias_count", F.size("aliases"))
