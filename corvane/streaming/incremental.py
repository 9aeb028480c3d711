"""Incremental work: only what is not there yet, as a batch or from a stream of shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def missing_items(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted work items that no finished one has the keys of."""
    return wanted.join(done.select(*keys), keys, "left_anti")


def collect_shards(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Appends the rows of new shard files to a Parquet table once each, also after a restart; the first row of a key stays.

    The keys seen so far are the query's state, partitioned and kept with the
    checkpoint, so a batch costs what it holds and not what the table holds.
    Keys that something else wrote to the table are not known.
    """
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).json(source)
    return stream.dropDuplicates(keys).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def label_rates(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows and share of purchases per window and type, for a batch or a stream with late rows (an extension of ours)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    return rows.groupBy(F.window("ts", window)).agg(F.count("*").alias("n_events"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("purchase_rate"))
