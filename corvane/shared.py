"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only where none is set and all runs on this machine (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = _own.get("dir") or _own.setdefault("dir", tempfile.mkdtemp(prefix="corvane-shared-"))
    return place


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared folder that goes when the application ends."""
    path = f"{shared_dir(spark)}/corvane-{uuid.uuid4().hex}"
    where, files = _file(spark, path)
    files.deleteOnExit(where)
    return path


def written(df: DataFrame) -> DataFrame:
    """A Parquet table in the shared folder, read back: lineage ends there; it goes with ``drop`` or when the application ends."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for table in tables:
        if path := _paths.pop(table, None):
            where, files = _file(table.sparkSession, path)
            files.delete(where, True)


def quoted(name: str) -> str:
    """A column name, dots and all, for select and col."""
    return "`" + name.replace("`", "``") + "`"
