"""Shared folder, table cuts and file access of the training-data operators.

Intermediate tables and archives go to the folder in `spark.checkpoint.dir`, which driver and
executors share. Files are opened with `pyarrow.fs`, so any store that it knows serves; a
writer names its file by task attempt and the driver reads only the files of finished tasks,
so retried and speculative tasks leave no double rows.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlsplit

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below `spark.checkpoint.dir`, deleted when the session's JVM ends.

    Where the setting is absent, as in tests, the warehouse folder stands in; that may be a folder of one machine, so only a local
    session takes it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/touchline-work"
    if not urlsplit(root).scheme:
        root = f"file://{os.path.abspath(root)}"
    folder = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write to the shared folder and read again: later steps neither repeat the work nor depend on an executor."""
    folder = f"{shared_folder(df.sparkSession, name)}/table"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def task_file(folder: str, number: int, ending: str) -> str:
    """A file name that no other attempt of this task uses."""
    ctx = TaskContext.get()
    return f"{folder}/part-{ctx.partitionId():06d}-{number:04d}-{ctx.taskAttemptId()}.{ending}"


def open_out(uri: str):
    files, path = pafs.FileSystem.from_uri(uri)
    return files.open_output_stream(path, compression=None)


def open_in(uri: str):
    """A seekable file."""
    files, path = pafs.FileSystem.from_uri(uri)
    return files.open_input_file(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def per_file(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """One row and one task a file; `rows` is the list the writers returned, one a file."""
    df = spark.createDataFrame(rows, schema)
    return df.repartition(max(1, len(rows))) if rows else df


def slices(batches, rows: int = 512):
    """Arrow batches in parts of so many rows, so that what a step makes of a batch stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def quoted(name: str) -> str:
    """A column name as an expression, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
