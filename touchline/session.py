"""Session helpers: settings for local runs and reliable lineage cuts."""

import gc
import os
import uuid
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "touchline") -> SparkSession:
    """Session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder in `spark.checkpoint.dir`.

    Reliable checkpoints survive the loss of executors. Where the setting is absent, as in tests, a folder
    in the warehouse stands in, which driver and executors share as well; it goes when the session's JVM ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            folder = f"{warehouse if urlsplit(warehouse).scheme else os.path.abspath(warehouse)}/checkpoints-{uuid.uuid4().hex}"
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Drop the shuffle files of finished jobs whose plans nobody holds; else they stay until the driver's JVM happens to collect."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def local_rows(df: DataFrame) -> DataFrame:
    """A result of a few rows, computed now; what was shuffled for it is freed."""
    spark, schema = df.sparkSession, df.schema
    rows = df.collect()
    del df
    free_shuffles(spark)
    return spark.createDataFrame(rows, schema)
