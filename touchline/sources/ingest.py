"""Incremental table builds, consolidation, ingestion manifest and audits."""

from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from touchline.session import cut_lineage

PARTITIONS = ["league", "season"]
WRITERS = 8


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns missing from a frame are NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unseen(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key is not stored yet."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def append_unseen(new: DataFrame, path: str, keys: list[str] = ("match_id",), partitions: list[str] = PARTITIONS) -> DataFrame:
    """Append the rows that a partitioned table does not hold yet; returns them.

    Rows of unseen matches are appended whole. Of a match that is stored already, for instance because its
    rows came in two batches, the rows that equal no stored row are appended, so a batch that runs
    twice adds nothing and none is lost. Only stored matches of the partitions at hand are read back: their
    values (one per league and season) become a partition filter. Each partition is written by up to
    `WRITERS` tasks, dealt by match.
    """
    spark = new.sparkSession
    keys, partitions = list(keys), list(partitions)
    fresh = new
    if stored(spark, path):
        at_hand = [tuple(r) for r in new.select(*partitions).distinct().collect()]
        existing = spark.read.schema(new.schema).parquet(path).where(in_partitions(new, partitions, at_hand))
        same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in new.columns])
        seen = existing.join(new.select(*keys).distinct(), keys, "left_semi").select(*new.columns)
        fresh = cut_lineage(new.alias("a").join(seen.alias("b"), same, "left_anti").select(*new.columns))
    writer = F.pmod(F.xxhash64(*keys), F.lit(WRITERS))
    fresh.repartition(*partitions, writer).write.mode("append").partitionBy(*partitions).parquet(path)
    return fresh


def stored(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there and holds files."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(files.exists(place)) and len(files.listStatus(place)) > 0


def in_partitions(df: DataFrame, partitions: list[str], values: list[tuple]):
    """Condition on partition columns: one of the given combinations, NULL included."""
    one = [
        reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v).cast(df.schema[c].dataType)) for c, v in zip(partitions, row)])
        for row in values
    ]
    return reduce(lambda a, b: a | b, one) if one else F.lit(False)


def partition_report(table: DataFrame, key: str = "match_id", partitions: list[str] = PARTITIONS) -> DataFrame:
    """Matches and rows per partition."""
    return table.groupBy(*partitions).agg(F.count_distinct(key).alias("n_matches"), F.count(F.lit(1)).alias("n_rows"))


def consolidate(frames: list[DataFrame], path: str, rows_per_file: int = 5_000_000) -> None:
    """All partitions of a table as one dataset with one schema."""
    (
        union_by_name(frames)
        .write.mode("overwrite")
        .option("maxRecordsPerFile", rows_per_file)
        .parquet(path)
    )


def read_cached(
    spark: SparkSession, paths: list[str], schema: StructType | None = None, ignore_corrupt: bool = False
) -> DataFrame:
    """Many per-match files as one table with a merged schema; corrupt files stop or are skipped."""
    reader = spark.read.option("ignoreCorruptFiles", str(ignore_corrupt).lower())
    reader = reader.schema(schema) if schema is not None else reader.option("mergeSchema", "true")
    return reader.parquet(*paths)


def skipped_files(spark: SparkSession, paths: list[str], schema: StructType) -> list[str]:
    """Files that can't be read to the end, by their full path; a healthy file without rows is none of them."""

    def bad(batches):
        for b in batches:
            kept = []
            for p in b["path"]:
                try:
                    files, at = pafs.FileSystem.from_uri(p if "://" in p else f"file://{p}")
                    with files.open_input_file(at) as f:
                        for _ in pq.ParquetFile(f).iter_batches():
                            pass
                except (OSError, ValueError, pa.ArrowException):
                    kept.append(p)
            yield pd.DataFrame({"path": kept})

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    found = {r[0] for r in listed.mapInPandas(bad, "path string").collect()}
    return [p for p in paths if p in found]


def known_keys(*tables: DataFrame, keys: list[str] = ("league", "season", "match_id")) -> DataFrame:
    """Distinct ingested keys over several tables."""
    return reduce(DataFrame.union, [t.select(*keys) for t in tables]).distinct()


def build_manifest(metadata: DataFrame) -> DataFrame:
    """One row per ingested match."""
    when = F.col("scraped_at") if "scraped_at" in metadata.columns else F.current_timestamp()
    return metadata.groupBy(
        F.col("match_id").cast("int").alias("match_id"), F.col("league"), F.col("season").cast("string").alias("season")
    ).agg(F.max(when).alias("scraped_at"))


def save_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").parquet(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Stored manifest, empty when there is none."""
    if stored(spark, path):
        return spark.read.parquet(path)
    return spark.createDataFrame([], "match_id int, league string, season string, scraped_at timestamp")


def high_water_marks(manifest: DataFrame, leagues: DataFrame) -> DataFrame:
    """Largest ingested match id per league of a fixed list; NULL for leagues without any."""
    top = manifest.groupBy("league").agg(F.max("match_id").alias("max_id"))
    return leagues.select("league").distinct().join(top, "league", "left")


def tables_available(metadata: DataFrame, tables: dict[str, DataFrame], key: str = "match_id") -> DataFrame:
    """Per match, comma-joined names of the tables that hold it; given values stay."""
    tagged = [t.select(key).distinct().withColumn("_table", F.lit(name)) for name, t in tables.items()]
    order = {name: i for i, name in enumerate(tables)}
    rank = F.lit(0)
    for name, i in order.items():
        rank = F.when(F.col("_table") == name, i).otherwise(rank)
    # At most one entry per table kind.
    listed = (
        reduce(DataFrame.unionByName, tagged)
        .groupBy(key)
        .agg(F.sort_array(F.collect_set(F.struct(rank.alias("i"), F.col("_table").alias("t")))).alias("_t"))
        .select(key, F.concat_ws(",", F.lit("metadata"), F.col("_t.t")).alias("_available"))
    )
    joined = metadata.join(listed, key, "left")
    given = F.col("tables_available") if "tables_available" in metadata.columns else F.lit(None).cast("string")
    return joined.withColumn("tables_available", F.coalesce(given, "_available", F.lit("metadata"))).drop("_available")


def export_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """CSV with doubles rounded."""
    rounded = [F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*rounded).write.mode("overwrite").option("header", "true").csv(path)
