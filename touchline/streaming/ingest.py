"""The incremental build as a file stream: new files in, unseen matches appended."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from touchline.sources.ingest import PARTITIONS, append_unseen


def stream_unseen(
    spark: SparkSession,
    incoming: str,
    schema: StructType,
    path: str,
    checkpoint: str,
    keys: list[str] = ("match_id",),
    partitions: list[str] = PARTITIONS,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Process all files not seen yet, then stop; the checkpoint remembers the files.

    A batch that runs twice appends nothing the second time, since its matches are stored.
    """

    def write(batch: DataFrame, _: int) -> None:
        append_unseen(batch, path, keys, partitions)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(incoming)
    return (
        source.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
