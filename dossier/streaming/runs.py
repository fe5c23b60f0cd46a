"""Starting streams and keeping what their batches produce."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream; new files are new data."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def table_stream(spark: SparkSession, table: str, schema: StructType) -> DataFrame:
    """A parquet table as a stream, whether its path is one file or a folder of files.

    A glob that names just this path: a stream of a plain path must be a folder, and a filter on
    the names of files would leave out those in the folder.
    """
    folder, name = table.rstrip("/").rsplit("/", 1)
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}")


def run_available(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    *,
    mode: str = "append",
    checkpoint: str | None = None,
) -> None:
    """Process all available data batch by batch, then stop. The same checkpoint continues."""
    (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint or shared_folder(stream.sparkSession, "stream"))
        .trigger(availableNow=True)
        .foreachBatch(handle)
        .start()
        .awaitTermination()
    )


def keep_batch(rows: DataFrame, folder: str, batch_id: int) -> None:
    """Store a batch in its own partition; a repeated batch replaces itself, so retries are safe."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")


def fold_batches(
    stream: DataFrame,
    shrink: Callable[[DataFrame, int], DataFrame],
    keys: list[str],
    merge: dict[str, Callable[[str], Column]],
    folder: str,
    *,
    checkpoint: str | None = None,
    every: int = 8,
) -> DataFrame:
    """State per key over all batches, kept in files and compacted as it grows.

    ``shrink`` makes the rows of a batch (``keys`` and the columns of ``merge``), ``merge`` says by
    which aggregate two rows of a key become one. Every ``every`` batches the last snapshot and the
    batches since become the next snapshot, so reading opens one snapshot and fewer than ``every``
    batches, and each batch is read once more at most. A repeated batch writes the same files again.
    """
    spark = stream.sparkSession

    def read(kind: str, numbers: list[int]) -> DataFrame:
        return spark.read.option("basePath", f"{folder}/{kind}").parquet(*(f"{folder}/{kind}/batch={n}" for n in numbers)).drop("batch")

    def merged(last: int) -> DataFrame:
        """Everything up to batch ``last``: the snapshot before it and the batches after that."""
        kept = last // every * every - 1
        rows = read("recent", list(range(kept + 1, last + 1)))
        if kept >= 0:
            rows = rows.unionByName(read("snapshots", [kept]))
        return rows.groupBy(*keys).agg(*(how(c).alias(c) for c, how in merge.items()))

    def handle(batch: DataFrame, number: int) -> None:
        keep_batch(shrink(batch, number).select(*keys, *merge), f"{folder}/recent", number)
        if (number + 1) % every == 0:
            keep_batch(merged(number), f"{folder}/snapshots", number)

    run_available(stream, handle, checkpoint=checkpoint)
    last = spark.read.parquet(f"{folder}/recent").agg(F.max("batch")).first()[0]
    return merged(last)
