"""Incremental ingest of pair files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from seqweave.sources.pairs import parse_pair_lines


def stream_pairs(
    spark: SparkSession, source: str, sink: str, checkpoint: str, label: int, files_per_batch: int = 1000
) -> None:
    """Read every file that has arrived below `source` in batches and append parsed pairs to Parquet.

    The checkpoint remembers consumed files: a restart continues where the last run stopped and each file
    reaches the sink exactly once. The parse is the one of the batch reader.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(source)
    query = (
        parse_pair_lines(lines, label)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
