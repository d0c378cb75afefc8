"""Transition counts kept up to date from arriving sequence files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqweave.operators.ngrams import transition_counts

SEQUENCES = "id string, seq string"


def batch_writer(state: str, n: int) -> Callable[[DataFrame, int], None]:
    """Counts one batch into the folder of its number; a batch that is run again replaces what it wrote before."""

    def keep(batch: DataFrame, number: int) -> None:
        transition_counts(batch, n).write.mode("overwrite").parquet(f"{state.rstrip('/')}/batch={number}")

    return keep


def stream_transition_counts(spark: SparkSession, source: str, state: str, checkpoint: str, n: int, files_per_batch: int = 1000) -> None:
    """Count the transitions of every sequence file (Parquet `id, seq`) that has arrived below `source`.

    The checkpoint remembers consumed files and numbers batches, and a batch's counts stand in a folder of its
    number, so a restart or a batch repeated after a failure changes no total. What is written per batch is one row
    per distinct transition in it.
    """
    arriving = spark.readStream.schema(SEQUENCES).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = arriving.writeStream.foreachBatch(batch_writer(state, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_transition_counts(spark: SparkSession, state: str) -> DataFrame:
    """`(src, dst, w)` over all batches so far."""
    kept = spark.read.schema("src string, dst string, w long, batch long").parquet(state)
    return kept.groupBy("src", "dst").agg(F.sum("w").alias("w"))
