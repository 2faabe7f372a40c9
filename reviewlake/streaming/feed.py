"""Change feeds that arrive over time.

The batch operators have no notion of time, so a stream is a sequence of batches of whole reviews: each micro-batch
runs the same operators, and its results are written under its own number, so a batch that is run again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import filtering


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Changed files as Parquet files appear under a path."""
    schema = "review_id long, file_ord long, path string, old_path string, status string, language string"
    return spark.readStream.schema(schema).parquet(path)


def filtered(files: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    """File filtering is row by row, so it holds for streams as it is."""
    return filtering.with_filter_reason(files, exclude)


def run_batches(files: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Starts a query that applies a batch operator to every micro-batch and writes its rows under batch_id=..."""

    def one(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
