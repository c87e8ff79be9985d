"""Incremental runs: only files that no earlier run has seen are read, by a checkpointed file stream that stops when it
has caught up. It does what "skip where the output exists" does in a batch, without listing outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_pending(spark: SparkSession, source: str, schema: str, checkpoint: str, output: str, transform: Callable[[DataFrame], DataFrame], fmt: str = "parquet") -> int:
    """Transforms files that arrived since the last run and appends the rows to ``output``; returns how many were read."""
    stream = spark.readStream.format(fmt).schema(schema).load(source)
    query = transform(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", output).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p["numInputRows"] for p in query.recentProgress)
