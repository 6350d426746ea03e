"""Checkpointed model stages as file streams: new chunks are processed once, results are appended, restarts resume."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def run_new(spark: SparkSession, source: str, schema: str, stage: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "chunk_id") -> int:
    """Runs ``stage`` over rows of Parquet files not seen before and appends its rows; returns the number of batches.

    The checkpoint remembers files; an anti join against the target drops keys that an interrupted batch has written.
    """
    batches = 0

    def step(batch: DataFrame, epoch: int) -> None:
        nonlocal batches
        session = batch.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(session._jsc.hadoopConfiguration()).exists(path):
            batch = batch.join(session.read.parquet(target).select(key).distinct(), key, "left_anti")
        stage(batch).write.mode("append").parquet(target)
        batches += 1

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return batches
