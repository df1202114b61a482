"""Score arriving emails and route decisions into an action-partitioned sink.

Every email is scored from its own row (URL features aggregated in-row, models
applied by ``transform``). ``route`` is stateless: an email that is delivered
again is decided again. ``route_once`` decides an id once: repetitions within
the watermark's delay are dropped, with state for that time only, and calls the scorer for every
micro-batch, so what the scorer reads (a model folder, thresholds) may change while the
stream runs. A restarted query resumes from its checkpoint in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


def stream_emails(spark: SparkSession, source_dir: str, schema) -> DataFrame:
    """A file stream over a folder of parquet email batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source_dir)


def route(spark: SparkSession, stream: DataFrame, score: Callable[[DataFrame], DataFrame],
          sink_dir: str, checkpoint_dir: str | None = None, available_now: bool = True):
    """Apply ``score`` (a DataFrame -> DataFrame function with an ``action`` column) and
    write to ``sink_dir`` partitioned by action. Returns the started query."""
    decided = score(stream)
    ckpt = checkpoint_dir or scratch_path(spark, "stream-checkpoint")
    w = (decided.writeStream.format("parquet").outputMode("append")
         .option("path", sink_dir).option("checkpointLocation", ckpt).partitionBy("action"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


#: How long an id is remembered after its first delivery.
REMEMBER = "1 day"


def with_arrival(stream: DataFrame, out: str = "arrived") -> DataFrame:
    """Adds the time an email's file was written: known before a row is read, equal on a replay."""
    return stream.withColumn(out, F.col("_metadata.file_modification_time"))


def route_once(spark: SparkSession, stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink_dir: str,
               key: str = "email_id", arrived: str = "arrived", delay: str = REMEMBER,
               checkpoint_dir: str | None = None, available_now: bool = True):
    """Decide each ``key`` once and write to ``sink_dir/batch=<n>/action=<a>``. Returns the started query.

    A batch that is run again after a failure replaces its own folder, so the sink stays exact.
    """
    once = stream.withWatermark(arrived, delay).dropDuplicatesWithinWatermark([key])

    def decide(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").partitionBy("action").parquet(f"{sink_dir}/batch={number}")
    ckpt = checkpoint_dir or scratch_path(spark, "stream-checkpoint")
    w = once.writeStream.outputMode("append").option("checkpointLocation", ckpt).foreachBatch(decide)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_to_completion(spark: SparkSession, batch: DataFrame, score: Callable[[DataFrame], DataFrame],
                      name: str = "route") -> DataFrame:
    """Land ``batch`` as arriving files, stream it through ``score`` and read the sink back."""
    arrivals = scratch_path(spark, f"{name}-arrivals")
    batch.write.mode("overwrite").parquet(arrivals)
    sink = scratch_path(spark, f"{name}-sink")
    q = route_once(spark, with_arrival(stream_emails(spark, arrivals, batch.schema)), score, sink)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(sink).drop("batch")
