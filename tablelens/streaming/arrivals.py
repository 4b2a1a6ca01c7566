"""Profiles of files as they arrive in a folder (the batch "profile every
input" loop, run as a Structured Streaming query).

Each micro-batch of new files is profiled with the same plan as a batch
table, and its column report is appended, tagged with the batch id, to an
output folder. Counts add up exactly across batches (rows, NULLs, bytes), so
``running_counts`` gives whole-folder totals from the appended reports
without re-reading any data. Distinct counts, moments, quantiles and top values
don't add up; for those each batch also leaves its mergeable state
(``states=True``, operators/state.py), and ``running_profile`` is the profile of
the whole folder from the states. Progress is kept in the query's checkpoint
location, so a restarted query resumes after the last committed batch.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.state import column_states, finish, merge_states
from ..plans.checkpoint import checkpoint_dir
from ..plans.report import profile
from ..sources.readers import UNUSED_NULL_MARKER


def profile_arrivals(
    spark: SparkSession,
    source_dir: str,
    schema,
    output_dir: str,
    fmt: str = "parquet",
    checkpoint_location: str | None = None,
    files_per_batch: int | None = None,
    available_now: bool = True,
    states: bool = False,
    **profile_options,
) -> StreamingQuery:
    """Start the stream; returns the StreamingQuery (call awaitTermination)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":  # as sources.load reads it: '' stays '', a bare empty field is NULL
        reader = reader.option("header", "true").option("nullValue", UNUSED_NULL_MARKER)
    stream = reader.load(source_dir)
    # by default one location for each output folder, by its whole path
    name = hashlib.sha256(output_dir.rstrip("/").encode()).hexdigest()[:32]
    location = checkpoint_location or f"{checkpoint_dir(spark)}/tablelens-stream/{name}"

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        rep = profile(batch, f"batch_{batch_id}", **profile_options).column_report
        # idempotent per batch id: a replayed batch overwrites its own folder
        rep.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            os.path.join(output_dir, f"batch_id={batch_id}"))
        if states:
            column_states(batch).write.mode("overwrite").parquet(os.path.join(_states_dir(output_dir), f"batch_id={batch_id}"))

    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def _states_dir(output_dir: str) -> str:
    return f"{output_dir.rstrip('/')}-states"


def running_profile(spark: SparkSession, output_dir: str, **options) -> DataFrame:
    """The whole folder's profile (state.finish) from the states of its batches."""
    return finish(merge_states(spark.read.parquet(_states_dir(output_dir)).drop("batch_id")), **options)


def read_batches(spark: SparkSession, output_dir: str) -> DataFrame:
    return spark.read.parquet(output_dir)


def running_counts(spark: SparkSession, output_dir: str) -> DataFrame:
    """Whole-folder totals per column from the appended batch reports."""
    reps = read_batches(spark, output_dir)
    return reps.groupBy("ordinal", "column_name").agg(
        F.sum("record_count").alias("record_count"),
        F.sum("number_non_empty_cells").alias("number_non_empty_cells"),
        F.sum("number_empty_cells").alias("number_empty_cells"),
        F.sum("size_bytes").alias("size_bytes"),
        F.count(F.lit(1)).alias("batches"),
    )
