"""Files that arrive in a folder, submitted and processed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliomill.plans.pipeline import Pipeline


def watch(pipeline: Pipeline, folder: str, checkpoint: str, per_batch: int = 1000):
    """Starts a query over new files of `folder`; a batch that is run again finds its documents already submitted.

    The query's own checkpoint remembers which files were seen.
    """
    files = pipeline.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", per_batch).load(folder)

    def batch(df: DataFrame, _: int) -> None:
        pipeline.submit(df.select(F.col("path").alias("submission_id"), F.regexp_extract("path", "[^/]+$", 0).alias("filename"), "content"))
        pipeline.process()

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def transition_counts(transitions: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts of a stream of transitions by time window, stage and status; rows later than `late` are dropped."""
    return transitions.withWatermark("at", late).groupBy(F.window("at", window), "stage", "status").count()
