"""The verdict log as a stream: new files of lines are taken once, and the last verdict of every pair is kept.

A batch combines its own lines and replaces its own partition, so a run that breaks off is done anew with the same result. What a
batch holds and what a pair takes does not grow with the log's history: of a pair each batch leaves one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.sources.files import VERDICTS, latest, verdicts


def verdict_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Verdicts of JSON-lines files that appear in folder."""
    return verdicts(spark.readStream.schema(VERDICTS).option("maxFilesPerTrigger", files_per_batch).json(folder))


def keep_last(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Take what is new; a, b and the last label, verdict and time of all that was ever taken. Of equal times the greater label, then verdict, counts."""

    def step(rows: DataFrame, number: int) -> None:
        last = latest(rows).withColumn("batch", F.lit(number))
        last.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    return latest(spark.read.schema("a string, b string, at timestamp, label string, verdict string, batch int").parquet(out).drop("batch"))


def counts_by_window(stream: DataFrame, out: str, checkpoint: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """start, verdict, n in windows of event time. A window is written once the newest line is `late` past its end; then it has no state
    any more, and lines that come for it are dropped."""
    counts = stream.withWatermark("at", late).groupBy(F.window("at", width), "verdict").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.select(F.col("window.start").alias("start"), "verdict", "n")
    rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(rows.schema).parquet(out)
