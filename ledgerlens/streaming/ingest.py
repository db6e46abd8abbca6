"""Streams over landing folders: late data, windows, duplicates, incremental postings.

Defined results: rows without an event time are dropped by the watermark's filter; a repeated id within the
watermark counts once; rows later than the watermark are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators.retrieval import entity_postings


def read_landing(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once_within(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Rows whose id was not seen within the watermark; the time column is cast, for a zoneless one has no
    watermark."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).where(F.col(time).isNotNull())
    return t.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return t.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def session_counts(stream: DataFrame, time: str, by: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def index_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Entity postings of new chunks appended to a Parquet folder; the batch id makes a repeated batch
    overwrite itself, so a restart adds nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        entity_postings(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
