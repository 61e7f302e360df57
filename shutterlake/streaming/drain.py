"""A queue of changed rows drained into a table by upserts, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drain(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, files: int = 64) -> None:
    """Take in every Parquet file of source that wasn't yet; returns when none is left, and does nothing if called again.

    A batch of at most so many files is written to a folder of its own, named by the batch: one that is run again after
    a failure replaces what it wrote before, so no row counts twice. The stream's checkpoint holds what is taken in.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str, key: str, changed: str) -> DataFrame:
    """The newest row of each key, the later batch on a tie: combined before the shuffle."""
    rows = spark.read.parquet(target)
    names = [c for c in rows.columns if c not in (key, "batch")]
    newest = F.max_by(F.struct(*names), F.struct(F.col(changed), F.col("batch")))
    return rows.groupBy(key).agg(newest.alias("row")).select(key, "row.*")


def session_counts(events: DataFrame, user: str, time: str, gap: str, late: str) -> DataFrame:
    """Events of each user by sessions that a gap ends; of a stream, rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(user, F.session_window(time, gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))
