"""Streaming writes and change feeds for version logs (an extension).

Each micro-batch appends its versions under its own batch id, so a batch that is run again
replaces itself; readers take the newest version of each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.history import COLUMNS, LOG, PUT, latest

#: Versions of one batch lie between batch * SPAN and (batch + 1) * SPAN.
SPAN = 1 << 40


def append_stream(stream: DataFrame, log_path: str, checkpoint: str, key: str = "_id", value: str = "_json", available_now: bool = True) -> StreamingQuery:
    """Append a stream of (key, JSON value) to a log; a null value deletes."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(
            F.lit("").alias("_group"), F.col(key).cast("string").alias("_id"), (F.lit(batch_id * SPAN) + F.monotonically_increasing_id()).alias("_ver"),
            F.when(F.col(value).isNull(), "del").otherwise(PUT).alias("_op"), F.lit(0).cast("long").alias("_row"),
            F.current_date().alias("_cdate"), F.current_date().alias("_mdate"), F.lit(0).alias("_ttl"), F.lit(0).alias("_flags"), F.col(value).cast("string").alias("_json"),
        ).select(*COLUMNS)
        rows.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(log_path).select(*COLUMNS)


def changes_since(spark: SparkSession, log_path: str, batch: int) -> DataFrame:
    """Newest versions written from a batch on; only those batches' files are read."""
    df = spark.read.schema(LOG + ", batch long").parquet(log_path).where(F.col("batch") >= batch)
    return latest(df.select(*COLUMNS))


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window and key of a stream with late rows."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
