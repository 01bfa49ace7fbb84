"""Streams: ticks to daily bars, late and repeated bars, and a table kept up to date batch by batch.

The reference computes in batches only; these are the same rules where data arrive as a stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import upsert
from ..storage import shared_folder


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def daily_bars(rows: DataFrame, *, key: str = "event_type", ts: str = "ts", price: str = "value", delay: str = "3 days") -> DataFrame:
    """Open, high, low, close and ticks of each key and day, for rows no later than `delay` behind the newest."""
    timed = rows.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", delay)
    order = F.struct("_at", "event_id")
    return timed.groupBy(F.window("_at", "1 day"), key).agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count(F.lit(1)).alias("ticks")).select(key, F.to_date("window.start").alias("market_date"), "open", "high", "low", "close", "ticks")


def without_repeats(rows: DataFrame, keys: list[str], ts: str, delay: str = "3 days") -> DataFrame:
    """The first of rows with one key that arrive within `delay` of each other."""
    return rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def own_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str, write) -> None:
    """Take everything that is there, batch by batch, through `write(batch, number)`."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", own_folder(spark, "stream")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def keep_table(stream: DataFrame, keys: list[str], values: tuple[str, ...]) -> DataFrame:
    """A table that each batch is upserted into. A batch writes a new version, so a batch that is run twice does no harm."""
    spark = stream.sparkSession
    root = own_folder(spark, "table")
    versions: list[str] = []

    def write(batch: DataFrame, number: int) -> None:
        at = f"{root}/{number}"
        old = [v for v in versions if v != at]
        merged = upsert(spark.read.parquet(old[-1]), batch, keys, values=values, places=None).drop("change") if old else batch
        merged.write.mode("overwrite").parquet(at)
        if at not in versions:
            versions.append(at)

    run_once(stream, "update", write)
    return spark.read.parquet(versions[-1]) if versions else spark.createDataFrame([], stream.schema)
