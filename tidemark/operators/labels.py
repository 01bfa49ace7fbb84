"""Horizon labels, datasets, chronological positions and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pricing import HORIZONS
from .temporal import as_of


def session_labels(bars: DataFrame, sessions: int) -> DataFrame:
    """At each session with a close, 1 if the close that many sessions later is higher, else 0; the last ones have none."""
    w = Window.partitionBy("instrument_id").orderBy("market_date")
    rows = bars.where("close is not null").select("instrument_id", "market_date", "close", F.lead("close", sessions).over(w).alias("later"))
    return rows.where("later is not null").select("instrument_id", "market_date", (F.col("later") > F.col("close")).cast("int").alias("label"))


def day_labels(days: DataFrame, bars: DataFrame, sessions: int) -> DataFrame:
    """The same for any calendar day: its base is the last close up to the day."""
    labelled = session_labels(bars, sessions)
    # a session without label must hide older ones, so it takes part with a null label
    every = bars.where("close is not null").select("instrument_id", "market_date").join(labelled, ["instrument_id", "market_date"], "left")
    found = as_of(days.select("instrument_id", "market_date"), every, keys=["instrument_id"], left_time="market_date", right_time="market_date", take={"label": "label"}, strict=False)
    return found.where("label is not null")


def dataset(snapshots: DataFrame, bars: DataFrame, horizon: str) -> DataFrame:
    """Snapshots with their label and chronological position; an unknown horizon is an error."""
    labels = day_labels(snapshots, bars, HORIZONS[horizon])
    position = F.row_number().over(Window.partitionBy("instrument_id").orderBy("market_date")) - 1
    return snapshots.join(labels, ["instrument_id", "market_date"]).withColumn("position", position)


def folds(sizes: DataFrame, min_train: int, test: int, step: int) -> DataFrame:
    """For rows (instrument_id, n), expanding training ranges [0, train_end) and test ranges [train_end, test_end)."""
    ends = F.when(F.col("n") >= min_train + test, F.sequence(F.lit(min_train), (F.col("n") - test).cast("int"), F.lit(step)))
    return sizes.select("instrument_id", F.posexplode(ends).alias("fold", "train_end")).select("instrument_id", "fold", "train_end", F.col("train_end").alias("test_start"), (F.col("train_end") + test).alias("test_end"))


def geometry(spark: SparkSession) -> DataFrame:
    """Smallest training part, test part and step of each horizon."""
    rows = spark.createDataFrame(list(HORIZONS.items()), "horizon string, sessions int")
    return rows.select("horizon", "sessions", F.greatest(F.lit(252), 4 * F.col("sessions")).alias("min_train"), F.greatest(F.lit(63), F.col("sessions")).alias("test_size"), F.greatest(F.lit(63), F.col("sessions")).alias("step"))


def members(rows: DataFrame, fold_table: DataFrame) -> DataFrame:
    """Rows (instrument_id, position) with each fold that they belong to, as train or test."""
    hit = rows.join(fold_table, "instrument_id").where("position < test_end")
    return hit.withColumn("part", F.when(F.col("position") < F.col("train_end"), "train").otherwise("test"))


def coverage(fold_table: DataFrame, sizes: DataFrame, min_train: int) -> DataFrame:
    """For each instrument, whether tests cover [min_train, n) exactly once."""
    covered = fold_table.select("instrument_id", F.explode(F.sequence("test_start", F.col("test_end") - 1)).alias("position")).groupBy("instrument_id", "position").agg(F.count(F.lit(1)).alias("times"))
    found = covered.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("positions"), F.max("times").alias("most"))
    return sizes.join(found, "instrument_id", "left").select("instrument_id", "n", F.coalesce((F.col("positions") == F.col("n") - min_train) & (F.col("most") == 1), F.lit(False)).alias("covered"))
