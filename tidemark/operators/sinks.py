"""Writes that say how they went: counts observed on the write itself, a row for each state, partitions replaced as a whole."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A row of the audit: a run has a row for each state it has been in.
AUDIT = "run_id string, series string, state string, at timestamp, counts map<string,bigint>, warnings array<string>, error string"


def now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc)


def append_audit(spark: SparkSession, path: str, *row) -> None:
    spark.createDataFrame([row], AUDIT).coalesce(1).write.mode("append").parquet(path)


def observed_write(rows: DataFrame, write: Callable[[DataFrame], None], *, series: str, audit_path: str, counts: dict[str, Column], warnings: list[str] | None = None) -> str:
    """Run `write(rows)` and record it in the table at `audit_path`: running before it, then succeeded or failed. Returns the run's id.

    `counts` are conditions; how many of the written rows meet each of them is observed while they are written, so that no second pass
    counts them, and a write that runs several jobs over the rows is an error of its caller. A write that fails leaves a failed row with the first line of its error,
    without counts, and the error is raised again. Nothing written by others is touched.
    """
    spark, run = rows.sparkSession, uuid.uuid4().hex
    told = list(warnings or [])
    append_audit(spark, audit_path, run, series, "running", now(), {}, told, None)
    seen = Observation(f"run-{run}")
    try:
        write(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(name) for name, c in counts.items()]))
    except Exception as e:
        append_audit(spark, audit_path, run, series, "failed", now(), {}, told, (str(e).splitlines() or [type(e).__name__])[0])
        raise
    append_audit(spark, audit_path, run, series, "succeeded", now(), {k: int(v) for k, v in seen.get.items()}, told, None)
    return run


def newest_states(audit: DataFrame) -> DataFrame:
    """The last state of each run, with when it began and how long it took in seconds (null while it runs)."""
    order = F.struct("at", F.col("state") != "running")
    last = audit.groupBy("run_id", "series").agg(F.min("at").alias("began"), F.max_by(F.struct("state", "at", "counts", "warnings", "error"), order).alias("l"))
    took = F.when(F.col("l.state") != "running", F.col("l.at").cast("double") - F.col("began").cast("double"))
    return last.select("run_id", "series", "l.state", "began", took.alias("seconds"), "l.counts", "l.warnings", "l.error")


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write rows so that each partition among them replaces the stored one; others stay. Run again, the table is the same."""
    rows.repartition(*[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
