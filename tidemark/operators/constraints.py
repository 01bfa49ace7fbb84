"""Constraints as queries for the rows that break them; a table is sound when each is empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def overlaps(periods: DataFrame, key: str = "instrument_id") -> DataFrame:
    """Periods that end after one of the same key that begins later has begun; an open end lasts for ever."""
    w = Window.partitionBy(key).orderBy("effective_from")
    rows = periods.withColumn("next_from", F.lead("effective_from").over(w))
    return rows.where(F.col("next_from").isNotNull() & (F.col("effective_to").isNull() | (F.col("effective_to") > F.col("next_from"))))


def broken_checks(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Rows with the names of the predicates that are false for them; null passes, as in SQL."""
    failed = F.filter(F.array(*[F.when(~F.expr(p), F.lit(name)) for name, p in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("broken", failed).where(F.size("broken") > 0)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows that point at no row; a null points nowhere and passes."""
    keys = parent.select(F.col(parent_key).alias("_parent"))
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_parent"), "left_anti")


def cascade(child: DataFrame, gone: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """What is left of a child table when parent rows go."""
    keys = gone.select(F.col(parent_key).alias("_parent"))
    return child.join(keys, F.col(child_key) == F.col("_parent"), "left_anti")
