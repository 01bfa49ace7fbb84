"""Runs put together from the operators: pure functions of stored states and what came in, to the new states and one audit row.

A run returns a dict of DataFrames. `audit` has one row: series, status, what was inserted, updated and deactivated, what was
rejected and quarantined, and how many warnings there were. Nothing is written; the caller stores the states and appends the audit row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import reconcile as rc
from . import upsert as up
from .upsert import insert_if_absent

COUNTS = ("inserted", "updated", "deactivated", "rejected", "quarantined", "warnings")


def audit(series: str, **counted: DataFrame) -> DataFrame:
    """The audit row of a run: how many rows each of `counted` has."""
    tags = [df.select(F.lit(name).alias("kind")) for name, df in counted.items()]
    rows = reduce(DataFrame.unionByName, tags)
    return rows.agg(*[F.count_if(F.col("kind") == c).alias(c) for c in COUNTS]).select(F.lit(series).alias("series"), F.lit("succeeded").alias("status"), *COUNTS)


def changes(*changed: DataFrame) -> dict[str, DataFrame]:
    """Inserted and updated rows of several writes."""
    every = reduce(DataFrame.unionByName, [df.select("change") for df in changed])
    return {kind: every.where(F.col("change") == kind) for kind in ("inserted", "updated")}


def metadata_run(instruments: DataFrame, history: DataFrame, snapshots: list[DataFrame], expected: DataFrame, *, day: Column, seen_at: Column) -> dict[str, DataFrame]:
    """Instruments, ratio periods (keyed by symbol) and quarantine after the sources' snapshots have been reconciled.

    Records are deduped inside each source and merged field by field; disputed fields are quarantined; ratios open and close periods on
    `day`; active instruments that no source lists are deactivated unless an expected source is missing. No snapshot is an error.
    """
    if not snapshots:
        raise ValueError("no source has delivered a snapshot")
    judged = rc.dedupe(rc.union_snapshots(snapshots))
    merged = rc.merge(judged.where("verdict is null").drop("verdict"))
    missing = rc.missing_sources(expected, judged)
    written = up.upsert_instruments(instruments, merged, seen_at)
    after = up.deactivate_missing(written.drop("change"), merged.select("symbol"), all_sources=missing.isEmpty())
    gone = written.where("is_active").select("symbol").join(after.where("not is_active").select("symbol"), "symbol", "left_semi")
    ratios = up.change_ratios(history, merged.select(F.col("symbol").alias("instrument_id"), "ratio"), day)
    quarantine = rc.quarantine(merged)
    counted = changes(written) | {"deactivated": gone, "rejected": judged.where("verdict is not null"), "quarantined": quarantine, "warnings": missing}
    return {"instruments": after, "ratios": ratios, "quarantine": quarantine, "missing": missing, "audit": audit("metadata", **counted)}


def price_run(stored_bars: DataFrame, bars: DataFrame, stored_rates: DataFrame, rates: DataFrame, failures: DataFrame) -> dict[str, DataFrame]:
    """Bars and rates after a run; symbols whose source failed (`failures`) are warnings and keep what they had."""
    new_bars, new_rates = up.upsert_bars(stored_bars, bars), up.upsert_rates(stored_rates, rates)
    return {"bars": new_bars, "rates": new_rates, "audit": audit("prices", **changes(new_bars, new_rates), warnings=failures)}


# Compared and silent columns of a theoretical price.
THEORETICAL_VALUES = ("theoretical_price", "premium_discount", "local_price", "ratio_used", "fx_used", "underlying_price_used")
THEORETICAL_SILENT = ("underlying_market_date", "fx_market_date")
# End of fixed values.


def theoretical_run(stored: DataFrame, rows: DataFrame, sessions: DataFrame) -> dict[str, DataFrame]:
    """Theoretical prices after a run; local sessions (instrument_id, market_date) for which an input is unknown are warnings."""
    new = up.upsert(stored, rows, ["instrument_id", "market_date"], values=THEORETICAL_VALUES, silent=THEORETICAL_SILENT)
    unknown = sessions.join(rows, ["instrument_id", "market_date"], "left_anti")
    return {"theoretical": new, "audit": audit("theoretical", **changes(new), warnings=unknown)}


def feature_run(stored: DataFrame, snapshots: DataFrame, version: str) -> dict[str, DataFrame]:
    """Feature snapshots with those of new days and this version appended; stored ones are never rewritten."""
    fresh = snapshots.withColumn("feature_version", F.lit(version))
    keys = ["instrument_id", "market_date", "feature_version"]
    return {"features": insert_if_absent(stored, fresh, keys), "audit": audit("features", inserted=fresh.join(stored, keys, "left_anti"))}
