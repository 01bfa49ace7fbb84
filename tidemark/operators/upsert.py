"""Idempotent writes as pure functions: (stored, incoming) to the new state, each row with what became of it.

A state is joined with what comes in by one full outer join on the key. The caller writes the result; writing it twice gives the
same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Counted and silent columns of a bar, fields of an instrument, when a deactivation is refused.
BAR_VALUES = ("open", "high", "low", "close", "adjusted_close")
BAR_SILENT = ("symbol", "timestamp", "volume", "traded_value", "trades")
KEPT_IF_SILENT = ("instrument_type", "underlying_market", "program_status")
GUARD_LEAST, GUARD_RETENTION = 10, 0.5
# End of fixed values.


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], *, values: tuple[str, ...], silent: tuple[str, ...] = (), places: int | None = 6) -> DataFrame:
    """The new state and `change`: inserted, updated, unchanged, or kept for rows that nothing came in for.

    `values` are rounded half up and compared, and a difference counts as an update; `silent` columns are overwritten without
    counting; all other stored columns stay as they were first written. Incoming rows with one key must be one.
    """
    rounded = lambda c: F.round(F.col(c).cast("decimal(38,12)"), places) if places is not None else F.col(c)
    values, silent = tuple(c for c in values if c in stored.columns), tuple(c for c in silent if c in stored.columns)
    old, new = stored.alias("old"), incoming.withColumn("_new", F.lit(True)).alias("new")
    both = old.withColumn("_old", F.lit(True)).alias("old").join(new, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full_outer")
    came, was = F.coalesce(F.col("new._new"), F.lit(False)), F.coalesce(F.col("old._old"), F.lit(False))
    differs = F.lit(False)
    for c in values:
        differs = differs | ~rounded(f"old.{c}").eqNullSafe(rounded(f"new.{c}"))
    change = F.when(~came, "kept").when(~was, "inserted").when(differs, "updated").otherwise("unchanged")
    pick = lambda c: F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")) if c in keys else F.when(came, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")) if c in (*values, *silent) else F.when(was, F.col(f"old.{c}")).otherwise(F.col(f"new.{c}") if c in incoming.columns else None)
    return both.select(*[pick(c).alias(c) for c in stored.columns], change.alias("change"))


def upsert_bars(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["instrument_id", "market_date"], values=BAR_VALUES, silent=BAR_SILENT)


def upsert_rates(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, ["pair", "source", "market_date"], values=("open", "high", "low", "close"), silent=("timestamp", "volume"))


def merge_attributes(old: Column, new: Column) -> Column:
    """Old entries that nothing came in for, and the new ones with their keys under 'sources.'."""
    none = F.create_map().cast("map<string,string>")
    fresh = F.transform_keys(F.coalesce(new, none), lambda k, _: F.concat(F.lit("sources."), k))
    return F.map_concat(F.map_filter(F.coalesce(old, none), lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)


def upsert_instruments(stored: DataFrame, incoming: DataFrame, seen_at: Column) -> DataFrame:
    """By symbol: a value that says something replaces the stored one, silence does not; who is listed is active again.

    `attributes`, where both sides have it, is merged with the incoming keys under 'sources.'.
    """
    both = stored.withColumn("_old", F.lit(True)).alias("old").join(incoming.withColumn("_new", F.lit(True)).alias("new"), F.col("old.symbol") == F.col("new.symbol"), "full_outer")
    came = F.col("_new").isNotNull()

    def pick(c: str) -> Column:
        old, new = F.col(f"old.{c}"), F.col(f"new.{c}") if c in incoming.columns else F.lit(None)
        if c == "custodian":
            return F.when(came, new).otherwise(old)
        if c == "is_active":
            return came | F.coalesce(old, F.lit(False))
        if c == "first_seen_at":
            return F.coalesce(old, seen_at)
        if c == "last_seen_at":
            return F.when(came, seen_at).otherwise(old)
        if c == "attributes":
            return merge_attributes(old, new)
        if c in KEPT_IF_SILENT:
            return F.coalesce(F.nullif(new, F.lit("UNKNOWN")), old, F.lit("UNKNOWN"))
        return F.coalesce(F.nullif(new, F.lit("")), old) if c != "symbol" else F.coalesce(old, new)

    change = F.when(~came, "kept").when(F.col("_old").isNull(), "inserted").otherwise("updated")
    return both.select(*[pick(c).alias(c) for c in stored.columns], change.alias("change"))


def change_ratios(history: DataFrame, incoming: DataFrame, day: Column) -> DataFrame:
    """Ratio periods after a run, with `change`: kept, closed or inserted.

    No ratio leaves the open period alone, an equal one too; another one closes it on `day` and opens a new period from then. A
    second change on the day on which the open period began replaces it, as a period may not be empty.
    """
    given = incoming.where("ratio is not null").select("instrument_id", F.col("ratio").alias("_ratio"))
    rows = history.join(given, "instrument_id", "left")
    hit = F.col("effective_to").isNull() & F.col("_ratio").isNotNull() & (F.col("_ratio") != F.col("ratio"))
    same_day = hit & (F.col("effective_from") == day)
    old = rows.where(~F.coalesce(same_day, F.lit(False))).select("instrument_id", "effective_from", F.when(hit, day).otherwise(F.col("effective_to")).alias("effective_to"), "ratio", F.when(hit, "closed").otherwise("kept").alias("change"))
    open_now = history.where("effective_to is null").select("instrument_id", F.col("ratio").alias("_open"))
    fresh = given.join(open_now, "instrument_id", "left").where("_open is null or _open <> _ratio")
    new = fresh.select("instrument_id", day.alias("effective_from"), F.lit(None).cast("date").alias("effective_to"), F.col("_ratio").alias("ratio"), F.lit("inserted").alias("change"))
    return old.unionByName(new)


def rebuild_ratios(observed: DataFrame) -> DataFrame:
    """Periods from observations (instrument_id, day, ratio): one for each run of equal ratios."""
    w = Window.partitionBy("instrument_id").orderBy("day")
    starts = observed.where("ratio is not null").withColumn("_before", F.lag("ratio").over(w)).where("_before is null or _before <> ratio")
    return starts.select("instrument_id", F.col("day").alias("effective_from"), F.lead("day").over(w).alias("effective_to"), "ratio")


def deactivate_missing(instruments: DataFrame, seen: DataFrame, *, all_sources: bool = True, least: int = GUARD_LEAST, retention: float = GUARD_RETENTION) -> DataFrame:
    """Instruments with `is_active` off for active ones that no source lists (`seen`: symbol).

    Nothing changes if a source is missing, or if of at least `least` active ones less than `retention` would stay.
    """
    if not all_sources:
        return instruments
    listed = seen.select("symbol").distinct().withColumn("_seen", F.lit(True))
    rows = instruments.join(listed, "symbol", "left").withColumn("_stale", F.col("is_active") & F.col("_seen").isNull())
    guard = rows.agg(F.count_if(F.col("is_active")).alias("_total"), F.count_if(F.col("_stale")).alias("_gone"))
    refused = (F.col("_total") >= least) & ((F.col("_total") - F.col("_gone")) / F.col("_total") < retention)
    # one row of two counts
    rows = rows.crossJoin(F.broadcast(guard.select(refused.alias("_refused"))))
    return rows.withColumn("is_active", F.col("is_active") & (~F.col("_stale") | F.col("_refused"))).select(*instruments.columns)


def insert_if_absent(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows as they are, and incoming ones with a new key."""
    return stored.unionByName(incoming.join(stored, keys, "left_anti").select(*stored.columns))


def replace_window(stored: DataFrame, incoming: DataFrame, keys: list[str], day: str, start: Column, end: Column) -> DataFrame:
    """Rows of the keys that come in are rebuilt inside [start, end]; all others stay."""
    touched = incoming.select(*keys).distinct()
    outside = stored.where(~F.col(day).between(start, end)).unionByName(stored.where(F.col(day).between(start, end)).join(touched, keys, "left_anti").select(*stored.columns))
    return outside.unionByName(incoming.where(F.col(day).between(start, end)).select(*stored.columns))


def tallies(changed: DataFrame, series: str) -> DataFrame:
    """Rows inserted and updated by a write, for its audit row."""
    return changed.agg(F.count_if(F.col("change") == "inserted").alias("inserted"), F.count_if(F.col("change") == "updated").alias("updated")).select(F.lit(series).alias("series"), "inserted", "updated")


def append_features(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("append").partitionBy("feature_version").parquet(path)
