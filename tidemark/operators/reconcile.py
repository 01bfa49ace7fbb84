"""Reconciling what several sources list: dedupe inside a source, then one row a symbol, field by field.

Records have `provider`, `rank` (the order of the sources), `pos` (the order inside a source), `symbol` and the fields below.
Everything is a grouping by symbol, or by source and symbol.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Merged fields, those that say nothing as 'UNKNOWN', those on which sources must agree, those of completeness.
FIELDS = ("name", "instrument_type", "underlying_symbol", "underlying_name", "underlying_market_raw", "underlying_isin", "isin", "ratio", "program_status", "program_status_raw")
SILENT_UNKNOWN = ("instrument_type", "program_status")
MUST_AGREE = ("ratio", "underlying_symbol")
COMPLETENESS = ("name", "underlying_symbol", "underlying_market_raw", "underlying_isin", "isin", "program_status_raw", "source_ref")
# End of fixed values.


def completeness(columns: list[str]) -> Column:
    """How many of the optional fields that a table has are filled."""
    filled = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in COMPLETENESS if c in columns]
    return sum(filled, F.lit(0))


def union_snapshots(snapshots: list[DataFrame]) -> DataFrame:
    """All records of all sources; a field that a source lacks is null."""
    first, *rest = snapshots
    for more in rest:
        first = first.unionByName(more, allowMissingColumns=True)
    return first


def dedupe(records: DataFrame) -> DataFrame:
    """Records with `verdict`: null for the one of each source and symbol that stays, else why it goes.

    Several different ratios: all go. One record with a ratio: it stays. Otherwise the most complete one stays, the first
    of equally complete ones.
    """
    group = Window.partitionBy("provider", "symbol")
    best = group.orderBy(F.desc("_score"), "pos")
    rows = records.withColumn("_score", completeness(records.columns)).withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_ratios", F.size(F.collect_set("ratio").over(group))).withColumn("_rated", F.count("ratio").over(group)).withColumn("_place", F.row_number().over(best))
    one_rated = F.col("_rated") == 1
    wins = F.when(one_rated, F.col("ratio").isNotNull()).otherwise(F.col("_place") == 1)
    verdict = F.when(F.col("_n") == 1, None).when(F.col("_ratios") > 1, "conflicting_ratios").when(wins, None).when(one_rated, "superseded_by_ratio_bearing_record").otherwise("duplicate_record")
    return rows.withColumn("verdict", verdict).drop("_score", "_n", "_ratios", "_rated", "_place")


def informative(field: str) -> Column:
    return F.col(field).isNotNull() & (F.col(field) != "UNKNOWN") if field in SILENT_UNKNOWN else F.col(field).isNotNull()


def merge(records: DataFrame) -> DataFrame:
    """One row a symbol: custodian, sources, each field, and `conflicts`, the fields that the sources disagree on.

    A field is the first value in the order of the sources that says something; a field that must agree and does not is null.
    """
    order = F.struct("rank", "pos")
    fields = [f for f in FIELDS if f in records.columns]
    first = [F.min_by(F.when(informative(f), F.col(f)), F.when(informative(f), order)).alias(f) for f in fields]
    # a source has at most one record of a symbol after dedupe, so these sets are as small as the list of sources
    values = [F.size(F.collect_set(F.when(informative(f), F.col(f)))).alias(f"_n_{f}") for f in fields if f in MUST_AGREE]
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "pos", "provider"))), lambda x: x["provider"])
    grouped = records.groupBy("symbol").agg(F.min_by("provider", order).alias("custodian"), F.min_by("source_ref", order).alias("source_ref"), F.array_distinct(listed).alias("sources"), *first, *values)
    disputed = lambda f: F.col(f"_n_{f}") > 1
    out = [F.when(~disputed(f), F.col(f)).alias(f) if f in MUST_AGREE else F.coalesce(F.col(f), F.lit("UNKNOWN")).alias(f) if f in SILENT_UNKNOWN else F.col(f) for f in fields]
    conflicts = F.filter(F.array(*[F.when(disputed(f), F.lit(f"conflicting_{f}")) for f in fields if f in MUST_AGREE]), lambda x: x.isNotNull())
    return grouped.select("symbol", "custodian", "source_ref", "sources", *out, conflicts.alias("conflicts"))


def quarantine(merged: DataFrame) -> DataFrame:
    """A row for each disputed field."""
    return merged.select("symbol", F.explode("conflicts").alias("reason"))


def merge_extras(records: DataFrame, extras: str = "extra") -> DataFrame:
    """Maps of all sources in one, keys as 'source.key'; of equal keys the first in the order of the sources."""
    pairs = records.select("symbol", "rank", "pos", "provider", F.explode(extras).alias("k", "v")).select("symbol", F.concat("provider", F.lit("."), "k").alias("key"), "v", F.struct("rank", "pos").alias("at"))
    first = pairs.groupBy("symbol", "key").agg(F.min_by("v", "at").alias("v"))
    return first.groupBy("symbol").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "v")))).alias("extra"))


def duplicated(records: DataFrame) -> DataFrame:
    """Symbols that one source lists more than once."""
    return records.groupBy("provider", "symbol").agg(F.count(F.lit(1)).alias("records")).where("records > 1")


def missing_sources(expected: DataFrame, records: DataFrame) -> DataFrame:
    """Expected sources (provider) without a record."""
    return expected.join(records, "provider", "left_anti")


def rejects(judged: DataFrame) -> DataFrame:
    """What an audit keeps of the records that a verdict turned away: source, symbol, reason and an excerpt as JSON, without the record."""
    shown = [c for c in ("source_ref", "ratio", "underlying_symbol") if c in judged.columns]
    detail = F.to_json(F.struct(*shown), {"ignoreNullFields": "false"})
    return judged.where("verdict is not null").select("provider", "symbol", F.col("verdict").alias("reason"), detail.alias("detail"))
