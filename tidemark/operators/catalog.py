"""The read side: filters, pages, point lookups and nested views of what is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vocabulary import format_ratio, normalise_symbol

#: Most rows of a page.
PAGE_MOST = 200


def universe(instruments: DataFrame, *, active: bool | None = None, kind: str | None = None, market: str | None = None, underlying: str | None = None, search: str | None = None) -> DataFrame:
    """Instruments that meet every filter given; `search` is a part of symbol, name or underlying, in any case."""
    if active is not None:
        instruments = instruments.where(F.col("is_active") == active)
    for column, value in (("instrument_type", kind), ("underlying_market", market and market.upper()), ("underlying_symbol", underlying and underlying.upper())):
        if value is not None:
            instruments = instruments.where(F.col(column) == value)
    if search:
        pattern = f"%{search.upper()}%"
        instruments = instruments.where(F.upper("symbol").like(pattern) | F.upper("name").like(pattern) | F.upper("underlying_symbol").like(pattern))
    return instruments


def between(df: DataFrame, day: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(day) >= start)
    return df.where(F.col(day) <= end) if end is not None else df


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """A page of at most 200 rows; Spark takes the smallest rows of each task first, without a full sort."""
    if not 1 <= limit <= PAGE_MOST or offset < 0:
        raise ValueError(f"limit must be 1 to {PAGE_MOST} and offset not negative")
    return df.orderBy(*order).offset(offset).limit(limit)


def newest(df: DataFrame, by: list[str], day: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(day)))).where(F.col("_n") <= n).drop("_n")


def latest(df: DataFrame, by: list[str], day: str, upto: Column) -> DataFrame:
    """The newest row of each key on or before a day."""
    rest = [c for c in df.columns if c not in by]
    return df.where(F.col(day) <= upto).groupBy(*by).agg(F.max_by(F.struct(*rest), F.col(day)).alias("_r")).select(*by, "_r.*")


def latest_instant(df: DataFrame, instant: str, now: Column | None = None) -> DataFrame:
    """The latest instant that is stored, as `latest`; `now` (the present one unless given) where none is."""
    return df.agg(F.coalesce(F.max(instant), F.current_timestamp() if now is None else now).alias("latest"))


def point(df: DataFrame, key: str, value: str) -> DataFrame:
    """The row of a symbol, written in any way; an error where there is none."""
    found = df.where(F.col(key) == normalise_symbol(F.lit(value)))
    if found.isEmpty():
        raise LookupError(f"no {key} {value!r}")
    return found


def unknown(requested: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return requested.join(known.select(key), key, "left_anti")


def with_ratio(instruments: DataFrame, periods: DataFrame, day: Column) -> DataFrame:
    """Instruments with the ratio in force on a day and as it is shown; null without one."""
    valid = periods.where((F.col("effective_from") <= day) & (F.col("effective_to").isNull() | (F.col("effective_to") > day)))
    one = valid.groupBy("instrument_id").agg(F.max_by("ratio", "effective_from").alias("ratio"))
    return instruments.join(one, "instrument_id", "left").withColumn("ratio_text", format_ratio(F.col("ratio")))


def nested(parent: DataFrame, child: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Each parent with its children as an ordered array; an empty one without any."""
    fields = [*order, *[c for c in child.columns if c not in (*order, key)]]
    packed = child.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    joined = parent.join(packed, key, "left")
    return joined.withColumn(name, F.coalesce(F.col(name), F.array().cast(packed.schema[name].dataType)))


def complete_runs(bars: DataFrame, snapshots: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Bars with their snapshots, of runs in which no bar lacks one."""
    have = snapshots.withColumn("_have", F.lit(1))
    joined = bars.join(have, [*keys, day], "left")
    whole = joined.groupBy(*keys).agg(F.count_if(F.col("_have").isNull()).alias("_miss")).where("_miss = 0").select(*keys)
    return joined.join(whole, keys, "left_semi").drop("_have")


def actual_and_theoretical(local: DataFrame, theoretical: DataFrame) -> DataFrame:
    """The two price series of a dashboard and the premium between them, on days that have both."""
    series = theoretical.select("instrument_id", "market_date", F.col("theoretical_price").alias("theoretical"), F.col("premium_discount").alias("premium"))
    return local.select("instrument_id", "market_date", F.col("close").alias("actual")).join(series, ["instrument_id", "market_date"])


def union_of_keys(rows: DataFrame, json: str, names: list[str]) -> DataFrame:
    """JSON objects as columns of doubles: a key that is missing is NaN, a value that is no number null; other keys are left out."""
    found = F.from_json(json, "map<string,string>")
    value = lambda n: F.when(F.coalesce(F.map_contains_key(found, F.lit(n)), F.lit(False)), F.try_element_at(found, F.lit(n)).try_cast("double")).otherwise(float("nan"))
    return rows.select(*[c for c in rows.columns if c != json], *[value(n).alias(n) for n in names])


def where_equal(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows whose columns equal the given values; a value of None asks for nothing."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def route_venues(instruments: DataFrame) -> DataFrame:
    """Instruments with `warning`: why the series of their underlying can't be asked for, or null.

    Of several reasons the first counts: no symbol (empty or white space too), no market, market UNKNOWN.
    """
    blank = F.coalesce(F.trim("underlying_symbol"), F.lit("")) == ""
    market = F.coalesce(F.col("underlying_market"), F.lit(""))
    return instruments.withColumn("warning", F.when(blank, "no_underlying_symbol").when(market == "", "no_underlying_market").when(market == "UNKNOWN", "unknown_underlying_market"))


def shown_theoretical(prices: DataFrame) -> DataFrame:
    """Theoretical prices as they are shown: with the ratio in words, empty where there is none; nulls stay."""
    return prices.withColumn("ratio_used_formatted", F.coalesce(format_ratio(F.col("ratio_used")), F.lit("")))


def holding_period(params: Column) -> Column:
    """The whole number that JSON parameters name as holding_period (true is 1, false 0); 1 without one or for any other value."""
    found = F.try_variant_get(F.try_parse_json(params), "$.holding_period", "variant")
    whole = F.schema_of_variant(found).isin("BIGINT", "BOOLEAN")
    return F.coalesce(F.when(whole, F.try_variant_get(found, "$", "int")), F.lit(1))


def backtest_summaries(backtests: DataFrame, instruments: DataFrame) -> DataFrame:
    """Stored runs without their vectors: id, symbol, start_date, end_date, n_bars, holding_period, total_costs, metrics."""
    named = backtests.join(instruments.select("instrument_id", "symbol"), "instrument_id", "left")
    return named.select("id", "symbol", "start_date", "end_date", "n_bars", holding_period(F.col("params")).alias("holding_period"), "total_costs", "metrics")
