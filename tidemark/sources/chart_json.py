"""Daily charts as JSON with parallel arrays: payloads to bars, quiet slots and payload errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTES = ("open", "high", "low", "close")
_series = ", ".join(f"{c}: array<double>" for c in QUOTES)
SCHEMA = f"struct<chart: struct<result: array<struct<meta: struct<currency: string, exchangeTimezoneName: string, symbol: string, error: string>, timestamp: array<bigint>, indicators: struct<quote: array<struct<{_series}, volume: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>, error: string>>"


def decode(content: Column, fallback: str = "ISO-8859-1") -> Column:
    """Bytes as text: UTF-8, or the fallback where that leaves replacement marks."""
    text = F.decode(content, "UTF-8")
    return F.when(F.try_validate_utf8(content).isNull(), F.decode(content, fallback)).otherwise(text)


def parse(payloads: DataFrame, *, body: str = "body", symbol: str = "symbol") -> DataFrame:
    """One row a payload: symbol, `error` (null if it can be used), its result and meta.

    Errors: not_json, chart_error, no_result, no_meta, meta_error, misaligned (arrays of different lengths).
    """
    rows = payloads.withColumn("_p", F.from_json(F.col(body), SCHEMA, {"mode": "PERMISSIVE"}))
    result = F.try_element_at("_p.chart.result", F.lit(1))
    rows = rows.withColumn("_r", result).withColumn("_q", F.try_element_at("_r.indicators.quote", F.lit(1)))
    slots = F.size("_r.timestamp")
    uneven = F.lit(False)
    for c in (*QUOTES, "volume"):
        uneven = uneven | F.coalesce(F.size(F.col(f"_q.{c}")) != slots, F.lit(False)) & F.col(f"_q.{c}").isNotNull()
    error = (
        F.when(F.col("_p.chart").isNull(), "not_json")
        .when(F.col("_p.chart.error").isNotNull(), "chart_error")
        .when(F.col("_r").isNull(), "no_result")
        .when(F.col("_r.meta").isNull(), "no_meta")
        .when(F.col("_r.meta.error").isNotNull(), "meta_error")
        .when(uneven, "misaligned")
    )
    return rows.withColumn("error", error)


def slots(parsed: DataFrame, *, symbol: str = "symbol", source: str = "chart", currency: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every slot of the usable payloads: a bar, or `reason` no_trade_slot where the close is missing; `keep` are further columns."""
    good = parsed.where("error is null")
    at = lambda arr: F.try_element_at(arr, F.col("_i") + 1)
    each = good.select(F.col(symbol).alias("symbol"), *keep, "_r", "_q", F.posexplode("_r.timestamp").alias("_i", "_t"))
    zone = F.coalesce(F.nullif(F.col("_r.meta.exchangeTimezoneName"), F.lit("")), F.lit("UTC"))
    instant = F.timestamp_seconds("_t")
    price = lambda c: F.nanvl(at(c), F.lit(None).cast("double"))
    adjusted = F.try_element_at("_r.indicators.adjclose", F.lit(1))["adjclose"]
    close = price(F.col("_q.close"))
    return each.select(
        "symbol",
        *keep,
        F.to_date(F.from_utc_timestamp(instant, zone)).alias("market_date"),
        instant.alias("timestamp"),
        *[price(F.col(f"_q.{c}")).alias(c) for c in QUOTES],
        price(adjusted).alias("adjusted_close"),
        at(F.col("_q.volume")).cast("long").alias("volume"),
        F.lit(currency).alias("currency") if currency else F.coalesce(F.nullif(F.col("_r.meta.currency"), F.lit("")), F.lit("USD")).alias("currency"),
        F.lit(source).alias("source"),
        F.when(close.isNull() | F.col("_t").isNull(), "no_trade_slot").alias("reason"),
    )


def bars(parsed: DataFrame, **options) -> DataFrame:
    return slots(parsed, **options).where("reason is null").drop("reason")


def rejected(parsed: DataFrame, **options) -> DataFrame:
    return slots(parsed, **options).where("reason is not null").select("symbol", "timestamp", "reason")

