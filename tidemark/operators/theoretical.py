"""Theoretical prices: local sessions with the ratio of the day, the lagged underlying close and the rate known then."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.market_time import market_date
from ..functions.pricing import premium, quantise_even, theoretical_price
from ..functions.vocabulary import market_zone
from .temporal import as_of, interval

# UTC clock times of the three series.
LOCAL_CLOCK, UNDERLYING_CLOCK, FX_CLOCK = "21:00:00", "20:00:00", "19:30:00"
# End of fixed values.


def at(day: str, clock: str):
    return F.to_timestamp_ntz(F.concat(F.col(day).cast("string"), F.lit(f" {clock}")))


def assemble(local: DataFrame, underlying: DataFrame, fx: DataFrame, ratios: DataFrame, instruments: DataFrame, *, lag: int = 1) -> DataFrame:
    """instrument_id, market_date, theoretical_price, premium_discount and the inputs used, where all inputs are known.

    The underlying bar is the `lag`-th newest with a date before the venue's own date at the local close, and an instant before it; the rate is
    the newest before that instant.
    """
    rows = local.select("instrument_id", "market_date", F.col("close").alias("local_price"), at("market_date", LOCAL_CLOCK).alias("ts"))
    rows = rows.join(instruments.select("instrument_id", market_zone(F.col("underlying_market")).alias("zone")), "instrument_id")
    # the venue's date at that instant: bars are eligible before it (their own instants, earlier in the day, then are too)
    rows = rows.withColumn("venue_date", market_date(F.col("ts"), F.col("zone")))
    under = underlying.where("close is not null").select("instrument_id", F.col("market_date").alias("u_date"), F.col("close").alias("u_close"))
    rows = as_of(rows, under, keys=["instrument_id"], left_time="venue_date", right_time="u_date", take={"u_close": "underlying_price_used", "u_date": "underlying_market_date"}, lag=lag)
    rates = fx.where("close is not null").select(at("market_date", FX_CLOCK).alias("f_ts"), F.col("market_date").alias("f_date"), F.col("close").alias("f_close"))
    rows = as_of(rows, rates, keys=[], left_time="ts", right_time="f_ts", take={"f_close": "fx_used", "f_date": "fx_market_date"})
    rows = interval(rows, ratios, key="instrument_id", day="market_date", value="ratio").withColumnRenamed("ratio", "ratio_used")
    price = theoretical_price(F.col("underlying_price_used"), F.col("fx_used"), F.col("ratio_used"))
    rows = rows.withColumn("theoretical_price", price).where("theoretical_price is not null")
    return rows.select("instrument_id", "market_date", "theoretical_price", premium(F.col("local_price"), F.col("theoretical_price")).alias("premium_discount"), "local_price", "ratio_used", "fx_used", "underlying_price_used", "underlying_market_date", "fx_market_date")


def stored(rows: DataFrame) -> DataFrame:
    """Amounts as they are stored: decimal(20,6), half even; premia from the unrounded price."""
    amounts = ["theoretical_price", "local_price", "ratio_used", "fx_used", "underlying_price_used"]
    return rows.select("instrument_id", "market_date", *[quantise_even(F.col(c)).alias(c) for c in amounts], quantise_even(F.col("premium_discount")).cast("decimal(10,6)").alias("premium_discount"), "underlying_market_date", "fx_market_date")
