"""The fifty features in five families, as state at each bar and as snapshots on calendar days."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import indicators as ind
from ..functions.pricing import premium
from .temporal import as_of, overlapping

VERSION = "1.0"
# Names of the features, in order, by family.
TECHNICAL = ["return_1d", "return_5d", "return_10d", "return_20d", "sma_5", "sma_10", "sma_20", "sma_50", "ema_10", "ema_20", "rsi_14", "macd", "macd_signal", "atr_14", "rolling_volatility_20d", "volume_change_5d"]
FAMILIES = {
    "cedear_technical": [f"cedear_{x}" for x in [*TECHNICAL, "volume_ratio_5d"]],
    "underlying_technical": [f"underlying_{x}" for x in TECHNICAL],
    "fx": ["fx_return_1d", "fx_return_5d", "fx_return_20d", "fx_volatility_20d", "fx_momentum_20d", "fx_rolling_change_5d"],
    "relative": ["premium_discount", "expected_cedear_return", "actual_cedear_return", "local_underlying_divergence"],
    "market": ["merval_return_1d", "sp500_return_1d", "nasdaq_return_1d", "dow_return_1d", "russell_2000_return_1d", "vix_return_1d", "sector_etf_return_1d"],
}
# End of fixed values.
NAMES = [x for names in FAMILIES.values() for x in names]


def newest(column: str, bars: int, *by: str) -> Column:
    """The values of a column over the newest rows up to the current one, without nulls."""
    return F.collect_list(F.col(column).cast("double")).over(Window.partitionBy(*by).orderBy("market_date").rowsBetween(1 - bars, 0))


def technical(bars: DataFrame, prefix: str) -> DataFrame:
    """State at each bar of the technical indicators: instrument_id, market_date and the family's columns."""
    # windows of few series are small in bytes but not in work: their partitions are not to be put together again
    bars = bars.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "instrument_id")
    arrays = {x: newest(c, ind.BARS, "instrument_id") for x, c in (("c", "close"), ("h", "high"), ("l", "low"), ("v", "volume"))}
    rows = bars.select("instrument_id", "market_date", *[a.alias(f"_{x}") for x, a in arrays.items()])
    c, h, lo, v = (F.col(f"_{x}") for x in "chlv")
    line, signal = ind.macd(c)
    columns = {f"return_{k}d": ind.change(c, k) for k in (1, 5, 10, 20)} | {f"sma_{k}": ind.mean(c, k) for k in (5, 10, 20, 50)} | {f"ema_{k}": ind.ema(c, k) for k in (10, 20)}
    columns |= {"rsi_14": ind.rsi(c), "macd": line, "macd_signal": signal, "atr_14": ind.atr(h, lo, c), "rolling_volatility_20d": ind.volatility(c), "volume_change_5d": ind.change(v, 5)}
    if prefix == "cedear":
        columns["volume_ratio_5d"] = ind.enough(v, 20, ind.mean(v, 5) / F.nullif(ind.mean(v, 20), F.lit(0.0)))
    known = F.size(c) >= 2  # with fewer closes nothing is known, not even of volumes
    return rows.select("instrument_id", "market_date", *[F.when(known, value).alias(f"{prefix}_{name}") for name, value in columns.items()])


def fx_state(fx: DataFrame) -> DataFrame:
    """State of the one series of rates at each of its days, in blocks of days that overlap by a window."""
    rows = overlapping(fx, "market_date", ind.FX_BARS - 1).select("market_date", "_guest", newest("close", ind.FX_BARS, "_block").alias("_c")).where("not _guest")
    c = F.col("_c")
    momentum = ind.back(c, 0) - ind.back(c, 20)
    values = {"fx_return_1d": ind.change(c, 1), "fx_return_5d": ind.change(c, 5), "fx_return_20d": ind.change(c, 20), "fx_volatility_20d": ind.volatility(c, 20), "fx_momentum_20d": momentum, "fx_rolling_change_5d": ind.change(c, 5)}
    return rows.select("market_date", *[v.alias(k) for k, v in values.items()])


def with_previous(bars: DataFrame, *by: str) -> DataFrame:
    """Close and the close of the observation before, of bars that have one; without keys the bars are one series."""
    closes = bars.where("close is not null")
    if not by:
        w = Window.partitionBy("_block").orderBy("market_date")
        return overlapping(closes, "market_date", 1).withColumn("prev_close", F.lag("close").over(w)).where("not _guest").drop("_block", "_guest")
    return closes.withColumn("prev_close", F.lag("close").over(Window.partitionBy(*by).orderBy("market_date")))


def step_return(close: Column, prev: Column) -> Column:
    return (close - prev) / F.nullif(prev, F.lit(0.0))


def relative(spine: DataFrame, local: DataFrame, underlying: DataFrame, fx: DataFrame, theoretical: DataFrame) -> DataFrame:
    """Local and theoretical up to the day itself, underlying strictly before it, rates up to the day."""
    take = {"close": "c", "prev_close": "p"}
    rows = spine.select("instrument_id", "market_date")
    for name, series, keys, strict in (("l", with_previous(local, "instrument_id"), ["instrument_id"], False), ("u", with_previous(underlying, "instrument_id"), ["instrument_id"], True)):
        rows = as_of(rows, series, keys=keys, left_time="market_date", right_time="market_date", take={k: f"{name}{v}" for k, v in take.items()}, strict=strict)
    rates = with_previous(fx)
    rows = as_of(rows, rates, keys=[], left_time="market_date", right_time="market_date", take={k: f"f{v}" for k, v in take.items()}, strict=False)
    rows = as_of(rows, theoretical, keys=["instrument_id"], left_time="market_date", right_time="market_date", take={"theoretical_price": "theo"}, strict=False)
    actual, under, rate = (step_return(F.col(f"{x}c"), F.col(f"{x}p")) for x in "luf")
    expected = (1 + under) * (1 + rate) - 1
    return rows.select("instrument_id", "market_date", premium(F.col("lc"), F.col("theo")).alias("premium_discount"), expected.alias("expected_cedear_return"), actual.alias("actual_cedear_return"), (actual - expected).alias("local_underlying_divergence"))


def merval(spine: DataFrame, bars: DataFrame, symbol_id: int) -> DataFrame:
    """Return of the market series on a day that has a bar, from its bar before; other market series have no source."""
    w = Window.partitionBy("instrument_id").orderBy("market_date")
    series = bars.where(F.col("instrument_id") == symbol_id).withColumn("prev", F.lag("close").over(w)).select("market_date", step_return(F.col("close"), F.col("prev")).alias("merval_return_1d"))
    return spine.select("instrument_id", "market_date").join(series, "market_date", "left").select("instrument_id", "market_date", "merval_return_1d", *[F.lit(None).cast("double").alias(x) for x in FAMILIES["market"][1:]])


def snapshots(spine: DataFrame, local: DataFrame, underlying: DataFrame, fx: DataFrame, theoretical: DataFrame, merval_id: int = 0) -> DataFrame:
    """All features on each day of the spine; days on which nothing is known are left out."""
    rows = spine.select("instrument_id", "market_date")
    for prefix, bars in (("cedear", local), ("underlying", underlying)):
        names = FAMILIES[f"{prefix}_technical"]
        rows = as_of(rows, technical(bars, prefix), keys=["instrument_id"], left_time="market_date", right_time="market_date", take={x: x for x in names})
    rows = as_of(rows, fx_state(fx), keys=[], left_time="market_date", right_time="market_date", take={x: x for x in FAMILIES["fx"]})
    rows = rows.join(relative(spine, local, underlying, fx, theoretical), ["instrument_id", "market_date"]).join(merval(spine, local, merval_id), ["instrument_id", "market_date"])
    return rows.select("instrument_id", "market_date", *NAMES).where(F.coalesce(*NAMES).isNotNull())


def catalogue(spark) -> DataFrame:
    """The registered features: name, family, lookback in days, version."""
    rows = [(name, family, lookback(name), VERSION) for family, names in FAMILIES.items() for name in names]
    return spark.createDataFrame(rows, "name string, family string, lookback_days int, version string")


def lookback(name: str) -> int:
    digits = [int(x.rstrip("d")) for x in name.split("_") if x.rstrip("d").isdigit()]
    return max(digits) if digits else {"macd": ind.SLOW, "signal": ind.SLOW + ind.SIGNAL}.get(name.rsplit("_", 1)[-1], 1)


