"""Indicators over arrays of the newest bars, oldest first (Column to Column).

All arrays of a bar come from one window specification, so a plan has one sort and one window for all indicators of a series.
Arrays hold no nulls: a missing value is dropped after the window has been cut, and takes one of its places.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bars in a window, sessions a year, spans of the indicators.
BARS, FX_BARS, YEAR = 100, 70, 252
WILDER, FAST, SLOW, SIGNAL, VOLATILITY = 14, 12, 26, 9, 20
# End of fixed values.


def enough(arr: Column, n: int, value: Column) -> Column:
    return F.when(F.size(arr) >= n, value)


def back(arr: Column, k: int) -> Column:
    """The element k before the last; null where there is none."""
    return F.try_element_at(arr, F.lit(-(k + 1)))


def tail(arr: Column, k: int) -> Column:
    return F.slice(arr, F.greatest(F.lit(1), F.size(arr) - k + 1), F.lit(k))


def change(arr: Column, k: int) -> Column:
    base = back(arr, k)
    return (back(arr, 0) - base) / F.nullif(base.cast("double"), F.lit(0.0))


def mean(arr: Column, k: int) -> Column:
    return enough(arr, k, total(tail(arr, k)) / k)


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def ewm(arr: Column, alpha: float) -> Column:
    """Exponential mean, begun with the first element."""
    rest = F.slice(arr, F.lit(2), F.greatest(F.lit(0), F.size(arr) - 1))
    return F.aggregate(rest, F.try_element_at(arr, F.lit(1)), lambda acc, x: acc * (1 - alpha) + x * alpha)


def ema(arr: Column, k: int) -> Column:
    """Exponential mean of the last k elements only."""
    return enough(arr, k, ewm(tail(arr, k), 2 / (k + 1)))


def steps(arr: Column) -> Column:
    """Differences of neighbours."""
    n = F.greatest(F.lit(0), F.size(arr) - 1)
    return F.zip_with(F.slice(arr, F.lit(2), n), F.slice(arr, F.lit(1), n), lambda x, y: x - y)


def returns(arr: Column) -> Column:
    n = F.greatest(F.lit(0), F.size(arr) - 1)
    return F.zip_with(F.slice(arr, F.lit(2), n), F.slice(arr, F.lit(1), n), lambda x, y: x / F.nullif(y, F.lit(0.0)) - 1)


def deviation(arr: Column) -> Column:
    """Sample standard deviation in one pass; null for fewer than two elements or a null among them."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def step(acc: Column, x: Column) -> Column:
        n, d = acc["n"] + 1, x - acc["m"]
        m = acc["m"] + d / n
        return F.struct(n.alias("n"), m.alias("m"), (acc["q"] + d * (x - m)).alias("q"))

    return F.aggregate(arr, start, step, lambda end: F.when(end["n"] >= 2, F.sqrt(end["q"] / (end["n"] - 1))))


def volatility(arr: Column, least: int = VOLATILITY + 1) -> Column:
    """Yearly deviation of the last returns; a zero close among their bases makes it null."""
    return enough(arr, least, deviation(returns(tail(arr, VOLATILITY + 1))) * math.sqrt(YEAR))


def rsi(arr: Column, period: int = WILDER) -> Column:
    """Wilder's relative strength of the moves between neighbours, in one pass."""
    a = 1 / period
    start = F.struct(F.try_element_at(arr, F.lit(1)).alias("x"), F.lit(None).cast("double").alias("g"), F.lit(None).cast("double").alias("l"))

    def mean_of(before: Column, x: Column) -> Column:
        return F.when(before.isNull(), x).otherwise(before * (1 - a) + x * a)

    def step(state: Column, x: Column) -> Column:
        move = x - state["x"]
        return F.struct(x.alias("x"), mean_of(state["g"], F.greatest(move, F.lit(0.0))).alias("g"), mean_of(state["l"], F.greatest(-move, F.lit(0.0))).alias("l"))

    def value(end: Column) -> Column:
        flat = F.when(end["g"] > 0, 100.0).otherwise(50.0)
        return F.when(end["l"] == 0, flat).otherwise(100 - 100 / (1 + end["g"] / F.nullif(end["l"], F.lit(0.0))))

    return enough(arr, period + 1, F.aggregate(F.slice(arr, F.lit(2), F.greatest(F.lit(0), F.size(arr) - 1)), start, step, value))


def macd(arr: Column) -> tuple[Column, Column]:
    """Line and signal, in one pass over the window."""
    first = F.try_element_at(arr, F.lit(1))
    start = F.struct(first.alias("f"), first.alias("s"), F.lit(0.0).alias("g"))
    a, b, c = (2 / (n + 1) for n in (FAST, SLOW, SIGNAL))

    def step(state: Column, x: Column) -> Column:
        f, s = state["f"] * (1 - a) + x * a, state["s"] * (1 - b) + x * b
        return F.struct(f.alias("f"), s.alias("s"), (state["g"] * (1 - c) + (f - s) * c).alias("g"))

    end = F.aggregate(F.slice(arr, F.lit(2), F.greatest(F.lit(0), F.size(arr) - 1)), start, step)
    return enough(arr, SLOW, end["f"] - end["s"]), enough(arr, SLOW + SIGNAL - 1, end["g"])


def atr(high: Column, low: Column, close: Column, period: int = WILDER) -> Column:
    """Wilder's mean of true ranges; the three series are aligned at their ends after each has lost its nulls."""
    n = F.least(F.size(high), F.size(low), F.size(close))
    last = lambda arr: F.slice(arr, F.greatest(F.lit(1), F.size(arr) - n + 1), n)
    h, lo, c = last(high), last(low), last(close)
    rows = F.arrays_zip(h.alias("h"), lo.alias("l"), F.concat(F.array(F.lit(None).cast("double")), F.slice(c, F.lit(1), F.greatest(F.lit(0), n - 1))).alias("p"))
    ranges = F.transform(rows, lambda x: F.greatest(F.abs(x["h"] - x["l"]), F.abs(x["h"] - x["p"]), F.abs(x["l"] - x["p"])))
    return F.when(n >= period + 1, ewm(ranges, 1 / period))
