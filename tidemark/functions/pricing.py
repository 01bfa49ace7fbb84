"""Prices, premia, roundings, costs and small presentation rules (Column to Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default costs, horizons in sessions, bands of a probability.
COMMISSION, SLIPPAGE = 0.005, 0.001
HORIZONS = {"1d": 1, "1w": 5, "1m": 21, "3m": 63, "6m": 126, "1y": 252, "2y": 504}
BANDS = (0.65, 0.55, 0.45, 0.35)
# End of fixed values.


def quantise_up(c: Column, places: int = 6) -> Column:
    return F.round(c.cast("decimal(38,12)"), places).cast(f"decimal(20,{places})")


def quantise_even(c: Column, places: int = 6) -> Column:
    return F.bround(c.cast("decimal(38,12)"), places).cast(f"decimal(20,{places})")


def theoretical_price(underlying: Column, rate: Column, ratio: Column) -> Column:
    return underlying * rate / F.nullif(ratio, F.lit(0))


def premium(local: Column, theoretical: Column) -> Column:
    """Relative distance of the local price from the theoretical one; null where either is unknown or the latter 0."""
    return (local - theoretical) / F.nullif(theoretical, F.lit(0.0))


def fold(start: Column, arr: Column, alpha: float) -> Column:
    return F.aggregate(arr, start, lambda acc, x: acc * (1 - alpha) + x * alpha)


def buy_price(price: Column, slippage: float = SLIPPAGE) -> Column:
    return price * (1 + slippage)


def sell_price(price: Column, slippage: float = SLIPPAGE) -> Column:
    return price * (1 - slippage)


def signal(probability: Column, threshold: float = 0.5) -> Column:
    return (probability >= threshold).cast("int")


def verdict(probability: Column) -> Column:
    """A word for P(up); the upper bands include their bound, the lower ones don't."""
    strong_up, up, neutral, down = BANDS
    words = F.when(probability >= strong_up, "strong up").when(probability >= up, "weak up").when(probability > neutral, "none").when(probability > down, "weak down")
    return F.when(probability.isNotNull(), words.otherwise("strong down"))


def safe_map(text: Column) -> Column:
    """A JSON object of numbers as a map; an empty map for anything else."""
    return F.coalesce(F.from_json(text, "map<string,double>"), F.create_map().cast("map<string,double>"))


def horizon_sessions(name: Column) -> Column:
    """Sessions of a horizon; an unknown one is an error."""
    known = F.create_map(*[F.lit(x) for kv in HORIZONS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, name), F.raise_error(F.concat(F.lit("unknown horizon: "), F.coalesce(name, F.lit("null")))).cast("int"))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def minus(value: Column) -> Column:
    """A minus for negative numbers, minus zero and what rounds to it included."""
    return F.when(value.cast("string").startswith("-"), "-").otherwise("")


def format_percent(fraction: Column, *, signed: bool = False) -> Column:
    """A fraction as a percentage with at most one decimal and ',' between thousands; a dash for null and non-finite ones.

    `signed` puts a plus before positive ones.
    """
    value = fraction.cast("double")
    digits = F.regexp_replace(F.format_number(F.round(F.abs(value * 100), 1), 1), r"\.0$", "")
    shown = F.concat(minus(value), digits, F.lit("%"))
    return F.when(finite(value), F.concat(F.when(value > 0, "+").otherwise(""), shown) if signed else shown).otherwise("—")


def format_amount(amount: Column) -> Column:
    """Pesos with two decimals, '.' between thousands and ',' before decimals; a dash for null and non-finite ones."""
    value = amount.cast("double")
    digits = F.translate(F.format_number(F.round(F.abs(value), 2), 2), ",.", ".,")
    return F.when(finite(value), F.concat(minus(value), F.lit("$\u00a0"), digits)).otherwise("—")


def format_compact(number: Column) -> Column:
    """A number with at most four decimals and ',' between thousands; a dash for null and non-finite ones."""
    value = number.cast("double")
    digits = F.regexp_replace(F.format_number(F.round(F.abs(value), 4), 4), r"\.?0+$", "")
    return F.when(finite(value), F.concat(minus(value), digits)).otherwise("—")
