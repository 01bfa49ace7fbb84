"""Long/flat backtests, benchmarks and their metrics.

The simulation is a set of windows over the bars of each run in order: positions carry the last decision, trades lie between entries
and exits, and the cash is the running product of what each closed trade kept. One exchange and one sort serve all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.indicators import YEAR
from ..functions.pricing import COMMISSION, SLIPPAGE, finite
from ..functions.vocabulary import normalise_symbol

CAPITAL = 1_000_000.0


def simulate(rows: DataFrame, by: list[str], order: str, *, price: str = "close", signal: str = "signal", capital: float = CAPITAL, commission: float = COMMISSION, slippage: float = SLIPPAGE, fraction: float = 1.0, holding_period: int | Column = 1) -> DataFrame:
    """Adds to each bar: bar_index, position (after its decision), equity (at its close), trade (where one closes), costs, open_fee.

    The signal of bar i decides at its close, if i is a multiple of the holding period; a null signal decides nothing. An entry
    puts `fraction` of the cash into shares, an exit sells all; the last bar never trades, and an open position is marked at its
    close. `costs` are those paid at the bar; `open_fee` is the entry fee of a position that the last bar still holds, else 0.
    """
    w = Window.partitionBy(*by).orderBy(order)
    sofar, earlier = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    p = F.col(price).cast("double")
    every = F.lit(holding_period) if isinstance(holding_period, int) else holding_period
    bars = rows.withColumn("bar_index", (F.row_number().over(w) - 1).cast("int")).withColumn("_last", F.lead(order).over(w).isNull())
    decision = F.when((F.col("bar_index") % every == 0) & ~F.col("_last"), (F.col(signal) == 1).cast("int"))
    bars = bars.withColumn("position", F.coalesce(F.last(decision, ignorenulls=True).over(sofar), F.lit(0)))
    bars = bars.withColumn("_before", F.coalesce(F.lag("position").over(w), F.lit(0)))
    enters, leaves = F.col("position") > F.col("_before"), F.col("position") < F.col("_before")
    entry = F.last(F.when(enters, F.struct(F.col("bar_index").alias("i"), (p * (1 + slippage)).alias("paid"))), ignorenulls=True)
    bars = bars.withColumn("_entry", entry.over(sofar)).withColumn("_sold", p * (1 - slippage))
    shares = fraction * (1 - commission) / F.col("_entry.paid")  # for each unit of the cash before the entry
    kept = F.when(leaves, F.ln(1 - fraction + shares * F.col("_sold") * (1 - commission)))
    bars = bars.withColumn("_cash", capital * F.exp(F.coalesce(F.sum(kept).over(earlier), F.lit(0.0))))
    fee = F.col("_cash") * fraction * commission
    proceeds = F.col("_cash") * shares * F.col("_sold")
    out = proceeds * commission
    trade = F.struct(
        F.col("_entry.i").alias("entry_index"), F.col("bar_index").alias("exit_index"), F.col("_entry.paid").alias("entry_price"), F.col("_sold").alias("exit_price"),
        (F.col("_cash") * shares).alias("shares"), (fee + out).alias("costs"), ((proceeds - out) - (F.col("_cash") * fraction - fee)).alias("pnl"),
    )
    return bars.select(
        *rows.columns,
        "bar_index",
        "position",
        (F.col("_cash") * F.when(F.col("_before") == 1, 1 - fraction + shares * p).otherwise(1.0)).alias("equity"),
        F.when(leaves, trade).alias("trade"),
        F.when(enters, fee).when(leaves, out).otherwise(0.0).alias("costs"),
        F.when(F.col("_last") & (F.col("position") == 1), fee).otherwise(0.0).alias("open_fee"),
    )


def trades(simulated: DataFrame, by: list[str]) -> DataFrame:
    """One row for each closed trade."""
    return simulated.where("trade IS NOT NULL").select(*by, "trade.*")


def packed(simulated: DataFrame, by: list[str], order: str, *, price: str = "close", signal: str = "signal") -> DataFrame:
    """One row a run, as it is stored: bars, prices, signals, equity, positions (all but the last bar's), trades, total_costs, open_fee."""
    bar = F.struct(order, F.col(price).cast("double").alias("p"), F.col(signal).cast("int").alias("s"), F.col("equity").alias("e"), F.col("position").alias("h"), F.col("trade").alias("t"))
    runs = simulated.groupBy(*by).agg(F.array_sort(F.collect_list(bar), lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)).alias("b"), F.sum("costs").alias("total_costs"), F.sum("open_fee").alias("open_fee"))
    arrays = {"prices": F.col("b.p"), "signals": F.col("b.s"), "bars": F.col(f"b.{order}"), "equity": F.col("b.e"), "positions": F.slice(F.col("b.h"), 1, F.size("b") - 1), "trades": F.array_compact(F.col("b.t"))}
    return runs.select(*by, *[c.alias(n) for n, c in arrays.items()], "total_costs", "open_fee")


def growth(rows: DataFrame, by: list[str], order: str, *, price: str = "close", signal: str = "signal", commission: float = COMMISSION, slippage: float = SLIPPAGE) -> DataFrame:
    """The equity of a fully invested run in closed form: the running product of one factor a bar, for runs of any length."""
    w = Window.partitionBy(*by).orderBy(order)
    before, ahead = F.coalesce(F.lag("held").over(w), F.lit(0)), F.lead(price).over(w)
    rows = rows.withColumn("last", ahead.isNull()).withColumn("held", F.when(~F.col("last"), F.col(signal)))
    trade = F.when((F.col("held") == 1) & (before == 0), (1 - commission) / (1 + slippage)).when((F.col("held") == 0) & (before == 1), (1 - slippage) * (1 - commission)).otherwise(1.0)
    factor = trade * F.when(F.col("held") == 1, ahead / F.col(price)).otherwise(1.0)
    rows = rows.withColumn("factor", F.when(~F.col("last"), factor))
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(*by, order, (CAPITAL * F.exp(F.coalesce(F.sum(F.ln("factor")).over(earlier), F.lit(0.0)))).alias("equity"))


def buy_and_hold(rows: DataFrame, by: list[str], order: str, *, price: str = "close", capital: float = CAPITAL, commission: float = COMMISSION, slippage: float = SLIPPAGE) -> DataFrame:
    """All capital into shares at the first close, with costs; the first point is the cash."""
    w = Window.partitionBy(*by).orderBy(order)
    first = F.first(price).over(w)
    shares = capital * (1 - commission) / (first * (1 + slippage))
    return rows.select(*by, order, F.when(F.row_number().over(w) == 1, capital).otherwise(shares * F.col(price)).alias("equity"))


def drawdown(curve: DataFrame, by: list[str], order: str, equity: str = "equity") -> DataFrame:
    peak = F.max(equity).over(Window.partitionBy(*by).orderBy(order))
    return curve.withColumn("_drop", 1 - F.col(equity) / peak).groupBy(*by).agg(F.max("_drop").alias("max_drawdown"))


def curve_metrics(curve: DataFrame, by: list[str], order: str, equity: str = "equity") -> DataFrame:
    """Growth, total and yearly return, volatility, Sharpe ratio and drawdown of each curve; null where a flat curve has none."""
    w = Window.partitionBy(*by).orderBy(order)
    steps = curve.withColumn("_step", F.col(equity) / F.lag(equity).over(w) - 1).withColumn("_drop", 1 - F.col(equity) / F.max(equity).over(w))
    total = steps.groupBy(*by).agg((F.max_by(equity, order) / F.min_by(equity, order)).alias("_gain"), F.count("_step").alias("_n"), F.nullif(F.stddev_samp("_step"), F.lit(0.0)).alias("_std"), F.avg("_step").alias("_mean"), F.max("_drop").alias("max_drawdown"))
    year = F.sqrt(F.lit(float(YEAR)))
    return total.select(*by, F.col("_gain").alias("growth"), F.col("_n").alias("steps"), (F.col("_gain") - 1).alias("total_return"), (F.pow("_gain", YEAR / F.col("_n")) - 1).alias("annualised_return"), (F.col("_std") * year).alias("volatility"), (F.col("_mean") / F.col("_std") * year).alias("sharpe"), "max_drawdown")


def trade_metrics(simulated: DataFrame, by: list[str]) -> DataFrame:
    """Win rate, mean result, profit factor and count of each run's closed trades, and its costs."""
    pnl = F.col("trade.pnl")
    loss = -F.sum(F.when(pnl < 0, pnl))
    won = F.coalesce(F.sum(F.when(pnl > 0, pnl)), F.lit(0.0))
    return simulated.groupBy(*by).agg(F.avg((pnl > 0).cast("int")).alias("win_rate"), F.count(pnl).cast("int").alias("trade_count"), F.avg(pnl).alias("average_trade"), (won / loss).alias("profit_factor"), F.sum("costs").alias("total_costs"))


def usd(simulated: DataFrame, by: list[str], order: str, rate: str = "rate") -> DataFrame:
    """Costs and results in dollars: each closed trade at the rate of its exit, the fee of an open position at the last rate."""
    at = F.col(rate)
    costs = F.coalesce(F.sum(F.col("trade.costs") / at), F.lit(0.0)) + F.max_by(F.col("open_fee") / at, order)
    return simulated.groupBy(*by).agg(costs.alias("costs_usd"), F.coalesce(F.sum(F.col("trade.pnl") / at), F.lit(0.0)).alias("pnl_usd"))


def validate(df: DataFrame, prices: str = "prices", signals: str = "signals", holding_period: int = 1, most: int = 5000) -> DataFrame:
    """The reason why a run cannot be simulated, or null."""
    p, n = F.col(prices), F.size(prices)
    bad = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x <= 0))
    return df.withColumn("error", F.when(n < 2, "too_few_bars").when(n > most, "too_many_bars").when(bad, "bad_price").when((n - 1) % holding_period != 0, "signal_count").when(F.exists(signals, lambda x: x.isNull() | ~x.isin(0, 1)), "bad_signal"))


def check_windows(requests: DataFrame, instruments: DataFrame, bars: DataFrame, *, price: str = "close", most: int = 5000) -> DataFrame:
    """Requests for backtests (symbol, start, end, holding_period, signals) with `bars`, the stored bars of the window, and `error`.

    The first that applies, or null: invalid_window (start after end, or one is null), instrument_not_found (a symbol may be
    written in any way), insufficient_history (a bar without a price), range_too_wide, insufficient_history (under two bars),
    signal_length_mismatch (not one signal for each holding period). No signals count as an empty array.

    Windows are counted by running counts at their edges, so long windows cost no more than short ones, and the days of an
    instrument that many requests name are sorted once.
    """
    named = instruments.select(F.col("symbol").alias("_symbol"), F.col("instrument_id").alias("_id"))
    asked = requests.withColumn("_symbol", normalise_symbol(F.col("symbol"))).join(named, "_symbol", "left")
    asked = asked.withColumn("_left", F.when(F.col("start") <= F.col("end"), F.date_sub("start", 1))).withColumn("_right", F.when(F.col("start") <= F.col("end"), F.col("end")))
    edges = asked.select("_id", F.explode(F.array("_left", "_right")).alias("_day")).where("_id IS NOT NULL AND _day IS NOT NULL").distinct()
    kept = bars.select(F.col("instrument_id").alias("_id"), F.col("market_date").alias("_day"), F.lit(1).alias("_n"), F.col(price).isNull().cast("int").alias("_holes"))
    days = kept.unionByName(edges.select("_id", "_day", F.lit(0).alias("_n"), F.lit(0).alias("_holes"))).groupBy("_id", "_day").agg(F.sum("_n").alias("_n"), F.sum("_holes").alias("_holes"))
    sofar = Window.partitionBy("_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    counts = days.select("_id", "_day", F.sum("_n").over(sofar).alias("_n"), F.sum("_holes").over(sofar).alias("_holes"))
    for side in ("_left", "_right"):
        asked = asked.join(counts.select("_id", F.col("_day").alias(side), F.col("_n").alias(f"{side}_n"), F.col("_holes").alias(f"{side}_holes")), ["_id", side], "left")
    n, holes = F.col("_right_n") - F.col("_left_n"), F.col("_right_holes") - F.col("_left_holes")
    needed = F.coalesce(F.array_size("signals"), F.lit(0)) * F.coalesce("holding_period", F.lit(1))
    error = (
        F.when(F.col("_right").isNull(), "invalid_window")
        .when(F.col("_id").isNull(), "instrument_not_found")
        .when(holes > 0, "insufficient_history")
        .when(n > most, "range_too_wide")
        .when(n < 2, "insufficient_history")
        .when(needed != n - 1, "signal_length_mismatch")
    )
    return asked.select(*requests.columns, n.alias("bars"), error.alias("error"))


def unusable(price: Column) -> Column:
    """Whether a price is null, not finite or not above zero."""
    value = price.cast("double")
    return ~finite(value) | (value <= 0)


def price_errors(rows: DataFrame, by: list[str], price: str = "close") -> DataFrame:
    """Why the prices of a key make no series, or null: too_few_prices, bad_price."""
    return rows.groupBy(*by).agg(F.when(F.count(F.lit(1)) < 2, "too_few_prices").when(F.count_if(unusable(F.col(price))) > 0, "bad_price").alias("error"))


def checked_prices(rows: DataFrame, by: list[str], price: str = "close") -> DataFrame:
    """The rows, in a plan that fails at a key whose prices make no series; later windows over the same key use its exchange."""
    many = F.count(F.lit(1)).over(Window.partitionBy(*by)) >= 2
    few = F.raise_error(F.lit(f"{price} needs at least 2 prices")).cast("double")
    bad = F.raise_error(F.lit(f"{price} must be finite and above zero")).cast("double")
    return rows.withColumn(price, F.when(~many, few).when(unusable(F.col(price)), bad).otherwise(F.col(price).cast("double")))
