"""Queries for scores, backtests and their metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import backtest as bt
from ..operators import evaluation as ev
from ..sources import domain_views as views
from ..sources.domain_views import table, with_views
from .registry import Registry

registry = Registry()
add = registry.add

SCORED = "(SELECT CAST(year(o_orderdate) AS INT) AS fold, o_orderkey, CAST(o_orderstatus = 'F' AS INT) AS y, ((o_orderkey % 1000) + 0.5::DOUBLE) / 1000 AS p FROM orders)"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and probabilities in yearly folds."""
    return table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("fold"), "o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (((F.col("o_orderkey") % 1000) + F.lit(0.5)) / 1000).alias("p"))


def close_to(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


SCORES = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "log_loss", "brier"]
CLASSIFY = f"""SELECT fold, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy,
  round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / (CAST(tp + fn > 0 AS INT) + CAST(tn + fp > 0 AS INT)), 6) AS balanced_accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(log_loss, 6) AS log_loss, round(brier, 6) AS brier
FROM (SELECT fold, count_if(y = 1 AND p >= 0.5)::DOUBLE AS tp, count_if(y = 0 AND p >= 0.5)::DOUBLE AS fp, count_if(y = 0 AND p < 0.5)::DOUBLE AS tn, count_if(y = 1 AND p < 0.5)::DOUBLE AS fn,
  -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss, avg(pow(p - y, 2)) AS brier FROM {SCORED} s GROUP BY fold) t"""


@add("a5_a8_classification", CLASSIFY)
def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_to(ev.classification(scored(spark, sf_dir), ["fold"]), *SCORES)


AUC = f"SELECT fold, round((sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2) / (n1 * n0), 6) AS roc_auc FROM (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2 AS r, sum(y) OVER (PARTITION BY fold)::DOUBLE AS n1, sum(1 - y) OVER (PARTITION BY fold)::DOUBLE AS n0 FROM {SCORED} s) t GROUP BY fold, n1, n0"


@add("a6_roc_auc", AUC)
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return close_to(ev.roc_auc(scored(spark, sf_dir), ["fold"]), "roc_auc")


@add("a3_majority", f"SELECT fold, avg(y) AS up_rate, CAST(sum(y) * 2 > count(*) AS INT) AS majority FROM {SCORED} s GROUP BY fold")
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.majority(scored(spark, sf_dir), ["fold"])


@add("a4_medians", with_views("SELECT instrument_id, coalesce(quantile_cont(close, 0.5), 0) AS close, coalesce(quantile_cont(CAST(volume AS DOUBLE), 0.5), 0) AS volume FROM v_local GROUP BY instrument_id"))
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.medians(views.local_bars(spark, sf_dir).withColumn("volume", F.col("volume").cast("double")), ["instrument_id"], ["close", "volume"])


@add("a9_majority_reference", f"SELECT t.fold, round(avg(CAST((r.rate >= 0.5) = (t.y = 1) AS INT)), 6) AS accuracy, round(avg(pow(r.rate - t.y, 2)), 6) AS brier FROM {SCORED} t JOIN (SELECT fold + 1 AS fold, avg(y) AS rate FROM {SCORED} s GROUP BY fold) r ON t.fold = r.fold GROUP BY t.fold")
def majority_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir)
    rate = ev.majority(rows, ["fold"]).select((F.col("fold") + 1).alias("fold"), F.col("up_rate").alias("p"))
    tested = rows.drop("p").join(rate, "fold")
    return close_to(ev.classification(tested, ["fold"]).select("fold", "accuracy", "brier"), "accuracy", "brier")


@add("a10_cross_fold_mean", f"SELECT round(avg(accuracy), 6) AS accuracy, round(avg(log_loss), 6) AS log_loss FROM ({CLASSIFY}) x")
def cross_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification(spark, sf_dir).agg(F.round(F.avg("accuracy"), 6).alias("accuracy"), F.round(F.avg("log_loss"), 6).alias("log_loss"))


@add("a17_up_rate", f"SELECT fold, avg(y) AS up_rate FROM {SCORED} s GROUP BY fold")
def up_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy("fold").agg(F.avg("y").alias("up_rate"))


# --- backtests: one run an instrument, signals from the day of the month -----------------------------------------------

BARS = "(SELECT instrument_id, market_date, close, CAST(day(market_date) % 3 > 0 AS INT) AS signal FROM v_local WHERE close IS NOT NULL)"
GROWTH = f"""eq AS (SELECT instrument_id, market_date, close, 1e6::DOUBLE * exp(coalesce(sum(ln(CASE WHEN ahead IS NOT NULL THEN trade * CASE WHEN signal = 1 THEN ahead / close ELSE 1 END END)) OVER (PARTITION BY instrument_id ORDER BY market_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS equity
FROM (SELECT *, CASE WHEN signal = 1 AND before = 0 THEN (1 - 0.005::DOUBLE) / (1 + 0.001::DOUBLE) WHEN signal = 0 AND before = 1 THEN (1 - 0.001::DOUBLE) * (1 - 0.005::DOUBLE) ELSE 1 END AS trade
FROM (SELECT *, coalesce(lag(signal) OVER w, 0) AS before, lead(close) OVER w AS ahead FROM {BARS} b WINDOW w AS (PARTITION BY instrument_id ORDER BY market_date)) c) d)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.local_bars(spark, sf_dir).where("close is not null").select("instrument_id", "market_date", "close", (F.dayofmonth("market_date") % 3 > 0).cast("int").alias("signal"))


def simulated(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return bt.simulate(bars(spark, sf_dir), ["instrument_id"], "market_date", **options)


def curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulated(spark, sf_dir).select("instrument_id", "market_date", "equity")


@add("b1_backtest_equity", with_views("SELECT instrument_id, market_date, round(ln(equity / 1e6), 6) AS log_growth FROM eq", GROWTH))
def backtest_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curve(spark, sf_dir).select("instrument_id", "market_date", F.round(F.ln(F.col("equity") / 1e6), 6).alias("log_growth"))


@add("b1_closed_form", with_views("SELECT instrument_id, market_date, round(ln(equity / 1e6), 6) AS log_growth FROM eq", GROWTH))
def closed_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.growth(bars(spark, sf_dir), ["instrument_id"], "market_date").select("instrument_id", "market_date", F.round(F.ln(F.col("equity") / 1e6), 6).alias("log_growth"))


HOLD = f"hold AS (SELECT instrument_id, market_date, CASE WHEN row_number() OVER w = 1 THEN 1e6::DOUBLE ELSE 1e6::DOUBLE * (1 - 0.005::DOUBLE) / (first_value(close) OVER w * (1 + 0.001::DOUBLE)) * close END AS equity FROM {BARS} b WINDOW w AS (PARTITION BY instrument_id ORDER BY market_date))"


@add("b2_buy_and_hold", with_views("SELECT instrument_id, market_date, round(equity, 2) AS equity FROM hold", HOLD))
def buy_and_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.buy_and_hold(bars(spark, sf_dir), ["instrument_id"], "market_date").select("instrument_id", "market_date", F.round("equity", 2).alias("equity"))


@add("b3_cash_curve", with_views(f"SELECT instrument_id, market_date, 1e6::DOUBLE AS equity FROM {BARS} b"))
def cash_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).select("instrument_id", "market_date", F.lit(bt.CAPITAL).alias("equity"))


UNDER = "(SELECT instrument_id, market_date, close FROM v_underlying)"


@add("b4_underlying_curve", with_views("SELECT instrument_id, market_date, round(equity, 2) AS equity FROM hold", HOLD.replace(BARS, UNDER)))
def underlying_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.buy_and_hold(views.underlying_bars(spark, sf_dir), ["instrument_id"], "market_date").select("instrument_id", "market_date", F.round("equity", 2).alias("equity"))


@add("b5_usd_curve", with_views("SELECT h.instrument_id, h.market_date, round(h.equity / f.close, 4) AS equity FROM hold h JOIN v_fx f ON h.market_date = f.market_date", HOLD))
def usd_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = views.fx(spark, sf_dir).withColumnRenamed("close", "rate")
    hold = bt.buy_and_hold(bars(spark, sf_dir), ["instrument_id"], "market_date")
    return hold.join(rates, "market_date").select("instrument_id", "market_date", F.round(F.col("equity") / F.col("rate"), 4).alias("equity"))


METRICS = ["log_return", "log_annualised", "volatility", "sharpe", "max_drawdown"]
METRICS_SQL = "SELECT instrument_id, round(ln(gain), 6) AS log_return, round(ln(gain) * 252 / n, 6) AS log_annualised, round(std * sqrt(252), 6) AS volatility, round(m / std * sqrt(252), 6) AS sharpe, round(dd, 6) AS max_drawdown FROM (SELECT instrument_id, max_by(equity, market_date) / min_by(equity, market_date) AS gain, count(step) AS n, nullif(stddev_samp(step), 0) AS std, avg(step) AS m, max(1 - equity / peak) AS dd FROM (SELECT *, equity / lag(equity) OVER w - 1 AS step, max(equity) OVER w AS peak FROM {} WINDOW w AS (PARTITION BY instrument_id ORDER BY market_date)) s GROUP BY instrument_id) t"


def shown(metrics: DataFrame) -> DataFrame:
    """The made-up prices jump, so returns are compared as logarithms."""
    logs = metrics.withColumn("log_return", F.ln("growth")).withColumn("log_annualised", F.ln("growth") * 252 / F.col("steps"))
    return close_to(logs.select("instrument_id", *METRICS), *METRICS)


@add("a11_backtest_metrics", with_views(METRICS_SQL.format("eq"), GROWTH))
def backtest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bt.curve_metrics(curve(spark, sf_dir), ["instrument_id"], "market_date"))


@add("a11_benchmark_metrics", with_views(METRICS_SQL.format("hold"), HOLD))
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(bt.curve_metrics(bt.buy_and_hold(bars(spark, sf_dir), ["instrument_id"], "market_date"), ["instrument_id"], "market_date"))


@add("a12_max_drawdown", with_views("SELECT instrument_id, max(1 - close / peak) AS max_drawdown FROM (SELECT *, max(close) OVER (PARTITION BY instrument_id ORDER BY market_date) AS peak FROM v_local WHERE close IS NOT NULL) t GROUP BY instrument_id"))
def max_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.drawdown(bars(spark, sf_dir), ["instrument_id"], "market_date", "close")


# a closed trade runs from the first bar of a stretch of signals to the first bar after it; its stake is the equity before entry less the fee
TRADES = f"""tr AS (SELECT instrument_id, entry_bar, exit_bar, e * (1 - 0.005::DOUBLE) * (x / (c * (1 + 0.001::DOUBLE)) * (1 - 0.001::DOUBLE) * (1 - 0.005::DOUBLE) - 1) AS pnl, x / (c * (1 + 0.001::DOUBLE)) * (1 - 0.001::DOUBLE) * (1 - 0.005::DOUBLE) - 1 AS gain
FROM (SELECT instrument_id, position AS entry_bar, equity AS e, close AS c, lead(position) OVER w AS exit_bar, lead(close) OVER w AS x, enters FROM
 (SELECT e.instrument_id, e.equity, e.close, row_number() OVER v - 1 AS position, signal = 1 AND coalesce(lag(signal) OVER v, 0) = 0 AS enters, signal = 0 AND coalesce(lag(signal) OVER v, 0) = 1 AS leaves, lead(e.close) OVER v IS NULL AS last
  FROM eq e JOIN {BARS} b ON e.instrument_id = b.instrument_id AND e.market_date = b.market_date WINDOW v AS (PARTITION BY e.instrument_id ORDER BY e.market_date)) a
 WHERE (enters OR leaves) AND NOT last WINDOW w AS (PARTITION BY instrument_id ORDER BY position)) t WHERE enters AND exit_bar IS NOT NULL)"""


@add("a11_trade_metrics", with_views("SELECT i.instrument_id, round(avg(CAST(pnl > 0 AS INT)), 6) AS win_rate, CAST(count(pnl) AS INT) AS trade_count, round(sum(CASE WHEN pnl > 0 THEN pnl END) / -sum(CASE WHEN pnl < 0 THEN pnl END), 6) AS profit_factor FROM (SELECT DISTINCT instrument_id FROM eq) i LEFT JOIN tr ON i.instrument_id = tr.instrument_id GROUP BY i.instrument_id", GROWTH, TRADES))
def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bt.trade_metrics(simulated(spark, sf_dir), ["instrument_id"]).drop("total_costs")
    return rows.select("instrument_id", F.round("win_rate", 6).alias("win_rate"), "trade_count", F.round("profit_factor", 6).alias("profit_factor"))


@add("b1_trades", with_views("SELECT instrument_id, CAST(entry_bar AS INT) AS entry_index, CAST(exit_bar AS INT) AS exit_index, round(gain, 6) AS gain FROM tr", GROWTH, TRADES))
def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.trades(simulated(spark, sf_dir), ["instrument_id"]).select("instrument_id", "entry_index", "exit_index", F.round(F.col("pnl") / (F.col("shares") * F.col("entry_price")), 6).alias("gain"))


def fold_sql(bars_sql: str, fraction: float, every: int) -> str:
    """SQL for the bars of a simulation: what is held, the entry's bar, the cash before each bar's decision."""
    return f"""n0 AS (SELECT *, row_number() OVER w - 1 AS i, lead(market_date) OVER w IS NULL AS last FROM {bars_sql} b WINDOW w AS (PARTITION BY instrument_id ORDER BY market_date)),
n1 AS (SELECT *, coalesce(last_value(CASE WHEN i % {every} = 0 AND NOT last THEN signal END IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY i), 0) AS held FROM n0),
n2 AS (SELECT *, coalesce(lag(held) OVER (PARTITION BY instrument_id ORDER BY i), 0) AS before FROM n1),
n3 AS (SELECT *, last_value(CASE WHEN held > before THEN close * (1 + 0.001::DOUBLE) END IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY i) AS paid FROM n2),
n4 AS (SELECT *, 1e6::DOUBLE * coalesce(product(CASE WHEN held < before THEN 1 - {fraction}::DOUBLE + {fraction}::DOUBLE * (1 - 0.005::DOUBLE) / paid * close * (1 - 0.001::DOUBLE) * (1 - 0.005::DOUBLE) END) OVER (PARTITION BY instrument_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS cash FROM n3),
sim AS (SELECT *, cash * CASE WHEN before = 1 THEN 1 - {fraction}::DOUBLE + {fraction}::DOUBLE * (1 - 0.005::DOUBLE) / paid * close ELSE 1 END AS equity, cash * {fraction}::DOUBLE * 0.005::DOUBLE AS fee,
  cash * {fraction}::DOUBLE * (1 - 0.005::DOUBLE) / paid * close * (1 - 0.001::DOUBLE) AS proceeds FROM n4)"""


RATED = f"(SELECT b.*, f.close AS rate FROM {BARS} b JOIN v_fx f ON b.market_date = f.market_date)"
USD = """SELECT instrument_id, round(ln(costs / 1e6), 6) AS log_costs, round(pnl / costs, 4) AS pnl_to_costs FROM (SELECT instrument_id,
  coalesce(sum(CASE WHEN held < before THEN (fee + proceeds * 0.005::DOUBLE) / rate END), 0) + sum(CASE WHEN last AND held = 1 THEN fee / rate ELSE 0 END) AS costs,
  coalesce(sum(CASE WHEN held < before THEN (proceeds * (1 - 0.005::DOUBLE) - fee * (1 - 0.005::DOUBLE) / 0.005::DOUBLE) / rate END), 0) AS pnl FROM sim GROUP BY instrument_id) t"""


@add("a18_usd_results", with_views(USD, fold_sql(RATED, 1.0, 1)))
def usd_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = views.fx(spark, sf_dir).withColumnRenamed("close", "rate")
    joined = bars(spark, sf_dir).join(rates, "market_date")
    found = bt.usd(bt.simulate(joined, ["instrument_id"], "market_date"), ["instrument_id"], "market_date")
    return found.select("instrument_id", F.round(F.ln(F.col("costs_usd") / 1e6), 6).alias("log_costs"), F.round(F.col("pnl_usd") / F.col("costs_usd"), 4).alias("pnl_to_costs"))


HALF = "SELECT instrument_id, market_date, CAST(held AS INT) AS position, round(ln(equity / 1e6), 6) AS log_growth, round(ln(CASE WHEN held > before THEN fee WHEN held < before THEN proceeds * 0.005::DOUBLE END), 6) AS log_costs FROM sim"


@add("b1_half_position", with_views(HALF, fold_sql(BARS, 0.5, 5)))
def half_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the cash at each entry, decisions every fifth bar."""
    rows = simulated(spark, sf_dir, fraction=0.5, holding_period=5)
    return rows.select("instrument_id", "market_date", "position", F.round(F.ln(F.col("equity") / 1e6), 6).alias("log_growth"), F.round(F.ln(F.when(F.col("costs") > 0, F.col("costs"))), 6).alias("log_costs"))


@add("b7_window_checks", with_views("SELECT instrument_id, CASE WHEN count(*) < 2 THEN 'too_few_bars' WHEN count(*) > 5000 THEN 'too_many_bars' WHEN count(close) < count(*) THEN 'bad_price' WHEN (count(*) - 1) % 5 <> 0 THEN 'signal_count' END AS error FROM v_local GROUP BY instrument_id"))
def window_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = views.local_bars(spark, sf_dir).groupBy("instrument_id").agg(F.collect_list(F.struct("close")).alias("b"))
    runs = packed.select("instrument_id", F.col("b.close").alias("prices"), F.array().cast("array<int>").alias("signals"))
    return bt.validate(runs, holding_period=5).select("instrument_id", "error")


#: A request for each order: windows of up to 12 days, each seventh of up to five years, some that end before they start.
ASKED = {
    "request_id": "o_orderkey",
    "symbol": "CASE WHEN o_orderkey % 31 = 0 THEN 'NONE' ELSE upper(n_name) END",
    "start": "CAST(o_orderdate AS DATE)",
    "end": "CAST(o_orderdate AS DATE) + CAST(o_orderkey % CASE WHEN o_orderkey % 7 = 0 THEN 1800 ELSE 13 END - 1 AS INT)",
    "holding_period": "CAST(1 + o_orderkey % 2 AS INT)",
    "n_signals": "CAST(o_custkey % 4 AS INT)",
}
WIDE = 1000
REQUESTS = ", ".join(f'{e} AS "{n}"' for n, e in ASKED.items())
WINDOWS = with_views(
    f"""SELECT request_id, bars, CASE WHEN start > "end" THEN 'invalid_window' WHEN instrument_id IS NULL THEN 'instrument_not_found' WHEN holes > 0 THEN 'insufficient_history'
  WHEN bars > {WIDE} THEN 'range_too_wide' WHEN bars < 2 THEN 'insufficient_history' WHEN n_signals * holding_period <> bars - 1 THEN 'signal_length_mismatch' END AS error
FROM (SELECT request_id, start, "end", holding_period, n_signals, i.instrument_id, CASE WHEN start <= "end" AND i.instrument_id IS NOT NULL THEN count(l.market_date) END AS bars, count(l.market_date) - count(l.close) AS holes
  FROM req r LEFT JOIN v_instruments i ON r.symbol = i.symbol LEFT JOIN v_local l ON l.instrument_id = i.instrument_id AND l.market_date BETWEEN r.start AND r."end" GROUP BY request_id, start, "end", holding_period, n_signals, i.instrument_id) t""",
    f"req AS (SELECT {REQUESTS} FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)",
)


@add("b7_request_errors", WINDOWS)
def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request judged against the stored bars of its window; windows of over 1000 bars are too wide."""
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    asked = joined.selectExpr(*[f"{e} AS `{n}`" for n, e in ASKED.items()]).withColumn("signals", F.array_repeat(F.lit(1), F.col("n_signals")))
    return bt.check_windows(asked, views.instruments(spark, sf_dir), views.local_bars(spark, sf_dir), most=WIDE).select("request_id", "bars", "error")


@add("b6_price_errors", with_views("SELECT instrument_id, CASE WHEN count(*) < 2 THEN 'too_few_prices' WHEN count(*) > count(close) OR min(close) <= 0 THEN 'bad_price' END AS error FROM v_local GROUP BY instrument_id UNION ALL SELECT 100 + instrument_id, CASE WHEN count(*) < 2 THEN 'too_few_prices' WHEN count(*) > count(close) OR min(close) <= 0 THEN 'bad_price' END FROM v_underlying GROUP BY instrument_id"))
def price_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local series, which have holes, and (from 100 on) foreign ones, which have none."""
    foreign = views.underlying_bars(spark, sf_dir).select((100 + F.col("instrument_id")).alias("instrument_id"), "close")
    return bt.price_errors(views.local_bars(spark, sf_dir).select("instrument_id", "close").unionByName(foreign), ["instrument_id"])


@add("a19_chart_extent", with_views("SELECT instrument_id, CASE WHEN max(close) = min(close) THEN min(close) - 1 ELSE min(close) - 0.05::DOUBLE * (max(close) - min(close)) END AS low, CASE WHEN max(close) = min(close) THEN max(close) + 1 ELSE max(close) + 0.05::DOUBLE * (max(close) - min(close)) END AS high FROM v_local GROUP BY instrument_id"))
def chart_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    lo, hi = F.min("close"), F.max("close")
    return views.local_bars(spark, sf_dir).groupBy("instrument_id").agg(F.when(hi == lo, lo - 1).otherwise(lo - F.lit(0.05) * (hi - lo)).alias("low"), F.when(hi == lo, hi + 1).otherwise(hi + F.lit(0.05) * (hi - lo)).alias("high"))


@add("f30_plot_scaling", with_views("SELECT instrument_id, market_date, (close - min(close) OVER w) / nullif(max(close) OVER w - min(close) OVER w, 0) * 100 AS y FROM v_local WHERE close IS NOT NULL WINDOW w AS (PARTITION BY instrument_id)"))
def plot_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("instrument_id")
    lo, hi = F.min("close").over(w), F.max("close").over(w)
    return bars(spark, sf_dir).select("instrument_id", "market_date", ((F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100).alias("y"))
