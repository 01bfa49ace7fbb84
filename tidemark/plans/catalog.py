"""Queries of the read side over the domain views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as ca
from ..operators import temporal
from ..sources import domain_views as views
from ..sources.domain_views import table, with_views
from .ingest import RECORDS, records
from .market import THEO_STEP, theoretical_rows
from .registry import Registry

registry = Registry()
add = registry.add
DAY = "DATE '1999-06-30'"

INSTRUMENTS = "ins AS (SELECT CAST(p_partkey AS BIGINT) AS instrument_id, concat('P', CAST(p_partkey AS STRING)) AS symbol, p_name AS name, upper(p_brand) AS underlying_symbol, CASE WHEN p_size > 25 THEN 'STOCK' ELSE 'ETF' END AS instrument_type, p_partkey % 4 > 0 AS is_active, CASE WHEN p_size % 2 = 0 THEN 'NYSE' ELSE 'LSE' END AS underlying_market FROM part)"


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS instrument_id", "concat('P', CAST(p_partkey AS STRING)) AS symbol", "p_name AS name", "upper(p_brand) AS underlying_symbol", "CASE WHEN p_size > 25 THEN 'STOCK' ELSE 'ETF' END AS instrument_type", "p_partkey % 4 > 0 AS is_active", "CASE WHEN p_size % 2 = 0 THEN 'NYSE' ELSE 'LSE' END AS underlying_market")


@add("flt1_universe_filter", f"WITH {INSTRUMENTS} SELECT instrument_id, symbol FROM ins WHERE is_active AND instrument_type = 'STOCK' AND underlying_market = 'NYSE'")
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.universe(instruments(spark, sf_dir), active=True, kind="STOCK", market="nyse").select("instrument_id", "symbol")


@add("flt2_search", f"WITH {INSTRUMENTS} SELECT instrument_id, symbol FROM ins WHERE upper(symbol) LIKE '%9A%' OR upper(name) LIKE '%RE%' OR upper(underlying_symbol) LIKE '%RE%' OR upper(symbol) LIKE '%RE%'".replace("upper(symbol) LIKE '%9A%' OR ", ""))
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.universe(instruments(spark, sf_dir), search="re").select("instrument_id", "symbol")


@add("flt3_date_range", with_views("SELECT instrument_id, market_date, close FROM v_local WHERE market_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"))
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.local_bars(spark, sf_dir).select("instrument_id", "market_date", "close")
    return ca.between(bars, "market_date", F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))


@add("flt6_drop_null_closes", with_views("SELECT instrument_id, market_date, close FROM v_local WHERE close IS NOT NULL"))
def null_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.local_bars(spark, sf_dir).where("close is not null").select("instrument_id", "market_date", "close")


@add("flt7_reject_split", with_views("SELECT instrument_id, market_date, CASE WHEN close IS NULL THEN 'no_trade_slot' WHEN volume IS NULL THEN 'no_volume' END AS reason FROM v_local WHERE close IS NULL OR volume IS NULL"))
def reject_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("close").isNull(), "no_trade_slot").when(F.col("volume").isNull(), "no_volume")
    return views.local_bars(spark, sf_dir).select("instrument_id", "market_date", reason.alias("reason")).where("reason is not null")


@add("flt10_unknown_symbols", f"WITH {INSTRUMENTS}, {RECORDS} SELECT DISTINCT replace(symbol, 'S', 'P') AS symbol FROM rec WHERE replace(symbol, 'S', 'P') NOT IN (SELECT symbol FROM ins WHERE is_active)")
def unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = records(spark, sf_dir).select(F.replace("symbol", F.lit("S"), F.lit("P")).alias("symbol")).distinct()
    return ca.unknown(asked, instruments(spark, sf_dir).where("is_active"), "symbol")


@add("flt11_point_lookup", f"WITH {INSTRUMENTS} SELECT instrument_id, symbol, name FROM ins WHERE symbol = 'P7'")
def point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.point(instruments(spark, sf_dir), "symbol", " p7 ").select("instrument_id", "symbol", "name")


@add("a1_filtered_count", f"WITH {INSTRUMENTS} SELECT count(*) AS rows FROM ins WHERE is_active AND instrument_type = 'ETF'")
def filtered_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.universe(instruments(spark, sf_dir), active=True, kind="ETF").agg(F.count(F.lit(1)).alias("rows"))


@add("a2_session_dates", with_views("SELECT DISTINCT market_date FROM v_local"))
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.local_bars(spark, sf_dir).select("market_date").distinct()


@add("a20_latest_instant", "SELECT max(ts) AS latest FROM events")
def latest_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.latest_instant(table(spark, sf_dir, "events"), "ts")


@add("t1_page_symbols", f"WITH {INSTRUMENTS} SELECT symbol, name FROM ins ORDER BY symbol LIMIT 20 OFFSET 40")
def page_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.page(instruments(spark, sf_dir).select("symbol", "name"), ["symbol"], 20, 40)


@add("t1_page_bars", with_views("SELECT market_date, close FROM v_local WHERE instrument_id = 3 ORDER BY market_date DESC LIMIT 50 OFFSET 10"))
def page_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.page(views.local_bars(spark, sf_dir).where("instrument_id = 3").select("market_date", "close"), [F.desc("market_date")], 50, 10)


@add("t2_newest_per_instrument", with_views("SELECT instrument_id, market_date, close FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY market_date DESC) AS n FROM v_local) t WHERE n <= 30"))
def newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.newest(views.local_bars(spark, sf_dir).select("instrument_id", "market_date", "close"), ["instrument_id"], "market_date", 30)


@add("t3_latest_on_or_before", with_views(f"SELECT instrument_id, max(market_date) AS market_date, arg_max_null(close, market_date) AS close FROM v_local WHERE market_date <= {DAY} GROUP BY instrument_id"))
def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.latest(views.local_bars(spark, sf_dir).select("instrument_id", "market_date", "close"), ["instrument_id"], "market_date", F.expr(DAY))


@add("t5_first_runs", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) t WHERE n <= 5")
def first_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.newest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 5)


@add("t6_first_appearance", f"WITH {RECORDS} SELECT symbol, min(pos) AS first_pos FROM rec GROUP BY symbol")
def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("symbol").agg(F.min("pos").alias("first_pos"))


@add("prj1_instrument_summary", with_views(f"SELECT i.instrument_id, i.symbol, CAST(r.ratio AS INT) AS ratio, CAST(r.ratio AS VARCHAR) || ':1' AS ratio_text FROM v_instruments i LEFT JOIN v_ratio r ON i.instrument_id = r.instrument_id AND r.effective_from <= {DAY} AND (r.effective_to IS NULL OR r.effective_to > {DAY})"))
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.with_ratio(views.instruments(spark, sf_dir).select("instrument_id", "symbol"), views.ratio_history(spark, sf_dir), F.expr(DAY))


@add("j7_runs_with_models", "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def runs_with_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@add("j8_backtests_with_instrument", with_views("SELECT i.symbol, l.market_date, l.close FROM v_local l LEFT JOIN v_instruments i ON l.instrument_id = i.instrument_id"))
def with_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.local_bars(spark, sf_dir).join(views.instruments(spark, sf_dir), "instrument_id", "left").select("symbol", "market_date", "close")


#: A stored run for each order; parameters as JSON of every kind.
STORED = {
    "id": "o_orderkey",
    "instrument_id": "o_custkey % 25",
    "start_date": "CAST(o_orderdate AS DATE)",
    "end_date": "CAST(o_orderdate AS DATE) + 30",
    "n_bars": "CAST(o_orderkey % 30 AS INT)",
    "params": """CASE o_orderkey % 7 WHEN 0 THEN concat('{"holding_period": ', CAST(o_custkey % 20 AS STRING), '}') WHEN 1 THEN '{"holding_period": "5"}' WHEN 2 THEN '{"holding_period": 2.5}'
  WHEN 3 THEN '{"threshold": 0.5}' WHEN 4 THEN '{"holding_period": null}' WHEN 5 THEN '{"holding_period": [3]}' END""",
    "total_costs": "o_totalprice",
    "metrics": "concat('{\"sharpe\": ', CAST(o_orderkey % 9 AS STRING), '}')",
}


@add("prj2_backtest_summary", with_views("SELECT o_orderkey AS id, symbol, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) + 30 AS end_date, CAST(o_orderkey % 30 AS INT) AS n_bars, CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 20 ELSE 1 END AS INT) AS holding_period, o_totalprice AS total_costs, concat('{\"sharpe\": ', CAST(o_orderkey % 9 AS VARCHAR), '}') AS metrics FROM orders LEFT JOIN v_instruments ON instrument_id = o_custkey % 25"))
def backtest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").selectExpr(*[f"{e} AS {n}" for n, e in STORED.items()])
    return ca.backtest_summaries(runs, views.instruments(spark, sf_dir))


@add("prj2_theoretical", with_views("SELECT instrument_id, market_date, theoretical_price, premium_discount, CASE WHEN ratio_used IS NULL THEN '' ELSE CAST(CAST(ratio_used AS INT) AS VARCHAR) || ':1' END AS ratio_used_formatted FROM theo", THEO_STEP))
def shown_theoretical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.shown_theoretical(theoretical_rows(spark, sf_dir)).select("instrument_id", "market_date", "theoretical_price", "premium_discount", "ratio_used_formatted")


@add("j9_models_with_runs", "SELECT c_custkey, CAST(count(o_orderkey) AS INT) AS runs, min(o_orderkey) AS first_run, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS listed FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def models_with_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    rows = ca.nested(table(spark, sf_dir, "customer").select("c_custkey"), runs, "c_custkey", ["o_orderkey"], "runs")
    ids = F.col("runs.o_orderkey")
    return rows.select("c_custkey", F.size("runs").alias("runs"), F.try_element_at(ids, F.lit(1)).alias("first_run"), F.array_join(ids, ",").alias("listed"))


@add("j10_instrument_history", with_views("SELECT i.instrument_id, coalesce(string_agg(CAST(r.ratio AS VARCHAR), ',' ORDER BY r.effective_from), '') AS ratios FROM v_instruments i LEFT JOIN v_ratio r ON i.instrument_id = r.instrument_id GROUP BY i.instrument_id"))
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ca.nested(views.instruments(spark, sf_dir).select("instrument_id"), views.ratio_history(spark, sf_dir), "instrument_id", ["effective_from"], "periods")
    return rows.select("instrument_id", F.array_join(F.col("periods.ratio").cast("array<string>"), ",").alias("ratios"))


SNAPS = "sn AS (SELECT instrument_id, market_date FROM v_local WHERE instrument_id % 3 > 0 OR day(market_date) <> 13)"


@add("j12_complete_runs", with_views("SELECT instrument_id, count(*) AS bars FROM v_local WHERE instrument_id NOT IN (SELECT l.instrument_id FROM v_local l LEFT JOIN sn ON l.instrument_id = sn.instrument_id AND l.market_date = sn.market_date WHERE sn.market_date IS NULL) GROUP BY instrument_id", SNAPS))
def complete_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.local_bars(spark, sf_dir).select("instrument_id", "market_date")
    snaps = bars.where("instrument_id % 3 > 0 OR day(market_date) <> 13")
    return ca.complete_runs(bars, snaps, ["instrument_id"], "market_date").groupBy("instrument_id").agg(F.count(F.lit(1)).alias("bars"))


@add("j13_actual_and_theoretical", with_views("SELECT l.instrument_id, l.market_date, l.close AS actual, t.theoretical_price AS theoretical, t.premium_discount AS premium FROM v_local l JOIN theo t ON l.instrument_id = t.instrument_id AND l.market_date = t.market_date", THEO_STEP))
def actual_and_theoretical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ca.actual_and_theoretical(views.local_bars(spark, sf_dir), theoretical_rows(spark, sf_dir))


@add("j15_symbol_semi_join", with_views("SELECT instrument_id, market_date FROM v_local WHERE instrument_id IN (SELECT instrument_id FROM v_instruments WHERE underlying_market = 'NYSE')"))
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.local_bars(spark, sf_dir).select("instrument_id", "market_date").join(views.instruments(spark, sf_dir).where("underlying_market = 'NYSE'"), "instrument_id", "left_semi")


@add("o4_calendar_spine", with_views("SELECT instrument_id, CAST(unnest(generate_series(min(market_date), max(market_date), INTERVAL 1 DAY)) AS DATE) AS market_date FROM v_local GROUP BY instrument_id"))
def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.calendar(views.local_bars(spark, sf_dir), ["instrument_id"])
