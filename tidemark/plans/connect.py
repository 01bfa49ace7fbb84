"""Queries for sources, streams and models."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as vo
from ..operators import evaluation as ev
from ..operators import features as fe
from ..operators import labels, models, training
from ..sources import catalogue_json, chart_json, html_tables, landed_charts
from ..sources import domain_views as views
from ..sources.domain_views import table, with_views
from ..storage import cut, shared_folder
from ..streaming import bars as stream
from .ingest import RECORD, RECORDS
from .market import snapshot_rows
from .registry import Registry

registry = Registry()
add = registry.add


# --- charts: each instrument's bars go out as one JSON payload and are read back ----------------------------------------


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.local_bars(spark, sf_dir).withColumn("t", F.unix_timestamp(F.col("market_date").cast("timestamp")) + 14 * 3600)
    packed = rows.groupBy("instrument_id").agg(F.sort_array(F.collect_list(F.struct("t", "open", "high", "low", "close", "volume"))).alias("b"))
    null = lambda c, kind: F.transform(F.col(f"b.{c}"), lambda x: F.coalesce(x.cast("string"), F.lit("null")))
    series = F.concat_ws(",", *[F.concat(F.lit(f'"{c}":['), F.array_join(null(c, "double"), ","), F.lit("]")) for c in ("open", "high", "low", "close", "volume")])
    meta = F.lit('"meta":{"currency":"ARS","exchangeTimezoneName":"America/Argentina/Buenos_Aires","symbol":"X"}')
    good = F.concat(F.lit('{"chart":{"result":[{'), meta, F.lit(',"timestamp":['), F.array_join(F.col("b.t").cast("array<string>"), ","), F.lit('],"indicators":{"quote":[{'), series, F.lit("}]}}],\"error\":null}}"))
    body = F.when(F.col("instrument_id") == 3, F.lit("no json")).when(F.col("instrument_id") == 4, F.lit('{"chart":{"result":[],"error":null}}')).when(F.col("instrument_id") == 5, F.lit('{"chart":{"result":null,"error":{"code":"Not Found"}}}')).when(F.col("instrument_id") == 6, F.regexp_replace(good, r'"timestamp":\[\d+,', '"timestamp":[')).otherwise(good)
    return packed.select(F.col("instrument_id").cast("string").alias("symbol"), body.alias("body"))


GOOD = "instrument_id NOT IN (3, 4, 5, 6)"


@add("src5_chart_bars", with_views(f"SELECT CAST(instrument_id AS VARCHAR) AS symbol, market_date, open, high, low, close, volume FROM v_local WHERE {GOOD} AND close IS NOT NULL"))
def chart_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_json.bars(chart_json.parse(payloads(spark, sf_dir))).select("symbol", "market_date", "open", "high", "low", "close", "volume")


@add("src5_chart_rejects", with_views(f"SELECT CAST(instrument_id AS VARCHAR) AS symbol, 'no_trade_slot' AS reason, count(*) AS slots FROM v_local WHERE {GOOD} AND close IS NULL GROUP BY 1"))
def chart_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_json.rejected(chart_json.parse(payloads(spark, sf_dir))).groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("slots"))


@add("src5_chart_errors", "SELECT CAST(n_nationkey AS VARCHAR) AS symbol, CASE n_nationkey WHEN 3 THEN 'not_json' WHEN 4 THEN 'no_result' WHEN 5 THEN 'chart_error' WHEN 6 THEN 'misaligned' END AS error FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey)")
def chart_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chart_json.parse(payloads(spark, sf_dir)).select("symbol", "error")


# --- payloads that landed as files: foreign and local series and rates of one folder, each read back under its own name -----

UNLANDED, UNROUTED, BROKEN = 7, 8, 9  # instruments without a file, without a known venue, with a body that is no JSON
WINDOW = ("1995-06-01", "1997-05-31")


def chart_body(rows: DataFrame, series: list[str], currency: Column, zone: Column) -> DataFrame:
    """One payload a ticker from `rows` (ticker, market_date, further columns); a series that is not given is absent."""
    instant = F.unix_seconds(F.col("market_date").cast("timestamp")) + 14 * 3600
    packed = rows.groupBy("ticker", zone.alias("zone"), currency.alias("currency")).agg(F.sort_array(F.collect_list(F.struct(instant.alias("t"), *series))).alias("b"))
    quote = F.struct(*[F.col(f"b.{c}").alias(c) for c in series])
    result = F.struct(F.struct("currency", F.col("zone").alias("exchangeTimezoneName"), F.col("ticker").alias("symbol")).alias("meta"), F.col("b.t").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    return packed.select("ticker", F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"}).alias("body"))


def wanted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    market = F.when(F.col("instrument_id") == UNROUTED, "UNKNOWN").otherwise(F.col("underlying_market"))
    return views.instruments(spark, sf_dir).withColumn("underlying_market", market)


def landing(spark: SparkSession, sf_dir: str) -> str:
    """A folder of payloads, one file a ticker."""
    wanted = wanted_series(spark, sf_dir)
    prices = ["open", "high", "low", "close", "volume"]
    market = F.col("underlying_market")
    money = F.when(market == "B3", "BRL").when(market == "XETRA", "EUR").when(market == "LSE", "GBP")
    foreign = views.underlying_bars(spark, sf_dir).join(wanted, "instrument_id").withColumn("ticker", vo.vendor_symbol(F.col("symbol"), market)).where(f"instrument_id <> {UNLANDED} AND ticker IS NOT NULL")
    broken = F.array(*[F.concat(F.col("symbol"), F.lit(s)) for s in set(vo.MARKET_SUFFIXES.values())])
    at_home = views.local_bars(spark, sf_dir).join(wanted, "instrument_id").withColumn("ticker", F.concat("symbol", F.lit(landed_charts.LOCAL_SUFFIX)))
    crossed = views.fx(spark, sf_dir).withColumn("ticker", F.lit(f"USDARS{landed_charts.CROSS_SUFFIX}"))
    home = F.lit("America/Argentina/Buenos_Aires")
    bad = wanted.where(f"instrument_id = {BROKEN}").select(F.explode(broken).alias("ticker")).withColumn("_bad", F.lit(True))
    files = chart_body(foreign, prices, money, vo.market_zone(market)).unionByName(chart_body(at_home, prices, F.lit("ARS"), home)).unionByName(chart_body(crossed, ["close"], F.lit("USD"), F.lit("Europe/London")))
    folder = f"{shared_folder(spark)}/charts-{uuid.uuid4().hex}"
    shown = files.join(bad, "ticker", "left").select("ticker", F.when(F.col("_bad"), "no json").otherwise(F.col("body")).alias("body"))
    shown.write.partitionBy("ticker").text(folder)
    return folder


USABLE = f"i.instrument_id NOT IN ({UNLANDED}, {UNROUTED}, {BROKEN})"
CURRENCY = "CASE i.underlying_market WHEN 'B3' THEN 'BRL' WHEN 'XETRA' THEN 'EUR' WHEN 'LSE' THEN 'GBP' ELSE 'USD' END"


@add("src7_underlying_series", with_views(f"SELECT i.symbol, u.market_date, u.open, u.high, u.low, u.close, u.volume, {CURRENCY} AS currency FROM v_underlying u JOIN v_instruments i ON u.instrument_id = i.instrument_id WHERE {USABLE}"))
def underlying_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = landed_charts.underlying(spark, landing(spark, sf_dir), wanted_series(spark, sf_dir))
    return found.bars.select("symbol", "market_date", "open", "high", "low", "close", "volume", "currency")


@add("src7_underlying_errors", with_views(f"SELECT symbol, CASE WHEN instrument_id = {UNROUTED} THEN 'unroutable' WHEN instrument_id = {UNLANDED} OR instrument_id NOT IN (SELECT s_nationkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey) THEN 'not_landed' ELSE 'not_json' END AS error FROM v_instruments WHERE instrument_id IN ({UNLANDED}, {UNROUTED}, {BROKEN}) OR instrument_id NOT IN (SELECT s_nationkey FROM supplier JOIN lineitem ON l_suppkey = s_suppkey)"))
def underlying_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed_charts.underlying(spark, landing(spark, sf_dir), wanted_series(spark, sf_dir)).errors


@add("src8_local_series", with_views(f"SELECT i.symbol, l.market_date, l.open, l.high, l.low, l.close, l.volume, 'ARS' AS currency FROM v_local l JOIN v_instruments i ON l.instrument_id = i.instrument_id WHERE l.close IS NOT NULL AND l.market_date BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'"))
def local_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two years of the local series."""
    found = landed_charts.local(spark, landing(spark, sf_dir), wanted_series(spark, sf_dir), start=WINDOW[0], end=WINDOW[1])
    return found.bars.select("symbol", "market_date", "open", "high", "low", "close", "volume", "currency")


@add("src8_local_rejects", with_views("SELECT i.symbol, CAST(l.market_date AS VARCHAR) || ' 14:00:00' AS slot, 'no_trade_slot' AS reason FROM v_local l JOIN v_instruments i ON l.instrument_id = i.instrument_id WHERE l.close IS NULL"))
def local_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = landed_charts.local(spark, landing(spark, sf_dir), wanted_series(spark, sf_dir))
    return found.rejected.select("symbol", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("slot"), "reason")


@add("src9_rate_series", with_views("SELECT 'USDARS' AS pair, market_date, close, 'ARS' AS currency FROM v_fx"))
def rate_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spark.createDataFrame([("USDARS",), ("EURARS",)], "pair string")
    return landed_charts.rates(spark, landing(spark, sf_dir), pairs).bars.select("pair", "market_date", "close", "currency")


@add("src2_charset_decode", "SELECT p_partkey, p_name || ' ñandú' AS text FROM part")
def charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" ñandú"))
    raw = F.when(F.col("p_partkey") % 2 == 0, F.encode(text, "UTF-8")).otherwise(F.encode(text, "ISO-8859-1"))
    return table(spark, sf_dir, "part").select("p_partkey", chart_json.decode(raw).alias("text"))


# --- catalogues and lists ---------------------------------------------------------------------------------------------


PAGE = 500  # records of one file or page


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", *[f"{e} AS {n}" for n, e in RECORD.items()])
    item = F.concat(F.lit("<ul><li><strong>NOMBRE: </strong>"), F.coalesce("name", F.lit("")), F.lit("</li><li><strong>Mercado de valor subyacente</strong>: "), F.when(F.col("pos") % 3 == 0, "Nasdaq GS").otherwise("none"), F.lit("</li><li><strong>Nombre</strong>: second</li><li>Ticker en mercado de or&iacute;gen: "), F.coalesce("underlying_symbol", F.lit("")), F.lit("</li></ul>"))
    product = F.struct(F.col("pos").cast("string").alias("id"), F.when(F.col("pos") % 50 > 0, F.concat(F.lit(" s"), F.col("pos").cast("string"))).alias("name"), item.alias("description"), F.col("p_brandname").alias("summary"), F.lit("Cedear Shares").alias("section"), F.concat(F.col("ratio").cast("int").cast("string"), F.lit(" :1")).alias("character"))
    return rows.withColumn("p_brandname", F.concat(F.lit("<b>"), "source_ref", F.lit("</b>"))).groupBy(F.floor(F.col("pos") / PAGE).alias("file")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(product)).alias("products"))).alias("body"))


@add("src10_catalogue_records", "SELECT 'S' || CAST(p_partkey AS VARCHAR) AS symbol, p_brand AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Nasdaq GS' ELSE 'none' END AS underlying_market_raw, CASE WHEN p_partkey % 7 > 0 THEN trim(p_name) END AS underlying_name, CASE WHEN p_partkey % 4 > 0 THEN CAST(1 + (p_partkey % 401) % 9 + (CASE WHEN p_partkey % 89 < 9 THEN 1 ELSE 0 END) AS DOUBLE) END AS ratio FROM part WHERE p_partkey % 50 > 0")
def catalogue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue_json.records(catalogue_json.products(catalogue(spark, sf_dir))).where("reason is null")
    return rows.select("symbol", "name", "underlying_market_raw", "underlying_name", F.col("ratio").cast("double").alias("ratio"))


@add("src10_catalogue_rejects", "SELECT 'missing_symbol' AS reason, count(*) AS rows FROM part WHERE p_partkey % 50 = 0 HAVING count(*) > 0")
def catalogue_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue_json.records(catalogue_json.products(catalogue(spark, sf_dir))).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: F.concat(F.lit("<td>"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("</td>"))
    rows = table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in RECORD.items()]).withColumn("r", F.concat(F.col("ratio").cast("int").cast("string"), F.lit(":1"))).withColumn("s", F.concat(F.lit("L"), F.col("pos").cast("string"))).withColumn("m", F.lit("NYSE"))
    body = F.concat(F.lit("<tr>"), *[cell(c) for c in ("name", "s", "underlying_symbol", "m", "r")], F.lit("</tr>"))
    head = "<html><table class='x'><tr><td>other</td></tr></table><table class=\"big tabla\"><thead><tr><th>CEDEAR de<br>Acciones</th><th>Símbolo BYMA</th><th>Ticker en Mercado de Origen</th><th>Mercado de Origen</th><th>Ratio CEDEARs / valor subyacente</th></tr></thead><tbody>"
    packed = rows.groupBy(F.floor(F.col("pos") / PAGE).alias("page_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", body.alias("b")))), lambda x: x["b"]), "\n").alias("b"))
    return packed.select("page_id", F.concat(F.lit(head), "b", F.lit("</tbody></table></html>")).alias("html"))


@add("src12_html_tables", f"SELECT CAST(p_partkey // {PAGE} AS BIGINT) AS page_id, CAST((count(*) + 1) * 5 AS BIGINT) AS cells FROM part GROUP BY 1")
def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tables.table_cells(list_pages(spark, sf_dir), "tabla").groupBy("page_id").agg(F.count(F.lit(1)).alias("cells"))


CELL_TEXT = f"""WITH {RECORDS}, r AS (SELECT CAST(pos // {PAGE} AS BIGINT) AS page_id, row_number() OVER (PARTITION BY pos // {PAGE} ORDER BY pos) AS row_no,
  [coalesce(name, ''), 'L' || CAST(pos AS VARCHAR), coalesce(underlying_symbol, ''), 'NYSE', coalesce(CAST(CAST(ratio AS INT) AS VARCHAR) || ':1', '')] AS texts FROM rec),
h AS (SELECT DISTINCT page_id, 0 AS row_no, ['CEDEAR de Acciones', 'Símbolo BYMA', 'Ticker en Mercado de Origen', 'Mercado de Origen', 'Ratio CEDEARs / valor subyacente'] AS texts FROM r)
SELECT page_id, CAST(row_no AS INT) AS row_no, CAST(i - 1 AS INT) AS col_no, row_no = 0 AS header, trim(regexp_replace(texts[i], '\\s+', ' ', 'g')) AS text
FROM (SELECT * FROM r UNION ALL SELECT * FROM h) t, range(1, 6) c(i)"""


@add("src12_cell_text", CELL_TEXT)
def html_cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of every page with its place and text."""
    return html_tables.table_cells(list_pages(spark, sf_dir), "tabla").select("page_id", "row_no", "col_no", "header", "text")


@add("src15_html_universe", "SELECT 'L' || CAST(p_partkey AS VARCHAR) AS symbol, 'STOCK' AS instrument_type, 'NYSE' AS underlying_market_raw, CASE WHEN p_partkey % 4 > 0 THEN CAST(1 + (p_partkey % 401) % 9 + (CASE WHEN p_partkey % 89 < 9 THEN 1 ELSE 0 END) AS DOUBLE) END AS ratio FROM part")
def html_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_tables.records(html_tables.labelled_rows(html_tables.table_cells(list_pages(spark, sf_dir), "tabla"))).where("reason is null")
    return rows.select("symbol", "instrument_type", "underlying_market_raw", F.col("ratio").cast("double").alias("ratio"))


@add("src13_html_text")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_tables.html_text("html").alias("text"))


# --- streams (not in the reference) ------------------------------------------------------------------------------------

DAILY = "SELECT event_type, CAST(ts AS DATE) AS market_date, min_by(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, max_by(value, (ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY 1, 2"


@add("x_stream_daily_bars", DAILY)
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.keep_table(stream.daily_bars(stream.ticks(spark, sf_dir)), ["event_type", "market_date"], ("open", "high", "low", "close", "ticks"))


# --- models -------------------------------------------------------------------------------------------------------------

CHOSEN = fe.FAMILIES["cedear_technical"]


def dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.local_bars(spark, sf_dir)
    state = fe.technical(bars, "cedear").select("instrument_id", "market_date", *CHOSEN)
    return labels.dataset(state, bars, "1d")


RUN = {"min_train": 60, "test": 20, "step": 20}
#: Rows with a label one session ahead, numbered by date, in the same folds; a day without close has the label of the close before it.
RATES = """lab AS (SELECT instrument_id, market_date, CAST(lead(close) OVER (PARTITION BY instrument_id ORDER BY market_date) > close AS INT) AS y FROM v_local WHERE close IS NOT NULL),
dat AS (SELECT l.instrument_id, l.market_date, b.y, row_number() OVER (PARTITION BY l.instrument_id ORDER BY l.market_date) - 1 AS pos, count(*) OVER (PARTITION BY l.instrument_id) AS n FROM v_local l ASOF JOIN lab b ON l.instrument_id = b.instrument_id AND l.market_date >= b.market_date WHERE b.y IS NOT NULL),
fol AS (SELECT instrument_id, CAST((e - 60) / 20 AS INT) AS fold, e FROM (SELECT instrument_id, unnest(range(60, n - 20 + 1, 20)) AS e FROM (SELECT DISTINCT instrument_id, n FROM dat) a) b)"""


@add("m1_majority_walk_forward", with_views("SELECT f.instrument_id, f.fold, round(avg(y) FILTER (WHERE pos < e), 9) AS p, round(avg(CAST((CASE WHEN pos >= e THEN y END) AS DOUBLE)), 9) AS up_rate FROM fol f JOIN dat d ON f.instrument_id = d.instrument_id AND pos < e + 20 GROUP BY 1, 2", RATES))
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = models.walk_forward(dataset(spark, sf_dir), CHOSEN[:1], ["instrument_id"], algorithm="majority", **RUN)
    return rows.groupBy("instrument_id", "fold").agg(F.round(F.first("p"), 9).alias("p"), F.round(F.avg("y"), 9).alias("up_rate"))


@add("m2_random_walk_forward")
def random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.walk_forward(dataset(spark, sf_dir), CHOSEN[:1], ["instrument_id"], algorithm="random", **RUN)


HORIZON = "1d"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of each day with the label one session ahead, and the horizon's geometry."""
    rows = labels.dataset(cut(snapshot_rows(spark, sf_dir)), views.local_bars(spark, sf_dir), HORIZON)
    shape = labels.geometry(spark).where(F.col("horizon") == HORIZON).drop("sessions")
    return cut(models.checked_rows(rows.withColumn("horizon", F.lit(HORIZON)).join(F.broadcast(shape), "horizon"), fe.NAMES))  # one row


def split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Training rows and the last test window of each instrument, as a sweep parts them."""
    rows = labelled(spark, sf_dir)
    plan = training.sweep_plan(rows.drop("min_train", "test_size", "step")).where("status <> 'skipped'").select(*training.KEY, "test_start_at")
    placed = rows.join(plan, training.KEY)
    return placed.where("position < test_start_at"), placed.where("position >= test_start_at")


def walked(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    return models.walk_forward(dataset(spark, sf_dir), CHOSEN, ["instrument_id"], algorithm=algorithm, **RUN)


@add("m3_logistic_walk_forward")
def logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(spark, sf_dir, "logistic")


@add("m4_boosted_trees")
def boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each instrument's ensemble on its last test window."""
    early, late = split(spark, sf_dir)
    fitted = models.fit(early, fe.NAMES, ["instrument_id"], algorithm="boosted_trees")
    served = models.score(fitted, late.select("instrument_id", "market_date", "label", *fe.NAMES), fe.NAMES, ["instrument_id"], "market_date")
    return served.select("instrument_id", "market_date", "label", F.col("p_up").alias("p"))


@add("m6_walk_forward_scores")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every fold beside those of the majority of its training part, and the means of each instrument's folds (fold null)."""
    by = ["instrument_id", "fold"]
    rows = cut(walked(spark, sf_dir, "logistic").where("p is not null"))
    own = ev.classification(rows, by).join(ev.roc_auc(rows, by), by)
    constant = ev.classification(rows.withColumn("p", F.col("majority_p")), by).select(*by, F.col("balanced_accuracy").alias("majority_balanced_accuracy"), F.col("log_loss").alias("majority_log_loss"))
    folds = own.join(constant, by)
    values = [c for c in folds.columns if c not in by]
    means = folds.groupBy("instrument_id").agg(*[F.avg(c).alias(c) for c in values])
    return folds.select(*by, *[F.col(c).cast("double").alias(c) for c in values]).unionByName(means.withColumn("fold", F.lit(None).cast("int")))


@add("m7_trained_models")
def trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.train(split(spark, sf_dir)[0], fe.NAMES, ["instrument_id"])


@add("m8_served_probability")
def served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored model of each instrument on its last test window; the plan fails on what is no probability."""
    early, late = split(spark, sf_dir)
    fitted = models.train(early, fe.NAMES, ["instrument_id"])
    found = models.serve(fitted, late.select("instrument_id", "market_date", *fe.NAMES), fe.NAMES, ["instrument_id"])
    return models.checked_scores(found, len(fe.NAMES)).select("instrument_id", "market_date", "p_up", "p_down")
