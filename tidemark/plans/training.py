"""Queries for training sweeps, demo backtests, orders of features, routes and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.pricing import HORIZONS
from ..operators import catalog, training
from ..operators import features as fe
from ..operators import reconcile as rc
from ..sources import domain_views as views
from ..sources.domain_views import table, with_views
from ..storage import cut
from .ingest import DEDUPED, RECORDS, deduped
from .registry import Registry

registry = Registry()
add = registry.add

CHOSEN = fe.FAMILIES["cedear_technical"]


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local features at each session, kept: what reads them has a plan of its own size."""
    return cut(fe.technical(views.local_bars(spark, sf_dir), "cedear").select("instrument_id", "market_date", *CHOSEN))


# --- sweeps -------------------------------------------------------------------------------------------------------------

#: Labelled rows of each horizon, with the smallest training part and the test size as the rule gives them.
SWEEP = (
    "hs AS (SELECT * FROM (VALUES ('1d', 1), ('1w', 5), ('1m', 21), ('3m', 63), ('6m', 126), ('1y', 252), ('2y', 504)) t(horizon, k))",
    "num AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY market_date) AS r FROM v_local WHERE close IS NOT NULL)",
    "lab AS (SELECT a.instrument_id, h.horizon, a.market_date, CAST(b.close > a.close AS INT) AS y FROM num a CROSS JOIN hs h LEFT JOIN num b ON a.instrument_id = b.instrument_id AND b.r = a.r + h.k)",
    "asked AS (SELECT l.instrument_id, l.market_date, h.horizon FROM v_local l CROSS JOIN hs h)",
    "dat AS (SELECT q.*, y, row_number() OVER (PARTITION BY q.instrument_id, q.horizon ORDER BY q.market_date) - 1 AS pos, count(*) OVER (PARTITION BY q.instrument_id, q.horizon) AS n FROM asked q ASOF JOIN lab b ON q.instrument_id = b.instrument_id AND q.horizon = b.horizon AND q.market_date >= b.market_date WHERE y IS NOT NULL)",
    "placed AS (SELECT d.*, greatest(252, 4 * k) AS least_train, greatest(63, k) AS tested, n - greatest(63, k) AS cut_at FROM dat d JOIN hs USING (horizon))",
)
SWEPT = """SELECT instrument_id, horizon, n, CASE WHEN ok THEN least_train + CAST(floor((cut_at - least_train) / tested) AS INT) * tested END AS cover,
  CASE WHEN ok THEN d0 END AS train_start, CASE WHEN ok THEN d1 END AS train_end, CASE WHEN ok THEN d2 END AS test_start, CASE WHEN ok THEN d3 END AS test_end,
  CASE WHEN ok THEN round(up, 9) END AS test_up_rate, CASE WHEN NOT ok THEN 'skipped' WHEN classes < 2 THEN 'failed' ELSE 'ready' END AS status
FROM (SELECT instrument_id, horizon, n, least_train, tested, cut_at, n >= least_train + tested AS ok, min(market_date) AS d0, max(market_date) FILTER (WHERE pos < cut_at) AS d1,
    min(market_date) FILTER (WHERE pos >= cut_at) AS d2, max(market_date) AS d3, avg(y) FILTER (WHERE pos >= cut_at) AS up, count(DISTINCT y) FILTER (WHERE pos < cut_at) AS classes
  FROM placed GROUP BY ALL) s"""


@add("m7_sweep_plan", with_views(SWEPT, *SWEEP))
def sweep_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.local_bars(spark, sf_dir)
    rows = training.datasets(bars.select("instrument_id", "market_date"), bars, sorted(HORIZONS))
    return training.sweep_plan(rows).select("instrument_id", "horizon", "n", "cover", "train_start", "train_end", "test_start", "test_end", F.round("test_up_rate", 9).alias("test_up_rate"), "status")


@add("o6_sweep_outcomes")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = training.train_sweep(states(spark, sf_dir), views.local_bars(spark, sf_dir), CHOSEN)
    return found["outcomes"].join(found["runs"].drop("status", "notes"), training.KEY, "left")


@add("o6_sweep_boosted_trees")
def tree_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sweep with boosted trees, of a short and of the longest horizon."""
    found = training.train_sweep(states(spark, sf_dir), views.local_bars(spark, sf_dir), CHOSEN, horizons=["1m", "2y"], algorithm="boosted_trees")
    return found["outcomes"].join(found["runs"].drop("status", "notes"), training.KEY, "left")


@add("b8_demo_backtests")
def demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of every horizon; the closes have holes, so bars without close are left out first."""
    state, bars = states(spark, sf_dir), views.local_bars(spark, sf_dir).where("close is not null")
    found = training.train_sweep(state, bars, CHOSEN)
    return training.demo_backtests(cut(found["models"]), state, bars, CHOSEN)["outcomes"]


# --- vectors, routes and audits ---------------------------------------------------------------------------------------

LIVE = "SELECT p_partkey AS id, p_size % 3 AS kind, CAST(p_size AS DOUBLE) AS b, p_retailprice AS a FROM part"


@add("prj3_feature_order", f"SELECT id, CASE WHEN kind = 0 THEN 'b,a' WHEN kind = 1 THEN 'a,b' END AS vector_order, CASE WHEN kind = 0 THEN b WHEN kind = 1 THEN a END AS head, CASE WHEN kind = 2 THEN 'feature_mismatch' END AS error FROM ({LIVE}) t")
def feature_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that knows the live names in its own order, one that knows others, and one of another width."""
    live = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).alias("kind"), F.create_map(F.lit("b"), F.col("p_size").cast("double"), F.lit("a"), F.col("p_retailprice").cast("double")).alias("values"))
    names = F.when(F.col("kind") == 0, F.array(F.lit("b"), F.lit("a"))).when(F.col("kind") == 1, F.array(F.lit("x"), F.lit("y"))).otherwise(F.array(F.lit("x"), F.lit("y"), F.lit("z")))
    made = training.ordered_vector(live.withColumn("names", names))
    good = F.col("error").isNull()
    return made.select("id", F.when(good, F.array_join("order", ",")).alias("vector_order"), F.get("vector", F.lit(0)).alias("head"), "error")


ROUTED = {
    "symbol": "concat('S', CAST(p_partkey AS STRING))",
    "underlying_symbol": "CASE WHEN p_partkey % 11 = 0 THEN ' ' WHEN p_partkey % 13 > 0 THEN p_brand END",
    "underlying_market": "CASE WHEN p_partkey % 7 = 0 THEN 'UNKNOWN' WHEN p_partkey % 5 > 0 THEN 'NYSE' END",
}


@add("flt8_venue_routes", "SELECT symbol, CASE WHEN coalesce(trim(underlying_symbol), '') = '' THEN 'no_underlying_symbol' WHEN underlying_market IS NULL THEN 'no_underlying_market' WHEN underlying_market = 'UNKNOWN' THEN 'unknown_underlying_market' END AS warning FROM (SELECT " + ", ".join(f"{e} AS {n}" for n, e in ROUTED.items()) + " FROM part) t")
def venue_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in ROUTED.items()])
    return catalog.route_venues(rows).select("symbol", "warning")


@add("flt4_equality_filters", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def equality_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return catalog.where_equal(rows, c_mktsegment="BUILDING", c_nationkey=3, c_custkey=None)


@add("f35_reject_audit", f"WITH {RECORDS}, {DEDUPED} SELECT provider, symbol, verdict AS reason, source_ref, ratio, underlying_symbol FROM ded WHERE verdict IS NOT NULL")
def reject_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excerpt is read back from its JSON to be compared."""
    parts = F.from_json("detail", "source_ref string, ratio double, underlying_symbol string")
    return rc.rejects(deduped(spark, sf_dir)).select("provider", "symbol", "reason", F.inline(F.array(parts)))
