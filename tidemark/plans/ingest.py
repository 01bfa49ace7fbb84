"""Queries for reconciling sources, idempotent writes and constraints.

Records of two sources are made from the parts, the same expressions in both engines; stored and incoming states are two
readings of the domain views.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as ca
from ..operators import constraints as co
from ..operators import reconcile as rc
from ..operators import runs, sinks
from ..operators import upsert as up
from ..sources import domain_views as views
from ..sources.domain_views import table, with_views
from ..storage import shared_folder
from .market import THEO_STEP, snapshot_rows, theoretical_rows
from .registry import Registry

registry = Registry()
add = registry.add

#: Expressions that both engines read; five or so records a symbol, with holes, repeats and disputes.
RECORD = {
    "pos": "p_partkey",
    "rank": "CAST(CAST(floor(p_partkey / 401.0) AS BIGINT) % 2 AS INT)",
    "provider": "CASE WHEN CAST(floor(p_partkey / 401.0) AS BIGINT) % 2 = 0 THEN 'alpha' ELSE 'beta' END",
    "symbol": "concat('S', CAST(p_partkey % 401 AS STRING))",
    "name": "CASE WHEN p_partkey % 7 > 0 THEN p_name END",
    "instrument_type": "CASE WHEN p_partkey % 3 = 0 THEN 'UNKNOWN' WHEN p_size > 25 THEN 'STOCK' ELSE 'ETF' END",
    "underlying_symbol": "CASE WHEN p_partkey % 5 > 0 THEN concat('U', CAST(p_partkey % 401 + (CASE WHEN p_partkey % 97 = 0 THEN 1 ELSE 0 END) AS STRING)) END",
    "ratio": "CASE WHEN p_partkey % 4 > 0 THEN CAST(1 + (p_partkey % 401) % 9 + (CASE WHEN p_partkey % 89 < 9 THEN 1 ELSE 0 END) AS DOUBLE) END",
    "isin": "CASE WHEN p_partkey % 6 = 0 THEN concat('I', CAST(p_partkey AS STRING)) END",
    "program_status": "CASE WHEN p_partkey % 2 = 0 THEN 'ACTIVE' ELSE 'UNKNOWN' END",
    "source_ref": "p_brand",
}
RECORDS = "rec AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in RECORD.items()) + " FROM part)"
SCORE = " + ".join(f"CASE WHEN {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '' THEN 1 ELSE 0 END" for c in rc.COMPLETENESS if c in RECORD)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{e} AS {n}" for n, e in RECORD.items()])


@add("set1_union_snapshots", f"WITH {RECORDS} SELECT pos, provider, symbol, name, ratio FROM rec WHERE rank = 0 UNION ALL SELECT pos, provider, symbol, NULL, ratio FROM rec WHERE rank = 1")
def union_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("pos", "provider", "symbol", "rank", "name", "ratio")
    return rc.union_snapshots([rows.where("rank = 0"), rows.where("rank = 1").drop("name")]).drop("rank")


DEDUPED = f"""ded AS (SELECT *, CASE WHEN n = 1 THEN NULL WHEN ratios > 1 THEN 'conflicting_ratios' WHEN rated = 1 AND ratio IS NOT NULL THEN NULL
  WHEN rated <> 1 AND place = 1 THEN NULL WHEN rated = 1 THEN 'superseded_by_ratio_bearing_record' ELSE 'duplicate_record' END AS verdict
FROM (SELECT *, count(*) OVER g AS n, count(DISTINCT ratio) OVER g AS ratios, count(ratio) OVER g AS rated, row_number() OVER (PARTITION BY provider, symbol ORDER BY {SCORE} DESC, pos) AS place
  FROM rec WINDOW g AS (PARTITION BY provider, symbol)) t)"""


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.dedupe(records(spark, sf_dir))


@add("set5_dedupe_source", f"WITH {RECORDS}, {DEDUPED} SELECT pos, provider, symbol, verdict FROM ded")
def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, sf_dir).select("pos", "provider", "symbol", "verdict")


@add("a15_completeness", f"WITH {RECORDS} SELECT pos, CAST({SCORE} AS INT) AS score FROM rec")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return rows.select("pos", rc.completeness(rows.columns).alias("score"))


@add("t4_most_complete", f"WITH {RECORDS} SELECT symbol, pos FROM (SELECT symbol, pos, row_number() OVER (PARTITION BY symbol ORDER BY {SCORE} DESC, pos) AS place FROM rec) t WHERE place = 1")
def most_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return rows.groupBy("symbol").agg(F.min_by("pos", F.struct((-rc.completeness(rows.columns)).alias("s"), "pos")).alias("pos"))


@add("a14_duplicate_symbols", f"WITH {RECORDS} SELECT provider, symbol, count(*) AS records FROM rec GROUP BY provider, symbol HAVING count(*) > 1")
def duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.duplicated(records(spark, sf_dir))


MERGED_FIELDS = [f for f in rc.FIELDS if f in RECORD]


def _informative(f: str) -> str:
    return f"{f} IS NOT NULL AND {f} <> 'UNKNOWN'" if f in rc.SILENT_UNKNOWN else f"{f} IS NOT NULL"


def _merged_sql() -> str:
    first = {f: f"min_by({f}, rank * 1000000000 + pos) FILTER (WHERE {_informative(f)})" for f in MERGED_FIELDS}
    out = [f"CASE WHEN count(DISTINCT {f}) <= 1 THEN {q} END AS {f}" if f in rc.MUST_AGREE else f"coalesce({q}, 'UNKNOWN') AS {f}" if f in rc.SILENT_UNKNOWN else f"{q} AS {f}" for f, q in first.items()]
    return f"SELECT symbol, min_by(provider, rank * 1000000000 + pos) AS custodian, {', '.join(out)} FROM ded WHERE verdict IS NULL GROUP BY symbol"


def merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.merge(deduped(spark, sf_dir).where("verdict is null").drop("verdict"))


@add("set2_field_merge", f"WITH {RECORDS}, {DEDUPED} {_merged_sql()}")
def field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(spark, sf_dir).select("symbol", "custodian", *MERGED_FIELDS)


_disputes = " UNION ALL ".join(f"SELECT symbol, 'conflicting_{f}' AS reason FROM ded WHERE verdict IS NULL GROUP BY symbol HAVING count(DISTINCT {f}) > 1" for f in rc.MUST_AGREE)


@add("set3_quarantine", f"WITH {RECORDS}, {DEDUPED} {_disputes}")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.quarantine(merged(spark, sf_dir))


@add("a16_published_values", f"WITH {RECORDS} SELECT symbol, count(DISTINCT ratio) AS ratios, count(DISTINCT underlying_symbol) AS underlyings FROM rec GROUP BY symbol")
def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("symbol").agg(F.count_distinct("ratio").alias("ratios"), F.count_distinct("underlying_symbol").alias("underlyings"))


EXTRAS = """SELECT symbol, '{' || string_agg('"' || key || '":"' || v || '"', ',' ORDER BY key) || '}' AS extra FROM (SELECT symbol, key, min_by(v, rank * 1000000000 + pos) AS v
  FROM (SELECT symbol, rank, pos, provider || '.code' AS key, source_ref AS v FROM rec UNION ALL SELECT symbol, rank, pos, provider || '.k' || CAST(pos % 3 AS VARCHAR), coalesce(isin, '-') FROM rec) p GROUP BY symbol, key) f GROUP BY symbol"""


@add("set4_merge_extras", f"WITH {RECORDS} {EXTRAS}")
def extras(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("extra", F.create_map(F.lit("code"), F.col("source_ref"), F.concat(F.lit("k"), (F.col("pos") % 3).cast("string")), F.coalesce("isin", F.lit("-"))))
    return rc.merge_extras(rows).select("symbol", F.to_json("extra").alias("extra"))


@add("set6_missing_sources", f"WITH {RECORDS} SELECT provider FROM (VALUES ('alpha'), ('beta'), ('gamma')) e(provider) WHERE provider NOT IN (SELECT provider FROM rec)")
def missing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rc.missing_sources(spark.createDataFrame([("alpha",), ("beta",), ("gamma",)], "provider string"), records(spark, sf_dir))


# --- writes ------------------------------------------------------------------------------------------------------------

OLD_BARS = "(SELECT * FROM v_local WHERE market_date < DATE '1999-01-01')"
NEW_BARS = "(SELECT instrument_id, market_date, open, high, low, CASE WHEN day(market_date) % 5 = 0 THEN close + 1 ELSE close END AS close, volume + 7 AS volume FROM v_local WHERE market_date >= DATE '1998-06-01' AND day(market_date) % 3 > 0)"


def stored_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.local_bars(spark, sf_dir).where("market_date < DATE '1999-01-01'")


def incoming_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.local_bars(spark, sf_dir).where("market_date >= DATE '1998-06-01' AND day(market_date) % 3 > 0")
    return rows.withColumn("close", F.when(F.dayofmonth("market_date") % 5 == 0, F.col("close") + 1).otherwise(F.col("close"))).withColumn("volume", F.col("volume") + 7)


UPSERTED = f"""SELECT coalesce(o.instrument_id, n.instrument_id) AS instrument_id, coalesce(o.market_date, n.market_date) AS market_date,
  CASE WHEN n.market_date IS NOT NULL THEN n.close ELSE o.close END AS close, CASE WHEN n.market_date IS NOT NULL THEN n.volume ELSE o.volume END AS volume,
  CASE WHEN n.market_date IS NULL THEN 'kept' WHEN o.market_date IS NULL THEN 'inserted' WHEN o.open IS DISTINCT FROM n.open OR o.high IS DISTINCT FROM n.high OR o.low IS DISTINCT FROM n.low OR o.close IS DISTINCT FROM n.close THEN 'updated' ELSE 'unchanged' END AS change
FROM {OLD_BARS} o FULL JOIN {NEW_BARS} n ON o.instrument_id = n.instrument_id AND o.market_date = n.market_date"""


@add("snk1_bar_upsert", with_views(UPSERTED))
def bar_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.upsert_bars(stored_bars(spark, sf_dir), incoming_bars(spark, sf_dir)).select("instrument_id", "market_date", "close", "volume", "change")


@add("a13_write_tallies", with_views(f"SELECT 'local' AS series, count_if(change = 'inserted') AS inserted, count_if(change = 'updated') AS updated FROM ({UPSERTED}) t"))
def write_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.tallies(up.upsert_bars(stored_bars(spark, sf_dir), incoming_bars(spark, sf_dir)), "local")


@add("snk2_fx_upsert", with_views("SELECT 'USDARS' AS pair, market_date, CASE WHEN month(market_date) = 3 THEN close * 2 ELSE close END AS close, CASE WHEN month(market_date) = 3 THEN 'updated' WHEN year(market_date) >= 1999 THEN 'inserted' ELSE 'kept' END AS change FROM v_fx WHERE month(market_date) = 3 OR year(market_date) < 1999 OR month(market_date) = 4".replace("WHEN month(market_date) = 3 THEN 'updated' WHEN year(market_date) >= 1999 THEN 'inserted'", "WHEN year(market_date) >= 1999 THEN 'inserted' WHEN month(market_date) = 3 THEN 'updated' WHEN month(market_date) = 4 THEN 'unchanged'")))
def fx_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = views.fx(spark, sf_dir).select(F.lit("USDARS").alias("pair"), F.lit("synthetic").alias("source"), "market_date", "close")
    incoming = rates.where("month(market_date) IN (3, 4)").withColumn("close", F.when(F.month("market_date") == 3, F.col("close") * 2).otherwise(F.col("close")))
    return up.upsert_rates(rates.where("year(market_date) < 1999"), incoming).select("pair", "market_date", "close", "change")


def theoretical_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = theoretical_rows(spark, sf_dir)
    return rows.where("year(market_date) < 1999"), rows.where("month(market_date) < 4").withColumn("fx_used", F.col("fx_used") * F.lit(2.0))


THEO_CHANGES = "SELECT instrument_id, market_date, CASE WHEN month(market_date) < 4 THEN fx_used * 2 ELSE fx_used END AS fx_used, CASE WHEN month(market_date) >= 4 THEN 'kept' WHEN year(market_date) < 1999 THEN 'updated' ELSE 'inserted' END AS change FROM theo WHERE year(market_date) < 1999 OR month(market_date) < 4"


@add("snk3_theoretical_upsert", with_views(THEO_CHANGES, THEO_STEP))
def theoretical_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = theoretical_states(spark, sf_dir)
    return runs.theoretical_run(old, new, new)["theoretical"].select("instrument_id", "market_date", "fx_used", "change")


STORED_SQL = "st AS (SELECT concat('S', CAST(c_custkey AS VARCHAR)) AS symbol, CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'UNKNOWN' ELSE 'STOCK' END AS instrument_type, 'old' AS custodian, c_custkey % 5 > 0 AS is_active, TIMESTAMP '2026-01-01 00:00:00' AS last_seen_at FROM customer)"


def stored_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("concat('S', CAST(c_custkey AS STRING)) AS symbol", "CASE WHEN c_custkey % 4 > 0 THEN c_name END AS name", "CASE WHEN c_custkey % 3 = 0 THEN 'UNKNOWN' ELSE 'STOCK' END AS instrument_type", "'old' AS custodian", "c_custkey % 5 > 0 AS is_active", "TIMESTAMP_NTZ '2026-01-01 00:00:00' AS last_seen_at")


@add("snk4_instrument_upsert", f"""WITH {RECORDS}, {DEDUPED}, {STORED_SQL}, inc AS ({_merged_sql()})
SELECT coalesce(st.symbol, inc.symbol) AS symbol, coalesce(inc.name, st.name) AS name, coalesce(nullif(inc.instrument_type, 'UNKNOWN'), st.instrument_type, 'UNKNOWN') AS instrument_type,
  CASE WHEN inc.symbol IS NOT NULL THEN inc.custodian ELSE st.custodian END AS custodian, inc.symbol IS NOT NULL OR st.is_active AS is_active,
  CASE WHEN inc.symbol IS NOT NULL THEN TIMESTAMP '2026-02-01 00:00:00' ELSE st.last_seen_at END AS last_seen_at,
  CASE WHEN inc.symbol IS NULL THEN 'kept' WHEN st.symbol IS NULL THEN 'inserted' ELSE 'updated' END AS change
FROM st FULL JOIN inc ON st.symbol = inc.symbol""")
def instrument_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return up.upsert_instruments(stored_instruments(spark, sf_dir), merged(spark, sf_dir), F.lit("2026-02-01 00:00:00").cast("timestamp_ntz"))


INCOMING_RATIO = "SELECT instrument_id, CASE WHEN instrument_id % 4 = 0 THEN NULL WHEN instrument_id % 4 = 1 THEN ratio ELSE ratio + 1 END AS ratio FROM v_ratio WHERE effective_to IS NULL"


@add("snk5_scd2_ratio", with_views(f"""SELECT r.instrument_id, r.effective_from, CASE WHEN r.effective_to IS NULL AND i.ratio <> r.ratio THEN DATE '2005-01-01' ELSE r.effective_to END AS effective_to, r.ratio,
  CASE WHEN r.effective_to IS NULL AND i.ratio <> r.ratio THEN 'closed' ELSE 'kept' END AS change FROM v_ratio r LEFT JOIN ({INCOMING_RATIO}) i ON r.instrument_id = i.instrument_id
UNION ALL SELECT r.instrument_id, DATE '2005-01-01', NULL, i.ratio, 'inserted' FROM v_ratio r JOIN ({INCOMING_RATIO}) i ON r.instrument_id = i.instrument_id WHERE r.effective_to IS NULL AND i.ratio <> r.ratio"""))
def scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = views.ratio_history(spark, sf_dir)
    given = history.where("effective_to is null").select("instrument_id", F.when(F.col("instrument_id") % 4 == 1, F.col("ratio")).when(F.col("instrument_id") % 4 > 0, F.col("ratio") + 1).alias("ratio"))
    return up.change_ratios(history, given, F.lit("2005-01-01").cast("date"))


@add("snk5_rebuild_ratio", with_views("SELECT * FROM v_ratio"))
def rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("DATE '1995-01-01' + CAST(FLOOR(p_partkey / 25) * 37 % 2557 AS INT)")
    seen = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 25).cast("int").alias("instrument_id"), start.alias("day")).agg(F.max_by("p_size", "p_partkey").alias("ratio"))
    return up.rebuild_ratios(seen)


for _name, _rule in (("snk6_deactivate_missing", "c_custkey % 3 > 0"), ("snk6_deactivation_refused", "c_custkey % 9 = 0")):
    _seen = f"SELECT DISTINCT concat('S', CAST(c_custkey AS VARCHAR)) AS symbol FROM customer WHERE {_rule}"

    @add(_name, f"""WITH {STORED_SQL}, seen AS ({_seen}), g AS (SELECT count_if(is_active) AS total, count_if(is_active AND symbol NOT IN (SELECT symbol FROM seen)) AS gone FROM st)
SELECT st.symbol, st.is_active AND (st.symbol IN (SELECT symbol FROM seen) OR (g.total >= 10 AND (g.total - g.gone) / g.total < 0.5)) AS is_active FROM st, g""")
    def deactivate(spark: SparkSession, sf_dir: str, rule: str = _rule) -> DataFrame:
        seen = table(spark, sf_dir, "customer").where(rule).selectExpr("concat('S', CAST(c_custkey AS STRING)) AS symbol")
        return up.deactivate_missing(stored_instruments(spark, sf_dir).select("symbol", "is_active"), seen)


@add("snk8_replace_window", with_views("SELECT instrument_id, market_date, CASE WHEN market_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND instrument_id % 2 = 0 THEN close + 1 ELSE close END AS close FROM v_local"))
def replace_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.local_bars(spark, sf_dir).select("instrument_id", "market_date", "close")
    fresh = bars.where("instrument_id % 2 = 0").withColumn("close", F.col("close") + 1)
    return up.replace_window(bars, fresh, ["instrument_id"], "market_date", F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date"))


@add("snk10_register_if_absent", "SELECT n_nationkey AS model_id, n_name AS name, '1d' AS horizon FROM nation WHERE n_nationkey < 10 UNION ALL SELECT n_nationkey + 100, n_name, '1d' FROM nation WHERE n_nationkey >= 10")
def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("model_id"), F.col("n_name").alias("name"), F.lit("1d").alias("horizon"))
    return up.insert_if_absent(nation.where("model_id < 10"), nation.withColumn("model_id", F.col("model_id") + 100), ["name", "horizon"])


# --- constraints --------------------------------------------------------------------------------------------------------


@add("c1_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@add("c2_overlapping_periods", with_views("SELECT a.instrument_id, a.effective_from FROM wide a JOIN (SELECT instrument_id, effective_from, lead(effective_from) OVER (PARTITION BY instrument_id ORDER BY effective_from) AS nxt FROM wide) b ON a.instrument_id = b.instrument_id AND a.effective_from = b.effective_from WHERE b.nxt < a.effective_to OR (b.nxt IS NOT NULL AND a.effective_to IS NULL)", "wide AS (SELECT instrument_id, effective_from, effective_to + CAST(ratio % 3 AS INT) AS effective_to FROM v_ratio)"))
def overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = views.ratio_history(spark, sf_dir).withColumn("effective_to", F.expr("date_add(effective_to, CAST(ratio % 3 AS INT))"))
    return co.overlaps(wide).select("instrument_id", "effective_from")


@add("c3_broken_checks", "SELECT o_orderkey, concat_ws(',', CASE WHEN NOT o_totalprice > 5000 THEN 'price' END, CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status' END) AS broken FROM orders WHERE NOT o_totalprice > 5000 OR NOT o_orderstatus IN ('F', 'O')")
def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = co.broken_checks(table(spark, sf_dir, "orders"), {"price": "o_totalprice > 5000", "status": "o_orderstatus IN ('F', 'O')"})
    return broken.select("o_orderkey", F.array_join("broken", ",").alias("broken"))


@add("c4_orphans", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 > 0)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.orphans(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 10 > 0"), "o_custkey", "c_custkey").select("o_orderkey")


@add("c4_cascade", "SELECT count(*) AS rows FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)")
def cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co.cascade(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 10 = 0"), "o_custkey", "c_custkey").agg(F.count(F.lit(1)).alias("rows"))


# --- runs: their audit rows; the states are those of the writes above ----------------------------------------------------------


def audit_sql(series: str, **counts: str) -> str:
    return f"SELECT '{series}' AS series, 'succeeded' AS status, " + ", ".join(f"{counts.get(c, 'CAST(0 AS BIGINT)')} AS {c}" for c in runs.COUNTS)


STALE = "(SELECT count(*) FROM st WHERE is_active AND symbol NOT IN (SELECT symbol FROM inc))"
ABSENT = "(SELECT count(*) FROM (VALUES ('alpha'), ('beta')) e(provider) WHERE provider NOT IN (SELECT provider FROM rec))"
ACTIVE = "(SELECT count(*) FROM (SELECT symbol FROM st WHERE is_active UNION SELECT symbol FROM inc) a)"


def metadata(spark: SparkSession, sf_dir: str, expected: str) -> dict[str, DataFrame]:
    rows = records(spark, sf_dir)
    sources = spark.createDataFrame([(x,) for x in expected.split()], "provider string")
    history = spark.createDataFrame([], "instrument_id string, effective_from date, effective_to date, ratio double")
    return runs.metadata_run(stored_instruments(spark, sf_dir), history, [rows.where("rank = 0"), rows.where("rank = 1")], sources, day=F.lit("2026-02-01").cast("date"), seen_at=F.lit("2026-02-01 00:00:00").cast("timestamp_ntz"))


@add("o1_metadata_run", f"WITH {RECORDS}, {DEDUPED}, {STORED_SQL}, inc AS ({_merged_sql()}) " + audit_sql(
    "metadata", inserted="(SELECT count(*) FROM inc WHERE symbol NOT IN (SELECT symbol FROM st))", updated="(SELECT count(*) FROM inc WHERE symbol IN (SELECT symbol FROM st))",
    warnings=ABSENT, deactivated=f"CASE WHEN {ABSENT} > 0 OR {ACTIVE} >= 10 AND ({ACTIVE} - {STALE}) / {ACTIVE} < 0.5 THEN 0 ELSE {STALE} END", rejected="(SELECT count(*) FROM ded WHERE verdict IS NOT NULL)", quarantined=f"(SELECT count(*) FROM ({_disputes}) q)"))
def metadata_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(spark, sf_dir, "alpha beta")["audit"]


@add("o1_missing_source_deactivates_nothing", f"WITH {RECORDS}, {DEDUPED}, {STORED_SQL}, inc AS ({_merged_sql()}) SELECT coalesce(st.symbol, inc.symbol) AS symbol, inc.symbol IS NOT NULL OR st.is_active AS is_active FROM st FULL JOIN inc ON st.symbol = inc.symbol")
def missing_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(spark, sf_dir, "alpha beta gamma")["instruments"].select("symbol", "is_active")


@add("o2_price_run", with_views(audit_sql("prices", inserted="(SELECT count(*) FROM ups WHERE change = 'inserted') + (SELECT count(*) FROM v_fx WHERE year(market_date) >= 1999 AND month(market_date) IN (3, 4))",
    updated="(SELECT count(*) FROM ups WHERE change = 'updated') + (SELECT count(*) FROM v_fx WHERE year(market_date) < 1999 AND month(market_date) = 3 AND close IS NOT NULL)", warnings="(SELECT count(*) FROM nation WHERE n_regionkey = 0)"), f"ups AS ({UPSERTED})"))
def price_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = views.fx(spark, sf_dir).select(F.lit("USDARS").alias("pair"), F.lit("synthetic").alias("source"), "market_date", "close")
    incoming = rates.where("month(market_date) IN (3, 4)").withColumn("close", F.when(F.month("market_date") == 3, F.col("close") * 2).otherwise(F.col("close")))
    failures = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("symbol"))
    return runs.price_run(stored_bars(spark, sf_dir), incoming_bars(spark, sf_dir), rates.where("year(market_date) < 1999"), incoming, failures)["audit"]


@add("o3_theoretical_run", with_views(audit_sql("theoretical", inserted="(SELECT count(*) FROM chg WHERE change = 'inserted')", updated="(SELECT count(*) FROM chg WHERE change = 'updated')",
    warnings="(SELECT count(*) FROM v_local l WHERE month(market_date) < 4 AND NOT EXISTS (SELECT 1 FROM theo t WHERE t.instrument_id = l.instrument_id AND t.market_date = l.market_date))"), THEO_STEP, f"chg AS ({THEO_CHANGES})"))
def theoretical_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = theoretical_states(spark, sf_dir)
    sessions = views.local_bars(spark, sf_dir).where("month(market_date) < 4").select("instrument_id", "market_date")
    return runs.theoretical_run(old, new, sessions)["audit"]


@add("o5_feature_run")
def feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since 1998 are new; those before are stored."""
    rows = snapshot_rows(spark, sf_dir)
    stored = rows.where("market_date < DATE '1998-01-01'").withColumn("feature_version", F.lit("1.0"))
    return runs.feature_run(stored, rows, "1.0")["audit"]


@add("prj4_union_of_keys", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_extract(props, '$.other') IS NULL AS other_missing FROM events")
def union_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ca.union_of_keys(table(spark, sf_dir, "events").select("event_id", "props"), "props", ["k", "other"])
    return rows.select("event_id", "k", F.isnan("other").alias("other_missing"))


# --- writes that are recorded --------------------------------------------------------------------------------------------


@add("snk12_observed_write", with_views("SELECT 'bars' AS series, 'succeeded' AS state, count(*) AS rows, count(*) FILTER (WHERE close IS NULL) AS without_close, count(*) FILTER (WHERE volume > 0) AS traded FROM v_local"))
def observed_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars are written once; what is counted about them is observed on that write."""
    at = f"{shared_folder(spark)}/observed-{uuid.uuid4().hex}"
    counts = {"without_close": F.col("close").isNull(), "traded": F.col("volume") > 0}
    sinks.observed_write(views.local_bars(spark, sf_dir), lambda df: df.write.parquet(f"{at}/bars"), series="bars", audit_path=f"{at}/audit", counts=counts)
    return sinks.newest_states(spark.read.parquet(f"{at}/audit")).select("series", "state", *[F.col("counts")[c].alias(c) for c in ("rows", *counts)])


@add("snk7_replaced_partitions", with_views("SELECT CAST(instrument_id AS INT) AS instrument_id, market_date, CASE WHEN instrument_id < 5 THEN close + 1 ELSE close END AS close FROM v_local"))
def replaced_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some instruments are written again, twice; their partitions are replaced and the others stay."""
    at = f"{shared_folder(spark)}/replaced-{uuid.uuid4().hex}"
    rows = views.local_bars(spark, sf_dir).select("instrument_id", "market_date", "close")
    sinks.replace_partitions(rows, at, ["instrument_id"])
    for _ in range(2):
        sinks.replace_partitions(rows.where("instrument_id < 5").withColumn("close", F.col("close") + 1), at, ["instrument_id"])
    return spark.read.parquet(at).select(F.col("instrument_id").cast("int").alias("instrument_id"), "market_date", "close")
