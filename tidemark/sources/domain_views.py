"""Bars, rates and ratios of a market, read from the star-schema tables, as DataFrames and as SQL for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument_id, symbol, underlying_market: 25 rows."""
    market = F.when(F.col("n_regionkey") == 0, "NYSE").when(F.col("n_regionkey") == 1, "NASDAQ_GS").when(F.col("n_regionkey") == 2, "B3").when(F.col("n_regionkey") == 3, "XETRA").otherwise("LSE")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("instrument_id"), F.upper("n_name").alias("symbol"), market.alias("underlying_market"))


def local_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar for each instrument and session; closes and volumes have holes."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    last = F.max("o_orderkey")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .groupBy(F.col("c_nationkey").alias("instrument_id"), F.col("o_orderdate").cast("date").alias("market_date"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.when(last % 53 != 0, F.max_by("o_totalprice", "o_orderkey")).alias("close"),
            F.when(last % 59 != 0, F.sum(1 + F.col("o_orderkey") % 997)).cast("long").alias("volume"),
        )
    )


def underlying_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("double") / 100
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_shipdate", "l_quantity", price.alias("p"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    order = F.col("l_orderkey") * F.lit(10000000.0) + F.col("p")
    return (
        lines.join(supplier, lines.l_suppkey == supplier.s_suppkey)
        .groupBy(F.col("s_nationkey").alias("instrument_id"), F.col("l_shipdate").cast("date").alias("market_date"))
        .agg(F.min_by("p", order).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", order).alias("close"), F.sum(F.col("l_quantity").cast("long")).alias("volume"))
    )


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("market_date")).agg((F.max_by("o_totalprice", "o_orderkey") / 100).alias("close"))


def ratio_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-open periods [effective_from, effective_to) without overlap."""
    start = F.expr("DATE '1995-01-01' + CAST(FLOOR(p_partkey / 25) * 37 % 2557 AS INT)")
    by_date = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 25).cast("int").alias("instrument_id"), start.alias("effective_from")).agg(F.max_by("p_size", "p_partkey").alias("ratio"))
    w = Window.partitionBy("instrument_id").orderBy("effective_from")
    changes = by_date.withColumn("prev", F.lag("ratio").over(w)).where("prev IS NULL OR prev <> ratio")
    return changes.select("instrument_id", "effective_from", F.lead("effective_from").over(w).alias("effective_to"), "ratio")


SQL = {
    "v_instruments": """SELECT n_nationkey AS instrument_id, upper(n_name) AS symbol,
  CASE n_regionkey WHEN 0 THEN 'NYSE' WHEN 1 THEN 'NASDAQ_GS' WHEN 2 THEN 'B3' WHEN 3 THEN 'XETRA' ELSE 'LSE' END AS underlying_market FROM nation""",
    "v_local": """SELECT c_nationkey AS instrument_id, CAST(o_orderdate AS DATE) AS market_date,
  min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  CASE WHEN max(o_orderkey) % 53 = 0 THEN NULL ELSE max_by(o_totalprice, o_orderkey) END AS close,
  CASE WHEN max(o_orderkey) % 59 = 0 THEN NULL ELSE CAST(sum(1 + o_orderkey % 997) AS BIGINT) END AS volume
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, CAST(o_orderdate AS DATE)""",
    "v_underlying": """SELECT s_nationkey AS instrument_id, CAST(l_shipdate AS DATE) AS market_date,
  min_by(p, l_orderkey * 10000000.0 + p) AS open, max(p) AS high, min(p) AS low,
  max_by(p, l_orderkey * 10000000.0 + p) AS close, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume
FROM (SELECT l_suppkey, l_orderkey, l_shipdate, l_quantity, floor(l_extendedprice / l_quantity * 100) / 100 AS p FROM lineitem) li
JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, CAST(l_shipdate AS DATE)""",
    "v_fx": "SELECT CAST(o_orderdate AS DATE) AS market_date, max_by(o_totalprice, o_orderkey) / 100 AS close FROM orders GROUP BY CAST(o_orderdate AS DATE)",
    "v_ratio": """SELECT instrument_id, effective_from,
  lead(effective_from) OVER (PARTITION BY instrument_id ORDER BY effective_from) AS effective_to, ratio
FROM (SELECT instrument_id, effective_from, ratio, lag(ratio) OVER (PARTITION BY instrument_id ORDER BY effective_from) AS prev
  FROM (SELECT CAST(p_partkey % 25 AS INT) AS instrument_id, DATE '1995-01-01' + CAST(floor(p_partkey / 25) * 37 % 2557 AS INT) AS effective_from,
      max_by(p_size, p_partkey) AS ratio
    FROM part GROUP BY 1, 2) a) b
WHERE prev IS NULL OR prev <> ratio""",
}


def with_views(body: str, *steps: str) -> str:
    """`body` after the views it names and further steps 'name AS (...)'."""
    text = " ".join((body, *steps))
    views = [f"{name} AS ({query})" for name, query in SQL.items() if name in text]
    return f"WITH {', '.join([*views, *steps])} {body}" if views or steps else body
