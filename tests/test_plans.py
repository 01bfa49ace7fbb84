"""Plans that must hold at scale: columns and filters reach the scan, no product of tables, one window for a family."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features
from tidemark.plans import everything, market
from tidemark.sources import domain_views as views

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j1_asof_underlying_lag1", "j2_asof_fx", "j1_date_and_instant_lag3", "j2_newest_date_before_instant", "j3_ratio_interval", "j3_overlapping_periods", "j4_theoretical", "flagship_premium", "snk1_bar_upsert", "set2_field_merge", "w_cov_coverage"])
def test_no_products(spark, name):
    plan = plan_of(everything.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["j2_asof_fx", "j2_newest_date_before_instant", "w10_w12_fx_features", "w14_step_returns", "j4_theoretical"])
def test_series_without_a_key_are_not_one_task(spark, name):
    df = everything.queries()[name](spark, SF)
    df.collect()
    assert "SinglePartition" not in plan_of(df).split("Initial Plan")[0]


def test_periods_are_not_gathered(spark):
    plan = plan_of(everything.queries()["j3_ratio_interval"](spark, SF))
    assert "collect_list" not in plan


def test_scan_reads_what_is_needed(spark):
    plan = plan_of(views.underlying_bars(spark, SF).where("instrument_id = 3").select("market_date", "close"))
    assert "l_comment" not in plan and "l_tax" not in plan and "PushedFilters" in plan


def test_one_window_for_a_family(spark):
    df = features.technical(views.local_bars(spark, SF), "cedear")
    df.collect()
    plan = plan_of(df)
    final = plan.split("Initial Plan")[0]
    assert final.count("Window [") == 1 and "BatchEvalPython" not in plan


def test_future_bars_do_not_matter(spark):
    """Features of a day are those without any later bar."""
    local, under, fx = views.local_bars(spark, SF), views.underlying_bars(spark, SF), views.fx(spark, SF)
    day = local.select(F.percentile_approx(F.unix_date("market_date"), 0.5)).first()[0]
    upto = lambda df: df.where(F.unix_date("market_date") <= day)
    spine = local.select("instrument_id").distinct().select("instrument_id", F.date_from_unix_date(F.lit(day)).alias("market_date"))
    theo = market.theoretical_rows(spark, SF)
    whole = features.relative(spine, local, under, fx, theo)
    past = features.relative(spine, upto(local), upto(under), upto(fx), upto(theo))
    assert sorted(map(str, whole.collect())) == sorted(map(str, past.collect()))
