"""Stored models and demo backtests on hand-made rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import training

DAY = dt.date(2024, 1, 1)
MODEL = "instrument_id int, horizon string, algorithm string, feature_version string, names array<string>, artifact string, n_train int, status string"
ALWAYS = '{"algorithm": "logistic", "weights": [0.0], "medians": [0.0], "bias": 5.0}'


def registry(spark, *ids):
    return spark.createDataFrame([(i, "1d", "logistic", "1.0", ["f"], ALWAYS, 300, "trained") for i in ids], MODEL)


def test_models_come_back_as_saved_and_foreign_ones_are_refused(spark, tmp_path):
    training.save_models(registry(spark, 1, 2), str(tmp_path / "m"))
    assert sorted(training.load_models(spark, str(tmp_path / "m")).collect()) == sorted(registry(spark, 1, 2).collect())
    with pytest.raises(ValueError, match="no models of 'majority'"):
        training.load_models(spark, str(tmp_path / "m"), algorithm="majority")
    training.save_models(registry(spark, 3).withColumn("algorithm", F.lit("majority")), str(tmp_path / "m"))
    with pytest.raises(ValueError, match="not of 'majority'"):
        training.load_models(spark, str(tmp_path / "m"), algorithm="majority")
    assert training.load_models(spark, str(tmp_path / "m")).count() == 2
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="holds no models"):
        training.load_models(spark, str(tmp_path / "other"))


def test_demo_backtests_say_why_they_skip(spark):
    """1 is always long; 2 has no model; 3 has a bar without close; 4 lacks a state; 5 has too few bars."""
    days = {1: 260, 2: 260, 3: 260, 4: 260, 5: 20}
    bars = [(i, DAY + dt.timedelta(d), None if i == 3 and d == 200 else 100.0 + d) for i, n in days.items() for d in range(n)]
    states = [(i, d, 1.0) for i, d, _ in bars if not (i == 4 and d == DAY + dt.timedelta(100))]
    found = training.demo_backtests(registry(spark, 1, 3, 4, 5), spark.createDataFrame(states, "instrument_id int, market_date date, f double"), spark.createDataFrame(bars, "instrument_id int, market_date date, close double"), ["f"], horizons=["1d"])
    rows = {r["instrument_id"]: r for r in found["outcomes"].collect()}
    assert {i: r["reason"] for i, r in rows.items()} == {1: None, 2: "no_model", 3: "gappy_prices", 4: "no_snapshot", 5: "gappy_prices"}
    shares = (1 - bt.COMMISSION) / ((100.0 + 7) * (1 + bt.SLIPPAGE))
    assert rows[1]["total_return"] == pytest.approx(shares * 359 - 1)
    assert (rows[1]["start"], rows[1]["end"]) == (DAY + dt.timedelta(7), DAY + dt.timedelta(259))


def test_unknown_horizon_is_an_error():
    with pytest.raises(ValueError, match="unknown horizons"):
        training.known_horizons(["1d", "9y"])


@pytest.mark.parametrize("algorithm", ["boosted_trees", "logistic", "majority", "random"])
def test_sweeps_of_every_algorithm(spark, algorithm):
    rng = random.Random(5)
    bars, level = [], 100.0
    for d in range(420):
        level = max(1.0, level + rng.choice([-1, 1]) * rng.random())
        bars.append((1, DAY + dt.timedelta(d), level))
    bars += [(2, DAY + dt.timedelta(d), 50.0) for d in range(40)]
    table = spark.createDataFrame(bars, "instrument_id int, market_date date, close double")
    states = table.select("instrument_id", "market_date", (F.col("close") % 3).alias("f"), (F.col("close") % 7).alias("g"))
    found = training.train_sweep(states, table, ["f", "g"], horizons=["1d", "1w"], algorithm=algorithm)
    assert {(r["instrument_id"], r["horizon"]): r["status"] for r in found["outcomes"].collect()} == {(1, "1d"): "succeeded", (1, "1w"): "succeeded", (2, "1d"): "skipped", (2, "1w"): "skipped"}
    for r in found["runs"].collect():
        assert r["n_test"] == 63 and r["n_folds"] >= 1 and 0 <= r["balanced_accuracy"] <= 1
    assert {r["algorithm"] for r in found["models"].collect()} == {algorithm}
