"""Checks of what a backtest is asked for and of the prices it runs on."""

from datetime import date, datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import catalog

REQUEST = "id int, symbol string, start date, end date, holding_period int, signals array<int>, bars string"
DAYS = [date(2024, 1, d) for d in (2, 3, 4, 5, 8)]


def judged(spark, rows, most=5000, closes=(10.0, 11.0, 12.0, 13.0, None)):
    stored = spark.createDataFrame([(1, d, c) for d, c in zip(DAYS, closes, strict=True)], "instrument_id int, market_date date, close double")
    known = spark.createDataFrame([(1, "AAPL"), (2, "KO")], "instrument_id int, symbol string")
    asked = spark.createDataFrame([(i, *r, "extra") for i, r in enumerate(rows)], REQUEST).drop("bars")
    found = bt.check_windows(asked, known, stored, most=most).collect()
    return [(r["bars"], r["error"]) for r in sorted(found, key=lambda r: r["id"])]


def test_each_reason_and_their_order(spark):
    first, last = DAYS[0], DAYS[3]
    rows = [
        ("AAPL", first, last, 1, [1, 0, 1]),
        (" aapl ", first, last, 3, [1]),
        ("AAPL", last, first, 1, [1]),
        ("NONE", last, first, 1, [1]),
        ("NONE", first, last, 1, [1]),
        (None, first, last, 1, [1]),
        ("AAPL", None, last, 1, [1]),
        ("AAPL", first, date(2024, 1, 8), 1, [1] * 4),
        ("AAPL", first, first, 1, []),
        ("KO", first, last, 1, []),
        ("AAPL", first, last, 2, [1]),
        ("AAPL", first, last, 1, None),
    ]
    assert judged(spark, rows) == [
        (4, None),
        (4, None),
        (None, "invalid_window"),
        (None, "invalid_window"),
        (None, "instrument_not_found"),
        (None, "instrument_not_found"),
        (None, "invalid_window"),
        (5, "insufficient_history"),
        (1, "insufficient_history"),
        (0, "insufficient_history"),
        (4, "signal_length_mismatch"),
        (4, "signal_length_mismatch"),
    ]


def test_a_missing_close_counts_before_the_width(spark):
    whole = [("AAPL", DAYS[0], date(2024, 2, 1), 1, [1] * 4), ("AAPL", DAYS[0], DAYS[3], 1, [1] * 3)]
    assert judged(spark, whole, most=3) == [(5, "insufficient_history"), (4, "range_too_wide")]


def test_repeated_and_no_requests(spark):
    same = [("AAPL", DAYS[0], DAYS[1], 1, [1])] * 3
    assert judged(spark, same) == [(2, None)] * 3
    assert judged(spark, []) == []


def series(spark, *closes):
    return spark.createDataFrame([(1, i, c) for i, c in enumerate(closes)], "k int, i int, close double")


@pytest.mark.parametrize(("closes", "error"), [((1.0, 2.0), None), ((1.0,), "too_few_prices"), ((1.0, 0.0), "bad_price"), ((1.0, -1.0), "bad_price"), ((1.0, None), "bad_price"), ((1.0, float("nan")), "bad_price"), ((1.0, float("inf")), "bad_price")])
def test_price_series(spark, closes, error):
    rows = series(spark, *closes)
    assert bt.price_errors(rows, ["k"]).first()["error"] == error
    benchmark = bt.buy_and_hold(bt.checked_prices(rows, ["k"]), ["k"], "i")
    if error is None:
        assert benchmark.count() == 2
        return
    with pytest.raises(PySparkException, match="2 prices" if error == "too_few_prices" else "above zero"):
        benchmark.collect()


def test_latest_instant_falls_back(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 2, 20),), (None,)], "ts timestamp")
    assert catalog.latest_instant(rows, "ts").first()["latest"] == datetime(2024, 1, 2, 20)
    now = F.lit(datetime(2024, 5, 1)).cast("timestamp")
    assert catalog.latest_instant(rows.where("false"), "ts", now).first()["latest"] == datetime(2024, 5, 1)
    assert catalog.latest_instant(rows.where("false"), "ts").first()["latest"] is not None


def test_holding_period_of_stored_parameters(spark):
    texts = ['{"holding_period": 5}', '{"holding_period": "5"}', '{"holding_period": 2.5}', '{"holding_period": true}', '{"holding_period": false}', "{}", '{"holding_period": null}', "no json", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, params string")
    got = rows.select("i", catalog.holding_period(F.col("params")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [5, 1, 1, 1, 0, 1, 1, 1, 1, 1]


def test_ratio_of_a_shown_price_is_empty_where_none_is(spark):
    rows = spark.createDataFrame([(10.0,), (0.2,), (None,)], "ratio_used double")
    assert [r["ratio_used_formatted"] for r in catalog.shown_theoretical(rows).collect()] == ["10:1", "1:5", ""]
