"""Small cases with known results."""

import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.functions import pricing as pr
from tidemark.functions import vocabulary as vo
from tidemark.operators import backtest as bt
from tidemark.operators import catalog, constraints, labels, models, reconcile, runs, temporal, upsert
from tidemark.sources import catalogue_json, chart_json, html_tables


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_ratios(spark):
    got = [one(spark, vo.parse_ratio(F.lit(x))) for x in ("60:1", "1:5", "1 :4", "15.1", " ", "1:0")]
    assert [None if x is None else float(x) for x in got] == [60, 0.2, 0.25, None, None, None]
    assert [one(spark, vo.format_ratio(F.lit(x))) for x in (60, 0.2)] == ["60:1", "1:5"]


def test_theoretical_price_and_premium(spark):
    price = lambda u, fx, r: one(spark, pr.theoretical_price(F.lit(u), F.lit(fx), F.lit(r)))
    assert price(1000.0, 1000.0, 10.0) == 100_000
    assert price(100.0, 1000.0, 0.2) == pytest.approx(500_000)
    assert one(spark, pr.premium(F.lit(1100.0), F.lit(1000.0))) == pytest.approx(0.1)
    assert one(spark, pr.premium(F.lit(None).cast("double"), F.lit(1000.0))) is None


def test_rsi_and_macd(spark):
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    assert [one(spark, ind.rsi(arr(xs))) for xs in (range(1, 21), [5] * 20, [1, 2])] == [100.0, 50.0, None]
    line, signal = ind.macd(arr(range(1, 29)))
    assert one(spark, line) is not None and one(spark, signal) is None
    assert one(spark, ind.macd(arr(range(1, 11)))[0]) is None


def test_session_labels(spark):
    closes = [100, 101, 102, 103, 104, 103, 102, 102]
    bars = spark.createDataFrame([(1, date(2026, 1, 5 + i), float(c)) for i, c in enumerate(closes)], "instrument_id int, market_date date, close double")
    got = lambda n: [r["label"] for r in labels.session_labels(bars, n).orderBy("market_date").collect()]
    assert got(5) == [1, 1, 0]
    assert got(1) == [1, 1, 1, 1, 0, 0, 0]


def test_as_of_is_strict(spark):
    left = spark.createDataFrame([(1, date(2026, 7, 13))], "k int, d date")
    right = spark.createDataFrame([(1, date(2026, 7, 10), 5.0), (1, date(2026, 7, 13), 6.0)], "k int, d date, v double")
    got = lambda **o: temporal.as_of(left, right, keys=["k"], left_time="d", right_time="d", take={"v": "v"}, **o).first()["v"]
    assert got() == 5.0
    assert got(strict=False) == 6.0
    assert got(lag=2) is None


def reference_run(prices, signals, c, s, fraction, hp, cash=1000.0):
    shares, curve, trades = 0.0, [cash], []
    for i in range(len(prices) - 1):
        if i % hp == 0 and signals[i] == 1 and shares == 0:
            spent = cash * fraction
            shares, cash = spent * (1 - c) / (prices[i] * (1 + s)), cash - spent
        elif i % hp == 0 and signals[i] != 1 and shares > 0:
            cash += shares * prices[i] * (1 - s) * (1 - c)
            shares = 0.0
            trades.append(i)
        curve.append(cash + shares * prices[i + 1])
    return curve, trades


def run_of(spark, prices, signals, **options):
    rows = spark.createDataFrame([("r", i, p, s) for i, (p, s) in enumerate(zip(prices, signals))], "run string, at int, close double, signal int")
    return bt.simulate(rows, ["run"], "at", **options)


@pytest.mark.parametrize("fraction,hp", [(1.0, 1), (0.5, 3), (0.25, 1)])
def test_backtest_against_a_loop(spark, fraction, hp):
    rng = np.random.default_rng(3)
    prices = (100 * np.exp(np.cumsum(rng.normal(0, 0.02, 60)))).tolist()
    signals = rng.integers(0, 2, 60).tolist()
    done = run_of(spark, prices, signals, capital=1000.0, fraction=fraction, holding_period=hp)
    row = bt.packed(done, ["run"], "at").first()
    curve, trades = reference_run(prices, signals, 0.005, 0.001, fraction, hp)
    assert row["equity"] == pytest.approx(curve)
    assert [t["exit_index"] for t in row["trades"]] == trades
    assert len(row["positions"]) == 59 and row["prices"] == prices and row["bars"] == list(range(60))
    # what the closed trades gained, the open position's rise and its fee are all there is
    last = row["positions"][-1]
    if not last:
        assert sum(t["pnl"] for t in row["trades"]) - entry_fees(row["trades"]) == pytest.approx(curve[-1] - 1000.0)
    assert row["total_costs"] == pytest.approx(sum(t["costs"] for t in row["trades"]) + row["open_fee"])
    assert (row["open_fee"] > 0) == bool(last)


def entry_fees(trades):
    """Entry fees are costs of a trade, not part of its result."""
    return sum(t["shares"] * t["entry_price"] * 0.005 / 0.995 for t in trades)


def test_backtest_cases(spark):
    """A null signal decides nothing; the last bar never trades; one bar alone is flat; holding periods may be a column."""
    assert [r["position"] for r in run_of(spark, [1.0, 2.0, 3.0, 4.0], [1, None, 0, 1]).orderBy("at").collect()] == [1, 1, 0, 0]
    alone = run_of(spark, [5.0], [1]).first()
    assert (alone["position"], alone["equity"], alone["trade"], alone["open_fee"]) == (0, bt.CAPITAL, None, 0.0)
    held = run_of(spark, [1.0, 2.0, 3.0, 4.0], [0, 1, 1, 1], holding_period=F.lit(2)).orderBy("at").collect()
    assert [r["position"] for r in held] == [0, 0, 1, 1]
    assert run_of(spark, [], []).count() == 0


def test_backtest_without_costs(spark):
    done = run_of(spark, [100.0, 110.0, 121.0], [1, 1, 1], capital=1000.0, commission=0.0, slippage=0.0)
    assert done.orderBy("at").collect()[-1]["equity"] == pytest.approx(1210)


def test_backtest_has_one_exchange(spark):
    plan = run_of(spark, [1.0, 2.0], [1, 0], fraction=0.5, holding_period=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan


def test_folds(spark):
    got = labels.folds(spark.createDataFrame([(1, 12)], "instrument_id int, n int"), 4, 2, 2).orderBy("fold").collect()
    assert [r["train_end"] for r in got] == [4, 6, 8, 10]


RECORD = "provider string, rank int, pos int, symbol string, name string, ratio double, underlying_symbol string, source_ref string"


def test_dedupe_rules(spark):
    rows = [("a", 0, 1, "X", None, 2.0, None, "r"), ("a", 0, 2, "X", "n", 3.0, None, "r"), ("a", 0, 3, "Y", "n", None, "u", "r"), ("a", 0, 4, "Y", None, 5.0, None, "r"), ("a", 0, 5, "Z", None, 5.0, None, "r"), ("a", 0, 6, "Z", "n", 5.0, None, "r"), ("a", 0, 7, "W", None, None, None, None)]
    got = {r["pos"]: r["verdict"] for r in reconcile.dedupe(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {1: "conflicting_ratios", 2: "conflicting_ratios", 3: "superseded_by_ratio_bearing_record", 4: None, 5: "duplicate_record", 6: None, 7: None}


def test_merge_quarantines_disputes(spark):
    rows = [("a", 0, 1, "X", None, 2.0, "u", "r"), ("b", 1, 1, "X", "late", 3.0, "u", "q"), ("b", 1, 2, "Y", "y", None, None, None)]
    got = {r["symbol"]: r for r in reconcile.merge(spark.createDataFrame(rows, RECORD)).collect()}
    assert (got["X"]["custodian"], got["X"]["name"], got["X"]["ratio"], got["X"]["underlying_symbol"], got["X"]["conflicts"], got["X"]["sources"]) == ("a", "late", None, "u", ["conflicting_ratio"], ["a", "b"])
    assert got["Y"]["ratio"] is None and got["Y"]["conflicts"] == []


def test_upsert_twice_changes_nothing(spark):
    schema = "instrument_id int, market_date date, close double, volume long"
    old = spark.createDataFrame([(1, date(2026, 1, 1), 5.0, 1), (1, date(2026, 1, 2), None, 1)], schema)
    new = spark.createDataFrame([(1, date(2026, 1, 2), 6.0, 2), (2, date(2026, 1, 2), 7.0, 3)], schema)
    first = upsert.upsert_bars(old, new)
    assert sorted((r["instrument_id"], r["close"], r["change"]) for r in first.collect()) == [(1, 5.0, "kept"), (1, 6.0, "updated"), (2, 7.0, "inserted")]
    again = upsert.upsert_bars(first.drop("change"), new)
    assert {r["change"] for r in again.collect()} == {"kept", "unchanged"}
    assert sorted(again.drop("change").collect()) == sorted(first.drop("change").collect())


def test_ratio_change_on_the_day_it_began(spark):
    history = spark.createDataFrame([(1, date(2026, 1, 1), None, 5.0)], "instrument_id int, effective_from date, effective_to date, ratio double")
    day = F.lit("2026-01-01").cast("date")
    got = upsert.change_ratios(history, spark.createDataFrame([(1, 6.0)], "instrument_id int, ratio double"), day).collect()
    assert [(r["ratio"], r["effective_to"]) for r in got] == [(6.0, None)]
    assert constraints.overlaps(history.unionByName(history)).count() == 1


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        catalog.page(spark.range(5), ["id"], 201)
    with pytest.raises(LookupError):
        catalog.point(spark.createDataFrame([("A",)], "symbol string"), "symbol", "b")


def test_chart_with_holes(spark):
    body = '{"chart":{"result":[{"meta":{"currency":"USD","exchangeTimezoneName":"America/New_York"},"timestamp":[1767621600,1767708000,1767794400],"indicators":{"quote":[{"open":[1,null,3],"high":[1,null,3],"low":[1,null,3],"close":[1.5,null,3.5],"volume":[10,null,30]}],"adjclose":[{"adjclose":[1.4,null]}]}}],"error":null}}'
    parsed = chart_json.parse(spark.createDataFrame([("A", body)], "symbol string, body string"))
    got = chart_json.bars(parsed).orderBy("market_date").collect()
    assert [(r["market_date"], r["close"], r["adjusted_close"], r["volume"]) for r in got] == [(date(2026, 1, 5), 1.5, 1.4, 10), (date(2026, 1, 7), 3.5, None, 30)]
    assert [r["reason"] for r in chart_json.rejected(parsed).collect()] == ["no_trade_slot"]


def test_catalogue_description(spark):
    text = "<ul><li><strong>NOMBRE: </strong>ALTABA INC</li> <li><strong>Mercado de valor subyacente</strong>: none</li><li>Nombre: second</li><li>Observaciones Programa:&nbsp;Inhabilitado</li></ul>"
    assert one(spark, catalogue_json.description_fields(F.lit(text))) == {"NOMBRE": "ALTABA INC", "MERCADODEVALORSUBYACENTE": "none", "OBSERVACIONESPROGRAMA": "Inhabilitado"}


def test_html_tables_and_text():
    page = "<table class='a b'><thead><tr><th>H<br>1</th><th>H2</th></tr></thead><tr><td>x &amp; y</td><td><table class='b'><tr><td>in</td></tr></table>z</td></tr></table>"
    assert html_tables.cells_of(page, "b") == [(0, 0, 0, True, "H 1"), (0, 0, 1, True, "H2"), (0, 1, 0, False, "x & y"), (0, 1, 1, False, "z")]
    assert html_tables.text_of("<p>a<script>b</script>c</p>d &eacute;<br/>e") == "ac d é e"


def test_logistic_is_at_the_minimum():
    rng = np.random.default_rng(42)
    x = rng.normal(size=(60, 6))
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(int)
    m = models.Logistic().fit(x, y)
    p = m.predict_proba(x)
    assert np.abs(x.T @ (p - y) + m.weights).max() < 1e-6 and abs((p - y).sum()) < 1e-6
    with pytest.raises(ValueError):
        models.Logistic().fit(x, np.ones(60))
    with pytest.raises(ValueError):
        models.make_model("oracle")


def test_served_equals_fitted(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 2))
    rows = [(1, i, int(a + b > 0.1 * i / 80), float(a), None if i % 9 == 0 else float(b)) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, position int, label int, f1 double, f2 double")
    fitted = models.train(df, ["f1", "f2"], ["k"], cut=60)
    got = [r["p_up"] for r in models.serve(fitted, df.where("position >= 60"), ["f1", "f2"], ["k"]).orderBy("position").collect()]
    table = np.array([[r[3], np.nan if r[4] is None else r[4]] for r in rows])
    own = models.Logistic().fit(table[:60], np.array([r[2] for r in rows[:60]]))
    assert got == pytest.approx(own.predict_proba(table[60:]).tolist())


def test_market_date_is_local(spark):
    from tidemark.functions import market_time as mt

    df = spark.createDataFrame([(datetime(2026, 3, 10, 1, 0),)], "t timestamp_ntz")
    assert df.select(mt.market_date(F.col("t"))).first()[0] == date(2026, 3, 9)


def test_random_baseline_draws_one_label_a_row():
    x, y = np.zeros((200, 1)), np.array([0, 1, 1, 1] * 50)
    model = models.make_model("random").fit(x, y)
    p = model.predict_proba(x)
    assert set(p.tolist()) == {0.0, 1.0} and (model.predict(x) == p).all() and 0.65 < p.mean() < 0.85
    assert (models.make_model("random").fit(x, y).predict_proba(x) == p).all()


def test_unknown_horizon_is_an_error(spark):
    names = spark.createDataFrame([("1d", 1), ("2y", 504)], "h string, n int")
    assert all(r["n"] == r["s"] for r in names.withColumn("s", pr.horizon_sessions(F.col("h"))).collect())
    with pytest.raises(Exception, match="unknown horizon: 5d"):
        spark.createDataFrame([("5d",)], "h string").select(pr.horizon_sessions(F.col("h"))).collect()


def test_percentages(spark):
    values = [(0.53, "53%", "+53%"), (-0.004, "-0.4%", "-0.4%"), (12.3456, "1,234.6%", "+1,234.6%"), (-0.00029, "-0%", "-0%"), (0.00029, "0%", "+0%"), (None, "—", "—"), (float("nan"), "—", "—"), (float("inf"), "—", "—"), (0.0, "0%", "0%"), (-0.0, "-0%", "-0%"), (0.1234, "12.3%", "+12.3%")]
    rows = spark.createDataFrame(values, "v double, shown string, signed string")
    for r in rows.select("shown", "signed", pr.format_percent(F.col("v")).alias("a"), pr.format_percent(F.col("v"), signed=True).alias("b")).collect():
        assert (r["a"], r["b"]) == (r["shown"], r["signed"])


def test_amounts_and_compact_numbers(spark):
    values = [(1234.5, "$\u00a01.234,50", "1,234.5"), (-0.083333, "-$\u00a00,08", "-0.0833"), (1000.0, "$\u00a01.000,00", "1,000"), (100.0, "$\u00a0100,00", "100"), (0.0, "$\u00a00,00", "0"), (None, "—", "—"), (float("-inf"), "—", "—")]
    rows = spark.createDataFrame(values, "v double, amount string, compact string")
    for r in rows.select("amount", "compact", pr.format_amount(F.col("v")).alias("a"), pr.format_compact(F.col("v")).alias("b")).collect():
        assert (r["a"], r["b"]) == (r["amount"], r["compact"])


def test_no_snapshot_is_an_error(spark):
    with pytest.raises(ValueError, match="snapshot"):
        runs.metadata_run(None, None, [], None, day=F.current_date(), seen_at=F.current_timestamp())


def test_tables_in_tables_and_unclosed_parts():
    page = "<table class='x b'><tr><th>A</th></tr><tr><td>1<table class=b><tr><td>in</td></tr></table>2<br>3</td><td></td></tr><tr></tr></table><table><tr><td>no</td></tr></table><table class=b><tr><td>late"
    assert html_tables.cells_of(page, "b") == [(0, 0, 0, True, "A"), (0, 1, 0, False, "12 3"), (0, 1, 1, False, "")]
    assert html_tables.text_of("<p>a<script>if (a < b) x()</script>b</p>c<style>d</style>&amp;<div>e") == "ab c& e"


def test_union_of_keys(spark):
    rows = spark.createDataFrame([(1, '{"a": 1.5, "b": "x"}'), (2, '{"b": 2, "c": 3}'), (3, None)], "i int, j string")
    got = {r["i"]: (r["a"], r["b"]) for r in catalog.union_of_keys(rows, "j", ["a", "b"]).collect()}
    assert got[1] == (1.5, None) and math.isnan(got[2][0]) and got[2][1] == 2.0 and all(map(math.isnan, got[3]))
