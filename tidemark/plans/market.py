"""Queries over bars, rates and ratios: windows, as-of joins, theoretical prices, features, labels, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import indicators as ind
from ..functions.pricing import HORIZONS
from ..operators import features, labels, temporal, theoretical
from ..sources import domain_views as views
from ..sources.domain_views import with_views
from .registry import Registry

registry = Registry()
add = registry.add
KEYS = ("instrument_id", "market_date")
ROUND = 6


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in names], *[F.round(n, ROUND).alias(n) for n in names])


# --- indicators -----------------------------------------------------------------------------------------------------


def technical_sql(view: str, prefix: str) -> str:
    """The technical family at each bar, with lists for arrays."""
    frame = "OVER (PARTITION BY instrument_id ORDER BY market_date ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"
    lists = ", ".join(f"list(CAST({c} AS DOUBLE)) FILTER (WHERE {c} IS NOT NULL) {frame} AS {x}" for x, c in (("c0", "close"), ("h0", "high"), ("l0", "low"), ("v0", "volume")))
    names = ", ".join(f"coalesce({x}0, []) AS {x}" for x in "chlv")
    change = lambda a, k: f"CASE WHEN len({a}) > {k} THEN ({a}[-1] - {a}[-{k + 1}]) / nullif({a}[-{k + 1}], 0) END"
    mean = lambda a, k: f"CASE WHEN len({a}) >= {k} THEN list_sum({a}[-{k}:]) / {k} END"
    ewm = lambda a, alpha: f"list_reduce({a}, lambda acc, x: acc * (1 - {alpha}) + x * {alpha})"
    columns = {f"return_{k}d": change("c", k) for k in (1, 5, 10, 20)} | {f"sma_{k}": mean("c", k) for k in (5, 10, 20, 50)}
    columns |= {f"ema_{k}": f"CASE WHEN len(c) >= {k} THEN {ewm(f'c[-{k}:]', f'(2.0::DOUBLE / {k + 1})')} END" for k in (10, 20)}
    a = "(1.0::DOUBLE / 14)"
    gain, loss = (f"{ewm(f'list_transform(d, lambda x: greatest({s}x, 0.0::DOUBLE))', a)}" for s in ("", "-"))
    columns["rsi_14"] = f"CASE WHEN len(c) >= 15 THEN CASE WHEN {loss} = 0 THEN CASE WHEN {gain} > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + {gain} / {loss}) END END"
    pairs = ", ".join(f"(SELECT list({ewm('c[:i]', f'(2.0::DOUBLE / {n + 1})')} ORDER BY i) FROM generate_series(1, len(c)) AS g(i)) AS e{n}" for n in (12, 26))
    columns["macd"] = "CASE WHEN len(c) >= 26 THEN e12[-1] - e26[-1] END"
    line = "list_transform(list_zip(e12, e26), lambda z: z[1] - z[2])"
    columns["macd_signal"] = f"CASE WHEN len(c) >= 34 THEN {ewm(line, '(2.0::DOUBLE / 10)')} END"
    n = "least(len(c), len(h), len(l))"
    rows = f"list_zip(h[-({n}):], l[-({n}):], list_concat([NULL::DOUBLE], c[-({n}):][:-2]))"
    ranges = f"list_transform({rows}, lambda z: greatest(abs(z[1] - z[2]), abs(z[1] - z[3]), abs(z[2] - z[3])))"
    columns["atr_14"] = f"CASE WHEN {n} >= 15 THEN {ewm(ranges, a)} END"
    columns["rolling_volatility_20d"] = "CASE WHEN len(c) >= 21 THEN list_stddev_samp(r[-20:]) * sqrt(252) END"
    columns["volume_change_5d"] = change("v", 5)
    if prefix == "cedear":
        columns["volume_ratio_5d"] = f"CASE WHEN len(v) >= 20 THEN ({mean('v', 5)}) / nullif(({mean('v', 20)}), 0) END"
    out = ", ".join(f"CASE WHEN len(c) >= 2 THEN {v} END AS {prefix}_{k}" for k, v in columns.items())
    diff = "list_transform(list_zip(c[2:], c[:-2]), lambda z: z[1] - z[2]) AS d, list_transform(list_zip(c[2:], c[:-2]), lambda z: z[1] / nullif(z[2], 0) - 1) AS r"
    return f"SELECT instrument_id, market_date, {out} FROM (SELECT *, {diff}, {pairs} FROM (SELECT instrument_id, market_date, {names} FROM (SELECT instrument_id, market_date, {lists} FROM {view}) x) y) z"


def rounded_sql(source: str, names: list[str], keys: tuple[str, ...] = KEYS) -> str:
    return f"SELECT {', '.join(keys)}, {', '.join(f'round({n}, {ROUND}) AS {n}' for n in names)} FROM ({source}) t"


GROUPS = {
    "w1_returns": ["return_1d", "return_5d", "return_10d", "return_20d"],
    "w2_sma": ["sma_5", "sma_10", "sma_20", "sma_50"],
    "w3_ema": ["ema_10", "ema_20"],
    "w4_rolling_volatility": ["rolling_volatility_20d"],
    "w5_rsi_14": ["rsi_14"],
    "w6_macd": ["macd", "macd_signal"],
    "w7_atr_14": ["atr_14"],
    "w8_volume_change": ["volume_change_5d"],
    "w9_volume_ratio": ["volume_ratio_5d"],
}
for _name, _columns in GROUPS.items():
    _full = [f"cedear_{x}" for x in _columns]
    registry.queries[_name] = lambda s, d, names=_full: rounded(features.technical(views.local_bars(s, d), "cedear").select(*KEYS, *names), *names)
    registry.oracles[_name] = with_views(rounded_sql(technical_sql("v_local", "cedear"), _full))
for _prefix, _view, _bars in (("cedear", "v_local", views.local_bars), ("underlying", "v_underlying", views.underlying_bars)):
    _full = features.FAMILIES[f"{_prefix}_technical"]
    registry.queries[f"features_{_prefix}_technical"] = lambda s, d, p=_prefix, b=_bars, names=_full: rounded(features.technical(b(s, d), p), *names)
    registry.oracles[f"features_{_prefix}_technical"] = with_views(rounded_sql(technical_sql(_view, _prefix), _full))

FX_SQL = """SELECT market_date,
  CASE WHEN len(c) > 1 THEN (c[-1] - c[-2]) / nullif(c[-2], 0) END AS fx_return_1d, CASE WHEN len(c) > 5 THEN (c[-1] - c[-6]) / nullif(c[-6], 0) END AS fx_return_5d,
  CASE WHEN len(c) > 20 THEN (c[-1] - c[-21]) / nullif(c[-21], 0) END AS fx_return_20d,
  CASE WHEN len(c) >= 20 THEN list_stddev_samp(list_transform(list_zip(c[2:], c[:-2]), lambda z: z[1] / nullif(z[2], 0) - 1)[-20:]) * sqrt(252) END AS fx_volatility_20d,
  CASE WHEN len(c) > 20 THEN c[-1] - c[-21] END AS fx_momentum_20d, CASE WHEN len(c) > 5 THEN (c[-1] - c[-6]) / nullif(c[-6], 0) END AS fx_rolling_change_5d
FROM (SELECT market_date, list(close) OVER (ORDER BY market_date ROWS BETWEEN 69 PRECEDING AND CURRENT ROW) AS c FROM v_fx)"""


@add("w10_w12_fx_features", with_views(rounded_sql(FX_SQL, features.FAMILIES["fx"], ("market_date",))))
def fx_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.fx_state(views.fx(spark, sf_dir)), *features.FAMILIES["fx"])


PREV = "(SELECT instrument_id, market_date, close, lag(close) OVER (PARTITION BY instrument_id ORDER BY market_date) AS prev FROM v_local WHERE close IS NOT NULL)"


@add("w13_previous_return", with_views(f"SELECT instrument_id, market_date, (close - prev) / nullif(prev, 0) AS ret FROM {PREV} t"))
def previous_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_previous(views.local_bars(spark, sf_dir), "instrument_id")
    return rows.select(*KEYS, features.step_return(F.col("close"), F.col("prev_close")).alias("ret"))


@add("w14_step_returns", with_views("SELECT market_date, close / lag(close) OVER (ORDER BY market_date) - 1 AS step FROM v_fx"))
def step_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.with_previous(views.fx(spark, sf_dir))
    return rows.select("market_date", (F.col("close") / F.col("prev_close") - 1).alias("step"))


@add("w15_running_max", with_views("SELECT instrument_id, market_date, max(close) OVER (PARTITION BY instrument_id ORDER BY market_date) AS peak FROM v_local"))
def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.local_bars(spark, sf_dir).select(*KEYS, F.max("close").over(Window.partitionBy("instrument_id").orderBy("market_date")).alias("peak"))


# --- joins along time -----------------------------------------------------------------------------------------------


def lagged_sql(lag: int) -> str:
    under = f"(SELECT instrument_id, market_date, lag(close, {lag - 1}) OVER w AS close, lag(market_date, {lag - 1}) OVER w AS bar_date FROM v_underlying WINDOW w AS (PARTITION BY instrument_id ORDER BY market_date))"
    return with_views(f"SELECT l.instrument_id, l.market_date, u.bar_date AS underlying_date, u.close AS underlying_close FROM v_local l ASOF LEFT JOIN {under} u ON l.instrument_id = u.instrument_id AND l.market_date > u.market_date")


for _lag in (1, 3):

    @add(f"j1_asof_underlying_lag{_lag}", lagged_sql(_lag))
    def asof_underlying(spark: SparkSession, sf_dir: str, lag: int = _lag) -> DataFrame:
        left = views.local_bars(spark, sf_dir).select(*KEYS)
        right = views.underlying_bars(spark, sf_dir).withColumnRenamed("market_date", "bar_date")
        return temporal.as_of(left, right, keys=["instrument_id"], left_time="market_date", right_time="bar_date", take={"bar_date": "underlying_date", "close": "underlying_close"}, lag=lag)


@add("j2_asof_fx", with_views("SELECT l.instrument_id, l.market_date, f.market_date AS fx_date, f.close AS fx_close FROM v_local l ASOF LEFT JOIN v_fx f ON l.market_date > f.market_date"))
def asof_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = views.fx(spark, sf_dir).withColumnRenamed("market_date", "fx_day")
    return temporal.as_of(views.local_bars(spark, sf_dir).select(*KEYS), rates, keys=[], left_time="market_date", right_time="fx_day", take={"fx_day": "fx_date", "close": "fx_close"})


#: Events are bars of their user's instrument: the session date is up to three days off the instant's own.
SESSIONS = "SELECT event_id, user_id, ts, CAST(CAST(ts AS DATE) + CAST(event_id % 5 - 2 AS INT) AS DATE) AS day, value FROM events"


def dominance_sql(lag: int) -> str:
    ranked = "SELECT a.event_id, b.event_id AS bar, b.value, row_number() OVER (PARTITION BY a.event_id ORDER BY b.day DESC, b.ts DESC, b.event_id DESC) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND b.day < a.day AND b.ts < a.ts"
    return f"WITH s AS ({SESSIONS}), r AS ({ranked}) SELECT s.event_id, r.bar, r.value FROM s LEFT JOIN r ON s.event_id = r.event_id AND n = {lag}"


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 5 - 2).cast("int"))
    return views.table(spark, sf_dir, "events").select("event_id", "user_id", "ts", day.alias("day"), "value")


for _lag in (1, 3):

    @add(f"j1_date_and_instant_lag{_lag}", dominance_sql(_lag))
    def date_and_instant(spark: SparkSession, sf_dir: str, lag: int = _lag) -> DataFrame:
        """The n-th newest session that ended before both the date and the instant of each event."""
        rows = sessions(spark, sf_dir)
        bars = rows.withColumnRenamed("event_id", "bar").withColumnRenamed("value", "bar_value")
        found = temporal.dominance_as_of(rows.drop("value"), bars, keys=["user_id"], first=("day", "day"), second=("ts", "ts"), take={"bar": "bar", "bar_value": "value"}, lag=lag)
        return found.select("event_id", "bar", "value")


@add("j2_newest_date_before_instant", f"WITH s AS ({SESSIONS}) SELECT event_id, CAST(best.day AS DATE) AS day, best.bar AS bar FROM (SELECT event_id, max({{'day': day, 'ts': ts, 'bar': event_id}}) OVER (ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS best FROM s) t")
def newest_date_before_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series without a key: of all observations before the instant, the one with the newest date."""
    rows = sessions(spark, sf_dir)
    seen = rows.select(F.col("event_id").alias("bar"), "day", F.col("ts").alias("seen_at"))
    found = temporal.as_of(rows.select("event_id", "ts"), seen, keys=[], left_time="ts", right_time="seen_at", take={"day": "day", "bar": "bar"}, best_by=["day", "seen_at", "bar"])
    return found.select("event_id", "day", "bar")


RATIO_JOIN = "LEFT JOIN v_ratio r ON l.instrument_id = r.instrument_id AND r.effective_from <= l.market_date AND (r.effective_to IS NULL OR r.effective_to > l.market_date)"


@add("j3_ratio_interval", with_views(f"SELECT l.instrument_id, l.market_date, r.ratio FROM v_local l {RATIO_JOIN}"))
def ratio_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.interval(views.local_bars(spark, sf_dir).select(*KEYS), views.ratio_history(spark, sf_dir), key="instrument_id", day="market_date", value="ratio")


@add("j3_overlapping_periods", "WITH p AS (SELECT user_id, event_id, CAST(ts AS DATE) AS a, CASE WHEN event_id % 9 > 0 THEN CAST(ts AS DATE) + CAST(1 + event_id % 4 AS INT) END AS b FROM events) SELECT e.event_id, max(p.event_id) AS period FROM (SELECT event_id, user_id, CAST(ts AS DATE) + 1 AS d FROM events) e LEFT JOIN p ON e.user_id = p.user_id AND p.a <= d AND (p.b IS NULL OR p.b > d) AND (p.a, -coalesce(p.b - DATE '1970-01-01', 1 << 30), p.event_id) = (SELECT max((q.a, -coalesce(q.b - DATE '1970-01-01', 1 << 30), q.event_id)) FROM p q WHERE q.user_id = e.user_id AND q.a <= d AND (q.b IS NULL OR q.b > d)) GROUP BY 1")
def overlapping_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of a user that overlap: the newest of those that hold the day."""
    rows = views.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("date").alias("d"))
    end = F.when(F.col("event_id") % 9 > 0, F.date_add("d", (1 + F.col("event_id") % 4).cast("int")))
    newest = rows.select("user_id", F.col("d").alias("effective_from"), end.alias("effective_to"), F.col("event_id").alias("period"))
    return temporal.interval(rows.withColumn("d", F.date_add("d", 1)), newest, key="user_id", day="d", value="period", overlaps=True).select("event_id", "period")


ZONE = "CASE i.underlying_market WHEN 'NYSE' THEN 'America/New_York' WHEN 'NASDAQ_GS' THEN 'America/New_York' WHEN 'B3' THEN 'America/Sao_Paulo' WHEN 'XETRA' THEN 'Europe/Berlin' ELSE 'Europe/London' END"
THEO_SQL = f"""SELECT l.instrument_id, l.market_date, u.close * f.close / r.ratio AS theoretical_price,
  (l.close - u.close * f.close / r.ratio) / nullif(u.close * f.close / r.ratio, 0) AS premium_discount, l.close AS local_price, r.ratio AS ratio_used,
  f.close AS fx_used, u.close AS underlying_price_used, u.market_date AS underlying_market_date, f.market_date AS fx_market_date
FROM (SELECT b.*, CAST(timezone({ZONE}, timezone('UTC', b.market_date + INTERVAL 21 HOUR)) AS DATE) AS venue_date FROM v_local b JOIN v_instruments i ON b.instrument_id = i.instrument_id) l
ASOF JOIN v_underlying u ON l.instrument_id = u.instrument_id AND l.venue_date > u.market_date
ASOF JOIN (SELECT market_date, market_date + INTERVAL 1 DAY AS next_day, close FROM v_fx) f ON l.market_date >= f.market_date
JOIN v_ratio r ON l.instrument_id = r.instrument_id AND r.effective_from <= l.market_date AND (r.effective_to IS NULL OR r.effective_to > l.market_date)"""


def theoretical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theoretical.assemble(views.local_bars(spark, sf_dir), views.underlying_bars(spark, sf_dir), views.fx(spark, sf_dir), views.ratio_history(spark, sf_dir), views.instruments(spark, sf_dir))


@add("j4_theoretical", with_views(THEO_SQL))
def theoretical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return theoretical_rows(spark, sf_dir)


def previous_sql(view: str, keyed: bool = True) -> str:
    part = "PARTITION BY instrument_id " if keyed else ""
    return f"(SELECT *, lag(close) OVER ({part}ORDER BY market_date) AS prev FROM {view} WHERE close IS NOT NULL)"


SPINE_SQL = "spine AS (SELECT instrument_id, CAST(unnest(generate_series(min(market_date), max(market_date), INTERVAL 1 DAY)) AS DATE) AS market_date FROM v_local GROUP BY instrument_id)"
THEO_STEP = f"theo AS ({THEO_SQL})"
RELATIVE_SQL = f"""SELECT s.instrument_id, s.market_date, (l.close - t.theoretical_price) / nullif(t.theoretical_price, 0) AS premium_discount,
  (1 + (u.close - u.prev) / nullif(u.prev, 0)) * (1 + (f.close - f.prev) / nullif(f.prev, 0)) - 1 AS expected_cedear_return, (l.close - l.prev) / nullif(l.prev, 0) AS actual_cedear_return,
  (l.close - l.prev) / nullif(l.prev, 0) - ((1 + (u.close - u.prev) / nullif(u.prev, 0)) * (1 + (f.close - f.prev) / nullif(f.prev, 0)) - 1) AS local_underlying_divergence
FROM spine s ASOF LEFT JOIN {previous_sql('v_local')} l ON s.instrument_id = l.instrument_id AND s.market_date >= l.market_date
ASOF LEFT JOIN {previous_sql('v_underlying')} u ON s.instrument_id = u.instrument_id AND s.market_date > u.market_date
ASOF LEFT JOIN {previous_sql('v_fx', False)} f ON s.market_date >= f.market_date
ASOF LEFT JOIN theo t ON s.instrument_id = t.instrument_id AND s.market_date >= t.market_date"""


@add("j5_relative_features", with_views(RELATIVE_SQL, SPINE_SQL, THEO_STEP))
def relative_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = views.local_bars(spark, sf_dir)
    return features.relative(temporal.calendar(local, ["instrument_id"]), local, views.underlying_bars(spark, sf_dir), views.fx(spark, sf_dir), theoretical_rows(spark, sf_dir))


MERVAL = "(SELECT market_date, (close - prev) / nullif(prev, 0) AS merval_return_1d FROM (SELECT market_date, close, lag(close) OVER (ORDER BY market_date) AS prev FROM v_local WHERE instrument_id = 0) x)"
MARKET_NULLS = ", ".join(f"CAST(NULL AS DOUBLE) AS {x}" for x in features.FAMILIES["market"][1:])
MARKET_SQL = f"SELECT s.instrument_id, s.market_date, m.merval_return_1d, {MARKET_NULLS} FROM spine s LEFT JOIN {MERVAL} m ON s.market_date = m.market_date"


@add("j6_market_features", with_views(MARKET_SQL, SPINE_SQL))
def market_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = views.local_bars(spark, sf_dir)
    return features.merval(temporal.calendar(local, ["instrument_id"]), local, 0)


def snapshot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = views.local_bars(spark, sf_dir)
    return features.snapshots(temporal.calendar(local, ["instrument_id"]), local, views.underlying_bars(spark, sf_dir), views.fx(spark, sf_dir), theoretical_rows(spark, sf_dir))


_ct, _ut, _fx = (features.FAMILIES[x] for x in ("cedear_technical", "underlying_technical", "fx"))
SNAPSHOT_SQL = f"""SELECT * FROM (SELECT s.instrument_id, s.market_date, {", ".join(f"round({a}.{x}, {ROUND}) AS {x}" for a, names in (("ct", _ct), ("ut", _ut), ("fs", _fx), ("rl", features.FAMILIES["relative"]), ("mk", features.FAMILIES["market"])) for x in names)}
FROM spine s ASOF LEFT JOIN ctech ct ON s.instrument_id = ct.instrument_id AND s.market_date > ct.market_date
ASOF LEFT JOIN utech ut ON s.instrument_id = ut.instrument_id AND s.market_date > ut.market_date
ASOF LEFT JOIN fxs fs ON s.market_date > fs.market_date
JOIN rel rl ON s.instrument_id = rl.instrument_id AND s.market_date = rl.market_date
JOIN mkt mk ON s.instrument_id = mk.instrument_id AND s.market_date = mk.market_date) t WHERE coalesce({", ".join(features.NAMES)}) IS NOT NULL"""


@add("feature_snapshots", with_views(SNAPSHOT_SQL, SPINE_SQL, THEO_STEP, f"ctech AS ({technical_sql('v_local', 'cedear')})", f"utech AS ({technical_sql('v_underlying', 'underlying')})", f"fxs AS ({FX_SQL})", f"rel AS ({RELATIVE_SQL})", f"mkt AS ({MARKET_SQL})"))
def feature_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(snapshot_rows(spark, sf_dir), *features.NAMES)


@add("reg1_feature_catalogue", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', {len(n)})" for f, n in features.FAMILIES.items()) + ") AS t(family, features)")
def feature_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.catalogue(spark).groupBy("family").agg(F.count(F.lit(1)).cast("int").alias("features"))


@add("flt5_newest_before", with_views("SELECT instrument_id, market_date, close FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY market_date DESC) AS n FROM v_local WHERE market_date < DATE '1998-01-01') t WHERE n <= 100"))
def newest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("instrument_id").orderBy(F.desc("market_date")))
    return views.local_bars(spark, sf_dir).where("market_date < DATE '1998-01-01'").withColumn("n", n).where(F.col("n") <= ind.BARS).select(*KEYS, "close")


# --- labels and folds -----------------------------------------------------------------------------------------------


def label_sql(sessions: int) -> str:
    return f"SELECT instrument_id, market_date, CAST(later > close AS INT) AS label FROM (SELECT *, lead(close, {sessions}) OVER (PARTITION BY instrument_id ORDER BY market_date) AS later FROM v_local WHERE close IS NOT NULL) t WHERE later IS NOT NULL"


for _h in ("1d", "1w", "1m"):

    @add(f"w_lbl_{_h}", with_views(label_sql(HORIZONS[_h])))
    def horizon_label(spark: SparkSession, sf_dir: str, h: str = _h) -> DataFrame:
        return labels.session_labels(views.local_bars(spark, sf_dir), HORIZONS[h])


DAY_LABEL = f"""SELECT s.instrument_id, s.market_date, CAST(b.later > b.close AS INT) AS label FROM spine s
JOIN LATERAL (SELECT 1) one ON true ASOF JOIN (SELECT *, lead(close, 5) OVER (PARTITION BY instrument_id ORDER BY market_date) AS later FROM v_local WHERE close IS NOT NULL) b
ON s.instrument_id = b.instrument_id AND s.market_date >= b.market_date WHERE b.later IS NOT NULL""".replace("JOIN LATERAL (SELECT 1) one ON true ", "")


@add("j11_day_labels", with_views(DAY_LABEL, SPINE_SQL))
def day_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = views.local_bars(spark, sf_dir)
    return labels.day_labels(temporal.calendar(local, ["instrument_id"]), local, HORIZONS["1w"])


POSITION = "pos AS (SELECT instrument_id, market_date, row_number() OVER (PARTITION BY instrument_id ORDER BY market_date) - 1 AS position FROM v_local)"
SIZES_SQL = "sizes AS (SELECT instrument_id, count(*) AS n FROM v_local GROUP BY instrument_id)"
FOLDS_SQL = "folds AS (SELECT instrument_id, CAST((e - 100) / 50 AS INT) AS fold, e AS train_end, e AS test_start, e + 50 AS test_end FROM (SELECT instrument_id, CAST(unnest(range(100, n - 50 + 1, 50)) AS INT) AS e FROM sizes) t)"


@add("w_pos_position", with_views("SELECT instrument_id, market_date, CAST(position AS INT) AS position FROM pos", POSITION))
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.session_rank(views.local_bars(spark, sf_dir)).select(*KEYS, (F.col("session") - 1).alias("position"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.local_bars(spark, sf_dir).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("n"))


@add("w_fold_walk_forward", with_views("SELECT * FROM folds", SIZES_SQL, FOLDS_SQL))
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.folds(sizes(spark, sf_dir), 100, 50, 50)


@add("w_cov_coverage", with_views("SELECT s.instrument_id, s.n, coalesce(c.positions = s.n - 100 AND c.most = 1, false) AS covered FROM sizes s LEFT JOIN (SELECT instrument_id, count(*) AS positions, max(times) AS most FROM (SELECT instrument_id, p, count(*) AS times FROM (SELECT instrument_id, unnest(range(test_start, test_end)) AS p FROM folds) a GROUP BY 1, 2) b GROUP BY 1) c ON s.instrument_id = c.instrument_id", SIZES_SQL, FOLDS_SQL))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = sizes(spark, sf_dir)
    return labels.coverage(labels.folds(n, 100, 50, 50), n, 100)


@add("j14_fold_members", with_views("SELECT p.instrument_id, f.fold, CASE WHEN position < train_end THEN 'train' ELSE 'test' END AS part, count(*) AS rows FROM pos p JOIN folds f ON p.instrument_id = f.instrument_id AND p.position < f.test_end GROUP BY 1, 2, 3", SIZES_SQL, FOLDS_SQL, POSITION))
def fold_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = labels.folds(sizes(spark, sf_dir), 100, 50, 50)
    return labels.members(positions(spark, sf_dir), table).groupBy("instrument_id", "fold", "part").agg(F.count(F.lit(1)).alias("rows"))


_values = ", ".join(f"('{h}', {n}, {max(252, 4 * n)}, {max(63, n)}, {max(63, n)})" for h, n in HORIZONS.items())


@add("w_geo_geometry", f"SELECT * FROM (VALUES {_values}) AS t(horizon, sessions, min_train, test_size, step)")
def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.geometry(spark)


@add("w_epoch_index", with_views("SELECT instrument_id, market_date, CAST(position // 5 AS INT) AS epoch, CAST(position % 5 = 0 AS INT) AS decides FROM pos", POSITION))
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir).select(*KEYS, F.floor(F.col("position") / 5).cast("int").alias("epoch"), (F.col("position") % 5 == 0).cast("int").alias("decides"))


FLAGSHIP_SQL = f"""SELECT t.instrument_id, t.market_date, round(c.cedear_sma_5, {ROUND}) AS sma_5, round(c.cedear_return_1d, {ROUND}) AS return_1d, t.theoretical_price, t.premium_discount
FROM theo t JOIN ctech c ON t.instrument_id = c.instrument_id AND t.market_date = c.market_date"""


@add("flagship_premium", with_views(FLAGSHIP_SQL, THEO_STEP, f"ctech AS ({technical_sql('v_local', 'cedear')})"))
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session's 5-day mean, 1-day return, theoretical price and premium over it."""
    state = features.technical(views.local_bars(spark, sf_dir), "cedear").select(*KEYS, F.round("cedear_sma_5", ROUND).alias("sma_5"), F.round("cedear_return_1d", ROUND).alias("return_1d"))
    return theoretical_rows(spark, sf_dir).select(*KEYS, "theoretical_price", "premium_discount").join(state, list(KEYS)).select(*KEYS, "sma_5", "return_1d", "theoretical_price", "premium_discount")
