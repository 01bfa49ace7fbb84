"""Training sweeps over instruments and horizons, their registry and run records, and backtests of what was trained.

Everything is keyed by (instrument_id, horizon): a sweep is one set of joins and groupings over all of them, not a loop that
trains one model after the other. Only the few horizons are listed in the plan, as each has its own label distance and folds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.pricing import HORIZONS
from ..storage import cut
from . import backtest as bt
from . import evaluation as ev
from . import labels, models

KEY = ["instrument_id", "horizon"]
# Decisions of a demo backtest for each horizon.
EPOCHS = {"1d": 252, "1w": 52, "1m": 12, "3m": 8, "6m": 6, "1y": 3, "2y": 2}
# End of fixed values.
MODEL_COLUMNS = ("instrument_id", "horizon", "algorithm", "feature_version", "names", "artifact", "n_train", "status")


def known_horizons(horizons: list[str] | None) -> list[str]:
    wanted = sorted(HORIZONS) if horizons is None else horizons
    unknown = [h for h in wanted if h not in HORIZONS]
    if unknown:
        raise ValueError(f"unknown horizons {unknown}; known: {sorted(HORIZONS)}")
    return wanted


def datasets(states: DataFrame, bars: DataFrame, horizons: list[str]) -> DataFrame:
    """Labelled rows of every horizon, numbered by date inside (instrument_id, horizon)."""
    days = states.select("instrument_id", "market_date")
    parts = [labels.day_labels(days, bars, HORIZONS[h]).withColumn("horizon", F.lit(h)) for h in horizons]
    found = reduce(DataFrame.unionByName, parts).select(*KEY, "market_date", "label")
    position = F.row_number().over(Window.partitionBy(*KEY).orderBy("market_date")) - 1
    return states.join(found, ["instrument_id", "market_date"]).withColumn("position", position)


def sweep_plan(rows: DataFrame) -> DataFrame:
    """For each instrument and horizon: rows, geometry, where the test window starts, how far whole folds reach, dates, and status.

    The test window is the last one. Status is skipped (too few rows), failed (training rows of one class only) or ready.
    """
    sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))
    shape = labels.geometry(rows.sparkSession).drop("sessions")
    plan = sizes.join(shape, "horizon").withColumn("test_start_at", F.col("n") - F.col("test_size"))
    enough = F.col("n") >= F.col("min_train") + F.col("test_size")
    whole = F.floor((F.col("test_start_at") - F.col("min_train")) / F.col("test_size")).cast("int")
    plan = plan.withColumn("cover", F.when(enough, F.col("min_train") + whole * F.col("test_size")))
    trained, tested = F.col("position") < F.col("test_start_at"), F.col("position") >= F.col("test_start_at")
    facts = rows.join(plan.where(enough).select(*KEY, "test_start_at"), KEY).groupBy(*KEY).agg(
        F.min("market_date").alias("train_start"), F.max(F.when(trained, F.col("market_date"))).alias("train_end"),
        F.min(F.when(tested, F.col("market_date"))).alias("test_start"), F.max("market_date").alias("test_end"),
        F.avg(F.when(tested, F.col("label"))).alias("test_up_rate"), F.count_distinct(F.when(trained, F.col("label"))).alias("_classes"),
    )
    status = F.when(~enough, "skipped").when(F.col("_classes") < 2, "failed").otherwise("ready")
    return plan.join(facts, KEY, "left").withColumn("status", status).drop("_classes")


def walk_forward_means(rows: DataFrame, plan: DataFrame, features: list[str], algorithm: str = "logistic") -> DataFrame:
    """Means over the folds of each run's coverable rows; null, with the number of folds, where a fold had one class to learn from."""
    inside = rows.join(plan.where("status = 'ready'").select(*KEY, "cover", "min_train", "test_size", "step"), KEY).where("position < cover")
    tested = models.walk_forward(inside, features, KEY, algorithm=algorithm, min_train="min_train", test="test_size", step="step")
    by_fold = [*KEY, "fold"]
    scored = ev.classification(tested.where("p is not null"), by_fold).select(*by_fold, "balanced_accuracy")
    every = tested.select(*by_fold).distinct().join(scored, by_fold, "left")
    mean = F.when(F.count("balanced_accuracy") == F.count(F.lit(1)), F.avg("balanced_accuracy"))
    return every.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_folds"), mean.alias("wf_balanced_accuracy"))


def train_sweep(states: DataFrame, bars: DataFrame, features: list[str], *, horizons: list[str] | None = None, version: str = "1.0", algorithm: str = "logistic") -> dict[str, DataFrame]:
    """One model of an algorithm for each instrument and horizon, scored by walk-forward folds and once on its last window.

    Returns `models` (registry rows with their artifacts), `runs` (a record for each model that was tried) and
    `outcomes` (one row for each instrument and horizon, skipped ones too). An unknown horizon is an error. Empty states give
    empty tables. The labelled rows and
    the plan are persisted, as several steps read them.
    """
    wanted = known_horizons(horizons)
    rows = datasets(states, bars, wanted).persist()
    plan = sweep_plan(rows).persist()
    placed = rows.join(plan.where("status <> 'skipped'").select(*KEY, "test_start_at"), KEY)
    fitted = models.fit(placed.where(F.col("position") < F.col("test_start_at")).drop("test_start_at"), features, KEY, algorithm=algorithm).persist()
    registry = fitted.withColumn("feature_version", F.lit(version)).select(*MODEL_COLUMNS)
    late = placed.where(F.col("position") >= F.col("test_start_at")).select(*KEY, "position", F.col("label").alias("y"), *features)
    served = models.score(fitted, late, features, KEY, "position")
    scores = ev.classification(served, KEY, p="p_up").join(ev.roc_auc(served, KEY, p="p_up"), KEY)
    folds = walk_forward_means(rows, plan, features, algorithm)
    tried = plan.where("status <> 'skipped'").join(fitted.select(*KEY, "n_train", F.col("status").alias("_fit")), KEY).join(scores, KEY, "left").join(folds, KEY, "left")
    good = F.col("_fit") == "trained"
    runs = tried.select(*KEY, F.when(good, "succeeded").otherwise("failed").alias("status"), "train_start", "train_end", "n_train", F.lit(len(features)).alias("n_features"), F.when(good, F.col("test_size")).alias("n_test"), "test_start", "test_end", "test_up_rate", "balanced_accuracy", "log_loss", "brier", "roc_auc", "n_folds", "wf_balanced_accuracy", F.when(~good, F.col("_fit")).alias("notes"))
    ended = plan.join(runs.select(*KEY, F.col("status").alias("_end"), "notes"), KEY, "left")
    short = F.concat(F.lit("only "), F.col("n").cast("string"), F.lit(" labelled rows, need "), (F.col("min_train") + F.col("test_size")).cast("string"))
    outcomes = ended.select(*KEY, F.coalesce("_end", "status").alias("status"), F.when(F.col("status") == "skipped", short).otherwise(F.col("notes")).alias("reason"))
    return {"models": registry, "runs": runs, "outcomes": outcomes}


def record_runs(stored: DataFrame, runs: DataFrame, at: Column) -> DataFrame:
    """Run records with those of a sweep appended; records are never rewritten, so a repeated sweep adds its own."""
    return stored.unionByName(runs.withColumn("recorded_at", at).select(*stored.columns))


def save_models(registry: DataFrame, path: str) -> None:
    """Registry rows with their artifacts as Parquet, partitioned by algorithm; of the algorithms among them the stored ones are replaced."""
    registry.select(*MODEL_COLUMNS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("algorithm").parquet(path)


def load_models(spark: SparkSession, path: str, *, algorithm: str = "logistic") -> DataFrame:
    """Models of an algorithm as saved; a table of another shape is refused, and so is an artifact that names another algorithm."""
    models.make_model(algorithm)
    rows = spark.read.parquet(path)
    if set(rows.columns) != set(MODEL_COLUMNS):
        raise ValueError(f"{path} holds no models: columns {sorted(rows.columns)}")
    own = rows.where(F.col("algorithm") == algorithm)
    if own.isEmpty():
        raise ValueError(f"{path} holds no models of {algorithm!r}")
    foreign = own.where(F.col("artifact").isNotNull() & ~F.get_json_object("artifact", "$.algorithm").eqNullSafe(F.lit(algorithm))).limit(1).collect()
    if foreign:
        raise ValueError(f"{path} holds an artifact that is not of {algorithm!r}: {foreign[0]['instrument_id']}, {foreign[0]['horizon']}")
    return own.select(*MODEL_COLUMNS)


def newest_bars(bars: DataFrame, horizons: list[str]) -> DataFrame:
    """Each instrument's last epochs * sessions + 1 bars for each horizon, with `at`, their place from 0, and that count as `most`."""
    wanted = [(h, EPOCHS[h] * HORIZONS[h] + 1) for h in horizons]
    longest = max(k for _, k in wanted)
    newest = bars.withColumn("_back", F.row_number().over(Window.partitionBy("instrument_id").orderBy(F.desc("market_date")))).where(F.col("_back") <= longest)
    sizes = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("most")) for h, k in wanted])
    each = newest.select("instrument_id", "market_date", "close", "_back", F.inline(sizes)).where(F.col("_back") <= F.col("most"))
    return each.withColumn("at", F.row_number().over(Window.partitionBy(*KEY).orderBy("market_date")) - 1).drop("_back")


def demo_backtests(registry: DataFrame, states: DataFrame, bars: DataFrame, features: list[str], *, horizons: list[str] | None = None) -> dict[str, DataFrame]:
    """Backtests of the stored models over each horizon's last epochs; a decision is made at every `sessions`-th bar.

    Returns `backtests` (one row each with prices, signals, equity and trades) and `outcomes` (one row for each instrument with
    bars and each horizon: succeeded, or skipped with the reason no_model, gappy_prices or no_snapshot, the first that holds).
    """
    wanted = known_horizons(horizons)
    steps = F.create_map(*[F.lit(x) for h in wanted for x in (h, HORIZONS[h])])
    window = newest_bars(bars, wanted).withColumn("_holding", F.try_element_at(steps, F.col("horizon")))
    decides = (F.col("at") % F.col("_holding") == 0) & (F.col("at") < F.col("most") - 1)
    asked = window.withColumn("decides", decides)
    vectors = asked.where("decides").select(*KEY, "market_date").join(states, ["instrument_id", "market_date"])
    signals = models.score(registry, vectors, features, KEY, "market_date").select(*KEY, "market_date", (F.col("p_up") >= 0.5).cast("int").alias("signal"))
    known = states.select("instrument_id", "market_date").distinct().withColumn("_known", F.lit(True))
    filled = asked.join(known, ["instrument_id", "market_date"], "left").join(signals, [*KEY, "market_date"], "left")
    trained = registry.where("status = 'trained'").select(*KEY).distinct().withColumn("_model", F.lit(True))
    facts = filled.groupBy(*KEY).agg(F.first("most").alias("most"), F.count("close").alias("_closes"), F.count_if(F.col("decides") & F.col("_known").isNull()).alias("_unknown"), F.min("market_date").alias("start"), F.max("market_date").alias("end")).join(trained, KEY, "left")
    reason = F.when(F.col("_model").isNull(), "no_model").when(F.col("_closes") != F.col("most"), "gappy_prices").when(F.col("_unknown") > 0, "no_snapshot")
    judged = facts.select(*KEY, "start", "end", F.when(reason.isNull(), "succeeded").otherwise("skipped").alias("status"), reason.alias("reason"))
    usable = filled.join(judged.where("status = 'succeeded'").select(*KEY), KEY, "left_semi").withColumn("signal", F.coalesce("signal", F.lit(0)))
    runs = cut(bt.packed(bt.simulate(usable, KEY, "market_date", holding_period=F.col("_holding")), KEY, "market_date"))  # read by both results
    result = runs.withColumn("total_return", F.element_at("equity", -1) / bt.CAPITAL - 1)
    outcomes = judged.join(result.select(*KEY, "total_return", F.size("trades").alias("trades")), KEY, "left")
    return {"backtests": result.join(judged.select(*KEY, "start", "end"), KEY), "outcomes": outcomes}


def save_backtests(stored: DataFrame, backtests: DataFrame, at: Column, notes: Column) -> DataFrame:
    """Stored backtests with new ones appended, nested as they are."""
    return stored.unionByName(backtests.withColumn("saved_at", at).withColumn("notes", notes).select(*stored.columns))


def feature_order(stored: Column, live: Column) -> Column:
    """The order of a live vector: the stored one if it names the same features, else the sorted names of the map `live`."""
    names = F.array_sort(F.map_keys(live))
    return F.when(F.array_sort(stored) == names, stored).otherwise(names)


def ordered_vector(rows: DataFrame, *, stored: str = "names", live: str = "values", width: Column | None = None) -> DataFrame:
    """Adds `order`, `vector` (doubles, null for a missing value) and `error`: feature_mismatch if the model expects another width."""
    expected = F.size(stored) if width is None else width
    ordered = rows.withColumn("order", feature_order(F.col(stored), F.col(live)))
    vector = F.transform("order", lambda n: F.try_element_at(F.col(live), n).cast("double"))
    wrong = F.size("order") != expected
    return ordered.withColumn("vector", F.when(~wrong, vector)).withColumn("error", F.when(wrong, "feature_mismatch"))
