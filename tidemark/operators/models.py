"""Direction models: majority, seeded random, L2 logistic regression and second-order boosted trees, and their walk-forward runs.

A run is one instrument's chronological rows, a few thousand; runs are dealt to tasks by their key and fitted there. `trees.py` also
fits one ensemble to all rows of a table, with histograms summed by Spark.

A fitted model is an artifact: JSON that names its algorithm and holds all it needs to predict. Every algorithm of the factory can be
trained, stored, loaded and served.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .trees import NewtonTrees

# Seed and inverse strength of the penalty.
SEED, INVERSE_PENALTY = 7, 1.0
# End of fixed values.


class Majority:
    """The larger class of the training labels, ties to 0, with the empirical distribution as probability."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Majority:
        self.rate = float(checked_labels(y).mean())
        return self

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.rate)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), int(self.rate > 0.5))


class SeededRandom:
    """Labels drawn with the training distribution from a seeded generator; a drawn label has probability 1."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> SeededRandom:
        self.rate = float(checked_labels(y).mean())
        return self

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        return np.random.default_rng(SEED).choice([0, 1], size=len(x), p=[1 - self.rate, self.rate]).astype(float)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.predict_proba(x).astype(int)


class Logistic:
    """Median imputation, then sum of log losses + |w|^2 / 2C by Newton steps; the intercept is free."""

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 100) -> Logistic:
        y = checked_labels(y)
        if y.min() == y.max():
            raise ValueError("one class only")
        self.medians = medians(x)
        filled = np.where(np.isnan(x), self.medians, x)
        # steps are taken in scaled columns, the penalty is that of the plain ones
        self.scale = np.where(filled.std(axis=0) > 0, filled.std(axis=0), 1.0)
        wide = np.hstack([filled / self.scale, np.ones((len(x), 1))])
        penalty = np.append(1 / self.scale**2 / INVERSE_PENALTY, 0.0)
        theta = np.zeros(wide.shape[1])
        loss = lambda t: np.logaddexp(0, -(2 * y - 1) * (wide @ t)).sum() + 0.5 * (penalty * t * t).sum()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(wide @ theta, -40, 40)))
            grad = wide.T @ (p - y) + penalty * theta
            step = np.linalg.lstsq((wide * (p * (1 - p))[:, None]).T @ wide + np.diag(penalty + 1e-12), grad, rcond=None)[0]
            rate = 1.0
            while loss(theta - rate * step) > loss(theta) and rate > 1e-6:
                rate /= 2
            theta = theta - rate * step
            if np.abs(rate * step).max() < 1e-10:
                break
        self.weights, self.bias = theta[:-1] / self.scale, float(theta[-1])
        return self

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != len(self.weights):
            raise ValueError(f"{len(self.weights)} features expected, {x.shape[1]} given")
        return 1 / (1 + np.exp(-np.clip(np.where(np.isnan(x), self.medians, x) @ self.weights + self.bias, -40, 40)))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.predict_proba(x) >= 0.5).astype(int)


class BoostedTrees(NewtonTrees):
    """Median imputation, then boosted trees with Newton leaves."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        y = checked_labels(y)
        if y.min() == y.max():
            raise ValueError("one class only")
        self.medians = medians(x)
        super().fit(np.where(np.isnan(x), self.medians, x), y)
        return self

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        if x.shape[1] != len(self.medians):
            raise ValueError(f"{len(self.medians)} features expected, {x.shape[1]} given")
        return super().predict_proba(np.where(np.isnan(x), self.medians, x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return (self.predict_proba(x) > 0.5).astype(int)


MODELS: dict[str, Callable] = {"majority": Majority, "random": SeededRandom, "logistic": Logistic, "boosted_trees": BoostedTrees}
#: What an artifact holds of each algorithm.
STATE = {"majority": ("rate",), "random": ("rate",), "logistic": ("weights", "bias", "medians"), "boosted_trees": ("medians", "base", "feature", "threshold", "value")}


def to_artifact(name: str, model) -> str:
    return json.dumps({"algorithm": name} | {k: np.asarray(v).tolist() for k in STATE[name] for v in [getattr(model, k)]})


def from_artifact(name: str, text: str):
    """The model as it was stored; an artifact of another algorithm, or one that lacks something, is refused."""
    held = json.loads(text)
    if held.get("algorithm") != name:
        raise ValueError(f"an artifact of {held.get('algorithm')!r}, not {name!r}")
    missing = [k for k in STATE[name] if k not in held]
    if missing:
        raise ValueError(f"the artifact lacks {missing}")
    model = make_model(name)
    for k in STATE[name]:
        setattr(model, k, np.asarray(held[k]) if isinstance(held[k], list) else held[k])
    return model


def make_model(name: str):
    if name not in MODELS:
        raise ValueError(f"unknown algorithm {name!r}; known: {sorted(MODELS)}")
    return MODELS[name]()


def checked_labels(y: np.ndarray) -> np.ndarray:
    y = np.asarray(y, dtype=np.int64).reshape(-1)
    if not len(y) or not np.isin(y, (0, 1)).all():
        raise ValueError("labels must be 0 or 1, and some")
    return y


def medians(x: np.ndarray) -> np.ndarray:
    """Column medians without NaN; 0 for a column without values."""
    return np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])


OUT = "position int, fold int, y int, p double, majority_p double, guess int"


def walk_forward(rows: DataFrame, features: list[str], by: list[str], *, algorithm: str, min_train: int | str, test: int | str, step: int | str) -> DataFrame:
    """Out-of-fold predictions of runs: each test row with label, P(up), that of the majority of its training part, and the label guessed.

    Rows have `by`, `position`, `label` and the features. Sizes are numbers, or names of columns that are constant in a run. A fold whose training part has one class only has null predictions.
    """
    schema = rows.select(*by).schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", " + OUT
    sizes = (min_train, test, step)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        least, tests, ahead = (int(frame[v].iloc[0]) if isinstance(v, str) else v for v in sizes)
        x, y = frame[features].to_numpy(np.float64, na_value=np.nan), frame["label"].to_numpy(np.int64)
        x = np.where(np.isfinite(x), x, np.nan)
        parts = []
        for fold, end in enumerate(range(least, len(frame) - tests + 1, ahead)):
            tested = slice(end, end + tests)
            part = frame.iloc[tested][[*by, "position"]].assign(fold=fold, y=y[tested], majority_p=float(y[:end].mean()), p=np.nan, guess=None)
            try:
                model = make_model(algorithm).fit(x[:end], y[:end])
                part = part.assign(p=model.predict_proba(x[tested]), guess=model.predict(x[tested]))
            except ValueError:
                pass
            parts.append(part)
        columns = [*by, "position", "fold", "y", "p", "majority_p", "guess"]
        return pd.concat(parts)[columns] if parts else pd.DataFrame(columns=columns)

    return rows.select(*by, "position", "label", *features, *dict.fromkeys(v for v in sizes if isinstance(v, str))).groupBy(*by).applyInPandas(run, schema)


def train(rows: DataFrame, features: list[str], by: list[str], *, algorithm: str = "logistic", cut: int | None = None) -> DataFrame:
    """Coefficients of a logistic model on each run's first rows (position < cut; all without one): `by`, n_train, names, weights, medians, bias, status."""
    schema = rows.select(*by).schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", n_train int, names array<string>, weights array<double>, medians array<double>, bias double, status string"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        x = frame[features].to_numpy(np.float64, na_value=np.nan)
        x = np.where(np.isfinite(x), x, np.nan)
        head = {k: [frame[k].iloc[0]] for k in by} | {"n_train": [len(frame)], "names": [features]}
        try:
            model = make_model(algorithm).fit(x, frame["label"].to_numpy(np.int64))
            return pd.DataFrame(head | {"weights": [model.weights.tolist()], "medians": [model.medians.tolist()], "bias": [model.bias], "status": ["trained"]})
        except ValueError as e:
            return pd.DataFrame(head | {"weights": [None], "medians": [None], "bias": [np.nan], "status": [str(e)]})

    first = rows if cut is None else rows.where(F.col("position") < cut)
    return first.select(*by, "position", "label", *features).groupBy(*by).applyInPandas(run, schema)


def serve(models: DataFrame, rows: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """P(up) of rows by the stored models: a dot product in SQL functions. The models' order of features decides."""
    values = F.array(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features])
    by_name = F.map_from_arrays(F.array(*[F.lit(c) for c in features]), values)
    joined = rows.withColumn("_x", by_name).join(models.where("status = 'trained'").select(*by, "names", "weights", "medians", "bias"), by)
    filled = F.zip_with(F.transform("names", lambda n: F.try_element_at("_x", n)), "medians", lambda v, m: F.coalesce(v, m))
    z = F.aggregate(F.zip_with(filled, "weights", lambda v, w: v * w), F.col("bias"), lambda a, x: a + x)
    p = 1 / (1 + F.exp(-F.least(F.lit(40.0), F.greatest(F.lit(-40.0), z))))
    return joined.select(*rows.columns, p.alias("p_up")).withColumn("p_down", 1 - F.col("p_up"))


def matrix(frame: pd.DataFrame, features: list[str]) -> np.ndarray:
    x = frame[features].to_numpy(np.float64, na_value=np.nan)
    return np.where(np.isfinite(x), x, np.nan)


def _columns(rows: DataFrame, names: list[str]) -> str:
    return rows.select(*names).schema.simpleString()[len("struct<") : -1].replace(":", " ")


def fit(rows: DataFrame, features: list[str], by: list[str], *, algorithm: str) -> DataFrame:
    """A model of any algorithm for each run: `by`, algorithm, n_train, names, artifact, status (trained, or why it is not)."""
    make_model(algorithm)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("position")
        head = {k: [frame[k].iloc[0]] for k in by} | {"algorithm": [algorithm], "n_train": [len(frame)], "names": [features]}
        try:
            model = make_model(algorithm).fit(matrix(frame, features), frame["label"].to_numpy(np.int64))
            return pd.DataFrame(head | {"artifact": [to_artifact(algorithm, model)], "status": ["trained"]})
        except ValueError as e:
            return pd.DataFrame(head | {"artifact": [None], "status": [str(e)]})

    return rows.select(*by, "position", "label", *features).groupBy(*by).applyInPandas(run, _columns(rows, by) + ", algorithm string, n_train int, names array<string>, artifact string, status string")


def score(models: DataFrame, rows: DataFrame, features: list[str], by: list[str], order: str) -> DataFrame:
    """`rows` of the runs that have a trained model, with p_up and p_down; a model's own order of features decides.

    A model that expects features which the rows do not have is an error. What is served is checked (`checked_scores`).
    """

    def run(models: pd.DataFrame, frame: pd.DataFrame) -> pd.DataFrame:
        if not len(models) or not len(frame):
            return pd.DataFrame(columns=[*frame.columns, "p_up"])
        frame, m = frame.sort_values(order), models.iloc[0]
        unknown = sorted(set(m["names"]) - set(features))
        if unknown:
            raise ValueError(f"the model expects {unknown}")
        return frame.assign(p_up=from_artifact(m["algorithm"], m["artifact"]).predict_proba(matrix(frame, list(m["names"]))))

    kept = models.where("status = 'trained'").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "algorithm", "names", "artifact")
    served = kept.groupBy(*[f"_k{i}" for i in range(len(by))]).cogroup(rows.groupBy(*by)).applyInPandas(run, _columns(rows, rows.columns) + ", p_up double")
    return checked_scores(served.withColumn("p_down", 1 - F.col("p_up")), len(features))


def checked_scores(scores: DataFrame, width: int) -> DataFrame:
    """`scores`, whose plan fails on a probability that is missing, outside 0 to 1, or does not make 1 with the other one."""
    if width < 1:
        raise ValueError("a model needs at least one feature")
    up, down = F.col("p_up"), F.col("p_down")
    right = F.coalesce(up.between(0, 1) & down.between(0, 1) & (F.abs(up + down - 1) < 1e-9), F.lit(False))
    return scores.where(F.assert_true(right, F.lit("probabilities must lie in 0 to 1 and sum to 1")).isNull())


def checked_rows(rows: DataFrame, features: list[str]) -> DataFrame:
    """Training rows, whose plan fails on a label other than 0 and 1, a negative position or a feature that is infinite."""
    label = F.coalesce(F.col("label").isin(0, 1), F.lit(False))
    finite = F.forall(F.array(*[F.col(c).cast("double") for c in features]), lambda v: v.isNull() | (F.abs(v) != float("inf")))
    checks = [(label, "labels must be 0 or 1"), (F.coalesce(F.col("position") >= 0, F.lit(False)), "positions must not be negative"), (finite, "features must be finite")]
    for right, message in checks:
        rows = rows.where(F.assert_true(right, F.lit(message)).isNull())
    return rows
