"""Quality classifier by positive-unlabelled learning (operator 7).

Trusted positives are documents whose label is 1; the unlabelled text is the whole table. Labels 0 are never read. A linear scorer g on
text features minimises the non-negative unbiased risk

    pi R+(g) + max(0, Ru-(g) - pi R+-(g)),

with logistic losses, where R+ and R+- are means over the positives of the loss for label 1 and 0, Ru- is the mean over all documents
of the loss for label 0, and pi is the class prior. The prior is estimated from both kinds of text: a first scorer is fitted for
pi = 1/2, and pi is the least ratio, over thresholds at quantiles of the positives, of the share of all documents above it to the share of
positives above it (each with its margin of error). The scorer is then fitted for that prior.
The score is the probability of label 1 if both classes were equally frequent: sigmoid(g - ln(pi / (1 - pi))).

Features are counts of character classes, pairs of classes, words and lines, so that they depend neither on language nor on the rows of
the sample; they are made once, where a document is read, and stored as one byte each. Fitting takes a few dozen passes over that table.
A pass sums losses and gradients inside each task for several step lengths along one search direction (limited-memory BFGS); sums of
fixed size meet in `MERGED` groups and go to the driver. Only positives are sampled: at most `sample`, those with the least hash of their id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stored

#: Most labelled rows that the scorer is fitted on.
SAMPLE = 4_000
THRESHOLD, FOLDS = 0.3, 5
#: Features are stored in steps of 1 / SCALE; groups in which the sums of tasks meet.
SCALE, MERGED = 80, 16
#: Passes for the first scorer and for the second, step lengths tried in each, and the weight of the squared norm.
PASSES, STEPS, DECAY = (10, 20), (2.0, 1.0, 0.5, 0.2, 0.05), 1e-4
#: Character classes: lower, upper, digit, space, newline, other bytes of UTF-8, and each ASCII sign by itself.
SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _classes() -> np.ndarray:
    table = np.full(256, 5, np.int64)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = 0, 1, 2
    table[[32, 9]], table[[10, 13]] = 3, 4
    table[list(SIGNS)] = 6 + np.arange(len(SIGNS))
    return table


CLASS = _classes()
KINDS = int(CLASS.max()) + 1
EXTRA = 13
WIDTH = KINDS + KINDS * KINDS + EXTRA


def features(text: str) -> np.ndarray:
    """Shares of character classes and of pairs of them (square roots), and a few counts of words and lines; in steps of 1 / SCALE."""
    out = np.zeros(WIDTH, np.float32)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if n:
        kind = CLASS[raw]
        out[:KINDS] = np.sqrt(np.bincount(kind, minlength=KINDS) / n)
        out[KINDS : KINDS * (KINDS + 1)] = np.sqrt(np.bincount(kind[:-1] * KINDS + kind[1:], minlength=KINDS * KINDS) / n)
    words, lines = text.split(), text.split("\n")
    plain = [w.rstrip(".,;:!?").lower() for w in words]
    many, rows = max(1, len(words)), max(1, len(lines))
    out[-EXTRA:] = [
        np.log1p(n) / 10,
        np.log1p(len(words)) / 10,
        min(3.0, n / many / 6),
        len(set(words)) / many,
        sum(map(str.isupper, words)) / many,
        sum(map(str.isalpha, words)) / many,
        len(set(lines)) / rows,
        min(3.0, many / rows / 20),
        min(1.0, max(map(len, words), default=0) / 60),
        float(n < 200),
        float(n == 0),
        sum(w[-1] in ".!?" for w in words) / many,
        sum(map(str.__eq__, plain, plain[1:])) / many,
    ]
    return np.clip(np.rint(out * SCALE), 0, 255).astype(np.uint8)


class Scorer(NamedTuple):
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of stored features."""
        return sigmoid(x.astype(np.float32) @ self.weights + (self.bias - np.log(self.prior / (1 - self.prior)))).astype(np.float64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Unlabelled:
    """The stored features of all documents, seen through passes that return sums."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("x")

    def summed(self, sums_of: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
        """The sum over all rows of `sums_of` a block of them (a vector of `width` numbers)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(width)
            for batch in rows_of(batches, rows=2048):
                total += sums_of(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, WIDTH).astype(np.float32))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % MERGED], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

        def add(key: tuple, rows: pa.Table) -> pa.Table:
            total = sum((np.frombuffer(x) for x in rows["sums"].to_pylist()), np.zeros(width))
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        found = self.rows.mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").collect()
        return sum((np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["part"])), np.zeros(width))

    def losses(self, theta: np.ndarray, way: np.ndarray, steps: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, float]:
        """Sums of the loss for label 0 at theta - a * way for each step a, of its gradient (bias last), and the number of rows."""
        both = np.stack([theta, way]).astype(np.float32)

        def sums_of(x: np.ndarray) -> np.ndarray:
            at, along = (x @ both[:, :-1].T + both[:, -1]).T
            g = at - np.array(steps, np.float32)[:, None] * along
            p = sigmoid(g)
            return np.concatenate([np.logaddexp(0, g).sum(axis=1, dtype=np.float64), (p @ x).ravel(), p.sum(axis=1, dtype=np.float64), [len(x)]])

        k = len(steps)
        out = self.summed(sums_of, k * (WIDTH + 2) + 1)
        return out[:k], np.hstack([out[k : k + k * WIDTH].reshape(k, WIDTH), out[-k - 1 : -1, None]]), out[-1]

    def spread(self) -> np.ndarray:
        """Standard deviation of each feature, at least SCALE / 20."""
        out = self.summed(lambda x: np.concatenate([x.sum(axis=0, dtype=np.float64), (x.astype(np.float64) ** 2).sum(axis=0), [len(x)]]), 2 * WIDTH + 1)
        mean = out[:WIDTH] / out[-1]
        return np.sqrt(np.maximum(out[WIDTH:-1] / out[-1] - mean**2, (SCALE / 20) ** 2))

    def above(self, theta: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The share of rows with a g of at least each bound."""
        out = self.summed(lambda x: np.append((x @ theta[:-1].astype(np.float32) + theta[-1] >= bounds[:, None]).sum(axis=1), len(x)).astype(np.float64), len(bounds) + 1)
        return out[:-1] / out[-1]


def fit_risk(positive: np.ndarray, unlabelled: Unlabelled, prior: float, spread: np.ndarray, passes: int, start: np.ndarray | None = None) -> np.ndarray:
    """Weights and bias (last) with the least non-negative risk, `DECAY` times half the squared norm of the weights on standardised features added.

    Limited-memory BFGS on the standardised features; every pass over the unlabelled rows tries all STEPS and takes the best.
    """
    unit = np.append(spread, 1.0)
    positive = np.hstack([positive.astype(np.float32), np.ones((len(positive), 1), np.float32)])

    def at(theta: np.ndarray, way: np.ndarray, steps: tuple[float, ...]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        loss, grad, n = unlabelled.losses(theta / unit, way / unit, steps)
        out = []
        for a, sum_loss, sum_grad in zip(steps, loss, grad, strict=True):
            there = theta - a * way
            g = positive @ (there / unit).astype(np.float32)
            p = sigmoid(g)
            rest = sum_loss / n - prior * np.logaddexp(0, g).mean()
            slope = prior * (positive.T @ (p - 1)) / len(positive)
            if rest > 0:
                slope = slope + sum_grad / n - prior * (positive.T @ p) / len(positive)
            out.append((float(prior * np.logaddexp(0, -g).mean() + max(0.0, rest) + DECAY / 2 * there @ there), slope / unit + DECAY * there, there))
        return out

    theta = np.zeros(len(unit)) if start is None else start * unit
    risk, grad, _ = at(theta, np.zeros_like(theta), (0.0,))[0]
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    reach = 1.0
    for _ in range(passes):
        way, shares = grad.copy(), []
        for s, y in reversed(moves):
            shares.append(s @ way / (s @ y))
            way -= shares[-1] * y
        way *= (moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]) if moves else reach / max(np.linalg.norm(grad), 1e-9)
        for (s, y), share in zip(moves, reversed(shares), strict=True):
            way += s * (share - y @ way / (s @ y))
        found = min(at(theta, way, STEPS), key=lambda x: x[0])
        if found[0] >= risk - 1e-7:
            # where the max() has its kink, curvature from the other side misleads: down the gradient itself, by less each time
            if not moves:
                reach /= 10
            moves = []
            if reach < 1e-3:
                break
            continue
        s, y = found[2] - theta, found[1] - grad
        if s @ y > 1e-10:
            moves = [*moves[-9:], (s, y)]
        risk, grad, theta = found
    return theta / unit


def estimate_prior(positive: np.ndarray, unlabelled: Unlabelled, theta: np.ndarray) -> float:
    """The least ratio of the share of all documents to the share of positives above a threshold, each with its margin."""
    g = np.sort(positive.astype(np.float32) @ theta[:-1].astype(np.float32) + theta[-1])
    bounds = np.quantile(g, np.linspace(0.02, 0.9, 80))
    mine = 1 - np.searchsorted(g, bounds, "left") / len(g)
    ratio = unlabelled.above(theta, bounds) / np.maximum(mine, 1 / len(g))
    margin = np.sqrt(np.log(40) / 2 / len(g)) / np.maximum(mine, 1 / len(g))
    return float(np.clip(ratio[np.argmin(ratio + margin)], 0.01, 0.99))


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never looked at."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def with_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            raw = [features(t.as_py() or "").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "x"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, x binary")


def fit(rows: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample: int = SAMPLE) -> Scorer | None:
    """A scorer from stored features (doc_id, x) of all documents and the positive labels outside the held-out fold.

    At most `sample` positive rows come to the driver. None where there is no positive document to learn from.
    """
    positives = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where((F.col("y") == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    drawn = positives.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` ids, so they may be broadcast
    found = rows.join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    if not found:
        return None
    positive = np.stack([np.frombuffer(r["x"], np.uint8) for r in found])
    unlabelled = Unlabelled(rows)
    spread = unlabelled.spread()
    first = fit_risk(positive, unlabelled, 0.5, spread, PASSES[0])
    prior = estimate_prior(positive, unlabelled, first)
    theta = fit_risk(positive, unlabelled, prior, spread, PASSES[1], first)
    return Scorer(theta[:-1].astype(np.float32), float(theta[-1]), prior)


def scored(rows: DataFrame, scorer: Scorer | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for stored features (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.score(x) if scorer else np.full(len(x), 0.5))], names=["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the positive labels outside the held-out fold and all text, and score every document.

    Returns doc_id, held_out, score, predicted.

    Defined cases: a null text counts as empty and is scored like any other; rows that repeat an id are scored one by one;
    a null id is not held out; without positive labels every score is 0.5; an empty table gives no rows; other columns are ignored.
    """
    rows = stored(with_features(docs, id_col, text_col)).rows
    return scored(rows, fit(rows, labels, sample=sample), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that the classifier does not reject; scoring and choosing are one pass.

    Without positive labels nothing is known to be bad, and all documents stay. The other cases are those of `classify`.
    """
    made = stored(with_features(docs, id_col, text_col))
    scorer = fit(made.rows, labels, sample=sample)
    made.drop()
    if scorer is None:
        return docs

    @F.pandas_udf("double")
    def quality(text):
        import pandas as pd

        out = np.empty(len(text))
        for i in range(0, len(text), 512):
            out[i : i + 512] = scorer.score(np.stack([features(t or "") for t in text.iloc[i : i + 512]]))
        return pd.Series(out)

    return docs.where(quality(F.coalesce(F.col(text_col), F.lit(""))) >= threshold)
