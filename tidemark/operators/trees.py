"""Second-order gradient boosting for two classes: binned features, histograms of gradients and Hessians, Newton leaves.

`NewtonTrees` fits the rows of one run in memory. `pooled_trees` fits one ensemble to all rows of a table: each task sums the gradients and
Hessians of its rows by node, feature and bin, Spark adds the sums up, and the driver, which sees one pair of numbers for each of
them however many rows there are, picks the splits. Both choose splits by the same function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

# Trees, depth, learning rate, L2 penalty of leaves, least Hessian of a child, bins of a feature.
TREES, DEPTH, RATE, PENALTY, LEAST_WEIGHT, BINS = 100, 3, 0.1, 1.0, 1.0, 256
# End of fixed values.
LEAST_GAIN = 1e-6


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def edges_of(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between the distinct values of a feature, or between its quantiles if there are too many."""
    distinct = np.unique(values)
    if len(distinct) > bins:
        distinct = np.unique(np.quantile(values, np.linspace(0, 1, bins), method="inverted_cdf"))
    return (distinct[1:] + distinct[:-1]) / 2


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many thresholds are at most as large."""
    return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1).astype(np.int64) if edges else np.zeros((len(x), 0), np.int64)


def histograms(codes: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of g and h by node, feature and bin."""
    rows, features = codes.shape
    slot = ((node[:, None] * features + np.arange(features)) * bins + codes).reshape(-1)
    total = nodes * features * bins
    return tuple(np.bincount(slot, np.repeat(v, features), total).reshape(nodes, features, bins) for v in (g, h))


def best_splits(g: np.ndarray, h: np.ndarray, widths: np.ndarray) -> list[tuple[int, int] | None]:
    """For each node the feature and the last bin that goes left; None if no split gains. `widths`: bins of each feature."""
    left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    strength = lambda a, b: a * a / (b + PENALTY)
    gain = strength(left_g, left_h) + strength(right_g, right_h) - strength(all_g, all_h)
    able = (left_h >= LEAST_WEIGHT) & (right_h >= LEAST_WEIGHT) & (np.arange(g.shape[2]) < (widths - 1)[None, :, None])
    gain = np.where(able, gain, -np.inf).round(10)  # sums in another order must not decide between equal splits
    flat = gain.reshape(len(gain), -1)
    at = flat.argmax(axis=1)
    return [divmod(int(k), g.shape[2]) if flat[i, k] > LEAST_GAIN else None for i, k in enumerate(at)]


class Grown:
    """One tree while it grows, by codes: nodes are numbered like a heap; `split` holds feature and bin, or (-1, 0) for a leaf."""

    def __init__(self, depth: int):
        self.split = np.full((2 ** (depth + 1) - 1, 2), (-1, 0))
        self.value = np.zeros(len(self.split))

    def node_of(self, codes: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(codes), np.int64)
        for _ in range(depth):
            feature, last = self.split[node].T
            right = codes[np.arange(len(codes)), np.maximum(feature, 0)] > last
            node = np.where(feature >= 0, 2 * node + 1 + right, node)
        return node

    def grow(self, level: int, g: np.ndarray, h: np.ndarray, widths: np.ndarray, depth: int) -> None:
        """Split the nodes of a level, or make leaves of them."""
        first = 2**level - 1
        found = best_splits(g, h, widths) if level < depth else [None] * len(g)
        for i, split in enumerate(found):
            if split is None:
                self.value[first + i] = -RATE * g[i, 0].sum() / (h[i, 0].sum() + PENALTY)
            else:
                self.split[first + i] = split


class NewtonTrees:
    def __init__(self, trees: int = TREES, depth: int = DEPTH):
        self.trees, self.depth = trees, depth

    def fit(self, x: np.ndarray, y: np.ndarray, edges: list[np.ndarray] | None = None) -> NewtonTrees:
        edges = edges or [edges_of(c) for c in x.T]
        codes, widths = coded(x, edges), np.array([len(e) + 1 for e in edges])
        self.base = base_of(y.mean())
        margin, grown = np.full(len(y), self.base), []
        for _ in range(self.trees):
            p = sigmoid(margin)
            tree = Grown(self.depth)
            for level in range(self.depth + 1):
                node = tree.node_of(codes, level) - (2**level - 1)
                here = node >= 0
                tree.grow(level, *histograms(codes[here], node[here], (p - y)[here], (p * (1 - p))[here], 2**level, int(widths.max())), widths, self.depth)
            margin += tree.value[tree.node_of(codes, self.depth)]
            grown.append(tree)
        self.keep(grown, edges)
        return self

    def keep(self, grown: list[Grown], edges: list[np.ndarray]) -> None:
        """Splits by values: a row goes right if its value is at least the threshold."""
        self.feature = np.array([t.split[:, 0] for t in grown])
        self.threshold = np.array([[edges[f][b] if f >= 0 else 0.0 for f, b in t.split] for t in grown])
        self.value = np.array([t.value for t in grown])

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        margin, every = np.full(len(x), float(self.base)), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                node = np.where(inner, 2 * node + 1 + (x[every, np.maximum(feature[node], 0)] >= threshold[node]), node)
            margin += value[node]
        return sigmoid(margin)


def base_of(rate: float) -> float:
    rate = min(max(float(rate), 1e-6), 1 - 1e-6)
    return float(np.log(rate / (1 - rate)))


def pooled_trees(rows: DataFrame, features: list[str], *, label: str = "label", trees: int = TREES, depth: int = DEPTH, bins: int = BINS, edges: list[np.ndarray] | None = None) -> NewtonTrees:
    """One ensemble over all rows, whose features are finite numbers. Tables without rows or with one class are an error.

    The driver holds the thresholds (one number for each feature and bin), the trees, and the sums of one level.
    """
    x = [F.col(c).cast("double") for c in features]
    facts = rows.agg(F.avg(F.col(label).cast("double")).alias("rate"), *[F.percentile_approx(c, [i / (bins - 1) for i in range(bins)], 100 * bins).alias(f"q{i}") for i, c in enumerate(x if edges is None else [])]).first()
    if facts["rate"] is None or facts["rate"] in (0.0, 1.0):
        raise ValueError("rows of both classes are needed")
    edges = edges or [edges_of(np.array(facts[f"q{i}"])) for i in range(len(features))]
    widths, base = np.array([len(e) + 1 for e in edges]), base_of(facts["rate"])
    width = int(widths.max())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).T
            codes = coded(values, edges).astype("<u2")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in codes], pa.binary())], names=["y", "codes"])

    table = cut(rows.select(F.col(label).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).mapInArrow(encode, "y double, codes binary"))
    grown: list[Grown] = []
    for _ in range(trees):
        tree = Grown(depth)
        for level in range(depth + 1):

            def sums(batches: Iterator[pa.RecordBatch], tree: Grown = tree, level: int = level, done: tuple = tuple(grown)) -> Iterator[pa.RecordBatch]:
                total = np.zeros((2, 2**level * len(features) * width))
                for batch in batches:
                    y = batch.column(0).to_numpy()
                    codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(len(y), -1).astype(np.int64)
                    p = sigmoid(base + sum((t.value[t.node_of(codes, depth)] for t in done), np.zeros(len(y))))
                    node = tree.node_of(codes, level) - (2**level - 1)
                    here = node >= 0
                    for k, v in enumerate(histograms(codes[here], node[here], (p - y)[here], (p * (1 - p))[here], 2**level, width)):
                        total[k] += v.reshape(-1)
                at = np.flatnonzero(total[1])
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0][at]), pa.array(total[1][at])], names=["slot", "g", "h"])

            found = table.mapInArrow(sums, "slot long, g double, h double").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            g, h = np.zeros(2**level * len(features) * width), np.zeros(2**level * len(features) * width)
            for r in found:
                g[r["slot"]], h[r["slot"]] = r["g"], r["h"]
            shape = (2**level, len(features), width)
            tree.grow(level, g.reshape(shape), h.reshape(shape), widths, depth)
        grown.append(tree)
    model = NewtonTrees(trees, depth)
    model.base = base
    model.keep(grown, edges)
    return model
