"""Boosted trees, artifacts of every algorithm, and guards of what is trained and served."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, trees

RNG = np.random.default_rng(3)
X = RNG.normal(size=(400, 4)).round(2)
Y = (X[:, 0] * X[:, 1] + 0.5 * X[:, 2] + RNG.normal(size=400) * 0.3 > 0).astype(int)


def plain_first_tree(x, y):
    """The first tree by trying every threshold of every feature: a list of (feature, threshold, left, right) or a leaf's value."""
    p = np.full(len(y), y.mean())
    g, h = p - y, p * (1 - p)
    leaf = lambda i: -trees.RATE * g[i].sum() / (h[i].sum() + trees.PENALTY)
    strength = lambda i: g[i].sum() ** 2 / (h[i].sum() + trees.PENALTY)

    def grow(i, depth):
        if depth == 0:
            return leaf(i)
        best = (trees.LEAST_GAIN, None)
        for f in range(x.shape[1]):
            for t in trees.edges_of(x[:, f]):
                left = x[i, f] < t
                a, b = i[left], i[~left]
                if h[a].sum() >= trees.LEAST_WEIGHT and h[b].sum() >= trees.LEAST_WEIGHT:
                    gain = round(strength(a) + strength(b) - strength(i), 10)
                    if gain > best[0]:
                        best = (gain, (f, t, a, b))
        if best[1] is None:
            return leaf(i)
        f, t, a, b = best[1]
        return (f, t, grow(a, depth - 1), grow(b, depth - 1))

    return grow(np.arange(len(y)), trees.DEPTH)


def test_first_tree_like_every_split_tried():
    model, tree = trees.NewtonTrees(trees=1).fit(X, Y), plain_first_tree(X, Y)

    def walk(row, node):
        return node if not isinstance(node, tuple) else walk(row, node[2] if row[node[0]] < node[1] else node[3])

    margin = np.array([walk(r, tree) for r in X]) + trees.base_of(Y.mean())
    assert model.predict_proba(X) == pytest.approx(trees.sigmoid(margin), abs=1e-12)


def test_trees_learn_what_a_line_cannot():
    model = models.make_model("boosted_trees").fit(X[:300], Y[:300])
    line = models.make_model("logistic").fit(X[:300], Y[:300])
    right = lambda m: (m.predict(X[300:]) == Y[300:]).mean()
    assert right(model) > right(line) + 0.1


def test_pooled_trees_like_those_in_memory(spark):
    names = ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(*map(float, x), int(y)) for x, y in zip(X, Y, strict=True)], "a double, b double, c double, d double, label int").repartition(5)
    edges = [trees.edges_of(c) for c in X.T]
    pooled = trees.pooled_trees(rows, names, trees=4, edges=edges)
    own = trees.NewtonTrees(trees=4).fit(X, Y, edges)
    assert (pooled.feature == own.feature).all() and (pooled.threshold == own.threshold).all()
    assert pooled.predict_proba(X) == pytest.approx(own.predict_proba(X), abs=1e-9)
    approx = trees.pooled_trees(rows, names, trees=2)  # thresholds from Spark's quantiles
    assert np.abs(approx.predict_proba(X) - trees.NewtonTrees(trees=2).fit(X, Y).predict_proba(X)).mean() < 0.01
    with pytest.raises(ValueError, match="both classes"):
        trees.pooled_trees(rows.where("label = 1"), names, trees=1)


def table(spark):
    rows = [(k, i, int(Y[i]), *(float(v) if v > -2 else None for v in X[i])) for k in (1, 2) for i in range(200 * (k - 1), 200 * k)]
    return spark.createDataFrame(rows, "k int, position int, label int, a double, b double, c double, d double")


@pytest.mark.parametrize("algorithm", sorted(models.MODELS))
def test_stored_models_score_as_fitted_ones(spark, tmp_path, algorithm):
    names, rows = ["a", "b", "c", "d"], table(spark)
    models.fit(rows.where("position % 200 < 150"), names, ["k"], algorithm=algorithm).write.parquet(str(tmp_path / "m"))
    loaded = spark.read.parquet(str(tmp_path / "m"))
    assert {r["status"] for r in loaded.collect()} == {"trained"}
    late = rows.where("position % 200 >= 150")
    got = models.score(loaded, late.select("k", "position", "d", "c", "b", "a"), ["d", "c", "b", "a"], ["k"], "position").collect()
    for k in (1, 2):
        own = rows.where(f"k = {k}").toPandas().sort_values("position")
        fitted = models.make_model(algorithm).fit(models.matrix(own[:150], names), own["label"].to_numpy()[:150])
        mine = sorted((r for r in got if r["k"] == k), key=lambda r: r["position"])
        assert [r["p_up"] for r in mine] == pytest.approx(fitted.predict_proba(models.matrix(own[150:], names)).tolist(), abs=1e-12)
        assert all(r["p_up"] + r["p_down"] == pytest.approx(1) for r in mine)


def test_foreign_and_broken_artifacts():
    text = models.to_artifact("majority", models.make_model("majority").fit(X, Y))
    with pytest.raises(ValueError, match="not 'logistic'"):
        models.from_artifact("logistic", text)
    with pytest.raises(ValueError, match="lacks"):
        models.from_artifact("majority", '{"algorithm": "majority"}')
    with pytest.raises(ValueError, match="4 features expected"):
        models.from_artifact("boosted_trees", models.to_artifact("boosted_trees", models.make_model("boosted_trees").fit(X, Y))).predict_proba(X[:, :3])


def test_runs_of_one_class_say_so(spark):
    got = models.fit(table(spark).withColumn("label", F.lit(1)), ["a"], ["k"], algorithm="boosted_trees").collect()
    assert {r["status"] for r in got} == {"one class only"} and {r["artifact"] for r in got} == {None}


def test_unknown_features_of_a_model_are_an_error(spark):
    fitted = models.fit(table(spark), ["a", "b"], ["k"], algorithm="majority")
    with pytest.raises(Exception, match="the model expects"):
        models.score(fitted, table(spark).select("k", "position", "a"), ["a"], ["k"], "position").collect()


@pytest.mark.parametrize("up, down", [(1.2, -0.2), (0.4, 0.4), (None, 0.5), (float("nan"), 0.5)])
def test_probabilities_that_are_none(spark, up, down):
    bad = spark.createDataFrame([(0.5, 0.5), (up, down)], "p_up double, p_down double")
    with pytest.raises(Exception, match="sum to 1"):
        models.checked_scores(bad, 3).collect()


@pytest.mark.parametrize("label, position, a, message", [(2, 0, 1.0, "labels"), (None, 0, 1.0, "labels"), (1, -1, 1.0, "positions"), (1, 0, float("inf"), "finite")])
def test_rows_that_cannot_be_trained_on(spark, label, position, a, message):
    bad = spark.createDataFrame([(1, 0, 0.5), (label, position, a)], "label int, position int, a double")
    with pytest.raises(Exception, match=message):
        models.checked_rows(bad, ["a"]).collect()
    assert models.checked_rows(bad.limit(1), ["a"]).count() == 1
