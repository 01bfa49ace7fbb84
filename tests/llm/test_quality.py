import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pu_quality

SF = "/root/testdata/sf0.01"


class Local(pu_quality.Unlabelled):
    """All rows in one array instead of a table."""

    def __init__(self, x):
        self.x = x.astype(np.float32)

    def summed(self, sums_of, width):
        return sums_of(self.x)


def risk(theta, positive, unlabelled, prior, spread):
    """The penalised non-negative risk from its definition."""
    soft = lambda z: np.logaddexp(0, z).mean()
    p, u = positive @ theta[:-1] + theta[-1], unlabelled @ theta[:-1] + theta[-1]
    norm = np.append(theta[:-1] * spread, theta[-1])
    return prior * soft(-p) + max(0.0, soft(u) - prior * soft(p)) + pu_quality.DECAY / 2 * norm @ norm


@pytest.fixture(scope="module")
def texts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("documents", "labels"))
    x = np.stack([pu_quality.features(t or "") for t in docs.text])
    good = docs.doc_id.isin(labels.doc_id[labels.quality == 1]).to_numpy()
    return x[good][:150], x[:500]


def test_least_risk_is_that_of_plain_descent(texts, monkeypatch):
    """At least as low as many small steps get, with a norm that makes the problem well posed."""
    monkeypatch.setattr(pu_quality, "DECAY", 0.01)
    positive, everything = texts
    local = Local(everything)
    spread = local.spread()
    theta = pu_quality.fit_risk(positive, local, 0.7, spread, 60)
    found = risk(theta, positive, everything, 0.7, spread)
    # plain descent in many small steps
    p1, u1 = (np.hstack([x / spread, np.ones((len(x), 1))]) for x in (positive, everything))
    z = np.zeros(p1.shape[1])
    for _ in range(2000):
        gp, gu = p1 @ z, u1 @ z
        rest = np.logaddexp(0, gu).mean() - 0.7 * np.logaddexp(0, gp).mean()
        slope = 0.7 * p1.T @ (pu_quality.sigmoid(gp) - 1) / len(p1) + pu_quality.DECAY * z
        if rest > 0:
            slope += u1.T @ pu_quality.sigmoid(gu) / len(u1) - 0.7 * p1.T @ pu_quality.sigmoid(gp) / len(p1)
        z -= 0.02 * slope
    want = risk(np.append(z[:-1] / spread, z[-1]), positive, everything, 0.7, spread)
    assert found <= want + 1e-3 and found < risk(np.zeros(len(z)), positive, everything, 0.7, spread)


def test_without_a_norm_the_risk_stays_non_negative(texts):
    positive, everything = texts
    local = Local(everything)
    theta = pu_quality.fit_risk(positive, local, 0.7, local.spread(), 60)
    p, u = positive @ theta[:-1] + theta[-1], everything @ theta[:-1] + theta[-1]
    assert np.logaddexp(0, u).mean() - 0.7 * np.logaddexp(0, p).mean() > -0.01


def test_passes_over_a_table_give_the_sums_of_an_array(spark, texts):
    rows = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(texts[1])], "doc_id long, x binary").repartition(5)
    table, local = pu_quality.Unlabelled(rows), Local(texts[1])
    rng = np.random.default_rng(3)
    theta, way = rng.normal(0, 0.01, (2, pu_quality.WIDTH + 1))
    for a, b in zip(table.losses(theta, way, (1.0, 0.1)), local.losses(theta, way, (1.0, 0.1)), strict=True):
        assert np.allclose(a, b, rtol=1e-4)
    assert np.allclose(table.spread(), local.spread())
    bounds = np.array([-1.0, 0.0, 1.0])
    assert np.allclose(table.above(theta, bounds), local.above(theta, bounds))


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_prior_is_estimated_without_negatives(share):
    rng = np.random.default_rng(7)
    x = lambda n, shift: np.clip(rng.normal(100 + shift, 10, (n, pu_quality.WIDTH)) * (np.arange(pu_quality.WIDTH) < 4), 0, 255).astype(np.uint8)
    positive, mixed = x(1500, 15), np.vstack([x(int(4000 * share), 15), x(4000 - int(4000 * share), -15)])
    local = Local(mixed)
    theta = pu_quality.fit_risk(positive, local, 0.5, local.spread(), 20)
    assert abs(pu_quality.estimate_prior(positive, local, theta) - share) < 0.12


def test_labels_0_are_never_read(spark, docs, words):
    d = docs([words(30, i) + (" ###" * (i % 2)) for i in range(60)])
    positive = [(i, 1, 0) for i in range(0, 60, 2)]
    schema = "doc_id long, quality int, toxic int"
    with_negatives = spark.createDataFrame(positive + [(i, 0, 0) for i in range(1, 60, 2)], schema)
    first, second = ({r["doc_id"]: r["score"] for r in pu_quality.classify(d, x).collect()} for x in (spark.createDataFrame(positive, schema), with_negatives))
    assert first == pytest.approx(second)


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return pu_quality.classify(docs, labels).join(labels, "doc_id").toPandas()


def test_held_out_accuracy(scored):
    test = scored[scored.held_out]
    assert ((test.held_out) == [zlib.crc32(str(i).encode()) % 5 == 0 for i in test.doc_id]).all()
    assert len(test) > 20 and (test.predicted == test.quality).mean() > 0.85
    ranked = [(a > b) + 0.5 * (a == b) for a in test.score[test.quality == 1] for b in test.score[test.quality == 0]]
    assert np.mean(ranked) > 0.9


def test_held_out_labels_lang_and_source_do_not_matter(spark, docs, words):
    d = docs([words(30, i) + (" ###" * (i % 2)) for i in range(120)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(120)], "doc_id long, quality int, toxic int")
    flipped = labels.withColumn("quality", F.when(pu_quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    first = {r["doc_id"]: r["score"] for r in pu_quality.classify(d, labels).collect()}
    other = d.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y"))
    second = {r["doc_id"]: r["score"] for r in pu_quality.classify(other, flipped).collect()}
    assert first == pytest.approx(second)
    assert all(0 <= v <= 1 for v in first.values())


def test_keep_good_keeps_what_is_predicted(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in pu_quality.keep_good(docs, labels).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in pu_quality.classify(docs, labels).where("predicted = 1").collect()}
