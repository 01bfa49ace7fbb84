import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, queries


def test_marginals_meet_the_targets(spark):
    rows = [(i, "w " * (1 + i % 7), ["web", "books", "code"][i % 3], ["en", "de"][i % 2], ["a", "b"][i % 5 % 2]) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": {"web": 0.5, "books": 0.3, "code": 0.2}, "lang": {"en": 0.7, "de": 0.3}, "topic": {"a": 0.5, "b": 0.5}}
    got = mixing.mix(d, targets=targets, missing=0.0).cache()
    expected = got.withColumn("w", F.col("tokens") * F.col("probability"))
    total = expected.agg(F.sum("w")).first()[0]
    for dim, goal in targets.items():
        share = {r[0]: r[1] / total for r in expected.groupBy(dim).agg(F.sum("w")).collect()}
        assert share == pytest.approx(goal, abs=2e-3)
    assert got.agg(F.max("probability")).first()[0] == 1
    kept, chance = got.agg(F.count_if("sampled"), F.sum("probability")).first()
    assert abs(kept - chance) < 4 * chance**0.5


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    names = ["doc_id", "tokens", "probability", "sampled"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({mixing.oracle()})").fetchall())
    assert sorted(map(tuple, queries.op3_mixing(spark, sf).select(*names).collect())) == want


def test_targets_that_contradict_each_other_are_an_error(spark):
    # web is only in English, so that no weights have 0.9 of web and 0.9 of German
    rows = [(i, "w w", ["web", "books"][i % 2], ["en", "de"][i % 2], "a") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    with pytest.raises(ValueError, match="contradict"):
        mixing.mix(d, targets={"source": {"web": 0.9, "books": 0.1}, "lang": {"en": 0.1, "de": 0.9}}, fit=mixing.FIT)


def test_no_more_cells_than_fit_one_task_changes_nothing(docs, words, monkeypatch):
    d = docs([words(10, i) for i in range(60)])
    one = sorted(map(tuple, mixing.mix(d).collect()))
    monkeypatch.setattr(mixing, "CELLS_AT_ONCE", 0)
    assert sorted(map(tuple, mixing.mix(d).collect())) == one


def test_value_without_target_gets_nothing(docs):
    got = mixing.mix(docs(["a b"] * 40), targets={"source": {"web": 1.0}})
    assert {r["source"] for r in got.where("sampled").collect()} == {"web"}


def test_one_rare_row_does_not_set_the_yield(spark):
    rows = [(i, "w " * 20, ["web", "books", "code"][i % 3], ["en", "de"][i % 2], ["a", "b"][i % 5 % 2]) for i in range(6000)]
    schema = "doc_id long, text string, source string, lang string, topic string"
    plain = mixing.sample_documents(spark.createDataFrame(rows, schema)).count()
    rare = spark.createDataFrame([*rows, (-1, "", None, None, "a")], schema)
    kept = mixing.sample_documents(rare)
    assert kept.where("source is null").count() == 1
    assert kept.count() > 0.9 * plain
    # the cells that are not rare still have the raked shares
    got = mixing.mix(rare, missing=mixing.MISSING, fit=mixing.FIT).where("source <> ''").groupBy("source").agg(F.sum(F.col("tokens") * F.col("probability")).alias("w")).collect()
    total = sum(r["w"] for r in got)
    assert [r["w"] / total for r in got] == pytest.approx([1 / 3] * 3, abs=0.02)


def test_marginals_fit_within_tolerance(spark):
    """Skewed cells, for which one round is far from enough."""
    rows = [(i, s, x, t, n, float(n)) for i, (s, x, t, n) in enumerate([("a", "x", "p", 900), ("a", "y", "q", 10), ("b", "x", "q", 5), ("b", "y", "p", 700), ("b", "y", "q", 3), ("a", "x", "q", 1)])]
    cells = spark.createDataFrame(rows, "i long, source string, lang string, topic string, tokens long, weight double").drop("i", "weight")
    targets = {"source": {"a": 0.3, "b": 0.7}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 0.4, "q": 0.6}}
    assert mixing.misfit(mixing.rake(cells, targets, 1, 1.0)) > mixing.FIT
    assert mixing.misfit(mixing.rake(cells, targets, 1, 1.0, fit=mixing.FIT)) <= mixing.FIT
