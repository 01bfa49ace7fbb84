"""The stages one after another, each against its plain meaning."""

import re

import corpus_pipeline
import pytest

from tests.llm.test_chosen_path import brute
from tidemark.llm import mixing, pack_histogram, pu_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, SF).cache()
        out.append((name, docs, got))
        docs = got
    return out


def test_stages_in_order(steps):
    assert [n for n, _, _ in steps] == ["quality", "exact dedup", "near dedup", "mixture", "packing"]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_decisions(spark, steps):
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    (_, docs, good), (_, _, unique), (_, _, near), (_, _, mixed), (_, _, packed) = steps
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert ids(good) == {r["doc_id"] for r in pu_quality.classify(docs, labels).where("predicted = 1").collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in good.collect())
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), i)
    assert ids(unique) == set(first.values())
    texts = sorted((r["doc_id"], r["text"]) for r in unique.collect())
    classes = brute([t for _, t in texts])
    assert ids(near) == {texts[c][0] for c, _ in classes.values()}
    assert ids(mixed) == {r["doc_id"] for r in mixing.mix(near).where("sampled").collect()}
    want = sorted(map(tuple, pack_histogram.pack(mixed).collect()))
    assert sorted(map(tuple, packed.collect())) == want and {w[0] for w in want} == ids(mixed)


def test_run_is_the_stages(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[-1][2].collect()))
