"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import alignment, chosen_path, exact_dedup, importance, language_id, mixing, pack_bfd, pack_histogram, phrase_dedup, pu_quality, sharding, url_rules, weighted_sampling

LABELS = [(1, 1, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (4, 1, 0), (4, 1, 0), (6, 1, 0), (7, 0, 1), (8, 1, None)]


def labels_of(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def pages_of(docs):
    return docs.select(F.col("doc_id").alias("page_id"), F.when(F.col("doc_id") % 2 == 0, "http://a.b.fr/x").alias("url"), F.col("text").alias("html"), "lang")


OPERATORS = {
    "exact_dedup": lambda s, d: exact_dedup.exact_dedup(d),
    "first_of_each": lambda s, d: exact_dedup.first_of_each(d),
    "pack_bfd": lambda s, d: pack_bfd.digest(pack_bfd.pack_sequences(d)),
    "mixing": lambda s, d: mixing.mix(d),
    "sample_documents": lambda s, d: mixing.sample_documents(d),
    "packing": lambda s, d: pack_histogram.pack(d),
    "language_id": lambda s, d: language_id.identify(pages_of(d), d),
    "jaccard_join": lambda s, d: chosen_path.jaccard_join(d),
    "one_of_each": lambda s, d: chosen_path.one_of_each(d),
    "quality": lambda s, d: pu_quality.classify(d, labels_of(s)),
    "keep_good": lambda s, d: pu_quality.keep_good(d, labels_of(s)),
    "phrase_dedup": lambda s, d: phrase_dedup.remove_repeats(d),
    "sharding": lambda s, d: sharding.kd_shards(d, shards=3),
    "fingerprints": lambda s, d: weighted_sampling.neighbours(d),
    "alignment": lambda s, d: alignment.align(d),
    "importance": lambda s, d: importance.resample(d, d.select(F.col("doc_id").alias("item_id"), "text").limit(3)),
    "url_rules": lambda s, d: url_rules.judge(pages_of(d), url_rules.rule_files(s.createDataFrame(url_rules.RULES, "host string, path string, verdict string"))),
}
ONE_ROW_EACH = ["exact_dedup", "mixing", "language_id", "jaccard_join", "quality", "phrase_dedup", "sharding", "fingerprints", "alignment", "importance", "url_rules"]


def clashing(d):
    """More columns, named like those that operators make on the way."""
    for c in ("id", "t", "row", "h", "n", "keep", "kept", "rows", "bucket", "part", "node", "links", "score", "x", "size", "shard", "first", "tokens", "topic_", "batch", "data", "k", "home", "_chosen", "_id", "length"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture
def odd(docs, words):
    long = words(9000, 1)
    return docs([(1, None), (2, ""), (3, " \t\n "), (4, "one"), (4, "one"), (5, "one"), (None, "one two"), (None, None), (6, long), (7, long + " x"), (8, "naïve – 日本語 \U0001f600 text with marks"), (9, "<|endoftext|> as text")])


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, odd, name):
    plain = OPERATORS[name](spark, odd)
    rows = plain.collect()
    if name in ONE_ROW_EACH:
        assert len(rows) == odd.count()
    more = OPERATORS[name](spark, clashing(odd))
    assert more.count() == len(rows)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, docs, name):
    assert OPERATORS[name](spark, docs([])).count() == 0
