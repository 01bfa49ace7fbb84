"""Exact dedup by skew-safe combining (operator 1).

Equal texts meet in three steps, each a grouping on digest *and* full content:

1. inside each input partition (map-side partial aggregation),
2. inside each salted digest group, the salt being the input partition modulo `salts`,
3. among the salt winners of a digest, globally.

A text that fills a third of the table reaches the salted groups as one row per input partition and the last step as
`salts` rows, so no task sees the group itself. Only digest, winner and size go on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RUN, cut, text_or_empty


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest_chars: int = 64) -> DataFrame:
    """Group documents whose normalised texts are equal; the smallest id of a group stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Defined cases: a null text counts as empty, and empty texts form one group. A null id is never smaller than another;
    a group of null ids has a null keep_id. Rows that repeat a doc_id and its text are members of the group like any
    others, and exactly one row of each group is kept. An empty table gives no rows. Other columns are ignored, whatever
    their names. `digest_chars` shortens the grouping digest (tests use it to force collisions): texts that share a digest
    are told apart by content.
    """
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_or_empty(text_col)).alias("t"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("sha", F.sha2("t", 256)).withColumn("h", F.substring("sha", 1, digest_chars))
    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("h", "salt", "t").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("h", "t").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    classes = cut(winners.select("h", F.sha2("t", 256).alias("c_sha"), "keep", "n"))
    shared = classes.groupBy("h").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    if shared.isEmpty():
        # every digest stands for one content, as the grouping on content has shown: the digest is enough from here on
        joined = rows.drop("t").join(classes.select("h", "keep", "n"), "h")
    else:
        joined = rows.join(winners.select("h", "t", "keep", "n"), ["h", "t"])
    kept = F.col("id").eqNullSafe(F.col("keep"))
    repeated = docs.groupBy(F.col(id_col).alias("id")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    if not repeated.isEmpty():
        # several rows may carry the winning id: the first of them stays
        first = joined.where(kept).groupBy("sha").agg(F.min("row").alias("first"))
        joined, kept = joined.join(first, "sha"), F.col("row") == F.col("first")
    return joined.select(
        F.col("id").alias("doc_id"),
        F.col("keep").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        kept.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def first_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text one stays.

    Rows without an id stay if one without an id stands for its group.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    kept = exact_dedup(docs, **options).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    named = docs.withColumn("_text_sha256", F.sha2(normalised(F.col(text_col)), 256))
    chosen = named.join(kept, named[id_col].eqNullSafe(kept["_id"]) & (named["_text_sha256"] == kept["_sha"]), "left_semi").drop("_text_sha256")
    repeated = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return chosen if repeated.isEmpty() else chosen.dropDuplicates([id_col, text_col])
