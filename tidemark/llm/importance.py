"""Importance resampling towards a target text (operator 13), after the method that hashes n-grams into buckets.

A text's features are its runs of one to three words; each falls into one of 10,000 buckets. The gain of a bucket is the
logarithm of its smoothed frequency in the target over that in the corpus, in thousandths, rounded down; a document's weight is the sum of its
features' gains. Adding Gumbel noise that depends on the document's id and taking the highest scores draws without
replacement, with chances in proportion to the exponentials of the weights.

Higher-order functions make the array of buckets inside each row, and `aggregate` sums the gains of a literal array over it:
no row is exploded and no feature is shuffled, only counts of buckets are. Arrays are written once, as both passes read them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

BUCKETS = 10_000
#: Documents with fewer words are scored but never drawn.
LEAST_WORDS = 20
#: What parts words: ASCII that is neither letter nor digit.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bins of one step of the search for the lowest drawn score.
BINS = 4096
ROWS = 1 << 33  # monotonically_increasing_id counts rows of a partition from a multiple of this


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once for the row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), "")


def buckets_of(words: Column, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of one, two and three of the words, repeats included."""

    def longer(runs: Column, more: Column) -> Column:
        """Each run with the word that follows it; the last run has none."""
        return F.zip_with(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), more, lambda run, word: F.concat(run, F.lit(" "), word))

    def from_words(w: Column) -> Column:
        twos = longer(w, F.slice(w, F.lit(2), F.size(w) + 1))
        return let(twos, lambda two: F.transform(F.concat(w, two, longer(two, F.slice(w, F.lit(3), F.size(w) + 1))), lambda run: (F.crc32(run) % buckets).cast("int")))

    return let(words, from_words)


def with_buckets(table: DataFrame, *, id_col: str, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, buckets: one array a row."""
    made = table.select(F.col(id_col).cast("long").alias("doc_id"), let(words_of(F.col(text_col)), lambda w: F.struct(F.size(w).alias("n"), buckets_of(w, buckets).alias("b"))).alias("m"))
    return made.select("doc_id", F.col("m.n").alias("n_words"), F.col("m.b").alias("buckets"))


def bucket_totals(arrays: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often each occurs in the column `buckets`. Every task sends at most one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return arrays.select("buckets").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket from both tables of totals: one number a bucket comes to the driver."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    s, t = (F.col(c).cast("double") for c in "st")
    odds = ((t + 1) * F.lit(float(sums["s"] + buckets))) / ((s + 1) * F.lit(float(sums["t"] + buckets)))
    rows = both.select("bucket", F.floor(F.lit(1000.0) * F.log(odds)).alias("gain")).collect()
    return [r["gain"] for r in sorted(rows, key=lambda r: r["bucket"])]


def noise(doc_id: Column, seed: int = 42) -> Column:
    """Gumbel noise of an id, in thousandths, rounded down. A null id counts as the empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(arrays: DataFrame, gains: list[int], seed: int = 42) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""
    # one string that the optimizer folds into a literal array, in place of an expression for each entry
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<long>")
    weight = F.aggregate("buckets", F.lit(0).cast("long"), lambda total, bucket: total + F.element_at(table, bucket + 1))
    rows = arrays.select("doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), weight.alias("weight"))
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def lowest_drawn(scores: DataFrame, draw: int) -> int | None:
    """The score of the `draw`-th highest row, from counts of ever narrower bins; None if nothing is to be drawn."""
    if draw <= 0:
        return None
    ends = scores.agg(F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    lo, hi, left = ends["lo"], ends["hi"], draw
    while lo < hi:
        width = -(-(hi - lo + 1) // BINS)
        inside = scores.filter(F.col("score").between(lo, hi))
        counts = inside.groupBy(F.expr(f"CAST((score - ({lo}L)) DIV {width} AS INT)").alias("bin")).count().collect()  # at most BINS rows
        for bin_, n in sorted(((r["bin"], r["count"]) for r in counts), reverse=True):
            if n >= left:
                lo, hi = lo + bin_ * width, min(hi, lo + (bin_ + 1) * width - 1)
                break
            left -= n
    return lo


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with their places (1, 2, ...) in a total order, by a range sort and one number for each partition."""
    at = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).rows
    part = F.expr(f"_at DIV {ROWS}").alias("_part")
    sizes = at.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = at.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return placed.withColumn("rank", F.col("_before") + F.col("_at") % ROWS + 1).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", percent: int = 5, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """Each document's doc_id, n_features, weight, score and rank; rank is null unless the document is drawn.

    Drawn are the `percent` percent (rounded down) of the documents with at least 20 words that score highest; of equal scores the smaller id is first.

    Defined cases: a null or empty text has no features and weight 0; a null id counts as the empty string in the noise
    and comes first among equal scores; rows that repeat an id are rows of their own, in any order where all else
    is equal; an empty target or table smooths to equal frequencies; other columns are ignored.
    """
    arrays = stored(with_buckets(docs, id_col=id_col, text_col=text_col, buckets=buckets))
    aim = with_buckets(target, id_col=target_id, text_col=target_text, buckets=buckets)
    gains = gains_of(bucket_totals(arrays.rows, buckets), bucket_totals(aim, buckets), buckets)
    every = stored(scored(arrays.rows, gains, seed)).rows
    arrays.drop()
    able = F.col("n_words") >= LEAST_WORDS
    draw = percent * every.filter(able).count() // 100
    out = ["doc_id", "n_features", "weight", "score"]
    lowest = lowest_drawn(every.filter(able), draw)
    none = F.lit(None).cast("long").alias("rank")
    if lowest is None:
        return every.select(*out, none)
    high = able & (F.col("score") >= lowest)
    drawn = ranked(every.filter(high).select(*out), [F.desc("score"), F.asc_nulls_first("doc_id"), F.desc("n_features")])
    return drawn.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).unionByName(every.filter(~high).select(*out, none))


#: The table of remainders is made from the polynomial; features are hashed once each.
ORACLE = """
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
w AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL SELECT 'b', item_id, row_number() OVER (), regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
f AS (SELECT kind, id, row, unnest(list_concat(w, list_concat(
    list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))) AS f FROM w),
hexes AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
crc AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: CAST((instr('0123456789ABCDEF', substr(h, CAST(2 * i + 1 AS INT), 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, CAST(2 * i + 2 AS INT), 1)) - 1 AS BIGINT))),
    lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM hexes, tab),
n AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM f JOIN crc USING (f) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t + 1 AS DOUBLE) * ((SELECT sum(s) FROM n) + 10000)) / (CAST(s + 1 AS DOUBLE) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n),
sums AS (SELECT row, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN crc USING (f) JOIN g USING (bucket) WHERE kind = 'd' GROUP BY row),
s AS (SELECT w.id AS doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('42:' || w.id), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM w LEFT JOIN sums USING (row) WHERE kind = 'd'),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY words >= 20) AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= 5 * n // 100 THEN k END AS rank FROM r"""
