"""K-d tree sharding of documents (operator 9), in DataFrame functions only.

A document is a point in a space of metadata: logarithm of its size, source, language and text checksum, each scaled to
whole numbers of `BITS` bits. The tree begins with one node that owes all shards. In each round every node that owes more
than one shard is split along its widest dimension at the weighted median (or the quantile that matches the shards its two
halves owe), all nodes at once. A quantile is found from a histogram: rows are counted by the next `STEP` bits of their
order key (coordinate, then a hash that breaks ties) inside the range that the earlier steps left, so a step is one partial
aggregation over the table and the window functions above it see at most 2**STEP rows a node. Only integers of a fixed
width describe a row, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, stored, text_or_empty

#: Bits of a coordinate, of the tie-breaking hash below it, and those that one histogram step tells apart.
BITS, TIE_BITS, STEP = 20, 22, 14
EACH_ROW = 8


def coordinates(size: Column, source: Column, lang: Column, crc: Column) -> dict[str, Column]:
    """Whole numbers from 0 to 2**BITS - 1, one for each metadata dimension; null metadata count as empty strings."""
    top = (1 << BITS) - 1
    by_hash = lambda c: F.shiftright(F.xxhash64(F.coalesce(c.cast("string"), F.lit(""))), 64 - BITS).bitwiseAND(top)
    return {"size": F.least(F.lit(top), (F.log2(size.cast("double")) / 40 * top).cast("long")), "source": by_hash(source), "lang": by_hash(lang), "text": F.shiftright(crc, 32 - BITS).bitwiseAND(top)}


def repeated_ids(docs: DataFrame, id_col: str) -> DataFrame:
    return docs.groupBy(F.col(id_col).alias("again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("again")


def points_of(docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """A point for each row: doc_id, row, size, text_crc32, its coordinates d_* and `tie`.

    Ties are told apart by a hash of id and text, so that they do not depend on how the table is laid out. Only rows that repeat an id
    also use their place.
    """
    have = set(docs.columns)
    name = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    place = F.col(row_col) if row_col else F.monotonically_increasing_id()
    raw = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("t"), name("source").alias("source"), name("lang").alias("lang"), place.alias("row"))
    raw = raw.select("doc_id", "row", (F.octet_length("t") + EACH_ROW).cast("long").alias("size"), F.crc32(F.encode("t", "UTF-8")).alias("text_crc32"), F.xxhash64("doc_id", "t").alias("tie"), "source", "lang")
    again = repeated_ids(docs, id_col)
    if not again.isEmpty():
        raw = raw.join(again.withColumn("_again", F.lit(True)), raw["doc_id"].eqNullSafe(again["again"]), "left")
        raw = raw.withColumn("tie", F.when(F.col("_again"), F.xxhash64("tie", "row")).otherwise(F.col("tie")))
    dims = coordinates(F.col("size"), F.col("source"), F.col("lang"), F.col("text_crc32"))
    return raw.select("doc_id", "row", "size", "text_crc32", *[c.alias(f"d_{k}") for k, c in dims.items()], F.shiftrightunsigned("tie", 64 - TIE_BITS).alias("tie"))


def kd_shards(docs: DataFrame, *, shards: int | None = 24, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, bucket_rows: int = 50_000) -> DataFrame:
    """Shards of near-equal bytes.

    Returns one row per document: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) and row_col if given. Give
    the number of shards, or the bytes a shard should have at most about; then the tree stops at leaves of that size.

    Defined cases: a null text has no bytes and the checksum of the empty text; every row weighs its bytes plus 8, so
    empty texts count. Equal points are told apart by a hash of id and text, so copies, even very many, may lie in different
    shards; rows that repeat an id also by their place (`row_col`, a number for each row, or where they are read). Null sources and
    languages count as empty strings. Null ids are dealt like any others. An empty table gives no rows. Columns that are missing
    (source, lang) count as null; other columns are ignored.
    """
    points = cut(points_of(docs, id_col, text_col, row_col).withColumn("first", F.lit(0)))
    total, rows = points.agg(F.sum("size"), F.count(F.lit(1))).first()
    if target_bytes:
        shards = max(1, -(-(total or 0) // target_bytes))
    dims = [c[2:] for c in points.columns if c.startswith("d_")]
    # a node is known by the first of the shards it owes; how many it owes follows from the splits so far
    owed = {0: shards}
    while any(n > 1 for n in owed.values()):
        points = cut(split(points, owed, dims))
        owed = {k: m for first, n in owed.items() for k, m in ([(first, n)] if n == 1 else [(first, n // 2), (first + n // 2, n - n // 2)])}
    placed = numbered(points.withColumnRenamed("first", "shard"), max(1, -(-rows // bucket_rows)))
    return placed.withColumnRenamed("row", row_col) if row_col else placed.drop("row")


def split(points: DataFrame, owed: dict[int, int], dims: list[str]) -> DataFrame:
    """One round: move the upper part of each node that owes several shards to a new node."""
    wide = {k: n for k, n in owed.items() if n > 1}
    lower = F.create_map(*[F.lit(x) for k, n in wide.items() for x in (k, n // 2)])
    share = F.create_map(*[F.lit(x) for k, n in wide.items() for x in (k, n // 2 / n)])
    open_rows = points.where(F.col("first").isin([*wide]))
    spans = open_rows.groupBy("first").agg(F.sum("size").alias("weight"), *[(F.max(f"d_{d}") - F.min(f"d_{d}")).alias(f"w_{d}") for d in dims])
    widest = F.greatest(*[F.col(f"w_{d}") for d in dims])
    axis = F.coalesce(*[F.when(F.col(f"w_{d}") == widest, F.lit(i)) for i, d in enumerate(dims)])
    # the lower part gets weight * (n // 2) / n, counted in whole bytes
    nodes = cut(spans.select("first", axis.alias("axis"), F.floor(F.col("weight") * share[F.col("first")]).alias("goal"), F.lit(0).cast("long").alias("prefix")))
    key = F.shiftleft(F.element_at(F.array(*[F.col(f"d_{d}") for d in dims]), F.col("axis") + 1), TIE_BITS).bitwiseOR(F.col("tie"))
    shift = BITS + TIE_BITS
    while shift > 0:
        step = min(STEP, shift)
        inside = open_rows.join(F.broadcast(nodes), "first").withColumn("key", key).where(F.shiftright("key", shift) == F.col("prefix"))
        shift -= step
        bins = inside.groupBy("first", "axis", "goal", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("weight"))
        upto = F.sum("weight").over(Window.partitionBy("first").orderBy("bin"))
        running = bins.withColumn("upto", upto)
        # the bin in which the goal is reached; the last one if rounding leaves none
        hit = F.when(F.col("upto") >= F.col("goal"), F.struct("bin", (F.col("goal") - F.col("upto") + F.col("weight")).alias("goal"), "weight"))
        nodes = running.groupBy("first", "axis").agg(F.coalesce(F.min(hit), F.max(F.struct("bin", F.col("weight").alias("goal"), "weight"))).alias("hit"))
        # the last row goes to the side that it leaves nearer to its goal
        prefix = F.when((F.lit(shift) == 0) & (F.col("hit.goal") * 2 < F.col("hit.weight")), F.col("hit.bin") - 1).otherwise(F.col("hit.bin"))
        nodes = cut(nodes.select("first", "axis", F.col("hit.goal").alias("goal"), prefix.alias("prefix")))
    cuts = nodes.select("first", "axis", F.col("prefix").alias("cut"))
    moved = points.join(F.broadcast(cuts), "first", "left")
    upper = F.coalesce(key > F.col("cut"), F.lit(False))
    return moved.select(F.when(upper, F.col("first") + lower[F.col("first")]).otherwise(F.col("first")).alias("first"), *[c for c in points.columns if c != "first"])


def numbered(points: DataFrame, buckets: int) -> DataFrame:
    """Slots without gaps: rows are numbered inside buckets of a shard, after the rows of its earlier buckets."""
    points = points.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(buckets)))
    sizes = points.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "tie", "row")) - 1
    return points.withColumn("number", number).join(before, ["shard", "bucket"]).select("row", "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("number") + F.col("before")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the whole documents as one folder per shard, each row once.

    Rows meet their shards by id; where ids repeat, the table is stored first with a number for each row, and they meet by that.
    """
    id_col = options.get("id_col", "doc_id")
    if repeated_ids(docs, id_col).isEmpty():
        placed = kd_shards(docs, **options).select(F.col("doc_id").alias("_placed"), "shard")
        docs.join(placed, docs[id_col].eqNullSafe(placed["_placed"])).drop("_placed").write.mode("overwrite").partitionBy("shard").parquet(path)
        return
    row = "_row"
    while row in docs.columns:
        row += "_"
    held = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    held.rows.join(kd_shards(held.rows, row_col=row, **options).select(row, "shard"), row).drop(row).write.mode("overwrite").partitionBy("shard").parquet(path)
    held.drop()
