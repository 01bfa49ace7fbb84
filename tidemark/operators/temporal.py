"""Joins along time: as-of, interval, calendars and session ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import cut


#: Rows of one block of a series without a key.
BLOCK = 4096


def in_ranges(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` dealt by ranges of `order`, with the number of the range as `_range`; kept, so that the numbers stay."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id()))


def before_ranges(summaries: DataFrame, total: Column) -> DataFrame:
    """_range, _before: `total` over the summaries (one row a range: _range, _own) of all earlier ranges.

    Each summary goes to every later range: with n ranges n * n / 2 small rows, however many rows the ranges have.
    """
    last = int(summaries.sparkSession.conf.get("spark.sql.shuffle.partitions")) - 1
    sent = summaries.where(F.col("_range") < last).select(F.col("_range").alias("_from"), "_own", F.explode(F.sequence(F.col("_range") + 1, F.lit(last))).alias("_range"))
    return sent.groupBy("_range").agg(total.alias("_before"))


def overlapping(rows: DataFrame, order: str, before: int, block: int = BLOCK) -> DataFrame:
    """A series without a key in blocks, each with the `before` rows that come before it as guests: `_block`, `_guest`.

    Windows of at most `before` earlier rows may then be taken by block, after which guests are dropped.
    """
    placed = in_ranges(rows, order)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_own"))
    starts = before_ranges(sizes, F.sum("_own"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + F.coalesce("_before", F.lit(0))
    numbered = placed.join(F.broadcast(starts), "_range", "left").withColumn("_place", place)  # as many rows as ranges
    size = max(block, before, 1)
    own = F.struct(F.floor(F.col("_place") / size).alias("_block"), F.lit(False).alias("_guest"))
    next_ = F.struct((F.floor(F.col("_place") / size) + 1).alias("_block"), F.lit(True).alias("_guest"))
    homes = F.when(F.col("_place") % size >= size - before, F.array(own, next_)).otherwise(F.array(own))
    return numbered.select(*rows.columns, F.inline(homes))


def as_of(left: DataFrame, right: DataFrame, *, keys: list[str], left_time: str, right_time: str, take: dict[str, str], strict: bool = True, lag: int = 1, best_by: list[str] | None = None) -> DataFrame:
    """Each left row with columns of the `lag`-th newest right row before its time (at or before it unless `strict`).

    `take` names the right columns and what they are called in the result; they are null where there is no such row. With `best_by` the
    right row that is largest by those columns is taken in place of the newest. Left
    and right rows are put together in one table and sorted once by key and time; the newest (or best) right row is carried along. Without
    keys only the distinct times of the left side are sorted, in ranges; what a range ends with is carried to the later ones, and the
    result is joined back by time.
    """
    if lag > 1 and best_by:
        raise ValueError("the lag counts the newest rows, not the best")
    payload = F.struct(*[F.col(c).alias(name) for c, name in take.items()])
    if not keys:
        return _as_of_without_key(left, right, left_time, right_time, take, payload, strict, lag, best_by)
    if lag > 1:
        payload = F.lag(payload, lag - 1).over(Window.partitionBy(*keys).orderBy(right_time))
    old = right.select(*keys, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), _found(payload, best_by), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_row"))
    new = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0 if strict else 2).alias("_side"), F.lit(None).cast(old.schema["_found"].dataType).alias("_found"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    seen = new.unionByName(old).withColumn("_seen", _carried(best_by).over(w)).where("_side <> 1")
    return seen.select("_row.*", *[F.col(f"_seen.p.{name}").alias(name) for name in take.values()])


def _found(payload: Column, best_by: list[str] | None) -> Column:
    return F.struct(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(best_by or ())], payload.alias("p")).alias("_found")


def _carried(best_by: list[str] | None) -> Column:
    return F.max("_found") if best_by else F.last("_found", ignorenulls=True)


def _as_of_without_key(left: DataFrame, right: DataFrame, left_time: str, right_time: str, take: dict[str, str], payload: Column, strict: bool, lag: int, best_by: list[str] | None) -> DataFrame:
    if lag > 1:
        w = Window.partitionBy("_block").orderBy(right_time)
        right = overlapping(right, right_time, lag - 1).withColumn("_p", F.lag(payload, lag - 1).over(w)).where("not _guest")
        payload = F.col("_p")
    times = left.select(F.col(left_time).alias("_t")).where("_t is not null").distinct()
    old = right.select(F.col(right_time).alias("_t"), F.lit(1).alias("_side"), _found(payload, best_by)).where("_t is not null")
    new = times.select("_t", F.lit(0 if strict else 2).alias("_side"), F.lit(None).cast(old.schema["_found"].dataType).alias("_found"))
    placed = in_ranges(new.unionByName(old), "_t", "_side")
    ends = placed.where("_side = 1").groupBy("_range").agg((F.max("_found") if best_by else F.max_by("_found", "_t")).alias("_own"))
    starts = before_ranges(ends, F.max("_own") if best_by else F.max_by("_own", "_from"))
    w = Window.partitionBy("_range").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("_seen", _carried(best_by).over(w)).where("_side <> 1").join(F.broadcast(starts), "_range", "left")  # as many rows as ranges
    first = F.greatest("_seen", "_before") if best_by else F.coalesce("_seen", "_before")
    found = seen.select("_t", first.alias("_first")).select(F.col("_t").alias("_at"), *[F.col(f"_first.p.{name}").alias(name) for name in take.values()])
    return left.join(found, left[left_time] == F.col("_at"), "left").drop("_at")


def dominance_as_of(left: DataFrame, right: DataFrame, *, keys: list[str], first: tuple[str, str], second: tuple[str, str], take: dict[str, str], lag: int = 1, strict: bool = True) -> DataFrame:
    """Each left row with columns of the `lag`-th newest right row that lies before it in two orders at once.

    A right row is eligible if `first` (a date, say) and `second` (an instant) are both before the left row's; `first` may be equal unless
    `strict`. Of the eligible rows the newest by (first, second) counts. `first` and `second` name the left and the right column. Where the
    two orders disagree, a plain as-of join by either one is wrong.

    Right rows of a key are numbered by (first, second), so those with an eligible `first` are the numbers below a bound. A number lies in one
    node of each level of a binary tree, and the numbers below a bound are at most one node of each level; inside a node rows are sorted by `second` and
    the largest number so far is carried along. For n rows that makes n * log n small rows, whatever the two orders are, and no product. The next newest row is
    found in the same way below the one that was found.

    Nulls in either order are never before anything; of rows equal in both orders the one with the larger taken columns counts as newer; repeated left rows each get their row.
    """
    if lag < 1:
        raise ValueError(f"lag must be at least 1, not {lag}")
    (left_first, right_first), (left_second, right_second) = first, second
    payload = F.struct(*[F.col(c).alias(name) for c, name in take.items()])
    points = right.select(*keys, F.col(right_first).alias("_a"), F.col(right_second).alias("_s"), payload.alias("_p")).where("_a is not null and _s is not null")
    points = points.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_a", "_s", "_p")) - 1)
    asked = left.select(*keys, F.col(left_first).alias("_a"), F.col(left_second).alias("_s")).where("_a is not null and _s is not null").distinct()
    bounds = as_of(asked, points.select(*keys, F.col("_a").alias("_ra"), (F.col("_n") + 1).alias("_m")).groupBy(*keys, "_ra").agg(F.max("_m").alias("_m")), keys=keys, left_time="_a", right_time="_ra", take={"_m": "_bound"}, strict=strict)
    highest = F.length(F.bin(F.max("_n").over(Window.partitionBy(*keys)) + 1)) - 1
    # a bound's nodes have even numbers only
    at = F.expr("filter(sequence(0, _highest), k -> shiftright(_n, k) % 2 = 0)")
    nodes = points.withColumn("_highest", highest).select(*keys, "_s", "_n", F.explode(at).alias("_level")).withColumn("_node", F.expr("shiftright(_n, _level)"))
    w = Window.partitionBy(*keys, "_level", "_node").orderBy("_s", "_side").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(lag):
        open_ = bounds.where("_bound > 0")
        bits = F.expr("filter(sequence(0, length(bin(_bound)) - 1), k -> shiftright(_bound, k) % 2 = 1)")
        queries = open_.select(*keys, "_a", "_s", F.explode(bits).alias("_level"), "_bound").withColumn("_node", F.expr("shiftright(_bound, _level) - 1")).withColumn("_side", F.lit(0)).drop("_bound")
        rows = queries.unionByName(nodes.withColumn("_side", F.lit(1)), allowMissingColumns=True)
        best = rows.withColumn("_best", F.max("_n").over(w)).where("_side = 0").groupBy(*keys, "_a", "_s").agg(F.max("_best").alias("_bound"))
        bounds = best.where("_bound is not null")
    named = bounds.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_a", "_s", "_bound")
    own = [points[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    found = named.join(points.drop("_a", "_s"), reduce(Column.__and__, own, F.col("_bound") == F.col("_n"))).select(*named.drop("_bound").columns, *[F.col(f"_p.{name}").alias(name) for name in take.values()])
    same = [left[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [left[left_first] == F.col("_a"), left[left_second] == F.col("_s")]
    return left.join(found, reduce(Column.__and__, same), "left").select(*left.columns, *take.values())


def interval(left: DataFrame, periods: DataFrame, *, key: str, day: str, value: str, overlaps: bool = False) -> DataFrame:
    """Each left row with the value of the half-open period that holds its day; of several the newest, of none null.

    Days and the beginnings of periods are sorted together by key and day, and the period that began last is carried along; it holds the day
    unless it has ended. Periods of one key must not overlap (`constraints` finds those that do); with `overlaps` they
    may, and the newest of those that hold the day is found by both its ends (`dominance_as_of`); of those that begin on one day the one that
    ends first.
    """
    if overlaps:
        far = F.coalesce(F.datediff(F.lit("1970-01-01"), F.col("effective_to")), F.lit(-(1 << 30)))
        ended = periods.withColumn("_end", far)
        asked = left.withColumn("_day", F.datediff(F.lit("1970-01-01"), F.col(day)))
        return dominance_as_of(asked, ended, keys=[key], first=(day, "effective_from"), second=("_day", "_end"), take={value: value}, strict=False).drop("_day")
    begun = as_of(left, periods, keys=[key], left_time=day, right_time="effective_from", take={"effective_to": "_to", value: "_value"}, strict=False)
    return begun.withColumn(value, F.when(F.col("_to").isNull() | (F.col("_to") > F.col(day)), F.col("_value"))).drop("_to", "_value")


def session_rank(bars: DataFrame) -> DataFrame:
    return bars.withColumn("session", F.row_number().over(Window.partitionBy("instrument_id").orderBy("market_date")))


def calendar(bars: DataFrame, by: list[str]) -> DataFrame:
    """Every calendar day from the first bar of each key to its last."""
    return bars.groupBy(*by).agg(F.min("market_date").alias("a"), F.max("market_date").alias("b")).select(*by, F.explode(F.sequence("a", "b")).alias("market_date"))


def nth_before(dates: Column, day: Column, lag: int) -> Column:
    """From a sorted array of dates, the `lag`-th newest before a day."""
    return F.try_element_at(F.filter(dates, lambda d: d < day), F.lit(-lag))
