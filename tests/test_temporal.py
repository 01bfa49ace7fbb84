"""Joins along time against plain loops."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import temporal

DAY, NOON = date(2026, 1, 1), datetime(2026, 1, 1, 12)


def made(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["a", "b", None]), None if rng.random() < 0.05 else DAY + timedelta(rng.randint(0, 12)), None if rng.random() < 0.05 else NOON + timedelta(hours=rng.randint(0, 200)), i) for i in range(n)]


@pytest.mark.parametrize("lag", [1, 2, 4])
def test_dominance_like_a_loop(spark, lag):
    left, right = made(60, 1), made(90, 2)
    frame = lambda rows, n: spark.createDataFrame(rows, f"k string, d date, t timestamp_ntz, {n} int")
    found = temporal.dominance_as_of(frame(left, "i"), frame(right, "j"), keys=["k"], first=("d", "d"), second=("t", "t"), take={"j": "j"}, lag=lag)
    got = {r["i"]: r["j"] for r in found.collect()}
    for k, d, t, i in left:
        able = sorted((y, z, j) for x, y, z, j in right if x == k and None not in (d, t, y, z) and y < d and z < t)
        assert got[i] == (able[-lag][2] if len(able) >= lag else None)


def test_dominance_on_reversed_orders(spark):
    """The worst case for carrying one order along: the newer the date, the older the instant."""
    right = [(1, DAY + timedelta(i), NOON - timedelta(hours=i), i) for i in range(40)]
    left = [(1, DAY + timedelta(i), NOON - timedelta(hours=j), 100 * i + j) for i in range(0, 40, 3) for j in range(0, 40, 3)]
    frame = lambda rows, n: spark.createDataFrame(rows, f"k int, d date, t timestamp_ntz, {n} int")
    got = temporal.dominance_as_of(frame(left, "i"), frame(right, "j"), keys=["k"], first=("d", "d"), second=("t", "t"), take={"j": "j"}).collect()
    assert len(got) == len(left)
    for r in got:
        able = [j for _, y, z, j in right if y < r["d"] and z < r["t"]]
        assert r["j"] == max(able, default=None)


def test_dominance_repeats_empty_and_lag(spark):
    empty = spark.createDataFrame([], "k int, d date, t timestamp_ntz, j int")
    one = spark.createDataFrame([(1, DAY, NOON, 5)] * 3, "k int, d date, t timestamp_ntz, i int")
    ask = lambda left, right, **o: temporal.dominance_as_of(left, right, keys=["k"], first=("d", "d"), second=("t", "t"), take={"j": "j"}, **o)
    assert [r["j"] for r in ask(one, empty).collect()] == [None] * 3
    assert ask(empty.withColumnRenamed("j", "i"), empty).count() == 0
    with pytest.raises(ValueError, match="lag"):
        ask(one, empty, lag=0)


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("lag", [1, 3])
def test_as_of_without_a_key(spark, strict, lag):
    rng = random.Random(lag)
    right = [(x, x * 10) for x in sorted(rng.sample(range(100), 30))]
    left = [(rng.randint(-5, 105), i) for i in range(80)] + [(None, 99)]
    got = temporal.as_of(spark.createDataFrame(left, "t int, i int"), spark.createDataFrame(right, "u int, v int"), keys=[], left_time="t", right_time="u", take={"v": "v"}, strict=strict, lag=lag).collect()
    assert len(got) == len(left)
    for r in got:
        able = [v for u, v in right if r["t"] is not None and (u < r["t"] or u == r["t"] and not strict)]
        assert r["v"] == (able[-lag] if len(able) >= lag else None)


def test_best_before(spark):
    rng = random.Random(4)
    right = [(i, rng.randint(0, 50), i) for i in range(60)]
    left = [(i - 2, i) for i in range(64)]
    for keys in ([], ["k"]):
        a, b = spark.createDataFrame(left, "t int, i int").withColumn("k", F.lit(1)), spark.createDataFrame(right, "u int, d int, j int").withColumn("k", F.lit(1))
        got = temporal.as_of(a, b.drop("k") if not keys else b, keys=keys, left_time="t", right_time="u", take={"j": "j"}, best_by=["d", "u"]).collect()
        for r in got:
            able = [(d, u, j) for u, d, j in right if u < r["t"]]
            assert r["j"] == (max(able)[2] if able else None)


def test_blocks_overlap(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)], "t int")
    found = temporal.overlapping(rows, "t", 3, block=7).collect()
    own = [r["t"] for r in found if not r["_guest"]]
    assert sorted(own) == list(range(50))
    for block in {r["_block"] for r in found}:
        mine, guests = (sorted(r["t"] for r in found if r["_block"] == block and r["_guest"] == g) for g in (False, True))
        if mine:
            assert mine == list(range(7 * block, min(50, 7 * block + 7))) and guests == list(range(max(0, 7 * block - 3), 7 * block))


@pytest.mark.parametrize("overlaps", [False, True])
def test_periods(spark, overlaps):
    ends = [(0, 5, 1), (5, 9, 2), (12, None, 3)] if not overlaps else [(0, None, 1), (2, 9, 2), (4, 6, 3), (12, 12, 4)]
    periods = spark.createDataFrame([(1, DAY + timedelta(a), None if b is None else DAY + timedelta(b), v) for a, b, v in ends], "k int, effective_from date, effective_to date, v int")
    days = spark.createDataFrame([(1, DAY + timedelta(i), i) for i in range(-2, 20)] + [(2, DAY, 99)], "k int, d date, i int")
    for r in temporal.interval(days, periods, key="k", day="d", value="v", overlaps=overlaps).collect():
        able = [(a, v) for a, b, v in ends if a <= r["i"] and (b is None or b > r["i"])] if r["k"] == 1 else []
        assert r["v"] == (max(able)[1] if able else None)
