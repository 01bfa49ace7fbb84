import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding


@pytest.mark.parametrize("shards,bucket_rows", [(24, 50_000), (5, 7), (1, 10)])
def test_near_equal_bytes_and_gapless_slots(docs, words, shards, bucket_rows):
    table = [None, "", *["hot copy of a text"] * 400, *[words(1 + n % 50, n) for n in range(400)]]
    rows = sharding.kd_shards(docs(table, 6), shards=shards, bucket_rows=bucket_rows).collect()
    assert len(rows) == len(table) and {r["shard"] for r in rows} == set(range(shards))
    load, slots = [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        raw = (table[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean, most = sum(load) / shards, max(len((t or "").encode()) + 8 for t in table)
    assert max(abs(x - mean) for x in load) <= 3 * most


def test_leaves_of_a_size(docs, words):
    got = sharding.kd_shards(docs([words(20, n) for n in range(300)]), shards=None, target_bytes=3000)
    loads = [r[1] for r in got.groupBy("shard").agg(F.sum("size")).collect()]
    assert max(loads) < 3600 and len(loads) >= 8


def test_files(spark, docs, words, tmp_path):
    d = docs([words(5, n) for n in range(40)])
    sharding.write_shards(d, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["doc_id"] for r in back.collect()) == list(range(40)) and back.select("shard").distinct().count() == 4


def plain_tree(points, first, owes, out):
    """A k-d tree one node at a time: sort along the widest dimension, cut at the weighted quantile, go on in both halves."""
    if owes == 1 or not points:
        out.update((p["doc_id"], first) for p in points)
        return
    dims = [c for c in points[0] if c.startswith("d_")]
    width = lambda d: max(p[d] for p in points) - min(p[d] for p in points)
    axis = max(dims, key=lambda d: (width(d), -dims.index(d)))
    points = sorted(points, key=lambda p: (p[axis], p["tie"]))
    goal, weight, at = sum(p["size"] for p in points) * (owes // 2) // owes, 0, 0
    while at < len(points) and weight + points[at]["size"] < goal:
        weight += points[at]["size"]
        at += 1
    # the row at the cut goes where it leaves the halves nearer to their goals
    at += 2 * (goal - weight) >= points[at]["size"]
    plain_tree(points[:at], first, owes // 2, out)
    plain_tree(points[at:], first + owes // 2, owes - owes // 2, out)


@pytest.mark.parametrize("shards", [2, 7, 24])
def test_same_shards_as_a_plain_tree(docs, words, shards):
    d = docs([None, "", *["hot copy of a text"] * 300, *[words(1 + n % 50, n) for n in range(300)]], 6)
    points = [r.asDict() for r in sharding.points_of(d, "doc_id", "text", None).collect()]
    want: dict = {}
    plain_tree(points, 0, shards, want)
    assert {r["doc_id"]: r["shard"] for r in sharding.kd_shards(d, shards=shards).collect()} == want


def test_shards_do_not_depend_on_the_layout(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first, second = ({r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.kd_shards(x).collect()} for x in (d, d.repartition(7)))
    assert first == second


def test_files_hold_rows_that_repeat_an_id_once(spark, docs, words, tmp_path):
    table = [(1, "same"), (1, "same"), (1, "other"), (None, None), (None, None), *[(i, words(9, i)) for i in range(2, 40)]]
    sharding.write_shards(docs(table), str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in back.collect()) == sorted((i or 0, t or "") for i, t in table)
