import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def plain_buckets(text, buckets=10_000):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def plain(rows, target, percent, buckets=10_000):
    s, t = [0] * buckets, [0] * buckets
    for _, text in rows:
        for b in plain_buckets(text, buckets)[0]:
            s[b] += 1
    for text in target:
        for b in plain_buckets(text, buckets)[0]:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out, able = {}, []
    for doc, text in rows:
        found, words = plain_buckets(text, buckets)
        weight = sum(gain[b] for b in found)
        h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[doc] = [len(found), weight, score, None]
        if words >= 20:
            able.append((-score, doc))
    for rank, (_, doc) in enumerate(sorted(able)[: percent * len(able) // 100], 1):
        out[doc][3] = rank
    return out


def target_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_like_the_plain_version(spark, docs, words, percent):
    texts = [words(n, n % 7) for n in range(3, 90)] + [None, "", " - ", "Ärger ÉTÉ naïve 日本 \U0001f600 X" * 5, "One. two\tONE-two" * 9]
    target = [words(40, 3), words(25, 5), None, ""]
    got = {r["doc_id"]: [r["n_features"], r["weight"], r["score"], r["rank"]] for r in importance.resample(docs(texts), target_of(spark, target), percent=percent).collect()}
    assert got == plain(list(enumerate(texts)), target, percent)


def test_ties_go_to_the_smaller_id(spark, docs, words, monkeypatch):
    monkeypatch.setattr(importance, "noise", lambda doc_id, seed=42: F.lit(0).cast("long"))
    text = words(30, 1)
    rows = importance.resample(docs([(i, text) for i in (9, 4, 7, 2, 11, 5)]), target_of(spark, [text]), percent=50).collect()
    assert {r["doc_id"]: r["rank"] for r in rows if r["rank"]} == {2: 1, 4: 2, 5: 3}


def test_lowest_drawn_is_exact(spark):
    scores = [-(i * i * 37) % 100_003 - 50_000 for i in range(3000)] + [7] * 50
    table = spark.createDataFrame([(s,) for s in scores], "score long")
    ordered = sorted(scores, reverse=True)
    for k in (1, 2, 77, 1500, len(scores)):
        assert importance.lowest_drawn(table, k) == ordered[k - 1]
    assert importance.lowest_drawn(table, 0) is None


def test_repeated_rows_and_no_target(spark, docs, words):
    text = words(40, 2)
    rows = importance.resample(docs([(1, text)] * 20 + [(None, text)]), target_of(spark, []), percent=50).collect()
    assert len(rows) == 21 and sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 11))
    assert len({r["weight"] for r in rows}) == 1


def test_scoring_explodes_nothing(spark, docs):
    arrays = importance.with_buckets(docs(["a b c", "d"]), id_col="doc_id")
    plan = importance.scored(arrays, [0] * importance.BUCKETS)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange hashpartitioning" not in plan and "Python" not in plan
