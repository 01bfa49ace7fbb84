import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import url_rules

PAGES = "page_id long, url string"


def plain(url, rules, otherwise):
    """host, path, rule, verdict by trying every rule."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", None, otherwise
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len((h + p).encode()), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, otherwise)))


def judged(spark, urls, rules, otherwise="allow", file_bytes=url_rules.FILE_BYTES, key=None, digest=url_rules.digest_of):
    table = spark.createDataFrame([(h, p, v) for h, p, v in rules], "host string, path string, verdict string")
    files = url_rules.rule_files(table, file_bytes=file_bytes, key=key)
    rows = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), PAGES).repartition(3), files, otherwise=otherwise, digest=digest).collect()
    return files, [tuple(r)[1:] for r in sorted(rows, key=lambda r: r["page_id"])]


URLS = [
    None, "", "no scheme", "http://", "http://com", "http://com/", "HTTP://WWW.Example.COM/en/x?y#z", "https://example.com/en/", "https://example.com/en", "http://notexample.com/en/",
    "http://a.b.net/es/1", "http://net/fr/", "http://net/frx/", "http://x.net#/fr/", "http://x.net?/fr/", "a://b://c.com/x", "http://u@example.com:80/en/", "http://ÄÖ.com/é\nx/", "http://.com/", "http://..net/es/é", "http://com./",
]


@pytest.mark.parametrize("otherwise", ["allow", "block"])
def test_like_every_rule_tried(spark, otherwise):
    _, got = judged(spark, URLS, url_rules.RULES, otherwise)
    assert got == [plain(u, url_rules.RULES, otherwise) for u in URLS]


def made(n, seed):
    rng = random.Random(seed)
    label, part = lambda: rng.choice(["a", "b", "cc", "é", "x1"]), lambda: rng.choice(["", "/", "/a", "/a/", "/a/b", "/é", "/ab/c"])
    rules = {(".".join(label() for _ in range(rng.randint(1, 4))), part()): rng.choice(["allow", "block"]) for _ in range(n)}
    urls = [f"http://{'.'.join(label() for _ in range(rng.randint(1, 5)))}{part()}{rng.choice(['', '/', 'b', '?q', '#f'])}" for _ in range(400)]
    return [(h, p, v) for (h, p), v in rules.items()], urls


def test_many_rules_in_several_files(spark):
    rules, urls = made(150, 1)
    files, got = judged(spark, urls, rules, file_bytes=1000)
    assert len(files.names) > 2
    assert got == [plain(u, rules, "allow") for u in urls]


def test_equal_keys_are_told_apart_by_their_strings(spark):
    rules, urls = made(60, 2)
    weak = lambda rule: url_rules.digest_of(rule) % 3
    _, got = judged(spark, urls, rules, key=F.pmod(F.xxhash64("rule"), F.lit(3)), digest=weak)
    assert got == [plain(u, rules, "allow") for u in urls]


def test_keys_are_those_of_spark(spark):
    texts = ["", "a", "net/es/", "é/日本", "x" * 31, "x" * 32, "y" * 100]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] for r in rows] == [url_rules.digest_of(t.encode()) for t in texts]


def test_no_rules_and_rules_given_twice(spark):
    _, got = judged(spark, ["http://a.com/", None], [], "block")
    assert got == [("a.com", "/", None, "block"), ("", "", None, "block")]
    _, got = judged(spark, ["http://a.com/"], [("A.com", None, "allow"), ("a.com", "", "block"), ("a.com", "", "block")])
    assert got == [("a.com", "/", "a.com", "block")]


@pytest.mark.parametrize("rule", [("", "/", "allow"), (None, "/", "allow"), ("a", "b", "allow"), ("a/b", "/", "allow"), ("a", "/", "maybe"), ("a", "/", None)])
def test_rows_that_are_no_rules(spark, rule):
    with pytest.raises(ValueError):
        url_rules.checked(spark.createDataFrame([rule], "host string, path string, verdict string"))


def test_pages_are_not_shuffled(spark):
    files, _ = judged(spark, [], url_rules.RULES)
    plan = url_rules.judge(spark.createDataFrame([], PAGES), files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
