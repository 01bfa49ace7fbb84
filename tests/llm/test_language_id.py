import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language_id, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("url,parts", [("http://a.b.co.fr:80/x?y", ("a.b.co.fr", "co.fr", "fr")), ("//u:p@H.de", ("h.de", "h.de", "de")), ("localhost", ("", "", "")), ("", ("", "", "")), ("https://host", ("host", "host", ""))])
def test_address(url, parts):
    assert language_id.address(url) == parts


def test_text_of_a_page():
    assert language_id.text_of("<head><title>t</title></head><p>a &amp; b<script>no</script><!-- no -->").split() == ["a", "&", "b"]


@pytest.fixture
def pages(spark, words):
    """Two alphabets stand for two languages; some pages have no text."""
    flip = str.maketrans("abcdefgh", "stuvwxyz")
    rows, docs = [], []
    for i in range(80):
        one = i % 2
        text = words(30, i).translate(flip) if one else words(30, i)
        docs.append((i, text, ["aa", "bb"][one]))
        body = "" if i % 10 > 7 else text
        mark = f' lang="{["aa", "bb"][one]}"' if i % 5 else ""
        rows.append((i, f"http://{'x' if one else 'y'}{i % 3}.site.{'bb' if one else 'aa'}/p", f"<html{mark}><body>{body}</body></html>"))
    return spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string")


def test_pages_without_text_follow_other_evidence(pages):
    got = language_id.identify(*pages).collect()
    assert len(got) == 80 and all(r["lang"] == ["aa", "bb"][r["page_id"] % 2] for r in got)
    assert all(0.5 <= r["probability"] <= 1 for r in got)


def test_against_brute_force(pages):
    frames = [p.toPandas() for p in pages]
    langs, table = language_id.fit_text(pages[1])
    assert langs == ["aa", "bb"]
    seen = []
    for r in frames[0].sort_values("page_id").itertuples():
        counts = language_id.trigrams(language_id.text_of(r.html)).astype(float)
        ll = table.astype(float) @ counts * min(1.0, language_id.EVIDENCE / max(1, counts.sum()))
        share = np.exp(ll - ll.max())
        found = language_id.DECLARED.search(r.html)
        seen.append((r.page_id, found[1] if found else "none", *language_id.address(r.url), share / share.sum()))
    lean = language_id.LEAN
    total = sum(s[-1] for s in seen)
    overall = (total + 1) / (total.sum() + 2)
    group = lambda i, v: sum(s[-1] for s in seen if s[i] == v)
    want = {}
    for page, declared, host, domain, suffix, share in seen:
        given = [(group(i, v) + lean * group(i, v).sum() / total.sum()) / (total + lean) for i, v in ((1, declared), (4, suffix))]
        up = (group(4, suffix) + lean * overall) / (group(4, suffix).sum() + lean)
        up = (group(3, domain) + lean * up) / (group(3, domain).sum() + lean)
        weight = share * given[0] * given[1] * (np.maximum(0, group(2, host) - share) + lean * up)
        want[page] = (langs[int(weight.argmax())], float(weight.max() / weight.sum()))
    got = {r["page_id"]: (r["lang"], r["probability"]) for r in language_id.identify(*pages).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert [v[1] for _, v in sorted(got.items())] == pytest.approx([v[1] for _, v in sorted(want.items())], abs=1e-5)


def test_query_covers_all_pages(spark):
    got = queries.op5_language_id(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    # most pages declare the language they are written in
    assert got.where(F.col("declared").isin("en", "de", "fr", "es")).agg(F.avg((F.col("lang") == F.col("declared")).cast("double"))).first()[0] > 0.6


def test_rare_language_of_a_large_table(spark):
    """One document among 8,200 has a language, and the largest hash of all ids."""
    ids = spark.range(8200)
    rare = ids.orderBy(F.xxhash64("id", F.lit(3)).desc()).first()[0]
    one = F.col("id") == rare
    docs = ids.select(F.col("id").alias("doc_id"), F.when(one, "stuv vuts tsuv").otherwise("abcd dcba bacd").alias("text"), F.when(one, "cc").otherwise("aa").alias("lang"))
    langs, table = language_id.fit_text(docs)
    counts = 8199 * language_id.trigrams("abcd dcba bacd") + language_id.ALPHA
    assert langs == ["aa", "cc"]
    assert table[0] == pytest.approx(np.log(counts / counts.sum()), rel=1e-5)
    pages = spark.createDataFrame([(1, "http://x.cc/", '<html lang="cc"><body>stuv tsuv vuts</body></html>'), (2, "http://x.aa/", '<html lang="aa"><body>abcd dcba</body></html>')], "page_id long, url string, html string")
    assert {r["page_id"]: (r["lang"], r["declared"]) for r in language_id.identify(pages, docs).collect()} == {1: ("cc", "cc"), 2: ("aa", "aa")}
