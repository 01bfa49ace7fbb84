import hashlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import alignment
from tidemark.llm.token_ids import default_path


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(default_path(), alignment.piece_path())


def whole(both, text):
    """Ids and groups (as lists of A and B ids) of a text that is tokenised whole; None if it has no tokens."""
    if not text:
        return None
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    if b"".join(both.bytes_a[i] for i in a) != (" " + text).encode() or b"".join(both.bytes_b[i] for i in b) != (" " + text).encode():
        return None
    ends_a, ends_b, at = {}, {}, 0
    for k, i in enumerate(a, 1):
        at += len(both.bytes_a[i])
        ends_a[at] = k
    at = 0
    for k, i in enumerate(b, 1):
        at += len(both.bytes_b[i])
        ends_b[at] = k
    groups, p, q = [], 0, 0
    for end in sorted(ends_a.keys() & ends_b.keys()):
        groups.append((a[p : ends_a[end]], b[q : ends_b[end]]))
        p, q = ends_a[end], ends_b[end]
    return a, b, groups


def plain(both, texts):
    found = [whole(both, t) for t in texts]
    links = [[(x, y) for ga, gb in f[2] for x in ga for y in gb] if f else [] for f in found]
    count = defaultdict(int)
    for mine in links:
        for pair in set(mine):
            count[pair] += 1
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for f, mine in zip(found, links, strict=True):
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        written = ";".join(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}" for ga, gb in f[2])
        out.append((len(f[0]), len(f[1]), len(f[2]), len(mine), sum(count[p] == best[p[0]] for p in mine), sum(count[p] for p in mine), hashlib.sha256(written.encode()).hexdigest()))
    return out


def of(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b\n\n c \t d\r\ne\rf;\r g", "x   y  ", "x y   z", "a\x1c b\x1f\n c", "​ ﻿ a", "▁ a ▁b", "naïve é Ａ ﬁ 日本語 テスト \U0001f600 \U0001f469‍\U0001f680",
    "<|endoftext|> <s> </s> <unk> <0x41>", "it's I'll we've 'S 12,345.67 a1b2", "0" * 300 + " " * 77 + "=" * 500, "\x00 \x01\n", "tab\there\vand\fthere", "한국어 텍스트 Ελληνικά русский", "end.\n\nNext", "\r", " \r x\r \n",
]


def test_odd_texts_like_whole_ones(spark, docs, both):
    assert of(alignment.align(docs(ODD))) == plain(both, ODD)


def test_small_blocks_and_repeats(spark, docs, words, both):
    texts = [words(60, n % 9) + (" " * (n % 3)) + ".\nX" for n in range(40)] + ODD
    assert of(alignment.align(docs(texts, parts=2), block_bytes=700, block_segments=50)) == plain(both, texts)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.text(st.sampled_from(list("ab.;){'s1é日  \x1c\x85​▁ \n\t\r\v\f")) | st.characters(codec="utf-8"), max_size=40))
def test_segments_spell_what_the_whole_text_does(both, text):
    segments = both.segment.findall(" " + text)
    assert "".join(segments) == " " + text
    got = whole(both, text)
    if got is None:
        return
    assert sum(both.ids_a(segments), []) == got[0]
    assert sum(both.ids_b(segments), []) == got[1]


def test_marks_come_from_the_vocabularies(both):
    assert both.marks == " \n\t\v\f"  # some pieces of B end in a carriage return


def test_codes_of_both_widths():
    groups, a, b = [(1, 2), (2, 1)], [5, 6, 70_000], [7, 8, 9]
    code, wide = alignment.code_of(groups, a, b)
    assert code == b"" and wide != b""
    small, none = alignment.code_of([(1, 1)], [3], [4])
    assert none == b""
    import numpy as np

    one = alignment.packed(np.array([0]), np.array([len(small) // 2]), np.array([0]), np.frombuffer(small, "<u2"), np.zeros(0))
    two = alignment.packed(np.array([1, 1]), np.array([0, 0]), np.array([0, len(wide) // 4]), np.zeros(0), np.frombuffer(wide, "<u4"))
    lex = alignment.lexicon([two, one])
    assert lex.written == ["3|4", "", "5|7,8;6,70000|9"]
    assert lex.n_a.tolist() == [1, 0, 3] and lex.n_b.tolist() == [1, 0, 3] and lex.n_groups.tolist() == [1, 0, 2] and lex.n_links.tolist() == [1, 0, 4]
    assert sorted((int(x) >> 32, int(x) & 0xFFFFFFFF) for x in lex.names) == [(3, 4), (5, 7), (5, 8), (6, 9), (70_000, 9)]


def test_packed_numbers_come_back():
    import numpy as np

    arrays = [np.zeros(0, np.int64), np.array([5]), np.array([0, 1 << 40, 255, 256, 70_000])]
    assert [x.tolist() for x in alignment.unpacked(alignment.packed(*arrays))] == [x.tolist() for x in arrays]


def test_segments_that_run_over_portions(spark):
    from pyspark.sql import functions as F

    held = spark.createDataFrame([(home, at, s) for home in range(7) for at, s in enumerate([" a", " b", " naïve", " \u2581"])], "home long, at int, segment string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = alignment.aligned(held, default_path(), alignment.piece_path(), at_once=1).groupBy("home").agg(F.collect_list("data").alias("data")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(rows) == 7
    for r in rows:
        lex = alignment.lexicon([bytes(x) for x in r["data"]])
        assert [bool(n) for n in lex.n_groups] == [True, True, True, False]


def test_every_document_of_the_small_table(spark, both):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted(table.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    assert of(alignment.align(table)) == plain(both, [r["text"] for r in rows])


def test_repeated_and_null_ids(spark, docs):
    rows = alignment.align(docs([(1, "a b"), (1, "a b"), (None, "a b")])).collect()
    assert len(rows) == 3 and {r["count_sum"] for r in rows} == {3 * rows[0]["n_links"]}
