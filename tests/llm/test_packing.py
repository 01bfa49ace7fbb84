"""Both packers: whole round trips of ids, capacities, and the searches against plain ones."""

import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidemark.llm import pack_bfd, pack_histogram
from tidemark.llm.token_ids import default_path, loaded

DATA = "/root/testdata/sf0.1"
TOKENIZER = Tokenizer.from_file(default_path())


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", ["", " ", "a  b", " lead", "trail ", "it's we'll 123 x1y2", "naïve 日本語 \U0001f600", "a\n\nb \n c\t d", "x" * 300, "<|endoftext|> in text", " odd space", "é" * 3 + " !?", "A.B,C;D  --  E"])
def test_ids_are_those_of_the_tokenizer(text):
    assert loaded(default_path()).ids(text).tolist() == ids_of(text)[:-1]


def test_ids_of_random_texts():
    rng = random.Random(5)
    alphabet = "ab c1 2.'\n\té日 -"
    for _ in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        assert loaded(default_path()).ids(text).tolist() == ids_of(text)[:-1], repr(text)


def test_ids_of_whole_documents():
    ids = loaded(default_path()).ids
    for text in pq.read_table(f"{DATA}/documents.parquet", columns=["text"]).column(0).to_pylist():
        assert ids(text or "").tolist() == ids_of(text)[:-1]


@pytest.fixture
def table(docs, words):
    return [None, "", *[words(n, n) for n in (1, 5, 40, 40, 300, 900, 2000, 5000)], *["same text here"] * 30]


def test_best_fit_against_a_scan():
    rng = random.Random(2)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    packed, rooms = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(room, k) for k, room in enumerate(rooms) if room >= lengths[i]]
        if fits:
            k = min(fits)[1]
        else:
            k = len(rooms)
            rooms.append(100)
            packed.append([])
        packed[k].append(i)
        rooms[k] -= lengths[i]
    got = pack_bfd.best_fit_decreasing(lengths, 100)
    assert sorted(i for p in got for i in p) == list(range(500))
    assert len(got) == len(packed) and sorted(sum(lengths[i] for i in p) for p in got) == sorted(100 - r for r in rooms)


def test_matrices_give_the_documents_back(docs, table):
    rows = pack_bfd.pack_sequences(docs(table), seq_len=256, window=20).collect()
    pieces = {}
    for r in rows:
        ids, places, ends = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["position_ids"], "<u4"), r["cu_seqlens"]
        assert len(ids) == 256 and ends[0] == 0 and ends[-1] == r["n_tokens"] and not ids[ends[-1] :].any()
        for doc, start, a, b in zip(r["doc_ids"], r["starts"], ends, ends[1:], strict=False):
            pieces[doc, start] = ids[a:b].tolist()
            assert places[a:b].tolist() == list(range(b - a))
        assert places[ends[-1] :].tolist() == list(range(256 - ends[-1]))
    for doc, text in enumerate(table):
        assert sum((pieces[k] for k in sorted(pieces) if k[0] == doc), []) == ids_of(text)
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_files(spark, docs, table, tmp_path):
    pack_bfd.write_sequences(docs(table), str(tmp_path / "out"), seq_len=256)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select("doc_ids").count() and set(back.columns) >= {"ids", "cu_seqlens", "position_ids"}


@pytest.mark.parametrize("seq_len,bucket_rows", [(2048, 20_000), (64, 5)])
def test_histogram_packing(docs, table, seq_len, bucket_rows):
    rows = pack_histogram.pack(docs(table), seq_len=seq_len, bucket_rows=bucket_rows).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for members in by_sequence.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= seq_len
    for doc, text in enumerate(table):
        ids, at = ids_of(text), 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    tokens = sum(r["length"] for r in rows)
    assert len(by_sequence) <= -(-tokens // seq_len) * 1.2 + 2


def test_patterns_hold_every_piece():
    rng = random.Random(8)
    histogram = {rng.randint(1, 128): rng.randint(1, 50) for _ in range(60)}
    patterns = pack_histogram.shortest_pack_first(histogram, 128)
    seen = {}
    for pattern, count in patterns:
        assert sum(pattern) <= 128 and count > 0
        for length in pattern:
            seen[length] = seen.get(length, 0) + count
    assert seen == histogram
    slots = pack_histogram.slots_of(patterns)
    assert {k: len(set(map(tuple, v.tolist()))) for k, v in slots.items()} == {k: len(v) for k, v in slots.items()}
