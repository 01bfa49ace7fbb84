"""Alignment of two tokenizers over whole documents by distinct segments (operator 11).

A is byte-level BPE over a space and the text, B is BPE with byte fallback, which adds that space itself. Both give tokens
that cover the same bytes; where a token of A and one of B end at the same byte, a group of tokens ends. Tokens of one group
are linked.

No token of either vocabulary runs from a character that is not white space into certain white space characters
(`cut_marks` reads the vocabularies), so a document may be cut before every run of white space that begins with one of them: the ids,
and with them the groups, of the document are those of its segments in order. Then

1. documents become lists of numbers of segments, numbered anew in each block of some megabytes (no shuffle); the block
   also tells which segments it holds;
2. the blocks' segments are sorted by their text, so that each distinct one is tokenised and aligned once, where its rows
   meet, and its alignment goes back to every block that holds it;
3. each block composes its documents: counts, the digest of the groups, and the distinct pairs of linked ids;
4. pairs are counted over the blocks, and the blocks sum the counts over their documents' links.

A block holds a segment (and a pair) once, so that even the most frequent one has no more rows than there are blocks.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, stored
from .token_ids import byte_of_letter, default_path

#: A block ends once it has so many characters of text, distinct segments or documents.
BLOCK_BYTES, BLOCK_SEGMENTS, BLOCK_DOCS = 16 << 20, 200_000, 100_000
#: Documents that travel as one row.
CHUNK = 256
#: Segments that are tokenised at once, and rows of segments that are sent to their blocks at once.
AT_ONCE, ROWS_AT_ONCE = 4_000, 200_000
#: White space before which a text may be cut, if the vocabularies allow it.
MARKS = " \n\t\v\f\r"


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.lru_cache(maxsize=2)
class Tokenizers:
    """Both tokenizers, with the bytes of each of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_of_letter()
        special = {t["id"]: t["content"] for t in spec.get("added_tokens", ())}
        names = spec["model"]["vocab"]
        self.bytes_a = [b""] * (1 + max([*names.values(), *special]))
        for token, i in names.items():
            self.bytes_a[i] = b"" if i in special else bytes(letters[c] for c in token)
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        self.space = self.b.piece_to_id("▁")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            b"" if self.b.is_control(i) or self.b.is_unknown(i) else bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.sizes_a, self.sizes_b = ([len(x) for x in table] for table in (self.bytes_a, self.bytes_b))
        self.marks = "".join(m for m in MARKS if self.never_crossed(m))
        #: White space that may not be cut before, such as a no-break space, stays inside a segment.
        self.segment = re.compile(f"\\s*\\S+(?:[^\\S{re.escape(self.marks)}]\\s*\\S*)*|\\s+" if self.marks else "(?s:.+)")

    def never_crossed(self, mark: str) -> bool:
        """No token has `mark` after a character that is not white space, nor, but for the space, after B's own space."""
        own = mark.encode()
        crosses = re.compile(rb"[^\x09-\x0d\x20]" + re.escape(own))
        if any(crosses.search(t) for t in self.bytes_a if not t.replace(b"\xc2\xa0", b" ").isspace()) or any(crosses.search(t) for t in self.bytes_b):
            return False
        return mark == " " or not any(b" " + own in t for t in self.bytes_b)

    def ids_a(self, segments: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]

    def ids_b(self, segments: list[str]) -> list[list[int]]:
        """B puts a space before what it encodes: it stands for the segment's own first space, or is dropped again."""
        spaced = [s[0] == " " for s in segments]
        got = self.b.encode([s[1:] if own else s for s, own in zip(segments, spaced, strict=True)], num_threads=1)
        return [(ids or [self.space]) if own else ids[1:] for ids, own in zip(got, spaced, strict=True)]

    def groups(self, segment: bytes, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Tokens of A and of B in each group; None if the tokens do not spell the segment."""
        if b"".join([self.bytes_a[i] for i in a]) != segment or b"".join([self.bytes_b[i] for i in b]) != segment:
            return None
        out, i, j, at_a, at_b, from_i, from_j = [], 0, 0, 0, 0, 0, 0
        sizes_a, sizes_b = self.sizes_a, self.sizes_b
        while i < len(a) or j < len(b):
            if at_a <= at_b:
                at_a += sizes_a[a[i]]
                i += 1
            else:
                at_b += sizes_b[b[j]]
                j += 1
            if at_a == at_b:
                out.append((i - from_i, j - from_j))
                from_i, from_j = i, j
        return out


def code_of(groups: list[tuple[int, int]], a: list[int], b: list[int]) -> tuple[bytes, bytes]:
    """Groups and ids as 16-bit numbers, or as 32-bit ones if one does not fit: count, sizes in A, sizes in B, ids of A, ids of B."""
    values = [len(groups), *[n for n, _ in groups], *[n for _, n in groups], *a, *b]
    return (np.array(values, "<u2").tobytes(), b"") if max(values) < 1 << 16 else (b"", np.array(values, "<u4").tobytes())


# --- numbers as bytes ------------------------------------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of non-negative numbers, compressed: the first bytes of all numbers, then the second ones, and so on."""
    parts = [np.array([len(arrays), *map(len, arrays)], "<u8").tobytes(), *[np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in arrays]]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    sizes = raw[8 : 8 * (1 + int(raw[:8].view("<u8")[0]))].view("<u8").astype(int).tolist()
    out, at = [], 8 * (1 + len(sizes))
    for n in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 8 * n].reshape(8, n).T).view("<u8").reshape(-1).astype(np.int64))
        at += 8 * n
    return out


def parts_of(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []


# --- 1. documents as lists of numbers --------------------------------------------------------------------------------

BLOCKS = "kind byte, block long, at int, segment string, docs array<long>, data binary"


def in_blocks(rows: DataFrame, path_a: str, path_b: str, block_bytes: int, block_segments: int) -> DataFrame:
    """A row for some documents of a block (kind 0: their ids and numbers) and one for each segment (kind 1: its number `at`).

    Numbers go from the most frequent segment of the block to the rarest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Tokenizers(path_a, path_b).segment.findall
        block, size = TaskContext.get().partitionId() << 32, 0
        known: dict[str, int] = {}
        docs: list[int | None] = []
        lists: list[np.ndarray] = []

        def closed() -> Iterator[pa.RecordBatch]:
            times = np.zeros(len(known), np.int64)
            for x in lists:
                times += np.bincount(x, minlength=len(known))
            place = np.empty(len(known), np.int64)
            place[np.argsort(-times, kind="stable")] = np.arange(len(known))
            chunks = [(docs[i : i + CHUNK], lists[i : i + CHUNK]) for i in range(0, len(docs), CHUNK)]
            data = [packed(np.array([len(x) for x in some]), place[np.concatenate(some).astype(np.int64)]) for _, some in chunks]
            n, m = len(chunks), len(known)
            columns = [([0] * n + [1] * m, pa.int8()), ([block] * (n + m), pa.int64()), ([None] * n + place.tolist(), pa.int32()), ([None] * n + list(known), pa.string()), ([ids for ids, _ in chunks] + [None] * m, pa.list_(pa.int64())), (data + [None] * m, pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in rows_of(batches):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                docs.append(doc)
                lists.append(np.array([known.setdefault(s, len(known)) for s in find(" " + text)] if text else [], np.uint32))
                size += len(text or "")
                if size >= block_bytes or len(known) >= block_segments or len(docs) >= BLOCK_DOCS:
                    yield from closed()
                    block, size = block + 1, 0
                    known.clear(), docs.clear(), lists.clear()
        if docs:
            yield from closed()

    return rows.mapInArrow(run, BLOCKS)


# --- 2. distinct segments --------------------------------------------------------------------------------------------

PACKS = "home long, data binary"


def aligned(held: DataFrame, path_a: str, path_b: str, at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """home, data: alignments of some segments of a block, from the rows (home, at, segment) of all blocks.

    Rows are dealt and sorted by segment: a segment is tokenised where its first row is, and the last one of a portion is kept for the next.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Tokenizers(path_a, path_b)
        last: tuple[str, tuple[bytes, bytes]] | None = None
        waiting: list[pa.RecordBatch] = []

        def code(segment: str, a: list[int], b: list[int]) -> tuple[bytes, bytes]:
            groups = both.groups(segment.encode(), a, b)
            return code_of(groups, a, b) if groups else (b"", b"")

        def sent() -> Iterator[pa.RecordBatch]:
            nonlocal last
            table = pa.Table.from_batches(waiting).combine_chunks()
            waiting.clear()
            texts, (home, at) = table.column("segment").combine_chunks(), (table.column(c).to_numpy() for c in ("home", "at"))
            new = np.concatenate([[True], pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)])
            distinct, row = texts.filter(pa.array(new)).to_pylist(), np.cumsum(new) - 1
            known = [last[1]] if last and last[0] == distinct[0] else []
            codes = known
            for start in range(len(known), len(distinct), AT_ONCE):
                some = distinct[start : start + AT_ONCE]
                codes += [code(s, a, b) for s, a, b in zip(some, both.ids_a(some), both.ids_b(some), strict=True)]
            last = distinct[-1], codes[-1]
            order = np.lexsort((at, home))
            homes, starts = np.unique(home[order], return_index=True)
            data = []
            for mine in np.split(order, starts[1:]):
                narrow, wide = zip(*[codes[r] for r in row[mine].tolist()], strict=True)
                data.append(packed(np.diff(at[mine], prepend=0), *[np.array([len(x) // w for x in some], np.int64) for some, w in ((narrow, 2), (wide, 4))], np.frombuffer(b"".join(narrow), "<u2"), np.frombuffer(b"".join(wide), "<u4")))
            yield pa.RecordBatch.from_arrays([pa.array(homes), pa.array(data, pa.binary())], names=["home", "data"])

        count = 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                count += batch.num_rows
            if count >= at_once:
                yield from sent()
                count = 0
        if waiting:
            yield from sent()

    return held.repartition("segment").sortWithinPartitions("segment").mapInArrow(run, PACKS)


# --- 3. documents of a block -----------------------------------------------------------------------------------------


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one range after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Lexicon(NamedTuple):
    """The alignments of a block's segments, by segment number."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray  # 0 where the tokens do not spell the segment
    written: list[str]  # the groups
    first: np.ndarray  # where a segment's links begin in `pair`
    n_links: np.ndarray
    pair: np.ndarray  # of each link, the number of its pair in the block
    names: np.ndarray  # id of A << 32 | id of B of each pair of the block


def lexicon(packs: list[bytes]) -> Lexicon:
    parts = [unpacked(p) for p in packs]
    at = np.concatenate([np.cumsum(p[0]) for p in parts] or [np.zeros(0, np.int64)])
    narrow, broad, short, long = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in (1, 2, 3, 4))
    values = np.concatenate([short, long])
    starts = np.where(broad > 0, len(short) + np.cumsum(broad) - broad, np.cumsum(narrow) - narrow)
    order = np.argsort(at)  # `at` holds every number of the block once
    starts, sizes = starts[order], (narrow + broad)[order]
    groups = np.where(sizes > 0, values[np.minimum(starts, max(0, len(values) - 1))] if len(values) else 0, 0)
    of = np.repeat(np.arange(len(groups)), groups)  # segment of each group
    size_a, size_b = values[ranges(starts + 1, groups)], values[ranges(starts + 1 + groups, groups)]
    total = lambda x: np.bincount(of, x, len(groups)).astype(np.int64)
    n_a, n_b, n_links = total(size_a), total(size_b), total(size_a * size_b)
    a, b = values[ranges(starts + 1 + 2 * groups, n_a)], values[ranges(starts + 1 + 2 * groups + n_a, n_b)]
    from_a, from_b, links = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b, size_a * size_b
    group = np.repeat(np.arange(len(links)), links)
    inside = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    pairs = a[from_a[group] + inside // size_b[group]] << 32 | b[from_b[group] + inside % size_b[group]]
    del group, inside, from_a, from_b, values
    names, pair = np.unique(pairs, return_inverse=True)
    return Lexicon(n_a, n_b, groups, _written(a, b, size_a, size_b, groups), np.cumsum(n_links) - n_links, n_links, pair.astype(np.int32), names)


def _written(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, groups: np.ndarray) -> list[str]:
    decimal = list(map(str, range(1 + int(max(a.max(initial=0), b.max(initial=0))))))  # one string for each id
    ids_a, ids_b = [decimal[i] for i in a.tolist()], [decimal[i] for i in b.tolist()]
    every, i, j = [], 0, 0
    for m, n in zip(size_a.tolist(), size_b.tolist(), strict=True):
        every.append(f"{','.join(ids_a[i : i + m])}|{','.join(ids_b[j : j + n])}")
        i, j = i + m, j + n
    out, at = [], 0
    for n in groups.tolist():
        out.append(";".join(every[at : at + n]))
        at += n
    return out


def links_of(numbers: np.ndarray, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a document, and how many of its links each has."""
    segment, times = np.unique(numbers, return_counts=True)
    sizes = lex.n_links[segment]
    pair, inverse = np.unique(lex.pair[ranges(lex.first[segment], sizes)], return_inverse=True)
    return pair, np.bincount(inverse, np.repeat(times, sizes), len(pair)).astype(np.int64)


COMPOSED = "kind byte, block long, docs array<long>, data binary, pair int, a int, b int, n long"


def compose(docs: pa.Table, packs: pa.Table) -> pa.Table:
    """A block's documents (kind 0: ids, sums, digests, and the pairs with their links) and its pairs (kind 1: held by n documents).

    Pairs are numbered from the one that most documents hold to the rarest.
    """
    block = docs.column("block")[0].as_py()
    lex = lexicon(packs.column("data").to_pylist())
    held, made = np.zeros(len(lex.names), np.int64), []
    for data in docs.column("data").to_pylist():
        sizes, numbers = unpacked(data)
        sums, digests, pairs, links = [], [], [], []
        for mine in parts_of(numbers, sizes):
            if not len(mine) or (lex.n_groups[mine] == 0).any():
                sums.append([0, 0, 0, 0])
                continue
            pair, times = links_of(mine, lex)
            held[pair] += 1
            sums.append([int(x[mine].sum()) for x in (lex.n_a, lex.n_b, lex.n_groups, lex.n_links)])
            digests.append(hashlib.sha256(";".join(map(lex.written.__getitem__, mine.tolist())).encode()).digest())
            pairs.append(pair)
            links.append(times)
        made.append((np.array(sums, np.int64), b"".join(digests), pairs, links))
    order = np.argsort(-held, kind="stable")
    place = np.empty(len(held), np.int64)
    place[order] = np.arange(len(held))
    out = []
    for sums, digests, pairs, links in made:
        sorted_ = [(np.sort(x := place[p]), np.argsort(x)) for p in pairs]
        none = [np.zeros(0, np.int64)]
        numbers = packed(sums.reshape(-1), np.array([len(p) for p in pairs]), np.concatenate([np.diff(p, prepend=0) for p, _ in sorted_] or none), np.concatenate([n[at] for n, (_, at) in zip(links, sorted_, strict=True)] or none))
        out.append(np.array([len(digests)], "<u4").tobytes() + digests + numbers)
    n, m = len(out), int((held > 0).sum())
    names = lex.names[order[:m]]
    columns = [
        ([0] * n + [1] * m, pa.int8()), ([block] * (n + m), pa.int64()), (docs.column("docs").to_pylist() + [None] * m, pa.list_(pa.int64())), (out + [None] * m, pa.binary()),
        *[([None] * n + x.tolist(), kind) for x, kind in ((np.arange(m), pa.int32()), (names >> 32, pa.int32()), (names & 0xFFFFFFFF, pa.int32()), (held[order[:m]], pa.int64()))],
    ]
    return pa.Table.from_arrays([pa.array(x, kind) for x, kind in columns], names=[c.split()[0] for c in COMPOSED.split(", ")])


# --- 4. counts of pairs ----------------------------------------------------------------------------------------------

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def sums(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the sums over their links."""
    at = pairs.column("pair").to_numpy()
    count, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    count[at], best[at] = pairs.column("n").to_numpy(), pairs.column("best").to_numpy()
    rows: list[tuple] = []
    for ids, data in zip(docs.column("docs").to_pylist(), docs.column("data").to_pylist(), strict=True):
        (size,) = np.frombuffer(data[:4], "<u4")
        totals, sizes, steps, links = unpacked(data[4 + size :])
        digests, parts = data[4 : 4 + size], zip(parts_of(steps, sizes), parts_of(links, sizes), strict=True)
        k = 0
        for doc, four in zip(ids, totals.reshape(-1, 4).tolist(), strict=True):
            if four[2] == 0:
                rows.append((doc, 0, 0, 0, 0, 0, 0, ""))
                continue
            step, times = next(parts)
            pair = np.cumsum(step)
            rows.append((doc, *four, int((times * best[pair]).sum()), int((times * count[pair]).sum()), digests[k : k + 32].hex()))
            k += 32
    kinds = [*[pa.int64()] * 7, pa.string()]
    return pa.Table.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in RESULT.split(", ")])


def align(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None,
    block_bytes: int = BLOCK_BYTES, block_segments: int = BLOCK_SEGMENTS,
) -> DataFrame:
    """Each document's numbers of tokens, groups and links, the sums of its links' counts, and the digest of its groups.

    Defined cases: a null or empty text, and one that the tokens of A or B do not spell, has zeros and an empty digest; rows
    that repeat an id, or are equal, are documents of their own; a null id stays; a text of any length is one
    document of one block; an empty table gives no rows; other columns are ignored.
    """
    a, b = path_a or default_path(), path_b or piece_path()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = stored(in_blocks(rows, a, b, block_bytes, block_segments))
    packs = aligned(blocks.rows.filter("kind = 1").select(F.col("block").alias("home"), "at", "segment"), a, b)
    listed = blocks.rows.filter("kind = 0").select("block", "docs", "data")
    composed = stored(listed.groupBy("block").cogroup(packs.groupBy("home")).applyInArrow(compose, COMPOSED))
    blocks.drop()
    pairs = composed.rows.filter("kind = 1").select(F.col("block").alias("home"), "pair", "a", "b", "n")
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = totals.groupBy("a").agg(F.max("n").alias("most"))
    every = totals.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    counts = pairs.drop("n").join(every, ["a", "b"]).select("home", "pair", "n", "best")
    made = composed.rows.filter("kind = 0").select("block", "docs", "data")
    return made.groupBy("block").cogroup(counts.groupBy("home")).applyInArrow(sums, RESULT)
