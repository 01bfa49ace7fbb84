"""Removal of repeated byte strings by prefix-free parsing (operator 8).

A byte goes when a string of `width` bytes that covers it also starts in a document with a smaller id. All documents are
parsed by rolling hashes: the *trigger* of a window of `width` bytes is its `gram`-byte substring with the least hash, so equal
windows have equal triggers wherever they lie. A *phrase* is a run of neighbouring windows with one trigger value; neighbouring
phrases overlap by `width - 1` bytes, so every window lies in exactly one phrase, and parsing is a function of the text alone.

1. Dictionary. Each batch of documents keeps, of every distinct phrase, the smallest document. Phrases meet by trigger: a
   phrase that a smaller document has goes whole; one whose trigger belongs to no other phrase stays whole, as no window of it occurs
   anywhere else.
2. Suffixes. What is left are phrases that share a trigger with others (ends of copied passages, chance hits). Their bytes meet, and
   the array of their suffixes is sorted by the first `width` bytes, which is all that the order of the corpus needs here: a suffix goes on
   from its phrase into the next one of the parse only after that. Of suffixes that agree there, those of larger documents are marked.
3. Parse. Every document is parsed again, verdicts are put back in the order of its phrases, and the covered bytes removed.

Phrases count as equal if their trigger's hash (48 bits) and their bytes' hash (96 bits) agree; suffixes are compared by their bytes.

Steps exchange packed arrays: one row for each batch and bucket of triggers, not one for each phrase, and answers come back as one
byte an entry or suffix in the order of the question. A batch sends at most one entry for a phrase, however often it occurs.

Documents are dealt to batches of about `batch_bytes` by hash; texts cross the network once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

WIDTH, GRAM = 50, 20
ODD = np.uint64(0x9E6C63D0876A9A35)
LETTER = mix64(np.arange(1, 257, dtype=np.uint64))
LAST = np.iinfo(np.int64).max
CLEAN, REMOVED, SUFFIXES = 0, 1, 2
#: Suffixes sorted at once; phrases with one trigger are never parted.
AT_ONCE = 1 << 18
#: Bytes of a trigger, of a phrase's hash and of a document's id in a question.
ENTRY = (6, 12, 8)


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the substrings of one length at every position: polynomials modulo 2**64, put together from powers of two.

    The length is the sum of its binary digits; its parts follow one another from the shortest.
    """
    power, factor = LETTER[data], np.array([ODD])  # an array, for which multiplication modulo 2**64 goes without a warning
    size, done, n = max(0, len(data) - length + 1), 0, 1
    total = np.zeros(size, np.uint64)
    while n <= length and size:
        if length & n:
            total *= factor
            total += power[done : done + size]
            done += n
        longer = power[:-n] * factor
        longer += power[n:]
        power, factor, n = longer, factor * factor, 2 * n
    return mix64(total)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of `width` entries."""
    if len(x) < width:
        return x[:0]
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    rest = width - n
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Parsed(NamedTuple):
    ids: np.ndarray  #: id of each document, ascending; null ids last
    data: np.ndarray  #: bytes of all documents
    bounds: np.ndarray  #: where documents begin in `data`, and its end
    start: np.ndarray  #: first window of each phrase
    count: np.ndarray  #: windows of each phrase
    doc: np.ndarray  #: document of each phrase
    trigger: np.ndarray  #: upper bits of the hash of each phrase's trigger
    content: np.ndarray  #: hash of the bytes of each phrase, two columns of 64 bits; of the second, the upper half is 0


def digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    raw = memoryview(data)
    found = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return found & np.array([2**64 - 1, 2**32 - 1], np.uint64)


def packed(trigger: np.ndarray, content: np.ndarray, doc: np.ndarray) -> bytes:
    """Entries as bytes, one kind after another; ENTRY says how many of each kind count."""
    raw = (np.ascontiguousarray(x).view(np.uint8).reshape(len(trigger), -1)[:, :size] for x, size in zip((trigger, content, doc), ENTRY, strict=True))
    return b"".join(x.tobytes() for x in raw)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, at, out = len(raw) // sum(ENTRY), 0, []
    for size, width in zip(ENTRY, (8, 16, 8), strict=True):
        x = np.zeros((n, width), np.uint8)
        x[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(n, size)
        out.append(x)
        at += n * size
    return out[0].view(np.uint64).ravel(), out[1].view(np.uint64), out[2].view(np.int64).ravel()


def parse(ids: pa.ChunkedArray, texts: pa.ChunkedArray, width: int, gram: int) -> Parsed:
    """The phrases of a batch of documents, in an order that does not depend on how the rows arrived."""
    keys = [(LAST if i is None else i) for i in ids.to_pylist()]
    raw = [t or b"" for t in texts.to_pylist()]
    order = sorted(range(len(raw)), key=lambda i: (keys[i], raw[i]))
    data = np.frombuffer(b"".join([raw[i] for i in order]), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(raw[i]) for i in order])]).astype(np.int64)
    numbers = np.array([keys[i] for i in order], np.int64)
    least = sliding_min(rolling(data, gram), width - gram + 1)
    inside = np.ones(len(least), bool)
    for end in bounds[1:-1]:
        inside[max(0, end - width + 1) : end] = False
    at = np.flatnonzero(inside)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    return Parsed(numbers, data, bounds, start, count, np.searchsorted(bounds, start, "right") - 1, least[start] >> np.uint64(64 - 8 * ENTRY[0]), digests(data, start, start + count + width - 1))


def distinct_entries(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For equal keys one entry, that of the smallest document: its index, and the entry of each item."""
    order = np.lexsort((doc, *keys))
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order[1:]] != k[order[:-1]] for k in keys])
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    return order[new], entry


def dealt(key: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Entries ordered by bucket, the first `bits` bits of the scrambled key, and document; and where buckets begin.

    Triggers are least hashes and so gather near zero: their own first bits would put a large part of them into one bucket.
    """
    bucket = (mix64(key + ODD) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    order = np.lexsort((doc, bucket))
    return order, np.searchsorted(bucket[order], np.arange((1 << bits) + 1))


def grouped(key: np.ndarray) -> np.ndarray:
    """Indices of the entries whose key occurs more than once."""
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    more = np.zeros(len(key), bool)
    more[1:] |= same
    more[:-1] |= same
    return order[more]


def phrase_verdicts(trigger: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A verdict for each entry; `content` has two columns."""
    out = np.zeros(len(trigger), np.uint8)
    some = grouped(trigger)
    if len(some):
        order = some[np.lexsort((doc[some], content[some, 1], content[some, 0], trigger[some]))]
        t, c, d = trigger[order], content[order], doc[order]
        new_t = np.concatenate([[True], t[1:] != t[:-1]])
        new_c = new_t | np.concatenate([[True], (c[1:] != c[:-1]).any(axis=1)])
        least = d[new_c][np.cumsum(new_c) - 1]
        contents = np.add.reduceat(new_c, np.flatnonzero(new_t))[np.cumsum(new_t) - 1]
        out[order] = np.where(d > least, REMOVED, np.where(contents > 1, SUFFIXES, CLEAN))
    return out


def places_in(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each entry, `count` of them, one entry after another."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def suffix_array(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of `data` that begin at `at`, by their first `width` bytes, and where one differs from the one before.

    The bytes are read as big numbers of eight each, whose order is that of the bytes.
    """
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    columns = []
    for i in range(0, width, 8):
        column = np.zeros(len(at), np.uint64)
        for k in range(i, min(i + 8, width)):
            column = (column << np.uint64(8)) | held[at + k]
        columns.append(column)
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[order[1:]] != c[order[:-1]] for c in columns])
    return order, new


def suffix_verdicts(trigger: np.ndarray, doc: np.ndarray, count: np.ndarray, data: np.ndarray, width: int, at_once: int = AT_ONCE) -> np.ndarray:
    """A verdict for each window of the phrases, whose bytes follow one another in `data`.

    Equal windows have equal triggers, so the suffixes of some triggers at a time are sorted.
    """
    sizes = count + width - 1
    begin = np.cumsum(sizes) - sizes
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint8)
    order = np.argsort(trigger, kind="stable")
    ends = np.append(np.flatnonzero(trigger[order[1:]] != trigger[order[:-1]]) + 1, len(order))
    windows = np.cumsum(count[order])
    a = 0
    while a < len(order):
        # as many triggers as fit, one at least
        fits = np.searchsorted(windows[ends - 1], (windows[a - 1] if a else 0) + at_once, "right")
        b = ends[max(fits - 1, np.searchsorted(ends, a, "right"))]
        mine = order[a:b]
        where, d = places_in(first[mine], count[mine]), np.repeat(doc[mine], count[mine])
        sorted_, new = suffix_array(data, places_in(begin[mine], count[mine]), width)
        least = np.minimum.reduceat(d[sorted_], np.flatnonzero(new))[np.cumsum(new) - 1]
        out[where[sorted_]] = np.where(d[sorted_] > least, REMOVED, CLEAN)
        a = b
    return out


QUESTION = "bucket int, batch int, data binary"
ANSWER = "kind int, bucket int, batch int, data binary"


def questions(batch: int, cuts: np.ndarray, data: Callable[[int], bytes]) -> pa.Table:
    """A row for each bucket that has something to ask."""
    asked = [(b, x) for b in np.flatnonzero(np.diff(cuts)).tolist() if (x := data(b))]
    return pa.table({"bucket": pa.array([b for b, _ in asked], pa.int32()), "batch": pa.array([batch] * len(asked), pa.int32()), "data": pa.array([x for _, x in asked], pa.binary())})


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, batch_bytes: int = 1 << 20, bucket_bytes: int = 24 << 20, with_text: bool = False) -> DataFrame:
    """Remove each byte that is covered by `width` bytes which also start in a document with a smaller id.

    Returns one row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, `with_text`, the kept bytes.

    Defined cases: texts are UTF-8 bytes, a null text has none; texts under `width` bytes keep all of theirs; a null id is
    larger than any other; rows that repeat an id do not remove anything from each other; an empty table gives no rows;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    batches = max(1, -(-total // batch_bytes))
    bits = max(0, (total // bucket_bytes).bit_length())
    home = F.pmod(F.xxhash64("doc_id", "t"), F.lit(batches)).cast("int")
    texts = rows.select(home.alias("batch"), "doc_id", F.col("t").cast("binary").alias("data"))

    def phrases(table: pa.Table) -> tuple[Parsed, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        p = parse(table["doc_id"], table["data"], width, gram)
        entries, entry = distinct_entries((p.content[:, 1], p.content[:, 0], p.trigger), p.ids[p.doc])
        order, cuts = dealt(p.trigger[entries], p.ids[p.doc[entries]], bits)
        return p, entries, entry, order, cuts

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        p, entries, _, order, cuts = phrases(table)

        def data(b: int) -> bytes:
            mine = entries[order[cuts[b] : cuts[b + 1]]]
            return packed(p.trigger[mine], p.content[mine], p.ids[p.doc[mine]])

        return questions(key[0].as_py(), cuts, data)

    def answered(table: pa.Table, kind: int, sizes: list[int], found: np.ndarray) -> pa.Table:
        back = [x.tobytes() for x in np.split(found, np.cumsum(sizes)[:-1])]
        return pa.table({"kind": pa.array([kind] * len(back), pa.int32()), "bucket": table["bucket"], "batch": table["batch"], "data": pa.array(back, pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        parts = [unpacked(x) for x in table["data"].to_pylist()]
        return answered(table, 1, [len(x[0]) for x in parts], phrase_verdicts(*map(np.concatenate, zip(*parts, strict=True))))

    def answer_suffixes(table: pa.Table) -> pa.Table:
        heads, bodies, sizes = [], [], []
        for x in table["data"].to_pylist():
            n = int.from_bytes(x[:8], "little")
            heads.append(np.frombuffer(x, np.int64, 3 * n, 8).reshape(3, n))
            bodies.append(x[8 + 24 * n :])
            sizes.append(int(heads[-1][2].sum()))
        trigger, doc, count = np.concatenate(heads, axis=1)
        return answered(table, 2, sizes, suffix_verdicts(trigger, doc, count, np.frombuffer(b"".join(bodies), np.uint8), width))

    def told(answers: pa.Table, kind: int) -> np.ndarray:
        """The answers to one kind of question, in the order of the buckets."""
        mine = sorted((b, d) for k, b, d in zip(answers["kind"].to_pylist(), answers["bucket"].to_pylist(), answers["data"].to_pylist(), strict=True) if k == kind)
        return np.frombuffer(b"".join(d for _, d in mine), np.uint8)

    def ask_suffixes(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        p, entries, _, order, cuts = phrases(table)
        open_ = told(answers, 1) == SUFFIXES  # in the order of the buckets, like `order`

        def data(b: int) -> bytes:
            mine = entries[order[cuts[b] : cuts[b + 1]][open_[cuts[b] : cuts[b + 1]]]]
            if not len(mine):
                return b""
            head = np.concatenate([[len(mine)], p.trigger[mine].view(np.int64), p.ids[p.doc[mine]], p.count[mine]])
            return head.astype(np.int64).tobytes() + p.data[places_in(p.start[mine], p.count[mine] + width - 1)].tobytes()

        return questions(table["batch"][0].as_py() if table.num_rows else 0, cuts, data)

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        p, entries, entry, order, _ = phrases(table)
        verdict = np.zeros(len(entries), np.uint8)
        verdict[order] = told(answers, 1)
        # a phrase that a smaller document of the batch has goes whole, too
        whole = (p.ids[p.doc] > p.ids[p.doc[entries]][entry]) | (verdict[entry] == REMOVED)
        look = np.flatnonzero(~whole & (verdict[entry] == SUFFIXES))
        asked = order[verdict[order] == SUFFIXES]
        first = np.zeros(len(entries), np.int64)
        first[asked] = np.cumsum(p.count[entries[asked]]) - p.count[entries[asked]]
        at = places_in(p.start[look], p.count[look])
        gone = told(answers, 2)[places_in(first[entry[look]], p.count[look])] == REMOVED
        step = np.zeros(len(p.data) + 1, np.int32)  # bytes covered: +1 where a removed run of windows begins, -1 where it ends
        np.add.at(step, p.start[whole], 1)
        np.add.at(step, p.start[whole] + p.count[whole] + width - 1, -1)
        np.add.at(step, at[gone], 1)
        np.add.at(step, at[gone] + width, -1)
        covered = np.cumsum(step[:-1]) > 0
        out: list[tuple] = []
        for i, number in enumerate(p.ids):
            a, b = p.bounds[i], p.bounds[i + 1]
            cover, text = covered[a:b], p.data[a:b]
            removed = int(cover.sum())
            kept = text[~cover].tobytes() if removed else text.tobytes()
            spans = int(np.count_nonzero(cover[1:] & ~cover[:-1]) + cover[0]) if removed else 0
            out.append((None if number == LAST else int(number), int(b - a), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
        return pa.table([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    by_batch = texts.groupBy("batch")
    first = by_batch.applyInArrow(ask, QUESTION).groupBy("bucket").applyInArrow(answer, ANSWER)
    second = by_batch.cogroup(first.groupBy("batch")).applyInArrow(ask_suffixes, QUESTION).groupBy("bucket").applyInArrow(answer_suffixes, ANSWER)
    return by_batch.cogroup(first.unionByName(second).groupBy("batch")).applyInArrow(finish, schema)
