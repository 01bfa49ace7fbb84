"""Token-id output by best-fit-decreasing packing (operator 2).

Documents are tokenised and packed where they are read: every task takes its documents in windows of at most `window`
pieces, sorts a window's pieces by falling length and puts each into the open sequence whose free room is the least that
still holds it. The search is a segment tree over capacities: leaf c counts the open sequences with exactly c free ids,
an inner node the sum below it, and the best fit for a length is the first non-empty leaf at or above it. Nothing is
shuffled, and a window's padding is at most about one sequence, 1/`window` of its tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of
from .token_ids import default_path, loaded

SEQ_LEN, END_ID = 2048, 1
PACKED = "sequence_id long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, n_tokens int, ids binary, position_ids binary"


class CapacityTree:
    """A segment tree over capacities 0 to `most`; a leaf holds the sequences with that much room."""

    def __init__(self, most: int):
        self.leaves = 1 << max(1, most).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: dict[int, list[int]] = {}

    def add(self, room: int, sequence: int) -> None:
        self.open.setdefault(room, []).append(sequence)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, sequence) of the tightest open sequence with at least `need` free ids."""
        node = need + self.leaves
        if not self.count[node]:
            # up to the first right-hand sibling that holds anything, then down to its leftmost such leaf
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.open[room].pop()

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit_decreasing(lengths: list[int], seq_len: int) -> list[list[int]]:
    """Indices of the pieces in each sequence; ties in length keep their order."""
    tree, packed = CapacityTree(seq_len), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            room, sequence = seq_len, len(packed)
            packed.append([])
        else:
            room, sequence = found
        packed[sequence].append(i)
        if room > lengths[i]:
            tree.add(room - lengths[i], sequence)
    return packed


def pack_sequences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, pad_id: int = 0, window: int = 4096) -> DataFrame:
    """Packed token-id sequences, one row each.

    `ids` are `seq_len` little-endian unsigned 32-bit ids, padded with `pad_id`; `position_ids`, of the same form, begin at
    0 with every piece (padding counts as one more piece); `cu_seqlens` are the cumulative piece lengths from 0 to
    `n_tokens`; `doc_ids` and `starts` say which ids of which document a piece holds.

    Defined cases: a null or empty text is the single id `end_id`; a document longer than a sequence is split without loss;
    repeated rows and null ids are packed like any others; an empty table gives no rows; other columns are ignored.
    Sequence ids are unique; they depend on how the table is split into partitions, as the packing does.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part = loaded(path), TaskContext.get().partitionId()
        number = part << 33
        held: list[tuple[int | None, int, np.ndarray]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows: list[list] = [[] for _ in schema]
            for members in best_fit_decreasing([len(x[2]) for x in held], seq_len):
                some = [held[i] for i in members]
                lengths = [len(x[2]) for x in some]
                ends = np.cumsum([0, *lengths]).astype(np.int32)
                n = int(ends[-1])
                ids = np.full(seq_len, pad_id, "<u4")
                ids[:n] = np.concatenate([x[2] for x in some])
                place = (np.arange(seq_len) - np.repeat(ends, [*lengths, seq_len - n])).astype("<u4")
                for column, value in zip(rows, (number, [x[0] for x in some], [x[1] for x in some], ends.tolist(), n, ids.tobytes(), place.tobytes()), strict=True):
                    column.append(value)
                number += 1
                if len(rows[0]) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
                    rows = [[] for _ in schema]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
            held.clear()

        schema = pa.schema([("sequence_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("n_tokens", pa.int32()), ("ids", pa.binary()), ("position_ids", pa.binary())])
        for batch in rows_of(batches):
            for doc, own in zip(batch.column(0).to_pylist(), table.many([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(own, end_id).astype("<u4")
                for start in range(0, len(ids), seq_len):
                    held.append((doc, start, ids[start : start + seq_len]))
                    if len(held) == window:
                        yield from emit()
        if held:
            yield from emit()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PACKED)


def write_sequences(docs: DataFrame, path: str, **options) -> None:
    """Write the packed matrices as Parquet, one row per sequence, through Spark's committer (lost tasks are run again)."""
    pack_sequences(docs, **options).write.mode("overwrite").parquet(path)


def digest(packed: DataFrame) -> DataFrame:
    """What `packed` holds, small: one row per sequence with checksums in place of the matrices."""
    return packed.select("sequence_id", "doc_ids", "starts", "cu_seqlens", "n_tokens", F.crc32("ids").alias("ids_crc32"), F.crc32("position_ids").alias("position_ids_crc32"))


def crc32_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
