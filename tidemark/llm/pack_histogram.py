"""Shortest-pack-first packing over the length histogram (operator 4).

1. Each document is tokenised once, where it is read, and cut into pieces: full sequences and one remainder. Only piece
   descriptions (id, place, length, checksum) go on; the ids themselves never cross the network here.
2. The histogram of remainder lengths has at most `seq_len` entries whatever the size of the table. On it, lengths are
   placed longest first, each into the packs that are shortest so far; packs that look alike are one *pattern* with a
   count, so the work depends on the number of lengths and patterns, not on documents.
3. A piece finds its place by its rank among the pieces of its length: each pattern slot owns a range of ranks.

Ranks come from per-bucket counts: pieces of one length are spread over `buckets` by a hash of the id, numbered inside
their bucket, and shifted by the sizes of the earlier buckets, so that a length that holds a third of all pieces is no
single task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, rows_of
from .token_ids import default_path, loaded

SEQ_LEN, END_ID = 2048, 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, with `end_id` after them, into pieces of at most `seq_len`.

    Returns doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), doc_tokens and,
    `with_ids`, the ids as that many bytes.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = loaded(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        for batch in rows_of(batches):
            out: list[list] = [[] for _ in names]
            for doc, own in zip(batch.column(0).to_pylist(), table.many([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(own, end_id).astype("<u4")
                raw = memoryview(ids.tobytes())
                for start in range(0, len(ids), seq_len):
                    part = raw[4 * start : 4 * (start + seq_len)]
                    for column, value in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), len(ids)), strict=False):
                        column.append(value)
                    if with_ids:
                        out[-1].append(bytes(part))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out[:5]] + [pa.array(x, pa.binary()) for x in out[5:]], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def shortest_pack_first(histogram: dict[int, int], seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns with counts for a histogram of lengths: longest lengths first, always into the emptiest packs.

    It begins with as many empty packs as the tokens need at least. A step takes the pattern with the most room; as many
    of its packs as there are pieces left get one piece and become another pattern. If the length doesn't fit there it fits
    nowhere, and new packs are opened, each for as many pieces of that length as it holds.
    """
    tokens = sum(length * count for length, count in histogram.items())
    by_room: dict[int, dict[tuple[int, ...], int]] = {seq_len: {(): -(-tokens // seq_len)}} if tokens else {}

    def put(pattern: tuple[int, ...], room: int, count: int) -> None:
        if count:
            same = by_room.setdefault(room, {})
            same[pattern] = same.get(pattern, 0) + count

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(by_room, default=-1)
            if room < length:
                each = seq_len // length
                put((length,) * each, seq_len - each * length, left // each)
                if left % each:
                    put((length,) * (left % each), seq_len - left % each * length, 1)
                break
            pattern, count = by_room[room].popitem()
            if not by_room[room]:
                del by_room[room]
            used = min(left, count)
            put((*pattern, length), room - length, used)
            put(pattern, room, count - used)
            left -= used
    merged: dict[tuple[int, ...], int] = {}
    for same in by_room.values():
        for pattern, count in same.items():
            if pattern:
                merged[pattern] = merged.get(pattern, 0) + count
    return sorted(merged.items())


def slots_of(patterns: list[tuple[tuple[int, ...], int]], first_sequence: int = 0) -> dict[int, np.ndarray]:
    """By length, sorted rank ranges: columns first rank, sequence of that rank, offset there."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = first_sequence
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            rank = taken.get(length, 0)
            slots.setdefault(length, []).append((rank, sequence, offset))
            taken[length] = rank + count
            offset += length
        sequence += count
    return {length: np.array(rows, np.int64) for length, rows in slots.items()}


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, seq_len: int = SEQ_LEN, end_id: int = END_ID, bucket_rows: int = 20_000) -> DataFrame:
    """Pack all documents into sequences of at most `seq_len` tokens.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Defined cases: a null or empty text is the single id `end_id`. A document longer than a sequence is cut into full
    sequences and a remainder; no id is lost or repeated. Repeated rows and null ids are packed like any others. An empty
    table gives no rows. Other columns are ignored, whatever their names. Ties in length are ranked by id and start.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, id_col=id_col, text_col=text_col, tokenizer=tokenizer, seq_len=seq_len, end_id=end_id))
    rows = made.count()
    buckets = max(1, -(-rows // bucket_rows))
    made = made.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    sizes = made.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    # at most seq_len entries: the histogram is what the method works on
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(slots_of(shortest_pack_first(histogram, seq_len)))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start")) - 1
    ranked = made.withColumn("number", number).join(before, ["length", "bucket"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("number") + F.col("before")).alias("rank"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            rank = frame.pop("rank").to_numpy()
            for length, at in frame.groupby("length").indices.items():
                table = slots.value[length]
                row = table[np.searchsorted(table[:, 0], rank[at], "right") - 1]
                sequence[at], offset[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            yield frame.assign(sequence_id=sequence, offset=offset)

    return ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
