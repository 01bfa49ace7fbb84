"""Document fingerprints by consistent weighted sampling (operator 10).

A document is a weighted set: its words with their counts. For each of `samples` hash functions every term draws, from its
name alone, two Gamma(2, 1) variables r and c and a uniform b; for a weight w it then has

    t = floor(ln w / r + b),   y = exp(r (t - b)),   a = c / (y exp(r)),

and the term with the least a is the sample, together with its t. Two documents agree on a sample with a probability equal
to the generalised Jaccard similarity of their weighted sets, sum of minima over sum of maxima. A fingerprint holds 16 bits of
each (term, t); chance agreement of those bits is taken out of the likeness.

Draws depend on the term and the weight only, so a worker keeps the rows of ln a it has made in a bounded table; a document
is then a minimum over rows of that table.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, rows_of, shuffle_width

SAMPLES = 64
#: Table rows one worker keeps (with 64 samples about 25 MB), and the terms of a document handled at once.
TABLE_ROWS, AT_ONCE = 60_000, 2_000
#: Stands for the empty text, so that it has a fingerprint like any other.
NO_WORDS = b"\x00"


def entries_of(text: str) -> list[bytes]:
    """The weighted terms of a text: a word that occurs once is its own bytes, any other has its count and a space before it."""
    counts = Counter(text.encode("utf-8", "surrogatepass").split())
    return [term if n == 1 else b"%d %b" % (n, term) for term, n in counts.items()] or [NO_WORDS]


class Sampler:
    def __init__(self, samples: int):
        self.samples = samples
        self.rows: dict[bytes, int] = {}
        self.score = np.empty((TABLE_ROWS, samples), np.float32)
        self.mark = np.empty((TABLE_ROWS, samples), np.uint16)
        self.salts = mix64(np.arange(1, 2 * samples + 1, dtype=np.uint64)).reshape(2, samples)

    def draws(self, entries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ln a and the 16 bits of (term, t) of each entry and sample.

        Two scrambled hashes of a term and sample hold its five uniform numbers: twice 24 bits for r, twice 24 for c, and
        what is left of both, 32 bits, for b.
        """
        parted = [e.partition(b" ") for e in entries]
        name = np.array([xxhash.xxh3_64_intdigest(term or first) for first, _, term in parted], np.uint64)[:, None]
        weight = np.log(np.array([int(first) if term else 1 for first, _, term in parted], np.float32))[:, None]
        one, two = mix64(name ^ self.salts[0]), mix64(name ^ self.salts[1])
        low, step = np.uint64((1 << 24) - 1), np.float32(2.0**-24)
        uniform = lambda x: (x.astype(np.float32) + np.float32(0.5)) * step
        gamma = lambda x: np.maximum(-np.log(uniform(x >> np.uint64(40)) * uniform((x >> np.uint64(16)) & low)), np.float32(1e-7))
        r, c = gamma(one), gamma(two)
        b = (((one & np.uint64(0xFFFF)) << np.uint64(16)) | (two & np.uint64(0xFFFF))).astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(weight / r + b)
        score = np.log(c) - r * (t - b + 1)
        mark = ((name + t.astype(np.int64).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E6C63D0876A9A35)) >> np.uint64(48)
        return score, mark.astype(np.uint16)

    def look_up(self, entries: list[bytes]) -> list[int]:
        found = list(map(self.rows.get, entries))
        if None in found:
            new = [e for e, at in zip(entries, found, strict=True) if at is None]
            if len(self.rows) + len(new) > TABLE_ROWS:
                self.rows.clear()
                new = entries
            start = len(self.rows)
            self.score[start : start + len(new)], self.mark[start : start + len(new)] = self.draws(new)
            self.rows.update(zip(new, range(start, start + len(new)), strict=True))
            found = list(map(self.rows.get, entries))
        return found

    def fingerprint(self, text: str) -> np.ndarray:
        entries = entries_of(text)
        best, mark = np.full(self.samples, np.inf, np.float32), np.zeros(self.samples, np.uint16)
        every = np.arange(self.samples)
        for i in range(0, len(entries), AT_ONCE):
            rows = np.array(self.look_up(entries[i : i + AT_ONCE]))
            scores = self.score[rows]
            at = scores.argmin(axis=0)
            least = scores[at, every]
            better = least < best
            best[better], mark[better] = least[better], self.mark[rows[at], every][better]
        return mark


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal samples, less the agreement that 16 bits have by chance."""
    same, chance = float((a == b).mean()), 2.0**-16
    return max(0.0, (same - chance) / (1 - chance))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Each row with its fingerprint (hexadecimal): doc_id, fingerprint.

    Defined cases: a null text counts as empty; all texts without words share one fingerprint; repeated rows have equal
    ones; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in rows_of(batches):
            prints = [sampler.fingerprint(t.as_py() or "").tobytes().hex() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, after: str) -> str:
    """`text` with its last half replaced by as many first code points of `after`, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of its text edited with the next document's, and both likenesses.

    The next document is the one with the next smaller id; after the smallest comes the largest. Documents are dealt into
    ranges of ids by one shuffle and sorted inside them; the first document of a range also goes, as a guest, to the range
    before it, whose last document it follows.

    Defined cases: a null text counts as empty; a null id comes after all others; rows that repeat an id follow one another
    in the order of their texts; a document that is alone is its own next one; an empty table gives no rows; other columns
    are ignored.
    """
    spark = docs.sparkSession
    count = ranges or shuffle_width(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # order: descending id, null ids last; only the id column is read for the bounds
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    ids = rows.select(key.alias("k"))
    bounds = ids.agg(F.percentile_approx("k", [i / count for i in range(1, count)] or [0.5], 10_000).alias("b")).first()["b"]
    if bounds is None:
        return spark.createDataFrame([], OUT)
    steps = sorted(set(bounds))
    part = _range_of(F.col("k"), steps)
    dealt = rows.withColumn("k", key).withColumn("part", part)
    firsts = cut(ids.withColumn("part", part).groupBy("part").agg(F.max("k").alias("first")))
    order = [r["part"] for r in firsts.select("part").orderBy("part").collect()]  # one number a range
    before = {p: order[i - 1] for i, p in enumerate(order)}
    first_of = {r["part"]: r["first"] for r in firsts.collect()}
    lead = F.create_map(*[F.lit(x) for p in order for x in (p, first_of[p])])
    back = F.create_map(*[F.lit(x) for p in order for x in (p, before[p])])
    guest = F.col("k") == lead[F.col("part")]
    homes = F.when(guest, F.array(F.struct(F.col("part").alias("home"), F.lit(0).alias("guest")), F.struct(back[F.col("part")].alias("home"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("part").alias("home"), F.lit(0).alias("guest"))))
    placed = dealt.select("doc_id", "k", "text", F.inline(homes)).repartitionByRange(max(count, len(order)), "home").sortWithinPartitions("home", "guest", F.desc("k"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        held = None  # home, id, text, fingerprint of the row that waits for its next one
        for batch in rows_of(batches):
            out: list[tuple] = []
            for doc, text, home, is_guest in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                text = text.as_py()
                mine = sampler.fingerprint(text)
                if held is not None and held[0] == home:
                    new = edited(held[2], text)
                    theirs = sampler.fingerprint(new)
                    out.append((held[1], len(held[2]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), held[3].tobytes().hex(), theirs.tobytes().hex(), likeness(held[3], theirs), likeness(held[3], mine)))
                # of several guests with one id, the first follows the range; none of them waits for a next row
                held = None if is_guest else (home, doc, text, mine)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=OUT.replace(",", "").split()[::2])

    return placed.mapInArrow(run, OUT)


def _range_of(key, steps: list[int]):
    """The range of a key among sorted bounds, by a comparison tree of logarithmic depth; 0 holds the largest keys."""
    if not steps:
        return F.lit(0)

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(len(steps) - lo)
        mid = (lo + hi) // 2
        return F.when(key <= steps[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(steps))
