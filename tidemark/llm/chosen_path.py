"""N-gram Jaccard join by chosen paths (operator 6).

Texts are sets of hashed five-word shingles; texts with equal sets are one *node* from the start. The join has two parts.

Candidates, by chosen paths. In a run a set chooses each of its shingles with probability 1 / (threshold * size), by a hash that all
sets share, and goes to the bucket of every shingle it chose; two sets over the threshold are expected to choose a common one. Buckets of at
most `limit` sets are compared by brute force. Larger ones are split again by shingles chosen with other hashes, unless
their sets are alike on average, as splitting cannot part those: they are compared at once, in blocks. Runs are repeated
until a pair at the threshold is missed with a probability below 1 - `recall`. Comparisons use small sketches with a margin, and a
bucket gives back the links of a spanning forest, not its pairs.

Exact links. Components of candidates are small pieces of the corpus that hold every link: inside each, all pairs are compared exactly,
by products of the incidence matrix of shingles that at least two members have. Only counts and spanning links leave a task. Components
over `block` members are compared as pairs of blocks.

Nothing grows with the square of a group but the arithmetic inside these blocks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, rows_of, stored, text_or_empty
from .components import connected

THRESHOLD, GRAM, RECALL = 0.8, 5, 0.9999
#: Hashes of a sketch, and how far below the threshold an estimate may be (four standard deviations).
SKETCH = 64
MARGIN = 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / SKETCH)
DEPTH, DEEPER = 3, 2.0
LIMIT, BLOCK, ALIKE = 100, 2048, 0.4
#: Places of a sketch whose signs estimate how alike the sets of a bucket are.
SIGNS = 32
WORD_TABLE = 500_000
_A = mix64(np.arange(1, 1001, dtype=np.uint64)) | np.uint64(1)
_B = mix64(np.arange(1001, 2001, dtype=np.uint64))


class Shingler:
    """Sets of hashed shingles; a worker keeps the hashes of the words it has met in a bounded table."""

    def __init__(self, gram: int):
        self.gram, self.words = gram, {}

    def shingles(self, text: str) -> np.ndarray:
        """Sorted hashes of the runs of `gram` words; a shorter text is one run of all it has, and one without words none."""
        words = text.split()
        if not words:
            return np.zeros(0, np.uint64)
        found = list(map(self.words.get, words))
        if None in found:
            if len(self.words) > WORD_TABLE:
                self.words.clear()
                found = [None] * len(words)
            for i, h in enumerate(found):
                if h is None:
                    found[i] = self.words[words[i]] = int.from_bytes(hashlib.blake2b(words[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        ids = np.array(found, np.uint64)
        size = min(self.gram, len(ids))
        total = np.full(len(ids) - size + 1, np.uint64(size))
        for i in range(size):
            total = mix64(total) + ids[i : len(ids) - size + 1 + i]
        return np.unique(mix64(total))


def node_of(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def runs_for(recall: float) -> int:
    """Runs after which a pair at the threshold, with one common choice expected a level, is met with this probability."""
    met = 1.0
    for _ in range(DEPTH - 1):
        met = 1 - math.exp(-DEEPER * met)
    return math.ceil(math.log(1 - recall) / math.log(math.exp(-met)))


class Signed(NamedTuple):
    sketch: np.ndarray  #: one row of bytes a set
    chosen: list[tuple[np.ndarray, np.ndarray]]  #: for each depth, keys in the order of set and run, and how many each (set, run) has


def sketches_and_choices(sets: list[np.ndarray], runs: int, threshold: float) -> Signed:
    """Sketches, and for every depth and run the chosen shingles, of a batch of sets at once."""
    m, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), sizes)
    full = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[full]
    least = np.full((m, SKETCH), np.iinfo(np.uint64).max, np.uint64)
    for k in range(SKETCH):
        if len(full):
            least[full, k] = np.minimum.reduceat(flat * _A[k] + _B[k], starts)
    sketch = (mix64(least) >> np.uint64(56)).astype(np.uint8)
    chosen = []
    for depth in range(DEPTH):
        bound = np.minimum(1.0, (1.0 if depth == 0 else DEEPER) / (threshold * np.maximum(1, sizes)))
        most = np.repeat((np.minimum(bound, 1 - 2.0**-53) * 2.0**64).astype(np.uint64), sizes)
        at = SKETCH + depth * 100
        keys, slots = [], []
        for run in range(runs):
            hit = np.flatnonzero(mix64(flat ^ _B[at + run]) <= most)
            keys.append(mix64(flat[hit] + _A[at + run]).view(np.int64))
            slots.append(owner[hit] * runs + run)
        slot = np.concatenate(slots)
        chosen.append((np.concatenate(keys)[np.argsort(slot, kind="stable")], np.bincount(slot, minlength=m * runs)))
    return Signed(sketch, chosen)


def signs_of(sketch: np.ndarray) -> np.ndarray:
    """The lowest bits of the first places of each sketch, as one whole number."""
    return ((sketch[:, :SIGNS].astype(np.int64) & 1) << np.arange(SIGNS)).sum(axis=1)


def alike(rows: DataFrame) -> DataFrame:
    """(bucket, alike): whether the sets of a bucket (bucket, signs) have an average similarity of ALIKE or more, themselves included.

    A place of two sketches agrees with the sets' similarity and else by chance, so the product of two signs (1 or -1) is expected
    to be the similarity, and the square of a bucket's sum of signs the sum over all its pairs: one number a place, no pairs.
    """
    sums = [F.sum(F.shiftright("signs", i).bitwiseAND(1) * 2 - 1).alias(f"s{i}") for i in range(SIGNS)]
    mean = sum(F.pow(F.col(f"s{i}").cast("double"), F.lit(2.0)) for i in range(SIGNS)) / SIGNS
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *sums).select("bucket", (mean / F.pow("n", F.lit(2.0)) >= ALIKE).alias("alike"))


def offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


SIGNED = "doc_id long, node binary, text_key long, sketch binary, signs long, runs array<int>, first array<long>, second array<array<long>>, third array<array<long>>"


def signatures(docs: DataFrame, runs: int, threshold: float, gram: int) -> DataFrame:
    """A row per document: node, and the sketch and choices of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(gram)
        names = SIGNED.replace(", ", " ").split()[::2]
        for batch in rows_of(batches, size=2 << 20):
            m = batch.num_rows
            sets = [shingler.shingles(text.as_py()) for text in batch.column(2)]
            sketch, ((first, n_first), *deeper) = sketches_and_choices(sets, runs, threshold)
            by_set = offsets(n_first.reshape(m, runs).sum(axis=1))
            every_run = np.repeat(np.tile(np.arange(runs, dtype=np.int32), m), n_first)
            lists = [pa.ListArray.from_arrays(offsets(np.full(m, runs)), pa.ListArray.from_arrays(offsets(n), pa.array(keys))) for keys, n in deeper]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([node_of(s) for s in sets], pa.binary()), batch.column(1), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(signs_of(sketch)), pa.ListArray.from_arrays(by_set, pa.array(every_run)), pa.ListArray.from_arrays(by_set, pa.array(first)), *lists],
                names=names,
            )

    return docs.mapInArrow(run, SIGNED)


def groups_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """The rows of each group of a partition that is sorted by its first `keys` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def spanning(sketches: np.ndarray, least_same: int) -> np.ndarray:
    """A component number for each sketch, where those that agree in `least_same` places are linked."""
    label = np.full(len(sketches), -1)
    rest = np.arange(len(sketches))
    while len(rest):
        front, rest = rest[:1], rest[1:]
        root = front[0]
        label[root] = root
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for i in front:
                hit |= (sketches[rest] == sketches[i]).sum(axis=1) >= least_same
                if hit.all():
                    break
            front, rest = rest[hit], rest[~hit]
            label[front] = root
    return label


def candidate_links(buckets: DataFrame, threshold: float) -> DataFrame:
    """Spanning links (a, b) of buckets (bucket, i, j, node, sketch): the rows of a bucket, or of a pair of its blocks."""
    least_same = math.ceil((threshold - MARGIN) * SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: tuple[list, list] = ([], [])
        for rows in groups_of(batches, 3):
            label = spanning(np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(len(rows), SKETCH), least_same)
            for i in np.flatnonzero(label != np.arange(len(rows))):
                pairs[0].append(rows[i][3])
                pairs[1].append(rows[label[i]][3])
            if len(pairs[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in pairs], names=["a", "b"])
                pairs = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in pairs], names=["a", "b"])

    return buckets.select("bucket", "i", "j", "node", "sketch").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a binary, b binary")


def in_blocks(rows: DataFrame, members: str, block: int) -> DataFrame:
    """Give each row the block pairs (i, j), i <= j, that it takes part in; groups of up to `block` members have one."""
    n = F.greatest(F.lit(1), F.ceil(F.col(members) / block)).cast("int")
    mine = F.pmod(F.xxhash64("node"), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), n - 1), lambda other: F.struct(F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"), mine.alias("mine")))
    return rows.withColumn("pair", F.explode(pairs)).select(*rows.columns, "pair.i", "pair.j", "pair.mine")


def candidates(nodes: DataFrame, threshold: float, limit: int, block: int) -> DataFrame:
    """Candidate links between nodes by recursion on chosen shingles."""
    level = nodes.select("node", F.inline(F.arrays_zip(F.col("runs").alias("run"), F.col("first").alias("key"))))
    level = level.toDF("node", "run", "key").select("node", "run", F.xxhash64("run", "key").alias("bucket"))
    sketches = nodes.select("node", "sketch")
    found = None
    for depth, more in enumerate(("second", "third", None)):
        sizes = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = cut(level.join(sizes, "bucket"))
        large = shared.where(F.col("n") > limit)
        small = shared.where(F.col("n") <= limit).select("bucket", "node", "n")
        last = more is None or large.isEmpty()
        if last:
            ready = shared.select("bucket", "node", "n")
        else:
            marked = large.join(cut(alike(large.join(nodes.select("node", "signs"), "node"))), "bucket")
            ready = small.unionByName(marked.where("alike").select("bucket", "node", "n"))
            choices = nodes.select("node", F.col(more).alias("choices"))
            level = marked.where("not alike").select("node", "run", "bucket").join(choices, "node").select("node", "run", "bucket", F.explode(F.col("choices")[F.col("run")]).alias("key")).select("node", "run", F.xxhash64("bucket", "key").alias("bucket"))
        links = candidate_links(in_blocks(ready, "n", block * 4).join(sketches, "node"), threshold).distinct()
        found = links if found is None else found.unionByName(links)
        if last:
            break
    return found


def exact_links(members: DataFrame, threshold: float, gram: int) -> DataFrame:
    """All pairs of members (part, i, j, mine, node, copies, text) of a component, or of two of its blocks, compared exactly.

    Returns node, links (copies of the nodes it is linked with) and root, a node of a spanning forest of the links met here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(gram)
        for rows in groups_of((b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)), 3):
            mine = {}
            for _, i, j, block, node, copies, text in rows:
                if node not in mine:
                    s = shingler.shingles(text)
                    if node_of(s) == node:
                        mine[node] = (block, copies, s)
            nodes = list(mine)
            side, copies, sets = (np.array([x[k] for x in mine.values()]) if k < 2 else [x[2] for x in mine.values()] for k in (0, 1, 2))
            i, j = rows[0][1], rows[0][2]
            linked = linked_pairs(sets, threshold)
            if i != j:
                linked &= side[:, None] != side[None, :]
            label = forest(linked)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(linked @ copies.astype(np.int64), pa.int64()), pa.array([nodes[k] for k in label], pa.binary())], names=["node", "links", "root"])

    return members.select("part", "i", "j", "mine", "node", "copies", "text").repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(run, "node binary, links long, root binary")


def linked_pairs(sets: list[np.ndarray], threshold: float, columns: int = 2048) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least `threshold`; never a set with itself."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.float32)
    owner = np.repeat(np.arange(m), size.astype(np.int64))
    tokens, token, count = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[token]
    owner, column = owner[keep], number[token[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((m, m), np.float32)
    for start in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, [start, start + columns])
        part = np.zeros((m, columns), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        common += part @ part.T
    linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-3
    np.fill_diagonal(linked, False)
    return linked


def forest(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    label = np.full(len(linked), -1)
    for i in range(len(linked)):
        if label[i] < 0:
            front = np.zeros(len(linked), bool)
            front[i] = True
            while front.any():
                label[front] = i
                front = linked[front].any(axis=0) & (label < 0)
    return label


def jaccard_join(docs: DataFrame, *, threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """Classes of documents that are linked, directly or through others, by a Jaccard similarity of at least `threshold`.

    Returns one row per document: doc_id, class_id (the least id of its class), n_links (the other documents it is linked
    with; copies count), class_size, first (whether this is the row that stands for its class).

    Defined cases: words are parted by white space and taken as written; a text under `gram` words is one shingle of all its
    words; null and empty texts, and those of white space, have no shingles and are all alike. A null id is greater than
    others; a class of null ids has a null class_id. Rows that repeat an id are documents of their own, and one row stands for
    a class. An empty table gives no rows; other columns are ignored.
    """
    return placed_rows(docs, threshold, gram, recall, id_col, text_col, limit, block).select("doc_id", "class_id", "n_links", "class_size", "first")


def placed_rows(docs: DataFrame, threshold: float, gram: int, recall: float, id_col: str, text_col: str, limit: int, block: int) -> DataFrame:
    """What `jaccard_join` returns, with text_key: a hash of each row's text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = stored(signatures(rows.select("doc_id", "text_key", "text"), runs_for(recall), threshold, gram).withColumn("row", F.monotonically_increasing_id()))
    numbered = stored(signed.rows.select("doc_id", "node", "text_key", "row")).rows
    nodes = cut(numbered.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.min("text_key").alias("text_key"), F.min("row").alias("row")))
    # one signature for each node, from its first row
    lead = stored(signed.rows.join(nodes.select("row"), "row", "left_semi").select("node", "sketch", "signs", "runs", "first", "second", "third"))
    signed.drop()
    links = candidates(lead.rows, threshold, limit, block)
    parts = cut(connected(links).select("node", F.col("root").alias("part")))
    lead.drop()
    sizes = parts.groupBy("part").agg(F.count(F.lit(1)).alias("members"))
    members = cut(parts.join(sizes, "part").join(nodes.select("node", "copies", "text_key"), "node"))
    # the text of a node: one row of each text whose key is that of the node
    texts = rows.select("text_key", "text").join(members.select("text_key").distinct(), "text_key", "left_semi").groupBy("text_key", "text").agg(F.count(F.lit(1)).alias("n")).drop("n")
    full = in_blocks(members, "members", block).join(texts, "text_key")
    checked = cut(exact_links(full, threshold, gram))
    counted = checked.groupBy("node").agg(F.sum("links").alias("links"))
    # components of several blocks are put together from their spanning links; for the others the root is final
    several = members.where(F.col("members") > block).select("node")
    one = checked.join(several, "node", "left_anti").select("node", "root")
    if several.isEmpty():
        roots = one
    else:
        many = checked.join(several, "node", "left_semi")
        roots = one.unionByName(connected(many.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    with_root = nodes.join(counted, "node", "left").join(roots, "node", "left").select("node", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    classes = with_root.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("copies").alias("class_size"))
    by_node = with_root.join(classes, "root").select("node", "root", "class_id", "class_size", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    placed = numbered.join(by_node, "node")
    # the row that stands for a class: of the rows with its id, the first
    standing = placed.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("row").alias("first_row"))
    return placed.join(standing, "root").select("doc_id", "class_id", "n_links", F.col("class_size").cast("long").alias("class_size"), (F.col("row") == F.col("first_row")).alias("first"), "text_key")


def one_of_each(docs: DataFrame, *, threshold: float = THRESHOLD, gram: int = GRAM, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """The documents that stand for their class, with all their columns; of rows that repeat id and text one stays.

    Rows are known by id and text, so that of rows with one id but different texts each has its own fate.
    """
    chosen = placed_rows(docs, threshold, gram, recall, id_col, text_col, limit, block).where("first").select(F.col("doc_id").alias("_chosen"), F.col("text_key").alias("_chosen_text")).distinct()
    same = docs[id_col].eqNullSafe(chosen["_chosen"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == chosen["_chosen_text"])
    kept = docs.join(chosen, same, "left_semi")
    repeated = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return kept if repeated.isEmpty() else kept.dropDuplicates([id_col, text_col])
