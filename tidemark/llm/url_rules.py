"""Allow and block rules for URLs, looked up in a sorted digest array (operator 12).

A rule is a host with a path, written `host/path`. It fits a URL whose host is the rule's or lies below it and whose path
starts with the rule's; of several that fit, the one with the longest writing decides, and of equally long ones the one with the longer host.

The rules are hashed and sorted by Spark and written, partition by partition, as one file for each `FILE_BYTES` of them: the
64-bit xxhash keys in order, then the verdicts and the places of the strings, then the strings. Every executor gets the files
once and maps them into memory, so that its workers share the pages they touch. A worker writes the possible rules of a
batch of URLs (ends of the host with starts of the path, of the shapes that occur among the rules), finds their keys by one vectorised binary search and
compares the stored string before it believes a hit. Pages are never shuffled; a list that needs several files is
probed in as many passes.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import rows_of, shared_folder, stored

#: Bytes of one file of rules; longer lists are dealt over several files.
FILE_BYTES = 256 << 20
#: Spark's xxhash64 starts from this seed.
SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")
OUT = "page_id long, host string, path string, rule string, verdict string"

Digest = Callable[[bytes], int]


def digest_of(rule: bytes) -> int:
    """The key of a rule: its 64-bit xxhash as a signed number, as Spark's xxhash64 gives it."""
    h = xxhash.xxh64_intdigest(rule, SEED)
    return h - (1 << 64) if h >> 63 else h


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A to Z in lower case; empty without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class RuleFile:
    """One file of rules: int64 head (rules, shapes, host labels and path bytes of each shape), keys, starts, verdicts, strings."""

    def __init__(self, path: str, digest: Digest = digest_of):
        self.digest = digest
        count, shapes = (int(x) for x in np.memmap(path, np.int64, "r", 0, (2,)))
        head = np.memmap(path, np.int64, "r", 16, (2 * shapes,)) if shapes else np.zeros(0, np.int64)
        self.shapes = [(int(a), int(b)) for a, b in head.reshape(-1, 2)]
        at = 16 + 16 * shapes
        self.keys = np.memmap(path, np.int64, "r", at, (count,)) if count else np.zeros(0, np.int64)
        self.starts = np.memmap(path, np.int64, "r", at + 8 * count, (count + 1,))
        at += 16 * count + 8
        self.block = np.memmap(path, np.uint8, "r", at, (count,)) if count else np.zeros(0, np.uint8)
        self.strings = np.memmap(path, np.uint8, "r", at + count) if self.starts[-1] else np.zeros(0, np.uint8)

    def string(self, i: int) -> bytes:
        return self.strings[self.starts[i] : self.starts[i + 1]].tobytes()

    def candidates(self, host: bytes, path: bytes) -> Iterator[tuple[bytes, int]]:
        """Writings of the rules that could fit, with the length of their hosts."""
        ends = [len(host)]
        while ends[-1] >= 0 and len(ends) <= self.shapes[-1][0]:
            ends.append(host.rfind(b".", 0, ends[-1]))  # ends[k] is before the last k labels
        for labels, size in self.shapes:
            if labels < len(ends) and size <= len(path):
                end = host[ends[labels] + 1 :]
                yield end + path[:size], len(end)

    def best(self, hosts: Sequence[bytes], paths: Sequence[bytes]) -> list[tuple[bytes, int, bool] | None]:
        """For each URL the rule that decides, the length of its host, and whether it blocks; None if none fits."""
        out: list[tuple[bytes, int, bool] | None] = [None] * len(hosts)
        if not self.shapes:
            return out
        found = [(i, rule, size) for i, (host, path) in enumerate(zip(hosts, paths, strict=True)) if host for rule, size in self.candidates(host, path)]
        if not found:
            return out
        keys = np.fromiter((self.digest(rule) for _, rule, _ in found), np.int64, len(found))
        at, end = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for j in np.flatnonzero(at < end):
            i, rule, size = found[j]
            have = out[i]
            if have is not None and (len(rule), size) <= (len(have[0]), have[1]):
                continue
            for k in range(at[j], end[j]):  # rules whose keys are equal
                if self.string(k) == rule:
                    out[i] = (rule, size, bool(self.block[k]))
                    break
        return out


def _written(spark: SparkSession, name: str, parts: Sequence[Iterator[bytes]]) -> str:
    """Write pieces one after another to a file in the shared folder, through the file system that Spark uses."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        for part in parts:
            for piece in part:
                out.write(bytearray(piece))
    finally:
        out.close()
    return path.toString()


def _packed(values: Iterator, kind: type | None) -> Iterator[bytes]:
    """Values as bytes of `kind` (or as they are), some thousands at a time."""
    while some := list(islice(values, 1 << 16)):
        yield b"".join(some) if kind is None else np.array(some, kind).tobytes()


class RuleSet:
    """The files of a list of rules; `names` are looked up by the workers of every executor."""

    def __init__(self, names: list[str]):
        self.names = names


def checked(rules: DataFrame) -> DataFrame:
    """rule, labels, size, block: one row for each writing. A host must not be empty, a path is empty or begins with a slash.

    A rule that is both allowed and blocked blocks. Rows whose host is null or empty, whose path has another beginning or
    whose verdict is neither allow nor block are an error.
    """
    rows = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict"))
    bad = F.col("host").isNull() | (F.col("host") == "") | F.col("host").rlike("[/?#]") | ((F.col("path") != "") & ~F.col("path").startswith("/")) | F.col("path").rlike("[?#]") | F.col("verdict").isNull() | ~F.col("verdict").isin(*VERDICTS)
    if example := rows.filter(bad).take(1):
        raise ValueError(f"not a rule: {example[0]}")
    return (
        rows.groupBy("host", "path").agg(F.max((F.col("verdict") == "block").cast("int")).alias("block"))
        .select(F.concat("host", "path").alias("rule"), F.size(F.split("host", r"\.")).alias("labels"), F.octet_length("path").alias("size"), "block")
    )


def rule_files(rules: DataFrame, *, file_bytes: int = FILE_BYTES, key: Column | None = None) -> RuleSet:
    """Sort the rules by their keys and hand the files to all executors.

    rules: host, path, verdict. The driver holds one batch of rules at a time and, for each shape (labels of the host,
    bytes of the path) among them, two numbers. `key` replaces the digest, for tests of collisions.
    """
    spark = rules.sparkSession
    table = stored(checked(rules).withColumn("key", F.xxhash64("rule") if key is None else key))
    rows = table.rows
    size = rows.agg(F.coalesce(F.sum(F.octet_length("rule") + 17), F.lit(0)).alias("b")).first()["b"]
    files = max(1, -(-size // file_bytes))
    names = []
    for i in range(files):
        mine = rows.filter(F.pmod(F.xxhash64("rule"), F.lit(files)) == i) if files > 1 else rows
        # written once in order, so that every column of the file has its rows in the same order
        ordered = stored(mine.orderBy("key", "rule").withColumn("at", F.monotonically_increasing_id()))
        sorted_ = ordered.rows.orderBy("at")
        shapes = sorted((r["labels"], r["size"]) for r in mine.select("labels", "size").distinct().collect())
        count = mine.count()
        name = f"url-rules-{uuid.uuid4().hex}-{i}"
        column = lambda c: (r[0] for r in sorted_.select(c).toLocalIterator())  # noqa: B023, E731
        parts = [
            iter([np.array([count, len(shapes), *[x for s in shapes for x in s]], np.int64).tobytes()]),
            _packed(column("key"), np.int64),
            _packed(accumulate(column(F.octet_length("rule")), initial=0), np.int64),
            _packed(column("block"), np.uint8),
            _packed(column(F.encode("rule", "UTF-8")), None),
        ]
        path = _written(spark, name, parts)
        spark.sparkContext.addFile(path)
        names.append(name)
        ordered.drop()
    table.drop()
    return RuleSet(names)


@functools.lru_cache(maxsize=8)
def opened(name: str) -> RuleFile:
    """A mapped file, once for each Python worker."""
    return RuleFile(SparkFiles.get(name))


def judge(pages: DataFrame, rules: RuleSet, *, otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url", digest: Digest = digest_of) -> DataFrame:
    """Each page's page_id, host, path, the rule that decides and the verdict; `otherwise` where no rule fits.

    Defined cases: a null URL or one without `://` has an empty host and path, to which no rule fits; a port or user name is
    part of the host as it is written; repeated rows are judged each; an empty table gives no rows, an empty
    list gives `otherwise`; other columns are ignored.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"), F.lit(0).alias("size"))
    for name in rules.names:
        rows = _probe(rows, name, digest)
    return rows.drop("size")


def _probe(rows: DataFrame, name: str, digest: Digest) -> DataFrame:
    """`rows` with the better of the rule they have and the one in the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = opened(name)
        table.digest = digest
        for batch in rows_of(batches, rows=8192):
            hosts, paths = ([x.encode() for x in batch.column(c).to_pylist()] for c in ("host", "path"))
            rule, verdict, size = (batch.column(c).to_pylist() for c in ("rule", "verdict", "size"))
            for i, got in enumerate(table.best(hosts, paths)):
                if got is not None and (rule[i] is None or (len(got[0]), got[1]) > (len(rule[i].encode()), size[i])):
                    rule[i], size[i], verdict[i] = got[0].decode(), got[1], VERDICTS[got[2]]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(size, pa.int32())], names=batch.schema.names)

    return rows.mapInArrow(run, OUT + ", size int")


#: The rules of the query (host, path, verdict).
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]

ORACLE = f"""
WITH r(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (SELECT page_id, row_number() OVER () AS row, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT row, arg_max(h || p, strlen(h || p)) AS rule, arg_max(v, strlen(h || p)) AS v
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m USING (row)"""
