"""Chart payloads that landed as files, one a ticker, and the series composed from them.

`daily_charts` is a data source: `spark.read.format("daily_charts").load(folder)` has one row a file (ticker, path, body). The
driver lists names and sizes only; files are packed into partitions by bytes and read by tasks. A filter on `ticker` (equal, in)
is pushed to the listing, so files of other tickers are never opened. What a body means is decided by `chart_json`, in the plan.

A file is named `<ticker>.json`, or lies in a folder `ticker=<ticker>` as a partitioned write leaves it; both may be percent-encoded.
Several files of one ticker are several payloads; of bars of one day the payload with the greatest path wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.window import Window

from ..functions import vocabulary as vo
from . import chart_json

NAME = "daily_charts"
#: Bytes of files that one task reads; a larger file is a task of its own.
PARTITION_BYTES = 32 << 20
# The suffix of local tickers and of rates.
LOCAL_SUFFIX = ".BA"
CROSS_SUFFIX = "=X"
# End of fixed values.


def file_system(path: str):
    from pyarrow import fs

    for known, plain in (("s3a://", "s3://"), ("s3n://", "s3://")):
        path = plain + path[len(known) :] if path.startswith(known) else path
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


def ticker_of(path: str) -> str | None:
    """The ticker that a landed file's path names; None for files that are not payloads (marks of a finished write, hidden files)."""
    *folders, name = path.split("/")
    if name.startswith(("_", ".")):
        return None
    for folder in reversed(folders):
        if folder.startswith("ticker="):
            return unquote(folder.removeprefix("ticker="))
    return unquote(name.removesuffix(".json")) if name.endswith(".json") else None


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str]]  # ticker, path

    def __post_init__(self) -> None:
        super().__init__(None)


class LandedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is None or f.attribute != ("ticker",):
                yield f  # left to Spark
            else:
                self.wanted = names if self.wanted is None else self.wanted & names

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = [(ticker_of(f.path[len(root) :]), f.path, f.size) for f in found if f.is_file]
        files = sorted((f for f in files if f[0] is not None and (self.wanted is None or f[0] in self.wanted)), key=lambda f: f[1])
        parts: list[InputPartition] = []
        room = -1
        for ticker, path, size in files:
            if size > room:
                parts.append(Files([]))
                room = self.most
            parts[-1].files.append((ticker, path))
            room -= size
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = file_system(self.folder)
        for ticker, path in partition.files:
            with system.open_input_stream(path) as f:
                yield ticker, path, f.read()


class LandedCharts(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "ticker string, path string, body binary"

    def reader(self, schema) -> LandedReader:
        return LandedReader(dict(self.options))


def landed(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Payloads under `folder`; registers the source and turns filter pushdown of Python sources on for the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedCharts)
    return spark.read.format(NAME).options(**options).load(folder)


@dataclass
class Series:
    """What a folder of payloads holds of the wanted series: `bars`, `rejected` slots, and `errors` of series that give none."""

    bars: DataFrame
    rejected: DataFrame
    errors: DataFrame


def composed(spark: SparkSession, folder: str, wanted: DataFrame, name: str, ticker: Column, start, end, currency: str | None, source: str) -> Series:
    """Series named by column `name` of `wanted`, each in the files of its `ticker`, with days in [start, end] (null: open).

    Errors: unroutable (no ticker), not_landed (no file), and those of `chart_json.parse`. Asked for twice, a series is read once.
    The tickers asked for are not collected: a semi-join keeps their payloads. Use `landed` with a filter on `ticker` to prune files.
    """
    asked = wanted.select(F.col(name).alias("symbol"), ticker.alias("ticker")).distinct()
    files = landed(spark, folder).withColumn("body", chart_json.decode(F.col("body")))
    found = asked.where("ticker IS NOT NULL").join(files, "ticker", "left")
    parsed = chart_json.parse(found.where("path IS NOT NULL"))
    inside = F.lit(True)
    inside = inside & (F.col("market_date") >= F.lit(start).cast("date")) if start is not None else inside
    inside = inside & (F.col("market_date") <= F.lit(end).cast("date")) if end is not None else inside
    slots = chart_json.slots(parsed, source=source, currency=currency, keep=("path",)).where(inside | F.col("market_date").isNull())
    newest = Window.partitionBy("symbol", "market_date").orderBy(F.desc("path"), F.desc("timestamp"))
    bars = slots.where("reason IS NULL").withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n", "path", "reason")
    errors = asked.where("ticker IS NULL").select("symbol", F.lit("unroutable").alias("error"))
    errors = errors.unionByName(found.where("path IS NULL").select("symbol", F.lit("not_landed").alias("error"))).unionByName(parsed.where("error IS NOT NULL").select("symbol", "error"))
    return Series(bars, slots.where("reason IS NOT NULL").select("symbol", "timestamp", "reason"), errors)


def underlying(spark: SparkSession, folder: str, wanted: DataFrame, *, symbol: str = "symbol", market: str = "underlying_market", start=None, end=None, source: str = "chart") -> Series:
    """Foreign underlyings in the currency and days of their own venue; a venue without a known suffix is unroutable."""
    return composed(spark, folder, wanted, symbol, vo.vendor_symbol(F.col(symbol), F.col(market)), start, end, None, source)


def local(spark: SparkSession, folder: str, wanted: DataFrame, *, symbol: str = "symbol", start=None, end=None, source: str = "chart") -> Series:
    """Local series: the symbol with the suffix of the local market."""
    return composed(spark, folder, wanted, symbol, F.concat(F.col(symbol), F.lit(LOCAL_SUFFIX)), start, end, None, source)


def rates(spark: SparkSession, folder: str, wanted: DataFrame, *, pair: str = "pair", start=None, end=None, source: str = "chart") -> Series:
    """Rates in ARS for one unit of the other currency, whatever the payload declares; they have no volume."""
    found = composed(spark, folder, wanted, pair, F.concat(F.col(pair), F.lit(CROSS_SUFFIX)), start, end, "ARS", source)
    named = [df.withColumnRenamed("symbol", "pair") for df in (found.bars.drop("volume", "adjusted_close"), found.rejected, found.errors)]
    return Series(*named)
