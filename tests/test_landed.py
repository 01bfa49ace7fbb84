"""Chart payloads in files: what is read, what is pruned, what is refused; accents of every script."""

import json
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidemark.functions import vocabulary as vo
from tidemark.sources import landed_charts as lc

DAY = 86400


def chart(times, closes, zone="America/New_York", **meta):
    return json.dumps({"chart": {"result": [{"meta": {"exchangeTimezoneName": zone, **meta}, "timestamp": times, "indicators": {"quote": [{"close": closes}]}}], "error": None}})


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "AAA.json").write_text(chart([1_700_000_000, 1_700_000_000 + DAY], [1.5, None]))
    (tmp_path / "BBB.SA.json").write_text(chart([1_700_000_000], [2.5], "America/Sao_Paulo", currency="BRL"))
    (tmp_path / "AAA.BA.json").write_text(chart([1_700_000_000], [9.0], currency="ARS"))
    (tmp_path / "USDARS%3DX.json").write_text(chart([1_700_000_000], [350.0], currency="USD"))
    (tmp_path / "CCC.json").write_text('{"chart": {"result": null, "error": {"code": "Not Found"}}}')
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / "notes.txt").write_text("not a payload")
    late = tmp_path / "z" / "ticker=AAA"
    late.mkdir(parents=True)
    (late / "part-0").write_text(chart([1_700_000_000], [1.75]))
    return str(tmp_path)


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_files_are_payloads(spark, folder):
    found = lc.landed(spark, folder)
    assert sorted(r["ticker"] for r in found.collect()) == ["AAA", "AAA", "AAA.BA", "BBB.SA", "CCC", "USDARS=X"]
    assert found.columns == ["ticker", "path", "body"]


def test_partitions_follow_bytes(spark, folder):
    assert lc.landed(spark, folder, partitionBytes=1).rdd.getNumPartitions() == 6
    assert lc.landed(spark, folder).rdd.getNumPartitions() == 1


def test_other_tickers_are_not_opened(spark, folder):
    """The filter reaches the listing: no task has a file of another ticker."""
    for wanted, expected in ((F.col("ticker") == "BBB.SA", 1), (F.col("ticker").isin("AAA", "CCC"), 3), (F.col("ticker") == "none", 0)):
        found = lc.landed(spark, folder, partitionBytes=1).where(wanted)
        assert found.count() == expected
        assert found.rdd.getNumPartitions() == max(1, expected)


def test_only_known_filters_are_taken():
    reader = lc.LandedReader({"path": "x"})
    other = lc.EqualTo(("path",), "a")
    assert list(reader.pushFilters([other, lc.EqualTo(("ticker",), "A"), lc.In(("ticker",), ("A", "B"))])) == [other]
    assert reader.wanted == {"A"}


def test_underlying_series(spark, folder):
    """Suffix by venue, currency of the payload or USD, the later file wins a day, clear errors."""
    wanted = spark.createDataFrame([("AAA", "NYSE"), ("AAA", "NYSE"), ("BBB", "B3"), ("CCC", "NYSE"), ("DDD", "NYSE"), ("EEE", "UNKNOWN"), ("FFF", None)], "symbol string, underlying_market string")
    found = lc.underlying(spark, folder, wanted)
    assert rows(found.bars, "symbol", "close", "currency") == [("AAA", 1.75, "USD"), ("BBB", 2.5, "BRL")]
    assert rows(found.rejected, "symbol", "reason") == [("AAA", "no_trade_slot")]
    assert rows(found.errors, "symbol", "error") == [("CCC", "chart_error"), ("DDD", "not_landed"), ("EEE", "unroutable"), ("FFF", "unroutable")]
    assert lc.underlying(spark, folder, wanted, start="2024-01-01").bars.count() == 0


def test_local_series_and_rates(spark, folder):
    assert rows(lc.local(spark, folder, spark.createDataFrame([("AAA",)], "symbol string")).bars, "symbol", "close", "currency") == [("AAA", 9.0, "ARS")]
    found = lc.rates(spark, folder, spark.createDataFrame([("USDARS",), ("EURARS",)], "pair string"))
    assert rows(found.bars, "pair", "close", "currency") == [("USDARS", 350.0, "ARS")]
    assert rows(found.errors, "pair", "error") == [("EURARS", "not_landed")]
    assert "volume" not in found.bars.columns


def test_empty_folder_and_nothing_wanted(spark, folder, tmp_path):
    empty = tmp_path / "empty"
    empty.mkdir()
    assert lc.landed(spark, str(empty)).count() == 0
    none = spark.createDataFrame([], "symbol string, underlying_market string")
    found = lc.underlying(spark, folder, none)
    assert found.bars.count() == found.errors.count() == found.rejected.count() == 0


def stripped(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


TEXTS = ["", "plain", "Cotización Ñandú", "Tiếng Việt Đặng", "Άγιος Ὀδυσσεύς", "éö", "ﬁnal ½ ㎏ ﷺ", "한국어 각 가", "Й ё", "Ａ１", "́", "𝐀𝟙 🎈", "a\nﬀ\nb", "が パ"]


def test_accents_of_every_script(spark):
    found = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", vo.strip_accents(F.col("t")).alias("s")).collect()
    assert {r["t"]: r["s"] for r in found} == {t: stripped(t) for t in TEXTS}
    assert spark.createDataFrame([(None,)], "t string").select(vo.strip_accents(F.col("t"))).first()[0] is None


def test_accents_of_every_character(spark):
    codes = [c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000]
    found = spark.createDataFrame([("|".join(chr(c) for c in codes[i : i + 500]),) for i in range(0, len(codes), 500)], "t string").select("t", vo.strip_accents(F.col("t")).alias("s"))
    assert all(r["s"] == stripped(r["t"]) for r in found.collect())
