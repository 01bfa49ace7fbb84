"""Audited writes and partitions that are replaced."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import sinks


def table(spark, shift=0):
    return spark.createDataFrame([(i, i % 3, float(i + shift)) for i in range(30)], "id int, part int, value double")


def states(spark, path):
    return {r["state"]: r for r in sinks.newest_states(spark.read.parquet(path)).collect()}


def test_a_write_counts_what_it_writes(spark, tmp_path):
    out, audit = str(tmp_path / "out"), str(tmp_path / "audit")
    run = sinks.observed_write(table(spark), lambda df: df.write.parquet(out), series="prices", audit_path=audit, counts={"even": F.col("id") % 2 == 0, "none": F.lit(False)}, warnings=["symbol X has no source"])
    rows = spark.read.parquet(audit).where(F.col("run_id") == run).orderBy("at").collect()
    assert [r["state"] for r in rows] == ["running", "succeeded"]
    assert rows[1]["counts"] == {"rows": 30, "even": 15, "none": 0} and rows[1]["warnings"] == ["symbol X has no source"]
    assert states(spark, audit)["succeeded"]["seconds"] >= 0
    assert spark.read.parquet(out).count() == 30


def test_a_failing_write_leaves_a_failed_row(spark, tmp_path):
    audit = str(tmp_path / "audit")
    broken = table(spark).withColumn("value", F.when(F.col("id") == 17, F.raise_error(F.lit("bad bar"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="bad bar"):
        sinks.observed_write(broken, lambda df: df.write.parquet(str(tmp_path / "out")), series="prices", audit_path=audit, counts={})
    found = states(spark, audit)
    assert set(found) == {"failed"} and found["failed"]["error"] and found["failed"]["counts"] == {}


def test_partitions_are_replaced_as_a_whole(spark, tmp_path):
    out = str(tmp_path / "out")
    sinks.replace_partitions(table(spark), out, ["part"])
    late = table(spark, 100).where("part = 1 and id < 10")
    for _ in range(2):  # a rerun leaves the same rows
        sinks.replace_partitions(late, out, ["part"])
        rows = spark.read.parquet(out).collect()
        assert len(rows) == 23
        assert sorted(r["value"] for r in rows if r["part"] == 1) == [101.0, 104.0, 107.0]
    broken = late.withColumn("value", F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        sinks.replace_partitions(broken, out, ["part"])
    assert spark.read.parquet(out).count() == 23  # a failed write changes nothing
