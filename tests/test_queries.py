"""Every query of the engine against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tidemark.plans import everything

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = everything.queries(), everything.oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return None if v is None else str(v)


def table(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted(([plain(r[i]) for i in at] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    assert table(got, df.columns) == table(found.fetchall(), names)


def test_balances_of_minus_zero_have_no_sign(spark, tmp_path):
    """A rounded balance may be minus zero; only negative ones have a minus, as in the query's SQL."""
    values = [(1, -0.0, "$\u00a00,00", "0"), (2, 0.0, "$\u00a00,00", "0"), (3, -0.01, "-$\u00a00,01", "-0.0014"), (4, -0.001, "-$\u00a00,00", "-0.0001"), (5, None, "—", "—"), (6, -1234.5, "-$\u00a01.234,50", "-176.3571")]
    path = f"{tmp_path}/customer.parquet"
    spark.createDataFrame([v[:2] for v in values], "c_custkey long, c_acctbal double").write.parquet(path)
    got = [tuple(r) for r in QUERIES["f27_format_amounts"](spark, str(tmp_path)).orderBy("c_custkey").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}/*.parquet'")
    assert con.execute("SELECT count(*) FROM customer WHERE CAST(c_acctbal AS VARCHAR) = '-0.0'").fetchone()[0] == 1
    assert got == con.execute(ORACLES["f27_format_amounts"] + " ORDER BY c_custkey").fetchall() == [(k, amount, compact) for k, _, amount, compact in values]


#: Needs a longer history than the smallest tables have.
LONG = {"m4_boosted_trees", "m7_trained_models", "m8_served_probability"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """Queries that SQL cannot express; what they must give is in the golden tests and those of the models."""
    assert QUERIES[name](spark, SF.replace("0.001", "0.01") if name in LONG else SF).count() > 0
