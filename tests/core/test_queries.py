"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from scorewright import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


def rows(df: pd.DataFrame):
    def text(x):
        if isinstance(x, str):
            return x
        if pd.isna(x):
            return "NULL"
        return f"{x:.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(map(text, r)) for r in df.values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_others_have_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_shared_denominators(spark):
    out = registry.queries()["leaderboard_per_metric"](spark, SF).groupBy("preset", "normalize", "metric").agg({"den": "min", "dec": "count"}).collect()
    assert out and all(r["count(dec)"] == 4 for r in out)
    dens = registry.queries()["leaderboard_per_metric"](spark, SF).select("preset", "normalize", "metric", "den").distinct().groupBy("preset", "normalize", "metric").count()
    assert dens.where("count > 1").count() == 0


def test_ged_exact_odd_keys_and_prices(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE orders AS SELECT k AS o_orderkey, 1 AS o_custkey, p AS o_totalprice FROM (VALUES (-7::BIGINT), (-4), (NULL), (0), (5), (8), (58)) a(k), (VALUES (-3500.0::DOUBLE), (-0.5), (NULL), (0), (1500), (4200), (9000)) b(p)")
    con.execute("CREATE TABLE lineitem AS FROM '%s/lineitem.parquet' LIMIT 5" % "/root/testdata/sf0.001")
    for t in ("orders", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got = [tuple(r) for r in registry.queries()["ged_exact"](spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, con.execute(registry.oracle_sql()["ged_exact"]).fetchall()))
