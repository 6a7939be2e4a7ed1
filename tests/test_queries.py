"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from hourspark import queries as registry

registry.load()
FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows, names):
    places = [names.index(n) for n in sorted(names)]
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(([clean(r[p]) for p in places] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["wall_to_utc", "dst_status", "utc_to_local_hour", "stream_hourly", "chrono_split_span", "zone_cross_check"])
def test_session_zone_does_not_matter(spark, duck, name):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Australia/Adelaide")
    try:
        test_query_equals_its_sql(spark, duck, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
