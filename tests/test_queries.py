"""Every query of the library against its SQL, on the driver's smallest tables."""

import os
from collections import Counter

import pytest

from emberlog import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(own.QUERIES) == set(own.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = own.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(own.ORACLE_SQL[name])
    assert columns == sorted(want.columns)
    got = Counter(tuple(r[c] for c in columns) for r in df.collect())
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(r[i] for i in at) for r in want.fetchall())


def test_page_cursor_sorts_no_more_than_a_range_in_one_task(spark, duck, monkeypatch, tmp_path):
    monkeypatch.setattr(own, "scratch", lambda spark, name: str(tmp_path / name))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = own.QUERIES["page_cursor"](spark, DATA).select("event_id", "ordinal").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["entry_count"] for r in own.LogStore(spark, str(tmp_path / "store-pages")).catalogue().collect()]
    assert len(sizes) > 1 and max(sizes) < sum(sizes)
    assert Counter(map(tuple, got)) == Counter(duck.sql(own.ORACLE_SQL["page_cursor"]).fetchall())
