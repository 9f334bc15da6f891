import pytest

from emberlog.functions.times import ingest_time, iso_micros, micros, query_time, to_micros
from emberlog.operators import search
from emberlog.plans.filters import LogFilter
from emberlog.sources.model import canonical_metadata, from_records
from pyspark.sql import functions as F

BASE = 1_700_000_000_000_000


@pytest.fixture(scope="module")
def ten(spark):
    """Ten entries: even ones are errors, multiples of five time out, multiples of three are of the api."""
    rows = [
        {"timestamp": BASE + i * 1000, "level": "error" if i % 2 == 0 else "info", "message": "Request TIMEOUT" if i % 5 == 0 else f"request {i}", "metadata": {"i": i} | ({"service": "api"} if i % 3 == 0 else {})}
        for i in range(1, 11)
    ]
    return from_records(spark, rows).persist()


def found(df, **filters):
    return sorted(int(r["metadata"]["i"]) for r in LogFilter.of(**filters).apply(df).collect())


@pytest.mark.parametrize(
    ("filters", "expected"),
    [
        ({}, list(range(1, 11))),
        ({"level": "error"}, [2, 4, 6, 8, 10]),
        ({"message": "timeout"}, [5, 10]),
        ({"message": "%"}, []),
        ({"message": ""}, list(range(1, 11))),
        ({"since": BASE + 8000}, [8, 9, 10]),
        ({"until": BASE + 2000}, [1, 2]),
        ({"since": BASE + 3000, "until": BASE + 3000}, [3]),
        ({"metadata": {"i": 7}}, [7]),
        ({"metadata": {"service": "api"}}, [3, 6, 9]),
        ({"metadata": {"service": ""}}, [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]),  # the other names of a service are missing
        ({"metadata": {"zone": ""}}, list(range(1, 11))),
        ({"metadata": {"zone": "x"}}, []),
        ({"level": "error", "message": "timeout", "metadata": {"i": "10"}}, [10]),
        ({"colour": "red"}, list(range(1, 11))),
    ],
)
def test_filters(ten, filters, expected):
    assert found(ten, **filters) == expected


def test_aliases(spark):
    rows = [{"timestamp": BASE, "metadata": m} for m in ({"host.name": "vpn"}, {"hostname": "vpn"}, {"node": "vpn"}, {"host": "other"}, {"application": "api"})]
    df = from_records(spark, rows)
    assert LogFilter.of(metadata={"host": "vpn"}).apply(df).count() == 3
    assert LogFilter.of(metadata={"service": "api"}).apply(df).count() == 1
    assert LogFilter.of(metadata={"node": "vpn"}).apply(df).count() == 1
    assert LogFilter.of(metadata={"host": "vpn", "service": "api"}).apply(df).count() == 0


def test_null_values_read_as_null(spark):
    df = from_records(spark, [{"timestamp": BASE, "metadata": {"a": None, "b": True, "c": 1.5}}])
    for k, v in (("a", "null"), ("b", True), ("b", "true"), ("c", 1.5)):
        assert LogFilter.of(metadata={k: v}).apply(df).count() == 1


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("offset", [0, 3, 9, 10, 50])
def test_pages_with_and_without_totals_hold_the_same(ten, ascending, offset):
    a = search.page(ten, LogFilter(), ascending, 4, offset)
    b = search.page(ten, LogFilter(), ascending, 4, offset, count_total=False)
    order = sorted(range(1, 11), reverse=not ascending)[offset : offset + 4]
    assert [int(r["metadata"]["i"]) for r in a.entries] == order == [int(r["metadata"]["i"]) for r in b.entries]
    assert a.total == 10 and a.has_more == b.has_more == (offset + 4 < 10)
    assert b.total == offset + len(order) + b.has_more


def test_limit_zero_and_negative(ten):
    assert search.page(ten, LogFilter(), limit=0).entries == []
    with pytest.raises(ValueError):
        search.page(ten, LogFilter(), limit=-1)


def test_ties_are_by_message_then_level_then_metadata(spark):
    rows = [{"timestamp": BASE, "message": f"same-{i:02}"} for i in (3, 1, 2)] + [{"timestamp": BASE, "message": "same-01", "level": "debug"}, {"timestamp": BASE, "message": "same-01", "metadata": {"a": "1"}}]
    df = from_records(spark, rows)
    for ascending in (True, False):
        got = [(r["message"], r["level"], r["metadata"]) for r in search.page(df, LogFilter(), ascending).entries]
        assert got == [("same-01", "debug", {}), ("same-01", "info", {"a": "1"}), ("same-01", "info", {}), ("same-02", "info", {}), ("same-03", "info", {})]


def test_field_summaries(ten):
    values = [(r["value"], r["hits"]) for r in search.field_values(ten, "level", LogFilter()).collect()]
    assert values == [("error", 5), ("info", 5)]
    assert [(r["value"], r["hits"]) for r in search.field_values(ten, "service", LogFilter()).collect()] == [("api", 3)]
    assert search.field_values(ten, "none", LogFilter()).collect() == []
    names = {r["value"]: r["hits"] for r in search.field_names(ten, LogFilter.of(level="error")).collect()}
    assert names == {"_msg": 5, "_time": 5, "level": 5, "i": 5, "service": 1}


def test_empty_table(spark):
    df = from_records(spark, [])
    assert search.page(df, LogFilter()).total == 0
    assert search.field_names(df, LogFilter()).collect() == []
    assert search.totals(df, LogFilter()).first()["total"] == 0


def test_unicode_and_long_messages(spark):
    rows = [{"timestamp": BASE, "message": m, "metadata": {"k": "Ünïcödé"}} for m in ("Привет 世界", "", "x" * 100_000)]
    df = from_records(spark, rows)
    assert LogFilter.of(message="привет").apply(df).count() == 1
    assert LogFilter.of(metadata={"k": "Ünïcödé"}).apply(df).count() == 3
    assert df.selectExpr("max(length(message))").first()[0] == 100_000


def test_units():
    assert [to_micros(x) for x in (1_700_000_000, 1_700_000_000_000, BASE, 1_700_000_000_000_000_000)] == [BASE] * 4
    assert to_micros(12_345) == 12_345_000_000
    assert iso_micros("2024-01-15T10:30:00Z") == iso_micros("2024-01-15T12:30:00+02:00") == iso_micros("2024-01-15T10:30:00") == 1_705_314_600_000_000
    assert iso_micros("2024") is None and query_time("2024") == 2_024_000_000 and query_time("soon") is None


def test_unit_columns(spark):
    df = spark.createDataFrame([(1_700_000_000,), (1_700_000_000_000,), (BASE,), (BASE * 1000 + 999,), (-1_500,)], "v long")
    assert [r[0] for r in df.select(micros(F.col("v"))).collect()] == [BASE] * 4 + [-1_500_000_000]
    texts = spark.createDataFrame([("2024-01-15T10:30:00Z",), ("2024-01-15T10:30:00.5+0100",), ("1700000000",), ("2024",), ("2024-01-15",), ("junk",), (None,)], "t string")
    got = [r[0] for r in texts.select(ingest_time(F.col("t"), F.lit(7))).collect()]
    assert got == [1_705_314_600_000_000, 1_705_311_000_500_000, BASE, 2_024_000_000, 7, 7, 7]


def test_canonical_metadata_ignores_order(spark):
    df = spark.createDataFrame([({"b": "1", "a": "2"},), ({"a": "2", "b": "1"},)], "metadata map<string,string>")
    assert df.select(canonical_metadata(F.col("metadata"))).distinct().count() == 1


def test_scalar_filters_reach_the_scan(spark, tmp_path):
    from_records(spark, [{"timestamp": BASE}]).write.parquet(str(tmp_path / "t"))
    df = LogFilter.of(level="error", since=BASE).apply(spark.read.parquet(str(tmp_path / "t")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(level,error)" in plan and "GreaterThanOrEqual(timestamp_us," in plan


def test_top_k_plan(ten):
    plan = search.rows(ten, LogFilter(), limit=5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
