import pytest

from emberlog.plans.filters import LogFilter
from emberlog.plans.logsql import parse

NOW = 1_700_000_000_000_000


@pytest.mark.parametrize("text", ["*", "", "   "])
def test_everything(text):
    assert parse(text).where == LogFilter()


def test_levels_messages_and_fields():
    q = parse('level:error "disk full" service:api path:"/a b"')
    assert q.where.levels == ("error",) and q.where.messages == ("disk full",)
    assert q.where.metadata == {"service": "api", "path": "/a b"}


def test_quotes_inside_quotes():
    assert parse(r'"say \"hi\" now"').where.messages == ('say "hi" now',)


def test_last_value_of_a_field_wins_and_levels_add_up():
    q = parse("k:1 k:2 level:info level:error")
    assert q.where.metadata == {"k": "2"} and q.where.levels == ("info", "error")


@pytest.mark.parametrize(("text", "seconds"), [("30s", 30), ("15m", 900), ("6h", 21_600), ("7d", 604_800)])
def test_durations_count_back_from_now(text, seconds):
    assert parse(f"_time:{text}", NOW).where.since == (NOW - seconds * 1_000_000,)


@pytest.mark.parametrize("end", [")", "]"])
def test_ranges_are_inclusive(end):
    q = parse(f"_time:[2024-01-01T00:00:00Z, 2024-01-02T00:00:00Z{end}")
    assert q.where.since == (1_704_067_200_000_000,) and q.where.until == (1_704_153_600_000_000,)


def test_one_sided_times():
    assert parse("_time:>=2024-01-01T00:00:00Z").where.since == (1_704_067_200_000_000,)
    assert parse("_time:<2024-01-01T00:00:00Z").where.until == (1_704_067_200_000_000,)


def test_what_means_nothing_is_ignored_and_named():
    q = parse("level:error OR foo _time:soon | fields a | limit x")
    assert q.where.levels == ("error",) and not q.where.since and q.limit is None
    assert q.quirks == ("OR", "foo", "_time:soon", "fields a", "limit x")


def test_pipes():
    q = parse("* | sort by (_time) asc | limit 5 | offset 3 | limit 7")
    assert (q.ascending, q.limit, q.offset, q.count) == (True, 7, 3, False)
    assert not parse("* | sort by (_time)").ascending
    assert parse("* | stats count() as n").count


def test_limit_and_offset_in_one_pipe_keep_the_limit():
    q = parse("* | limit 50 offset 10")
    assert q.limit == 50 and q.offset is None


def test_pipes_inside_quotes_split_all_the_same():
    assert parse('"a | b"').where.messages == ("a",)


def test_unknown_level_finds_nothing():
    assert parse("level:bogus").where.nothing
