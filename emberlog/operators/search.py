"""Queries over a table of entries: pages, counts, summaries.  All are lazy DataFrames but for the totals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog import telemetry
from emberlog.plans.filters import LogFilter, extract
from emberlog.plans.logsql import LogQuery
from emberlog.sources.model import canonical_metadata

LIMIT, OFFSET = 100, 0


@dataclass(frozen=True)
class Page:
    """One page of entries.  ``total`` is exact, or a lower bound if totals were not asked for."""

    entries: list
    total: int
    limit: int
    offset: int
    has_more: bool


def ordered(df: DataFrame, ascending: bool = False, *tie: str) -> DataFrame:
    """By time; entries of one time by message, level and metadata, ascending in both directions, then by the tie columns."""
    at = F.col("timestamp_us").asc() if ascending else F.col("timestamp_us").desc()
    return df.orderBy(at, "message", "level", canonical_metadata(F.col("metadata")), *tie)


def checked(limit: int | None, offset: int | None) -> tuple[int, int]:
    limit, offset = LIMIT if limit is None else limit, OFFSET if offset is None else offset
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return limit, offset


def rows(df: DataFrame, where: LogFilter, ascending: bool = False, limit: int | None = None, offset: int | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """The entries of a page, in order.  Spark plans order, offset and limit as one top-k."""
    limit, offset = checked(limit, offset)
    return ordered(where.apply(df), ascending, *tie).offset(offset).limit(limit)


def page(df: DataFrame, where: LogFilter, ascending: bool = False, limit: int | None = None, offset: int | None = None, count_total: bool = True) -> Page:
    """Runs the query.  Without totals one entry more is fetched to see whether there are more, and nothing is counted."""
    limit, offset = checked(limit, offset)
    with telemetry.span("query.stop") as found:
        if count_total:
            got = rows(df, where, ascending, limit, offset).collect() if limit else []
            total = count(df, where)
            more = offset + len(got) < total
        else:
            got = rows(df, where, ascending, limit + 1, offset).collect()
            more, got = len(got) > limit, got[:limit]
            total = offset + len(got) + more
        found["total"] = total
    return Page(got, total, limit, offset, more)


def count(df: DataFrame, where: LogFilter) -> int:
    return where.apply(df).count()


def totals(df: DataFrame, where: LogFilter) -> DataFrame:
    return where.apply(df).agg(F.count("*").alias("total"))


def run(df: DataFrame, query: LogQuery) -> DataFrame:
    """A parsed LogsQL query: entries, or one row ``total``."""
    if query.count:
        return totals(df, query.where)
    return rows(df, query.where, query.ascending, query.limit, query.offset)


def field_values(df: DataFrame, name: str, where: LogFilter) -> DataFrame:
    """value, hits of a field, most frequent first; entries without the field don't count."""
    found = where.apply(df).select(extract(df, name).alias("value")).where("value is not null")
    return found.groupBy("value").agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), "value")


def field_names(df: DataFrame, where: LogFilter) -> DataFrame:
    """value, hits: how many entries have each field.

    Rows are first counted by their set of keys, so that the exploded rows are sets and not entries.
    """
    keys = F.array_sort(F.coalesce(F.map_keys("metadata"), F.array().cast("array<string>")))
    sets = where.apply(df).groupBy(keys.alias("k")).agg(F.count("*").alias("n"))
    fixed = F.array(F.lit("_msg"), F.lit("_time"), F.lit("level"))
    return sets.select(F.explode(F.concat(fixed, "k")).alias("value"), "n").groupBy("value").agg(F.sum("n").alias("hits")).orderBy(F.desc("hits"), "value")


def stream(df: DataFrame, where: LogFilter) -> Iterator:
    """All matching entries, oldest first, a partition at a time."""
    return where.apply(df).orderBy("timestamp_us").toLocalIterator()


def buckets(df: DataFrame, where: LogFilter, width_us: int = 3_600_000_000) -> DataFrame:
    """start, level, hits in windows of fixed width."""
    start = F.col("timestamp_us") - F.pmod(F.col("timestamp_us"), F.lit(width_us))
    return where.apply(df).groupBy(start.alias("start"), "level").agg(F.count("*").alias("hits"))


def nearest_rank(df: DataFrame, value: str, *percents: int) -> DataFrame:
    """One row: the value at rank ceil(p/100 * n) for each p."""
    return df.agg(*[F.expr(f"percentile_disc({p / 100}) within group (order by {value})").cast(df.schema[value].dataType).alias(f"p{p}") for p in percents])
