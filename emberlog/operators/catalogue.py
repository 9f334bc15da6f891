"""Blocks and their catalogue: numbering, statistics, postings, and what maintenance picks.

A catalogue has a row per block (a file): it is a thousandth of the data or less.  Windows over the
whole catalogue run in one task; windows over entries never do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.terms import terms


def numbered(df: DataFrame, order: list[str], slice_: Column, name: str = "rn") -> DataFrame:
    """df with a gapless number from 0 in the given order.

    slice_ must not decrease in that order (the day of a time, for instance).  Rows are numbered within slices,
    in parallel, and each slice starts where those before it end.
    """
    d = df.withColumn("_slice", slice_)
    before = F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = d.groupBy("_slice").agg(F.count("*").alias("_n")).select("_slice", F.coalesce(before, F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(*order)) - 1
    return d.withColumn("_within", within).join(starts, "_slice").withColumn(name, F.col("_start") + F.col("_within")).drop("_slice", "_start", "_within")


def day_of(us: str) -> Column:
    return F.floor(F.col(us) / F.lit(86_400_000_000)).cast("long")


def blocks(entries: DataFrame, rows_per_block: int, *order: str) -> DataFrame:
    """entries with ``block``: chunks of fixed size in time order."""
    d = numbered(entries, list(order), day_of("timestamp_us"))
    return d.withColumn("block", ((F.col("rn") - F.col("rn") % rows_per_block) / rows_per_block).cast("long")).drop("rn")


def manifest(entries: DataFrame, by: str = "block", *more: Column) -> DataFrame:
    return entries.groupBy(by).agg(F.count("*").alias("entry_count"), F.min("timestamp_us").alias("ts_min"), F.max("timestamp_us").alias("ts_max"), *more)


def overlapping(catalogue: DataFrame, since: int | None, until: int | None) -> DataFrame:
    """Blocks that can hold an entry of the time range."""
    if since is not None:
        catalogue = catalogue.where(F.col("ts_max") >= since)
    return catalogue if until is None else catalogue.where(F.col("ts_min") <= until)


def postings(entries: DataFrame, by: str = "block") -> DataFrame:
    """block, term, entry_count.  Counted by (level, key, value) pairs within a block."""
    return entries.select(by, F.explode(terms(F.col("level"), F.col("metadata"))).alias("term")).groupBy(by, "term").agg(F.count("*").alias("entry_count"))


def holding(catalogue: DataFrame, index: DataFrame, wanted: Iterable[str], by: str = "block") -> DataFrame:
    """Blocks whose postings have all wanted terms."""
    wanted = sorted(set(wanted))
    if not wanted:
        return catalogue
    full = index.where(F.col("term").isin(wanted)).groupBy(by).agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(wanted))
    return catalogue.join(full.select(by), by, "left_semi")


def index_count(catalogue: DataFrame, index: DataFrame, term: str, since: int, until: int, by: str = "block") -> DataFrame:
    """Entries of a term in the blocks that lie wholly inside the range: the part of a count that needs no entry."""
    inside = catalogue.where((F.col("ts_min") >= since) & (F.col("ts_max") <= until))
    return index.where(F.col("term") == term).join(inside, by).agg(F.coalesce(F.sum(index["entry_count"]), F.lit(0)).alias("covered"))


def term_counts(catalogue: DataFrame, index: DataFrame, by: str = "block") -> DataFrame:
    each = index.groupBy(by).agg(F.count("*").alias("terms"))
    return catalogue.join(each, by, "left").withColumn("terms", F.coalesce("terms", F.lit(0)))


OLDEST_FIRST = ("ts_min", "block")


def over_budget(catalogue: DataFrame, amount: str, most: int, order: tuple[str, ...] = OLDEST_FIRST) -> DataFrame:
    """The oldest blocks that must go for the amounts left to sum to most at the most."""
    by = Window.orderBy(*order)
    left = F.sum(amount).over(Window.partitionBy()) - F.coalesce(F.sum(amount).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return catalogue.withColumn("_left", left).where(F.col("_left") > most).drop("_left")


def expired(catalogue: DataFrame, cutoff: int) -> DataFrame:
    """Blocks whose entries are all older; one that straddles the cutoff stays whole."""
    return catalogue.where(F.col("ts_max") < cutoff)


def within_budget(catalogue: DataFrame, most: int, amount: str = "entry_count", order: tuple[str, ...] = OLDEST_FIRST) -> DataFrame:
    """The first blocks, as long as the amounts before each are below most."""
    before = F.coalesce(F.sum(amount).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return catalogue.withColumn("_before", before).where(F.col("_before") < most).drop("_before")


def greedy(sizes: Iterable[tuple], target: int) -> Iterator[list]:
    """Consecutive batches of (name, size): a batch closes before it would pass target.

    The last batch counts only with two blocks or more; an earlier one may be a single large block.
    """
    batch, held = [], 0
    for name, size in sizes:
        if batch and held + size > target:
            yield batch
            batch, held = [], 0
        batch.append(name)
        held += size
    if len(batch) >= 2:
        yield batch


def merge_groups(catalogue: DataFrame, target: int, order: tuple[str, ...] = OLDEST_FIRST, by: str = "block") -> DataFrame:
    """block, batch: greedy batches in order.  The catalogue streams through one task that holds one batch."""
    kind = dict(catalogue.dtypes)[by]

    def over(parts):
        import pandas as pd

        rows = ((b, n) for part in parts for b, n in zip(part[by], part["entry_count"], strict=True))
        for i, batch in enumerate(greedy(rows, target)):
            yield pd.DataFrame({by: batch, "batch": i})

    return catalogue.orderBy(*order).select(by, "entry_count").coalesce(1).mapInPandas(over, f"{by} {kind}, batch long")


def by_format(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("format").agg(F.count("*").alias("blocks"), F.sum("entry_count").alias("entries"), F.sum("byte_size").alias("bytes"), F.min("ts_min").alias("oldest"), F.max("ts_max").alias("newest"))


def out_of_order(entries: DataFrame, order: str, width: int = 1_000_000) -> DataFrame:
    """One row: how many entries are earlier than the one before them in the order of a whole-number column.

    Compared within slices of the column; the ends of neighbouring slices are compared in a small table.
    """
    d = entries.select(F.floor(F.col(order) / width).alias("_s"), F.col(order).alias("_o"), "timestamp_us")
    back = F.lag("timestamp_us").over(Window.partitionBy("_s").orderBy("_o", "timestamp_us")) > F.col("timestamp_us")
    inner = d.withColumn("_back", back.cast("long")).groupBy("_s").agg(F.sum("_back").alias("n"), F.min(F.struct("_o", "timestamp_us")).alias("a"), F.max(F.struct("_o", "timestamp_us")).alias("b"))
    edge = (F.lag("b.timestamp_us").over(Window.orderBy("_s")) > F.col("a.timestamp_us")).cast("long")
    return inner.withColumn("_edge", edge).agg((F.coalesce(F.sum("n"), F.lit(0)) + F.coalesce(F.sum("_edge"), F.lit(0))).alias("violations"))


def latest(log: DataFrame, key: str, sequence: str) -> DataFrame:
    """Snapshot and log as one: the last row of each key, without those that were deleted."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), sequence).alias("x")).select("x.*")
    return last.where("op <> 'delete'")
