r"""Sharding by weighted rendezvous hashing.

Every shard draws a number for every record key; the record goes to the shard with
the best draw, ``ln(u) / weight`` with u in (0, 1] from a hash of key and shard id.
Only the key and the shards decide, so adding a shard moves rows into it and nowhere
else, and removing one moves only its rows.

Nulls and ties: a null key hashes as the text ``\\N``; rows with one key share a shard; draws that
tie go to the shard listed first.  A null text has zero bytes.  Empty tables give no rows.
Rows that repeat get slots of their own.  Other columns of the input are left out of
``shard_plan`` and kept by ``write_shards``, where a column named ``shard`` is replaced and names beginning with ``_el_`` are reserved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.llm.common import stage, text_of

#: Rows that one sorting task of the slot numbering gets, about.
SLOT_BLOCK_ROWS = 200_000


def draw(key: Column, shard_id: int) -> Column:
    """u in (0, 1] from 52 bits of md5(key:shard)."""
    digest = F.md5(F.concat(key, F.lit(f":{shard_id}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)


def rendezvous(key: Column, shards: Sequence[tuple[int, float]]) -> Column:
    """The id of the shard that wins key; shards are (id, weight > 0) pairs."""
    if not shards or any(w <= 0 for _, w in shards):
        raise ValueError("give at least one shard; weights are positive")
    key = F.coalesce(key.cast("string"), F.lit("\\N"))
    draws = [F.struct((F.log(draw(key, s)) / float(w)).alias("s"), F.lit(-i).alias("o"), F.lit(s).alias("id")) for i, (s, w) in enumerate(shards)]
    return F.array_max(F.array(*draws))["id"]


def winner_of_two(key: Column, best: Column, best_weight: float, shard_id: int, weight: float) -> Column:
    """best, or shard_id where its draw beats that of best: all that one more shard can change."""
    key = F.coalesce(key.cast("string"), F.lit("\\N"))
    digest = F.md5(F.concat(key, F.lit(":"), best.cast("string")).cast("binary"))
    held = F.log((F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1.0) / float(1 << 52)) / best_weight
    return F.when(F.log(draw(key, shard_id)) / weight > held, F.lit(shard_id)).otherwise(best)


def add_slots(df: DataFrame, shard: str, order: Sequence[str]) -> DataFrame:
    """df with ``slot``: 0, 1, ... within each shard, in blocks of the order columns' hash.

    A shard may hold any share of the rows, so no task numbers a whole shard: rows are
    numbered within (shard, block) and each block starts where those before it end.
    The number of blocks follows the row count; block sizes are small numbers.
    """
    rows = df.count()
    blocks = max(1, -(-rows // SLOT_BLOCK_ROWS))
    block = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(blocks)).cast("int")
    df = df.withColumn("_block", block)
    starts = df.groupBy(shard, "_block").count().withColumn(
        "_start", F.sum("count").over(Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    )
    starts = starts.select(shard, "_block", F.coalesce("_start", F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(shard, "_block").orderBy(*order)) - 1
    return df.withColumn("_within", within).join(starts, [shard, "_block"]).withColumn("slot", (F.col("_start") + F.col("_within")).cast("long")).drop("_block", "_start", "_within")


def shard_plan(docs: DataFrame, n_shards: int = 24, key: str = "doc_id", text: str = "text", weights: Sequence[float] | None = None) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length of the text plus 8; grown_shard is the shard with one
    more shard of weight 1 after the others.
    """
    shards = list(enumerate(weights or [1.0] * n_shards))
    body = text_of(text).cast("binary")
    plan = docs.select(F.col(key), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), rendezvous(F.col(key), shards).alias("shard"))
    equal = len({w for _, w in shards}) == 1
    grown = winner_of_two(F.col(key), F.col("shard"), shards[0][1], n_shards, 1.0) if equal else rendezvous(F.col(key), [*shards, (n_shards, 1.0)])
    plan = stage(plan.withColumn("grown_shard", grown), "shards")
    return add_slots(plan, "shard", [key, "text_crc32", "size"]).select(key, "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, key: str = "doc_id", weights: Sequence[float] | None = None, files_per_shard: int = 1) -> None:
    """The rows themselves, as Parquet folders ``shard=N``; files_per_shard splits large shards."""
    shards = list(enumerate(weights or [1.0] * n_shards))
    out = docs.withColumn("shard", rendezvous(F.col(key), shards)).withColumn("_el_part", F.pmod(F.xxhash64(F.col(key)), F.lit(files_per_shard)))
    out.repartition(n_shards * files_per_shard, "shard", "_el_part").drop("_el_part").write.partitionBy("shard").parquet(path)
