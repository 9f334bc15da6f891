"""An order-insensitive digest: the sum of all entries' SHA-256 values, modulo 2**256.

An entry's bytes are its time (64 bits, signed, big-endian), then level, message and metadata, each after its
length in bytes (32 bits).  Sums are kept in eight 32-bit limbs, so that Spark adds them like any other column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.operators.catalogue import out_of_order
from emberlog.sources.model import canonical_metadata

LIMBS = 8


def sized(text: Column) -> Column:
    raw = text.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 8, "0")), raw)


def identity(metadata: Column | None = None) -> Column:
    """SHA-256 of an entry, in hex."""
    meta = canonical_metadata(F.col("metadata")) if metadata is None else metadata
    return F.sha2(F.concat(F.unhex(F.lpad(F.hex("timestamp_us"), 16, "0")), sized(F.col("level")), sized(F.col("message")), sized(meta)), 256)


def limbs(entries: DataFrame, metadata: Column | None = None) -> DataFrame:
    """One row: n and the sums limb_0 (high) to limb_7 of the 32-bit parts."""
    d = entries.select(identity(metadata).alias("h"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"limb_{i}") for i in range(LIMBS)]
    return d.agg(F.count("*").alias("n"), *parts)


def digest(entries: DataFrame, metadata: Column | None = None) -> tuple[int, str]:
    """(number of entries, 64 hex digits); 64 zeros for none."""
    row = limbs(entries, metadata).first()
    total = sum(int(row[f"limb_{i}"]) << 32 * (LIMBS - 1 - i) for i in range(LIMBS)) % (1 << 256)
    return row["n"], f"{total:064x}"


def quick(entries: DataFrame, metadata: Column | None = None) -> DataFrame:
    """One row: n and the xor of the first 60 bits; cheaper, and blind to entries that repeat an even number of times."""
    d = entries.select(identity(metadata).alias("h"))
    return d.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("long")), F.lit(0)).alias("digest"))


def verify(entries: DataFrame, expected_count: int, expected_digest: str) -> bool:
    return digest(entries) == (expected_count, expected_digest)


def validate(entries: DataFrame, expected_count: int, expected_digest: str, order: str | None = None) -> list[str]:
    """What is wrong with stored entries: nothing, or ``count``, ``digest``, ``order`` (times that fall along a whole-number column)."""
    n, found = digest(entries)
    wrong = [] if n == expected_count else ["count"]
    wrong += [] if found == expected_digest else ["digest"]
    if order is not None and out_of_order(entries, order).first()["violations"]:
        wrong.append("order")
    return wrong
