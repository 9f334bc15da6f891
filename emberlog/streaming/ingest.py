"""NDJSON landing files as a stream into a store."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog import telemetry
from emberlog.sources import ndjson

#: Metadata that keeps entries together; the message if an entry has none of it.
SHARD_KEYS = ("request_id", "trace_id", "service")


def shard_key() -> Column:
    return F.coalesce(*[F.try_element_at("metadata", F.lit(k)) for k in SHARD_KEYS], F.col("message"), F.lit(""))


def shard(n: int) -> Column:
    """Which of n shards an entry belongs to: 32 bits of its key's MD5, modulo n."""
    return (F.conv(F.substring(F.md5(shard_key().cast("binary")), 1, 8), 16, 10).cast("long") % n).cast("int")


def shard_of(entry: tuple, n: int) -> int:
    """shard of one entry (timestamp_us, level, message, metadata) in this process."""
    meta = entry[3] or {}
    key = next((meta[k] for k in SHARD_KEYS if meta.get(k) is not None), entry[2]) or ""
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % n


def lines(spark: SparkSession, landing: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(landing)


def into_store(store, landing: str, checkpoint: str, message_field: str = "_msg", time_field: str = "_time", seconds: float = 1.0, once: bool = False, on_batch=None) -> StreamingQuery:
    """Starts the stream.  Each micro-batch appends one segment; malformed lines are counted.

    The store skips a batch number it has, so a batch that is run again after a failure is stored once.  There is no watermark: late entries are kept.
    """

    def write(batch: DataFrame, number: int) -> None:
        began = time.perf_counter()
        parsed = ndjson.parse(batch, message_field, time_field).persist()
        try:
            good = parsed.where("not malformed").drop("malformed")
            n = store.append(good, batch=f"{checkpoint}#{number}")
            bad = parsed.where("malformed").count()
            if bad:
                store.note_malformed(bad)
            telemetry.event("flush.stop", {"duration": time.perf_counter() - began, "entry_count": n, "malformed": bad})
            if on_batch is not None:
                on_batch(good, n, bad)
        except Exception as failed:
            telemetry.event("flush.error", {"batch": number}, {"reason": repr(failed)})
            raise
        finally:
            parsed.unpersist()

    out = lines(store.spark, landing).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=f"{seconds} seconds")).start()
