"""The one table of the library, and views of other tables as log entries."""

from __future__ import annotations

import time
from collections.abc import Iterable
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.times import to_micros

#: timestamp in microseconds, severity, message, metadata of strings.
ENTRY = T.StructType(
    [
        T.StructField("timestamp_us", T.LongType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def _text(value: object) -> str | None:
    if value is None:
        return None
    return str(value).lower() if isinstance(value, bool) else str(value)


def from_records(spark: SparkSession, records: Iterable[dict], now: int | None = None) -> DataFrame:
    """Entries from dicts with level, message, and perhaps timestamp (any unit, or a datetime) and metadata."""
    now = now if now is not None else time.time_ns() // 1000
    rows = []
    for r in records:
        at = r.get("timestamp")
        meta = {str(k): _text(v) for k, v in (r.get("metadata") or {}).items()}
        rows.append((now if at is None else to_micros(at if isinstance(at, datetime) else int(at)), str(r.get("level", "info")), str(r.get("message", "")), meta))
    return local_entries(spark, rows)


_ARROW = pa.schema([("timestamp_us", pa.int64()), ("level", pa.string()), ("message", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))])


def local_entries(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Entries of this process as a DataFrame, by way of Arrow."""
    columns = zip(*[(a, b, c, list((m or {}).items())) for a, b, c, m in rows], strict=True) if rows else [[], [], [], []]
    return spark.createDataFrame(pa.table([pa.array(list(x), f.type) for x, f in zip(columns, _ARROW, strict=True)], _ARROW), ENTRY)


def canonical_metadata(metadata: Column) -> Column:
    """JSON with the keys in order: maps can't be compared, this can."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(metadata)))), F.lit("{}"))


def events_view(events: DataFrame) -> DataFrame:
    """The events table as log entries; event_id stays for total orders."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "error").when(kind == "signup", "warning").when(kind == "view", "debug").otherwise("info")
    own = F.create_map(F.lit("service"), kind, F.lit("host"), F.concat(F.lit("web-"), (F.col("user_id") % 5).cast("string")), F.lit("request_id"), F.col("event_id").cast("string"))
    props = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("timestamp_us"), level.alias("level"), F.concat(kind, F.lit(" by user "), F.col("user_id").cast("string")).alias("message"), F.map_concat(props, own).alias("metadata"))


def documents_view(documents: DataFrame) -> DataFrame:
    meta = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    return documents.select("doc_id", F.col("doc_id").alias("timestamp_us"), F.lit("info").alias("level"), F.col("text").alias("message"), meta.alias("metadata"))


def conversations_view(conversations: DataFrame) -> DataFrame:
    meta = F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string"))
    return conversations.select("conv_id", "turn", F.col("conv_id").alias("timestamp_us"), F.lit("info").alias("level"), F.col("text").alias("message"), meta.alias("metadata"))
