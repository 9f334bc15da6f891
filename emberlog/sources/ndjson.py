"""NDJSON lines as entries, in batch or as a stream, and entries as NDJSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.levels import ingest_level
from emberlog.functions.times import ingest_time, iso_text


def parse(lines: DataFrame, message_field: str = "_msg", time_field: str = "_time", now: Column | None = None, column: str = "value") -> DataFrame:
    """timestamp_us, level, message, metadata and ``malformed`` of non-empty lines.

    A line that isn't a JSON object is malformed.  Fields other than message, time and level are metadata:
    numbers as they are written, nested values as JSON text.
    """
    now = F.unix_micros(F.current_timestamp()) if now is None else now
    object_like = F.trim(F.col(column)).startswith("{")
    m = lines.where(F.length(F.trim(F.col(column))) > 0).select(F.when(object_like, F.from_json(column, "map<string,string>")).alias("m"))
    got = lambda k: F.try_element_at("m", F.lit(k))
    rest = F.map_filter("m", lambda k, v: ~k.isin(message_field, time_field, "level"))
    return m.select(
        ingest_time(got(time_field), now).alias("timestamp_us"),
        ingest_level(F.coalesce(got("level"), F.lit("info"))).alias("level"),
        F.coalesce(got(message_field), F.lit("")).alias("message"),
        F.coalesce(rest, F.create_map().cast("map<string,string>")).alias("metadata"),
        F.col("m").isNull().alias("malformed"),
    )


def render(entries: DataFrame) -> DataFrame:
    """One JSON object a row: _time, _msg, level, and metadata, which wins where names clash."""
    fixed = {"_time": iso_text(F.col("timestamp_us")), "_msg": F.col("message"), "level": F.col("level")}
    own = F.map_filter(F.create_map(*[x for k, v in fixed.items() for x in (F.lit(k), v)]), lambda k, v: ~F.map_contains_key(F.coalesce("metadata", F.create_map().cast("map<string,string>")), k))
    meta = F.transform_values(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: F.coalesce(v, F.lit("null")))
    return entries.select(F.to_json(F.map_concat(own, meta)).alias("value"))
