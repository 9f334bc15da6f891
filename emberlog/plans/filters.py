"""Filters as one Column, so that Catalyst pushes them into the scan."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.terms import COLUMN_KEYS
from emberlog.functions.times import to_micros

#: A search for the first key also looks at the others.
ALIASES = {"host": ("host.name", "host", "hostname", "node"), "service": ("service.name", "service", "application")}


def column_name(key: str) -> str:
    """Of the stored column that holds a metadata key."""
    return "m_" + key.replace(".", "_")


def field_value(df: DataFrame, key: str) -> Column:
    """A metadata value: the stored column if there is one, else a look-up in the map.

    A key that holds JSON null reads as the text null; a missing key is null.
    """
    if key in COLUMN_KEYS and column_name(key) in df.columns:
        return F.col(column_name(key))
    return F.when(F.map_contains_key("metadata", F.lit(key)), F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit("null")))


def extract(df: DataFrame, name: str) -> Column:
    """A field by the name that queries use."""
    return {"_msg": F.col("message"), "_time": F.col("timestamp_us").cast("string"), "level": F.col("level")}.get(name, field_value(df, name))


def as_text(value: object) -> str:
    """A wanted metadata value as it would be stored; None asks for a missing one."""
    if value is None:
        return ""
    return str(value).lower() if isinstance(value, bool) else str(value)


@dataclass(frozen=True)
class LogFilter:
    """All of these hold.  since and until are inclusive; None leaves a condition out."""

    levels: tuple[str, ...] = ()
    messages: tuple[str, ...] = ()
    since: tuple[int, ...] = ()
    until: tuple[int, ...] = ()
    metadata: dict[str, object] = field(default_factory=dict)
    nothing: bool = False

    @classmethod
    def of(cls, level: str | None = None, message: str | None = None, since: int | datetime | None = None, until: int | datetime | None = None, metadata: dict | None = None, **others) -> LogFilter:
        """From keywords; names that mean nothing here are ignored."""
        one = lambda x: () if x is None else (x,)
        return cls(one(level), one(message), tuple(map(to_micros, one(since))), tuple(map(to_micros, one(until))), {str(k): v for k, v in (metadata or {}).items()})

    def but(self, **changes) -> LogFilter:
        return replace(self, **changes)

    def column(self, df: DataFrame) -> Column:
        parts = [F.col("level") == x for x in self.levels]
        parts += [F.contains(F.lower("message"), F.lower(F.lit(x))) for x in self.messages]
        parts += [F.col("timestamp_us") >= x for x in self.since] + [F.col("timestamp_us") <= x for x in self.until]
        for key, value in self.metadata.items():
            same = [self._equals(df, k, as_text(value)) for k in ALIASES.get(key, (key,))]
            parts.append(reduce(Column.__or__, same))
        if self.nothing:
            parts.append(F.lit(False))
        return reduce(Column.__and__, parts) if parts else F.lit(True)

    @staticmethod
    def _equals(df: DataFrame, key: str, value: str) -> Column:
        """A missing key reads as empty; all other values are compared plainly, so that the scan can use stored columns."""
        found = field_value(df, key)
        return F.coalesce(found, F.lit("")) == "" if value == "" else found == value

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.column(df))
