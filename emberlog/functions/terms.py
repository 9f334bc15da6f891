"""Index terms: which metadata values are worth a posting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metadata keys that get postings.
TERM_KEYS = ("application", "cache", "host", "key", "job", "method", "path", "reason", "service", "status", "table")
#: Metadata keys that are looked up most and get columns, beside TERM_KEYS.
LOOKUP_KEYS = ("service", "service.name", "application", "host", "host.name", "hostname", "node", "path", "status")
#: Limits of a term's length in bytes and of what looks like an identifier.
HOST_BYTES, VALUE_BYTES, IDENTIFIER_CHARS, NUMERIC_DIGITS = 255, 64, 12, 6
#: All keys that the stored table has as columns.
COLUMN_KEYS = tuple(sorted({*TERM_KEYS, *LOOKUP_KEYS}))


def identifier_like(value: Column) -> Column:
    """Separated or hexadecimal and long, or mostly digits."""
    n, digits = F.length(value), F.length(F.regexp_replace(value, "[^0-9]", ""))
    separated = (F.contains(value, F.lit("-")) | F.contains(value, F.lit("_"))) & (n >= IDENTIFIER_CHARS)
    hexadecimal = value.rlike(f"^[0-9a-fA-F]{{{IDENTIFIER_CHARS},}}$")
    numeric = digits >= F.greatest(F.floor(n * 3 / 4), F.lit(NUMERIC_DIGITS))
    return separated | hexadecimal | numeric


def is_term(key: Column, value: Column) -> Column:
    """Does key:value get a posting?"""
    short = F.when(key == "host", F.octet_length(value) <= HOST_BYTES).otherwise((F.octet_length(value) <= VALUE_BYTES) & ~identifier_like(value))
    return key.isin(*TERM_KEYS) & value.isNotNull() & short


def term_like(key: str, value: str) -> bool:
    """is_term of one value in this process."""
    size = len(value.encode())
    if key == "host":
        return size <= HOST_BYTES
    n, digits = len(value), len(re.findall("[0-9]", value))
    separated = ("-" in value or "_" in value) and n >= IDENTIFIER_CHARS
    return key in TERM_KEYS and size <= VALUE_BYTES and not (separated or re.fullmatch(f"[0-9a-fA-F]{{{IDENTIFIER_CHARS},}}", value) or digits >= max(n * 3 // 4, NUMERIC_DIGITS))


def terms(level: Column, metadata: Column) -> Column:
    """All terms of an entry."""
    pairs = F.filter(F.coalesce(F.map_entries(metadata), F.array().cast("array<struct<key:string,value:string>>")), lambda e: is_term(e["key"], e["value"]))
    return F.concat(F.array(F.concat(F.lit("level:"), level)), F.transform(pairs, lambda e: F.concat_ws(":", e["key"], e["value"])))
