"""Severities.  They are strings and never folded into each other once stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("debug", "info", "notice", "warning", "error", "critical", "alert", "emergency")


def ingest_level(text: Column) -> Column:
    """NDJSON levels: debug, info, warning, error as they are, warn is warning, anything else is info."""
    return F.when(text.isin("debug", "info", "warning", "error"), text).when(text == "warn", "warning").otherwise("info")
