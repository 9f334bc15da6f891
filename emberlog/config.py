"""Settings of a store.  ``None`` switches an optional limit off."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    flush_rows: int = 1000
    flush_seconds: float = 1.0
    shards: int = 8
    soft_watermark: int = 50_000
    raw_debt_limit: int = 2_000_000_000
    backpressure_timeout: float = 60.0
    retention_max_age: int | None = 7 * 86_400
    retention_max_size: int | None = None
    retention_max_terms: int | None = None
    compaction_threshold: int = 500
    compaction_max_raw_age: int = 60
    compaction_rows: int = 1_000_000
    compaction_pass_rows: int = 50_000_000
    merge_target_rows: int = 1_000_000
    merge_min_blocks: int = 4
    idle_backoff_max: float = 300.0
    idle_codec_level: int = 9
    pressure_codec_level: int = 3
    tail_seconds: int = 30
    tail_rows: int = 250_000
    vacuum_grace: float = 86_400.0
    vacuum_seconds: float = 3600.0
    body_limit: int = 10 * 1024 * 1024
