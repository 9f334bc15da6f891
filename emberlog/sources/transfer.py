"""Copies one store into another, some blocks at a time, so that a copy that was cut short goes on where it stopped."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import functions as F

from emberlog.operators import digest
from emberlog.sources.model import ENTRY
from emberlog.sources.store import LogStore


def copy(source: LogStore, target: LogStore, progress: Callable[[int, int], None] | None = None, rows: int = 50_000_000) -> int:
    """Appends every block of source to target once; returns the entries that this call added.

    Blocks are gathered in order until they hold ``rows`` entries.  Each gathering is a named batch of the target, which is the journal: what is in is left out.  A source that
    can't be read whole stops the copy.
    """
    live = source.catalogue()
    groups, held = [[]], 0
    for r in live.coalesce(1).sortWithinPartitions("ts_min", "block").select("block", "entry_count").toLocalIterator():
        if groups[-1] and held + r["entry_count"] > rows:
            groups.append([])
            held = 0
        groups[-1].append(r["block"])
        held += r["entry_count"]
    added = done = 0
    for group in groups:
        part = live.where(F.col("block").isin(*group)) if group else None
        if part is not None:
            added += target.append(source._rows(part).select(*ENTRY.names), batch=f"copy {source.path} {hashlib.sha256(' '.join(group).encode()).hexdigest()}")
            done += len(group)
        if progress is not None:
            progress(done, sum(map(len, groups)))
    return added


def same(source: LogStore, target: LogStore) -> bool:
    """Do both hold the same entries, and as many as their catalogues say?"""
    found = [digest.digest(s.entries()) for s in (source, target)]
    return found[0] == found[1] and all(n == s.catalogue().agg(F.coalesce(F.sum("entry_count"), F.lit(0))).first()[0] for (n, _), s in zip(found, (source, target), strict=True))


def remove_copied(source: LogStore, target: LogStore) -> bool:
    """Deletes the source's folder, if and only if every block of it can be read and the target holds exactly its entries."""
    if source.damaged() or source.bad or not same(source, target):
        return False
    return bool(source.fs.delete(source._hadoop(""), True))
