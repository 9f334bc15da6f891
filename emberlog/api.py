"""The library's front: one object for ingest, queries, subscriptions and upkeep."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from emberlog import telemetry
from emberlog.config import Config
from emberlog.operators import search
from emberlog.plans import logsql
from emberlog.plans.filters import LogFilter
from emberlog.sources import ndjson
from emberlog.sources.model import ENTRY, from_records, local_entries
from emberlog.sources.store import LogStore, Seen
from emberlog.streaming.ingest import shard, shard_of
from emberlog.streaming.live import Subscriptions, Tail, matches


class Emberlog:
    """Entries in a store at path, or in memory if there is none.

    ``ingest`` accepts records at once: they can be queried and subscribers get them.  They wait in ``shards`` queues by a hash of their request, trace
    or service, and go to the store when a queue holds ``flush_rows``, on ``flush``, or every ``flush_seconds`` while an ``Upkeep`` runs.  Large amounts go through
    ``append`` or a stream instead.

    A query that meets a damaged block finds out which, reports ``block.error``, and goes on without those blocks.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, config: Config | None = None, clock: Callable[[], int] | None = None):
        self.spark, self.config = spark, config or Config()
        self.clock = clock or (lambda: time.time_ns() // 1000)
        self.store = LogStore(spark, path, self.config, self.clock) if path else None
        self.tail, self.subscriptions = Tail(self.config.tail_rows, self.config.tail_seconds, self.store is None), Subscriptions()
        self._queues: list[list[tuple[int, tuple]]] = [[] for _ in range(max(self.config.shards, 1))]
        self._lock, self._flushing = threading.Lock(), threading.Lock()
        self.upkeep: Upkeep | None = None

    # writing

    def ingest(self, records: Iterable[dict]) -> int:
        now = self.clock()
        rows = [tuple(r) for r in _rows(records, now)]
        if self.store is None:
            self.tail.add(rows)
            self.subscriptions.publish(rows)
            return len(rows)
        self._hold_back()
        with self._lock:
            names = self.tail.add(rows)
            for item in zip(names, rows, strict=True):
                self._queues[shard_of(item[1], len(self._queues))].append(item)
            due = any(len(q) >= self.config.flush_rows for q in self._queues)
        self.subscriptions.publish(rows)
        if due:
            self.flush()
        return len(rows)

    def ingest_one(self, record: dict) -> None:
        """Never raises: an entry that can't be taken is logged and dropped."""
        try:
            self.ingest([record])
        except Exception:
            logging.getLogger(__name__).exception("entry dropped")

    def ingest_ndjson(self, body: str, message_field: str = "_msg", time_field: str = "_time") -> tuple[int, int]:
        """(entries, malformed lines)."""
        lines = [x for x in body.split("\n") if x]
        if not lines:
            return 0, 0
        rows = ndjson.parse(self.spark.createDataFrame(pa.table({"value": lines}), "value string"), message_field, time_field).collect()
        good = [r for r in rows if not r["malformed"]]
        self.ingest([{"timestamp": r["timestamp_us"], "level": r["level"], "message": r["message"], "metadata": r["metadata"], "_exact": True} for r in good])
        return len(good), len(lines) - len(good)

    def append(self, entries: DataFrame) -> int:
        """A DataFrame of entries, straight into the store."""
        return self.store.append(entries)

    @property
    def queued(self) -> int:
        return sum(map(len, self._queues))

    def _hold_back(self) -> None:
        """Waits while too much is queued or uncompacted, for ``backpressure_timeout`` seconds at most, and then goes on: nothing is dropped.

        Without an Upkeep the waiting caller flushes and compacts itself.
        """
        began = time.monotonic()
        while time.monotonic() - began < self.config.backpressure_timeout:
            queued, debt = self.queued, self.store.raw_debt()
            if queued < self.config.soft_watermark and debt < self.config.raw_debt_limit:
                return
            telemetry.event("ingest.backpressure", {"queued": queued, "raw_bytes": debt})
            if queued >= self.config.soft_watermark:
                self.flush()
            elif self.upkeep is not None and self.upkeep.is_alive():
                self.upkeep.wake.set()
                time.sleep(0.02)
            elif self.store.compact(force=True) == "noop":
                return

    def flush(self) -> int:
        """Everything accepted so far is in the store when this returns."""
        if self.store is None:
            return 0
        with self._flushing:
            with self._lock:
                queues, self._queues = self._queues, [[] for _ in self._queues]
            batch = [x for q in queues for x in q]
            if not batch:
                return 0
            try:
                with telemetry.span("flush.stop") as found:
                    entries = local_entries(self.spark, [r for _, r in batch])
                    entries = entries.coalesce(1) if len(batch) < 100_000 else entries.repartition(len(queues), shard(len(queues)))
                    # what becomes visible in the store leaves the tail in the same moment
                    found["entry_count"] = self.store.append(entries, then=lambda: self.tail.stored([n for n, _ in batch]), rebalance=False)
            except Exception as failed:
                with self._lock:
                    self._queues = [a + b for a, b in zip(queues, self._queues, strict=True)]
                telemetry.event("flush.error", {"entry_count": len(batch)}, {"reason": repr(failed)})
                raise
            self.tail.sweep(self.clock())
            return len(batch)

    # reading

    def _snapshot(self) -> tuple[Seen, list[tuple]]:
        """A version of the store and what wasn't in it, in one moment."""
        with self.store.lock:
            return self.store.seen(), self.tail.fresh()

    def _reading(self, run: Callable):
        """run(), once more without the damaged blocks if it fails because of such."""
        try:
            return run()
        except ValueError:
            raise
        except Exception:
            if self.store is None or not self.store.damaged():
                raise
            return run()

    def entries(self, where: LogFilter | None = None) -> DataFrame:
        """All matching entries: the store and what isn't in it yet, each once."""
        where = where or LogFilter()
        if self.store is None:
            return where.apply(self.tail.frame(self.spark))
        seen, fresh = self._snapshot()
        found = self.store.entries(where, seen).select(*ENTRY.names)
        return found.unionByName(where.apply(local_entries(self.spark, fresh))) if fresh else found

    def query(self, order: str = "desc", limit: int | None = None, offset: int | None = None, count_total: bool = True, where: LogFilter | None = None, **filters) -> search.Page:
        where = where or LogFilter.of(**filters)

        def run() -> search.Page:
            if not count_total and order == "desc" and self.store is not None:
                lim, off = search.checked(limit, offset)
                seen, fresh = self._snapshot()
                df = self.store.newest_first(where, lim + off + 1, seen).select(*ENTRY.names)
                df = df.unionByName(where.apply(local_entries(self.spark, fresh))) if fresh else df
                return search.page(df, LogFilter(), False, limit, offset, False)
            return search.page(self.entries(where), LogFilter(), order == "asc", limit, offset, count_total)

        return self._reading(run)

    def recent(self, limit: int = 100, order: str = "desc", **filters) -> list[tuple]:
        """The newest accepted entries (of the last ``tail_seconds``, or not stored yet), without Spark: what a live view shows."""
        return self.tail.take(LogFilter.of(**filters), limit, order == "asc")

    def count(self, where: LogFilter | None = None, **filters) -> int:
        where = where or LogFilter.of(**filters)

        def run() -> int:
            if self.store is None:
                return sum(matches(e, where) for e in self.tail.fresh())
            seen, fresh = self._snapshot()
            return self.store.count(where, seen) + sum(matches(e, where) for e in fresh)

        return self._reading(run)

    def logsql(self, text: str, now: int | None = None) -> search.Page | int:
        """A page, or the number for ``stats count()``."""
        q = logsql.parse(text, self.clock() if now is None else now)
        if q.count:
            return self.count(where=q.where)
        return self.query("asc" if q.ascending else "desc", q.limit, q.offset, False, where=q.where)

    def field_values(self, name: str, where: LogFilter | None = None, limit: int = 10_000, **filters) -> list[dict]:
        """The most frequent values of a field."""
        return self._reading(lambda: [r.asDict() for r in search.field_values(self.entries(where or LogFilter.of(**filters)), name, LogFilter()).limit(limit).collect()])

    def field_names(self, where: LogFilter | None = None, limit: int = 10_000, **filters) -> list[dict]:
        return self._reading(lambda: [r.asDict() for r in search.field_names(self.entries(where or LogFilter.of(**filters)), LogFilter()).limit(limit).collect()])

    def stream(self, where: LogFilter | None = None, **filters) -> Iterator:
        return search.stream(self.entries(where or LogFilter.of(**filters)), LogFilter())

    def sql(self, text: str, **args) -> DataFrame:
        """SQL over the view ``logs``."""
        return self.spark.sql(text.replace("{logs}", "{df}"), args=args or None, df=self.entries()) if "{logs}" in text else self._with_view(text, args)

    def _with_view(self, text: str, args: dict) -> DataFrame:
        self.entries().createOrReplaceTempView("logs")
        return self.spark.sql(text, args=args or None)

    def stats(self) -> dict:
        if self.store is None:
            return {"total_blocks": 0, "total_entries": len(self.tail), "queued_entries": self.queued}
        return self.store.stats().first().asDict() | {"queued_entries": self.queued}

    # the rest

    def subscribe(self, callback: Callable[[tuple], None], **filters) -> int:
        return self.subscriptions.add(callback, LogFilter.of(**filters))

    def unsubscribe(self, name: int) -> None:
        self.subscriptions.remove(name)

    def merge_now(self) -> str:
        self.flush()
        return self.store.merge()

    def compact_now(self) -> str:
        self.flush()
        while (did := self.store.compact(force=True)) in ("more", "conflict"):
            pass
        return did

    def retain_now(self) -> str | tuple[str, int]:
        """The store's retention; what is too old goes from the tail, too."""
        age = self.config.retention_max_age
        self.flush()  # what the tail drops is in a block, where the store's retention finds it
        gone = 0 if age is None else self.tail.prune_before(self.clock() - age * 1_000_000)
        if self.store is None:
            return "noop" if age is None else ("ok", gone)
        return self.store.retain()

    def vacuum_now(self) -> int:
        return self.store.vacuum()

    def start(self, interval: float = 30.0) -> Upkeep:
        """Flushes and maintains in the background from now on; ``close`` ends that."""
        if self.upkeep is None or not self.upkeep.is_alive():
            self.upkeep = Upkeep(self, interval)
            self.upkeep.start()
        return self.upkeep

    def backup(self, target: str) -> dict:
        self.flush()
        return self.store.backup(target)

    def close(self) -> None:
        if self.upkeep is not None:
            self.upkeep.stop()
            self.upkeep.join()
            self.upkeep = None
        self.flush()

    def settings(self) -> dict:
        return asdict(self.config)


def _rows(records: Iterable[dict], now: int) -> list[tuple]:
    from emberlog.functions.times import to_micros
    from emberlog.sources.model import _text

    out = []
    for r in records:
        at = r.get("timestamp")
        us = now if at is None else at if r.get("_exact") else to_micros(at)
        out.append((us, str(r.get("level", "info")), str(r.get("message", "")), {str(k): _text(v) for k, v in (r.get("metadata") or {}).items()}))
    return out


class Upkeep(threading.Thread):
    """Flushes every ``flush_seconds``; compacts, merges, retains and vacuums at an interval that grows while there is nothing to do."""

    def __init__(self, log: Emberlog, interval: float = 30.0):
        super().__init__(daemon=True, name="emberlog-upkeep")
        self.log, self.interval, self.stopped, self.wake = log, interval, threading.Event(), threading.Event()

    def run(self) -> None:
        wait, due, vacuumed = self.interval, time.monotonic() + self.interval, time.monotonic()
        while not self.stopped.wait(min(self.log.config.flush_seconds, max(due - time.monotonic(), 0.0))):
            try:
                self.log.flush()
                self.log.tail.sweep(self.log.clock())
                if time.monotonic() < due and not self.wake.is_set():
                    continue
                self.wake.clear()
                did = [self.log.store.compact(), self.log.store.merge(), self.log.retain_now()]
                wait = 0.0 if "more" in did else self.interval if "ok" in did or "conflict" in did else min(max(wait, self.interval) * 2, self.log.config.idle_backoff_max)
                if time.monotonic() - vacuumed >= self.log.config.vacuum_seconds:
                    self.log.store.vacuum()
                    vacuumed = time.monotonic()
            except Exception as failed:
                telemetry.event("compaction.error", {}, {"reason": repr(failed)})
            due = time.monotonic() + wait

    def stop(self) -> None:
        self.stopped.set()


__all__ = ["Emberlog", "Upkeep", "from_records"]
