"""Named events with measurements, delivered to callbacks in this process."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

#: Events that the library emits.
EVENTS = ("flush.stop", "flush.error", "query.stop", "block.error", "retention.stop", "retention.term_pressure", "compaction.stop", "compaction.error", "merge_compaction.stop", "ingest.backpressure")

_handlers: dict[str, tuple[frozenset[str], Callable]] = {}
_lock = threading.Lock()


def attach(name: str, events: list[str], handler: Callable[[str, dict, dict], None]) -> None:
    with _lock:
        _handlers[name] = (frozenset(events), handler)


def detach(name: str) -> None:
    with _lock:
        _handlers.pop(name, None)


def event(name: str, measurements: dict, metadata: dict | None = None) -> None:
    with _lock:
        wanted = [(k, h) for k, (events, h) in _handlers.items() if name in events]
    for key, handler in wanted:
        try:
            handler(name, measurements, metadata or {})
        except Exception:  # a handler that fails is taken off, the caller goes on
            logging.getLogger(__name__).exception("telemetry handler %s failed", key)
            detach(key)


@contextmanager
def span(name: str, metadata: dict | None = None) -> Iterator[dict]:
    """Times a block; measurements put into the yielded dict go with the event."""
    began, found = time.perf_counter(), {}
    yield found
    event(name, {"duration": time.perf_counter() - began, **found}, metadata)
