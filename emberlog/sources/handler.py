"""A handler for Python's logging that writes into a log."""

from __future__ import annotations

import logging

#: Attributes of every record; what a program adds to a record is metadata.
OWN = frozenset(vars(logging.makeLogRecord({}))) | {"message", "asctime", "taskName"}
LEVELS = {logging.DEBUG: "debug", logging.INFO: "info", logging.WARNING: "warning", logging.ERROR: "error", logging.CRITICAL: "critical"}


class EmberlogHandler(logging.Handler):
    """``logging.getLogger().addHandler(EmberlogHandler(log))``; the extra of a call becomes metadata, as text."""

    def __init__(self, log, level: int = logging.NOTSET):
        super().__init__(level)
        self.log = log

    def emit(self, record: logging.LogRecord) -> None:
        if record.name.startswith(("emberlog", "py4j")):
            return  # what storing an entry logs is not an entry
        meta = {k: str(v) for k, v in vars(record).items() if k not in OWN and not k.startswith("_")}
        level = LEVELS.get(record.levelno) or LEVELS[max((x for x in LEVELS if x <= record.levelno), default=logging.DEBUG)]
        self.log.ingest_one({"timestamp": int(record.created * 1_000_000), "level": level, "message": record.getMessage(), "metadata": {"logger": record.name} | meta})


def install(log, logger: logging.Logger | None = None, level: int = logging.NOTSET) -> EmberlogHandler:
    """Adds a handler for all levels to a logger (the root by default); one that is there for the same log is changed instead."""
    logger = logger or logging.getLogger()
    found = next((h for h in logger.handlers if isinstance(h, EmberlogHandler) and h.log is log), None)
    if found is None:
        found = EmberlogHandler(log, level)
        logger.addHandler(found)
    found.setLevel(level)
    return found


def uninstall(handler: EmberlogHandler, logger: logging.Logger | None = None) -> None:
    (logger or logging.getLogger()).removeHandler(handler)
