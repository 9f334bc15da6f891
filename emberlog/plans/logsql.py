r"""A small LogsQL: filters, then pipes.

``level:error "disk full" service:api _time:1h | sort by (_time) desc | limit 20``

Words that mean nothing (boolean operators, bare words, unknown pipes) are ignored; ``quirks`` names them.
Pipes are split at `` | `` without regard to quotes.  All time bounds are inclusive.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, field

from emberlog.functions.levels import LEVELS
from emberlog.functions.times import iso_micros, seconds_of
from emberlog.plans.filters import LogFilter

KNOWN_LEVELS = frozenset((*LEVELS, "warn", "none", "all", "fatal", "trace"))
#: A token: quoted parts (with \" inside) and bracketed ranges may hold blanks.
QUOTED = r'"(?:\\"|[^"])*(?:"|\Z)'
TOKEN = re.compile(rf'{QUOTED}|(?:\[[^\])]*(?:[\])]|\Z)|{QUOTED}|[^\s"\[])+')
LEADING_INT = re.compile(r"[+-]?\d+")


@dataclass(frozen=True)
class LogQuery:
    where: LogFilter = field(default_factory=LogFilter)
    ascending: bool = False
    limit: int | None = None
    offset: int | None = None
    count: bool = False
    quirks: tuple[str, ...] = ()


def unquote(text: str) -> str:
    return text[1:].rstrip('"').replace('\\"', '"') if text.startswith('"') else text


def _range(text: str) -> tuple[int | None, int | None]:
    inner = text.lstrip("[").rstrip(")").rstrip("]")
    if "," not in inner:
        return None, None
    low, high = (iso_micros(x.strip()) for x in inner.split(",", 1))
    return low, high


def _bounds(text: str, now: int) -> tuple[int | None, int | None]:
    if text.startswith("["):
        return _range(text)
    if text.startswith(">="):
        return iso_micros(text[2:]), None
    if text.startswith("<"):
        return None, iso_micros(text[1:])
    span = seconds_of(text)
    return (None if span is None else now - span * 1_000_000), None


def parse(text: str, now: int | None = None) -> LogQuery:
    """now: microseconds that durations count back from; the clock if left out."""
    now = time.time_ns() // 1000 if now is None else now
    head, *pipes = text.split(" | ")
    levels, messages, since, until, metadata, quirks, nothing = [], [], [], [], {}, [], False
    head = head.strip()
    for token in [] if head == "*" else TOKEN.findall(head):
        name, colon, value = token.partition(":")
        if token.startswith('"'):
            messages.append(unquote(token))
        elif not colon:
            quirks.append(token)
        elif name == "_time":
            low, high = _bounds(value, now)
            if low is None and high is None:
                quirks.append(token)
            since += [low] if low is not None else []
            until += [high] if high is not None else []
        elif name == "level":
            levels.append(unquote(value))
            nothing |= levels[-1] not in KNOWN_LEVELS
        else:
            metadata[name] = unquote(value)
    found: dict = {"ascending": False, "limit": None, "offset": None, "count": False}
    for pipe in map(str.strip, pipes):
        word = next((w for w in ("limit", "offset") if pipe.startswith(w)), None)
        if pipe.startswith("sort by"):
            found["ascending"] = pipe.endswith("asc")
        elif word:
            number = LEADING_INT.match(pipe[len(word) :].lstrip())
            if number:
                found[word] = int(number[0])
            else:
                quirks.append(pipe)
        elif pipe.startswith("stats count("):
            found["count"] = True
        else:
            quirks.append(pipe)
    return LogQuery(LogFilter(tuple(levels), tuple(messages), tuple(since), tuple(until), metadata, nothing), **found, quirks=tuple(quirks))
