"""Records of runs and spans as JSON lines, which ``weftline.operators.perf`` analyses.

Recording never fails the recorded work: a log that can't be opened records nothing, a
record that can't be written is lost, an attribute that can't be worked out is left out.
Lines are appended and flushed one by one, so a run that is killed leaves its start and the
spans that ended.
"""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import datetime, timezone
from functools import wraps
from pathlib import Path

log = logging.getLogger(__name__)


class Lines:
    """Appends records to a file; ``opened`` is false where that can't be done."""

    def __init__(self, path: str | Path):
        self._file = None
        try:
            Path(path).parent.mkdir(parents=True, exist_ok=True)
            self._file = open(path, "a", encoding="utf-8")
        except OSError:
            log.warning("no records: %s can't be opened", path)

    @property
    def opened(self) -> bool:
        return self._file is not None

    def write(self, record: dict) -> None:
        try:
            self._file.write(json.dumps(record, ensure_ascii=False, default=str) + "\n")
            self._file.flush()
        except Exception as e:
            log.debug("a record is lost: %s", e)

    def close(self) -> None:
        if self._file:
            self._file.close()


class Run:
    """A run in progress: where its records go and when it began."""

    def __init__(self, lines: Lines):
        self.lines, self.id, self.began = lines, uuid.uuid4().hex, time.monotonic_ns()

    def since(self, begin: int, end: int) -> int:
        return (end - begin) // 1_000_000

    def say(self, kind: str, **fields) -> None:
        self.lines.write({"type": kind, "run_id": self.id, **fields})


class Span:
    """A span in progress; its attributes may grow until it ends."""

    def __init__(self, name: str, datasource_id: str | None, parent: Span | None, attrs: dict):
        self.id, self.name, self.parent, self.attrs = uuid.uuid4().hex, name, parent, attrs
        self.datasource_id = datasource_id if datasource_id is not None or parent is None else parent.datasource_id


_run: ContextVar[Run | None] = ContextVar("weftline_run", default=None)
_span: ContextVar[Span | None] = ContextVar("weftline_span", default=None)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


@contextmanager
def run(path: str | Path, operation: str, **attrs) -> Iterator[None]:
    """Record a run of an operation; an error in it is recorded and goes on."""
    lines = Lines(path)
    if not lines.opened:
        yield
        return
    own = Run(lines)
    held, no_span, failure = _run.set(own), _span.set(None), None
    own.say("run_start", ts=_now(), operation=operation, attrs=attrs)
    try:
        yield
    except Exception as e:
        failure = type(e).__name__
        raise
    finally:
        end = {"status": "error" if failure else "ok", "duration_ms": own.since(own.began, time.monotonic_ns())}
        own.say("run_end", ts=_now(), **end, **({"error_type": failure} if failure else {}))
        _span.reset(no_span)
        _run.reset(held)
        lines.close()


@contextmanager
def span(name: str, datasource_id: str | None = None, **attrs) -> Iterator[None]:
    """Record a step of the current run, within the current span, whose source it takes where it names none; outside a run nothing is recorded."""
    own = _run.get()
    if own is None:
        yield
        return
    current = Span(name, datasource_id, _span.get(), attrs)
    held, began, failure = _span.set(current), time.monotonic_ns(), None
    try:
        yield
    except Exception as e:
        failure = type(e).__name__
        raise
    finally:
        _span.reset(held)
        times = {"t_start_ms": own.since(own.began, began), "duration_ms": own.since(began, time.monotonic_ns())}
        who = {"span_id": current.id, "parent_span_id": current.parent.id if current.parent else None, "datasource_id": current.datasource_id}
        own.say("span", **who, name=name, **times, status="error" if failure else "ok", attrs=current.attrs, **({"error_type": failure} if failure else {}))


def set_attributes(**attrs) -> None:
    """Add attributes to the current span, if there is one."""
    if current := _span.get():
        current.attrs.update(attrs)


def recorded(name: str, attrs: Callable[..., dict] | None = None, datasource_id: str | Callable[..., str | None] | None = None) -> Callable:
    """Decorator: each call is a span; attributes and source may be worked out from its arguments, and what fails there is left out."""

    def found(value, args, kwargs):
        try:
            return value(*args, **kwargs) if callable(value) else value
        except Exception as e:
            log.debug("an attribute of %s is left out: %s", name, e)
            return None

    def put(f):
        @wraps(f)
        def call(*args, **kwargs):
            if _run.get() is None:
                return f(*args, **kwargs)
            extra = found(attrs, args, kwargs)
            extra = dict(extra) if isinstance(extra, dict) else {}
            source = found(datasource_id, args, kwargs)
            with span(name, extra.pop("datasource_id", None) if source is None else source):
                set_attributes(**{str(k): v for k, v in extra.items()})
                return f(*args, **kwargs)

        return call

    return put
