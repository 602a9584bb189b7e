"""How far a stream has come: rows and bytes so far, their rate, and the time that is left."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class Progress:
    phase: str
    done: int  # rows
    total: int  # rows, 0 if not known
    done_bytes: int = 0
    total_bytes: int = 0  # 0 if not known
    rate: float = 0.0  # rows a second, or bytes if their total is known
    seconds_left: float | None = None  # None while there is no telling


class ProgressListener(StreamingQueryListener):
    """Tells ``callback`` of each batch and of the end of the query named ``phase``.

    Rows are what the sources gave; bytes come from an observation of this name (``progress(rows, name, size)``). The rate
    is an average that leans to the latest batches (``weight`` of the newest). What the callback raises is dropped, as
    progress must not break the work.
    """

    def __init__(self, phase: str, callback: Callable[[Progress], None], total: int = 0, total_bytes: int = 0, observed: str | None = None, weight: float = 0.3):
        self.phase, self.callback, self.total, self.total_bytes, self.observed, self.weight = phase, callback, total, total_bytes, observed, weight
        self.done = self.done_bytes = 0
        self.rate = 0.0
        self.at: float | None = None
        self.run = None

    def onQueryStarted(self, event) -> None:
        if event.name == self.phase:
            self.run, self.at = event.runId, _seconds(event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.phase or not p.numInputRows:
            return
        size = p.observedMetrics.get(self.observed) if self.observed else None
        self.note(p.numInputRows, int(size["bytes"] or 0) if size is not None and "bytes" in size.asDict() else 0, _seconds(p.timestamp) + p.durationMs.get("triggerExecution", 0) / 1000)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self._tell(0.0 if event.exception is None else None)

    def note(self, rows: int, size: int, now: float) -> None:
        """A batch of rows and bytes that ended at a time."""
        self.done, self.done_bytes = self.done + rows, self.done_bytes + size
        by_bytes = self.total_bytes > 0
        took = max(now - self.at, 1e-3) if self.at is not None else None
        self.at = now
        if took:
            latest = (size if by_bytes else rows) / took
            self.rate = latest if not self.rate else (1 - self.weight) * self.rate + self.weight * latest
        left = max(0, self.total_bytes - self.done_bytes) if by_bytes else max(0, self.total - self.done)
        self._tell(left / self.rate if self.rate and (by_bytes or self.total) else None)

    def _tell(self, left: float | None) -> None:
        try:
            self.callback(Progress(self.phase, self.done, self.total, self.done_bytes, self.total_bytes, self.rate, left))
        except Exception:
            pass


def _seconds(timestamp: str) -> float:
    return datetime.datetime.fromisoformat(timestamp.replace("Z", "+00:00")).timestamp()
