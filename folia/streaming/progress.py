"""Heartbeats of running streams: what each batch read and wrote, kept for who asks and passed on to a sink."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener

#: Heartbeats that are kept of each stream.
KEPT = 100


class Heartbeats(StreamingQueryListener):
    """Add it with spark.streams.addListener(). live() has the streams that run, with their last heartbeat; sink, if given, gets
    every heartbeat as a dict, as does the log of one stream by history()."""

    def __init__(self, sink: Callable[[dict], None] | None = None, kept: int = KEPT):
        self.sink, self.kept, self.lock = sink, kept, threading.Lock()
        self.held: dict[str, deque] = {}
        self.running: set[str] = set()

    def _note(self, beat: dict) -> None:
        with self.lock:
            self.held.setdefault(beat["run"], deque(maxlen=self.kept)).append(beat)
        if self.sink:
            self.sink(beat)

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.running.add(str(event.runId))
        self._note({"run": str(event.runId), "event": "started", "name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        state = sum(s.numRowsTotal for s in p.stateOperators)
        self._note({"run": str(p.runId), "event": "batch", "name": p.name, "batch": p.batchId, "rows": p.numInputRows, "rows_a_second": p.processedRowsPerSecond, "state_rows": state})

    def onQueryIdle(self, event) -> None:
        self._note({"run": str(event.runId), "event": "idle"})

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.running.discard(str(event.runId))
        self._note({"run": str(event.runId), "event": "ended", "error": event.exception})

    def live(self) -> dict[str, dict]:
        with self.lock:
            return {run: self.held[run][-1] for run in self.running if run in self.held}

    def history(self, run: str) -> list[dict]:
        with self.lock:
            return list(self.held.get(run, ()))
