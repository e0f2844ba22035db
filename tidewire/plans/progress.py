"""Progress of a run, told while it runs."""

from __future__ import annotations

import json
import threading
import time

from tidewire.sources.tables import PROGRESS, Store

EVERY_SECONDS = 5.0


class Reporter:
    """Writes rows to the ``progress`` table of a run, at its phases and between them.

    ``seen`` is a counter that tasks add their rows to as they end; the driver reads it
    at an interval. Rows of tasks that ran twice count twice, so what is told never
    passes the total.
    """

    def __init__(self, store: Store, batch: int, source: str, every: float | None = None):
        self.store, self.batch, self.source = store, batch, source
        self.every = EVERY_SECONDS if every is None else every
        self.seen = store.spark.sparkContext.accumulator(0)
        self.total = 0
        self._phase, self._last, self._n = "", None, 0
        self._done = threading.Event()
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._lock = threading.Lock()

    def __enter__(self) -> Reporter:
        self._thread.start()
        return self

    def __exit__(self, *failed) -> None:
        self._done.set()
        self._thread.join()

    def tell(self, phase: str, total: int | None = None, done: int | None = None) -> None:
        """One row; the same figures are not written twice."""
        with self._lock:
            self._phase, self.total = phase, self.total if total is None else total
            done = min(int(self.seen.value) if done is None else done, self.total)
            row = (self.source, phase, self.total, done, self.total - done)
            if row == self._last:
                return
            self._last = row
            at = int(time.time() * 1000)
            told = dict(zip(PROGRESS.fieldNames(), (at, *row), strict=True))
            self._n += 1
            self.store.put(f"progress/batch={self.batch}/{at}-{self._n}.json", json.dumps(told))

    def _watch(self) -> None:
        while not self._done.wait(self.every):
            if self._phase:
                self.tell(self._phase)
