"""Read cache: a table is loaded once and kept for a time; readers that come while it loads wait for the same load."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame


class ReadCache:
    """Persisted DataFrames by name, each for ``ttl`` seconds; the clock is a parameter for tests."""

    def __init__(self, ttl: float = 15.0, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock = ttl, clock
        self._kept: dict[str, tuple[float, DataFrame]] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def get(self, name: str, load: Callable[[], DataFrame]) -> DataFrame:
        with self._guard:
            lock = self._locks.setdefault(name, threading.Lock())
        with lock:
            at, df = self._kept.get(name, (0.0, None))
            if df is None or self.clock() - at >= self.ttl:
                if df is not None:
                    df.unpersist()
                df = load().persist()
                self._kept[name] = (self.clock(), df)
            return df

    def drop(self, name: str) -> None:
        """Forget a table that was written."""
        _, df = self._kept.pop(name, (0.0, None))
        if df is not None:
            df.unpersist()
