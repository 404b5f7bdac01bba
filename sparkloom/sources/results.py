"""Results kept by key: computed once, read again until a path that they rest on is invalidated."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame

from sparkloom.functions.rounds import cut


class Results:
    """Written to the shared folder, so that an executor's loss costs nothing. One computation a key at a time."""

    def __init__(self) -> None:
        self._kept: dict[str, tuple[DataFrame, tuple[str, ...]]] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()
        self.hits = self.misses = 0

    def get(self, key: str, paths: list[str], make: Callable[[], DataFrame]) -> DataFrame:
        """The kept result of the key, or make()'s, which is kept; paths are what it rests on."""
        with self._guard:
            lock = self._locks.setdefault(key, threading.Lock())
        with lock:
            found = self._kept.get(key)
            if found:
                self.hits += 1
                return found[0]
            self.misses += 1
            made = cut(make())
            self._kept[key] = made, tuple(paths)
            return made

    def invalidate(self, path: str) -> int:
        """Forget results whose key or paths contain the path; how many they were."""
        gone = [k for k, (_, paths) in self._kept.items() if path in k or any(path in p for p in paths)]
        for k in gone:
            del self._kept[k]
        return len(gone)
