"""Caches: values in memory by least recent use, and frames that are dropped when their files change."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import DataFrame

from tarn.plans.oplog import OpLog


class MemoryCache:
    """Bounded by entries and bytes; entries may age out."""

    def __init__(self, max_entries: int = 1000, max_bytes: int = 1 << 26, ttl: float | None = None):
        self.max_entries, self.max_bytes, self.ttl = max_entries, max_bytes, ttl
        self._held: OrderedDict[str, tuple[float, str]] = OrderedDict()
        self._bytes = 0

    def get(self, key: str) -> str | None:
        found = self._held.get(key)
        if found is None or (self.ttl is not None and time.monotonic() - found[0] >= self.ttl):
            self.delete(key)
            return None
        self._held.move_to_end(key)
        return found[1]

    def set(self, key: str, value: str) -> None:
        self.delete(key)
        if len(value.encode()) > self.max_bytes:
            return
        self._held[key] = (time.monotonic(), value)
        self._bytes += len(value.encode())
        while len(self._held) > self.max_entries or self._bytes > self.max_bytes:
            self.delete(next(iter(self._held)))

    def delete(self, key: str) -> None:
        if (found := self._held.pop(key, None)) is not None:
            self._bytes -= len(found[1].encode())

    def clear_prefix(self, prefix: str) -> None:
        for key in [k for k in self._held if k.startswith(prefix)]:
            self.delete(key)


class NullCache:
    """Keeps nothing."""

    def get(self, key: str) -> None:
        return None

    def set(self, key: str, value: str) -> None:
        pass

    def delete(self, key: str) -> None:
        pass

    def clear_prefix(self, prefix: str) -> None:
        pass


class FrameCache:
    """Spark's cache of a log's live records. STAT looks at versions and sizes, HASH at the rows too, TRUST at nothing."""

    MODES = ("STAT", "HASH", "TRUST")

    def __init__(self, log: OpLog, mode: str = "STAT"):
        if mode not in self.MODES:
            raise ValueError(f"unknown mode: {mode}")
        self.log, self.mode = log, mode
        self._frame: DataFrame | None = None
        self._print: object = None

    def _fingerprint(self) -> object:
        if self.mode == "TRUST":
            return None
        stat = (self.log.versions.latest()[0], self.log.bytes())
        if self.mode == "STAT":
            return stat
        return stat, tuple(self.log.read().selectExpr("count(1)", "sum(cast(xxhash64(op, id, data) as decimal(38,0)))").first())

    def live(self) -> DataFrame:
        now = self._fingerprint()
        if self._frame is None or now != self._print:
            self.drop()
            self._frame, self._print = self.log.live().cache(), now
        return self._frame

    def drop(self) -> None:
        if self._frame is not None:
            self._frame.unpersist()
            self._frame = None
