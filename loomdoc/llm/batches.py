"""What operators with Python functions ask of a session and of a worker: this package on the executors, bounded Arrow
batches, so that a batch of long texts fits beside the other workers of an executor, and tables of bounded size that a
worker holds for one operator at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

from pyspark.sql import SparkSession

from loomdoc.shipping import ship

ROWS, BYTES = 1024, 8 << 20


def bound(spark: SparkSession, rows: int = ROWS, size: int = BYTES) -> None:
    """Ship the code and lower the session's Arrow batch limits to ``rows`` and ``size``; smaller settings of the user stay."""
    ship(spark)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key, None)
        digits = now if now and now.lstrip("-").isdigit() else "0"
        if not 0 < int(digits) <= most:
            spark.conf.set(key, str(most))


class Bounded(dict):
    """A table filled by ``make`` on first use, in two generations: when the young one holds half of ``size`` bytes (as ``cost``
    estimates them) it becomes the old one, and entries of the old one that are used again return."""

    def __init__(self, size: int):
        super().__init__()
        self.half, self.room, self.old = size // 2, size // 2, {}

    def make(self, key):
        raise NotImplementedError

    def cost(self, key, made) -> int | None:
        """Bytes of an entry; None for one that is not kept."""
        raise NotImplementedError

    def __missing__(self, key):
        made = self.old.get(key)
        if made is None:
            made = self.make(key)
        cost = self.cost(key, made)
        if cost is not None:
            self.room -= cost
            if self.room < 0:
                self.old, self.room = dict(self), self.half - cost
                self.clear()
            self[key] = made
        return made


_holder: list[tuple[str, Callable[[], object]]] = []


def claim(name: str, release: Callable[[], object] = lambda: None) -> None:
    """Make ``name`` the operator whose tables this worker process holds: those of the operator before are released, since workers
    outlive stages and their memory counts beside that of the next ones."""
    if _holder and _holder[0][0] != name:
        _holder.pop()[1]()
        trim()
    if not _holder:
        _holder.append((name, release))


def trim() -> None:
    """Return free memory to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
