"""Helpers for code that runs inside Spark's Python workers."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa

ENTRY = 180  # bytes of a dictionary's slot and the headers of a key and a value
HELD = "tideline_worker_store"  # the module object that keeps values between tasks
PUT = 1024  # values that enter a store of recent ones at once
ROWS = 1024  # rows handled at once; long texts make even this many a fair batch


def kept(name: str, make: Callable, owner: str | None = None):
    """What ``make()`` gives, made once per worker process and kept for its later tasks.

    Functions travel by value, so their module globals are new in each task; a module object
    entered in ``sys.modules`` stays. It holds the values of one ``owner`` (the module of ``make``, unless given): when another
    operator asks for its first value, those of the one before are dropped and their memory is handed back before
    the new value is made, so the stages of a pipeline do not add up.
    """
    store = sys.modules.setdefault(HELD, types.ModuleType(HELD)).__dict__
    owner = owner or make.__module__
    if store.get("owner") != owner:
        store["owner"], store["held"] = owner, {}
        hand_back()
    held = store["held"]
    if name not in held:
        held[name] = make()
    return held[name]


def hand_back() -> None:
    """Returns freed memory to the system, where its allocator offers that."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


class Recent:
    """A dictionary that forgets: two generations of about ``size`` bytes each; ``weigh`` tells the bytes of a value.

    A key found in the older one moves to the newer one, so frequent keys stay.
    """

    def __init__(self, size: int, weigh: Callable = len):
        self.size, self.weigh, self.used, self.new, self.old = size, weigh, 0, {}, {}

    def put(self, key, value) -> None:
        if self.used >= self.size:
            self.old, self.new, self.used = self.new, {}, 0
        self.used += len(key) + self.weigh(value) + ENTRY
        self.new[key] = value

    def put_all(self, values: dict) -> None:
        """``put`` of many, some of them at a time."""
        items = iter(values.items())
        while part := dict(islice(items, PUT)):
            if self.used >= self.size:
                self.old, self.new, self.used = self.new, {}, 0
            self.used += sum(map(len, part)) + sum(map(self.weigh, part.values())) + ENTRY * len(part)
            self.new |= part

    def find(self, keys: list) -> tuple[dict, list]:
        """Values of the known ones among ``keys`` and the list of unknown ones, each once."""
        new, old = self.new.get, self.old.get
        keys = dict.fromkeys(keys)
        found = {k: v for k in keys if (v := new(k)) is not None}
        unknown = [k for k in keys if k not in found]
        older = {k: v for k in unknown if (v := old(k)) is not None}
        if older:
            self.put_all(older)
            found |= older
            unknown = [k for k in unknown if k not in older]
        return found, unknown


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(column: pa.Array) -> list[str]:
    """Strings of a column, a null as the empty text."""
    return ["" if t is None else t for t in column.to_pylist()]
