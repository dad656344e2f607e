"""Giving memory back: a Python worker outlives its tasks, and what it keeps counts against its executor."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


#: What this worker remembers from task to task.
_remembered: dict[Hashable, Any] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once in this worker while its tasks are those of functions that remember."""
    if key not in _remembered:
        _remembered[key] = make()
    return _remembered[key]


def forget() -> None:
    """Drops what tasks of other functions left in this worker."""
    if _remembered:
        _remembered.clear()
        release()


def release() -> None:
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(f: Callable[[Iterator], Iterator], remembers: bool = False) -> Callable[[Iterator], Iterator]:
    """A function of batches that gives memory back when it ends, and begins with that of other functions given back unless it ``remembers``."""

    def run(batches: Iterator) -> Iterator:
        if not remembers:
            forget()
        yield from f(batches)
        release()

    return run


def tidy_group(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of a group."""

    def run(table: pa.Table) -> pa.Table:
        forget()
        out = f(table)
        release()
        return out

    return run
