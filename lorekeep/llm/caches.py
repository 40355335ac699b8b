"""What a Python worker keeps during a task: one thing at a time, so that its memory stays bounded."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_held: dict[Any, Any] = {}


def only(key: Any, make: Callable[[], Any] = object) -> Any:
    """The thing kept under this key, made if it isn't there; whatever else was kept goes."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def also(key: Any, make: Callable[[], Any]) -> Any:
    """A small thing kept under this key beside what else is kept, made if it isn't there."""
    if key not in _held:
        _held[key] = make()
    return _held[key]


def clear() -> None:
    """At the end of a task: an idle worker keeps nothing, and freed memory goes back to the system."""
    _held.clear()
    trim()


def trim() -> None:
    """At the end of a task whose cache the next one uses: freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
    if trim is not None:
        trim(0)
