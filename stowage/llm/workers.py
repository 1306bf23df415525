"""What a Python worker keeps between tasks, and what it gives back.

Workers are used again and again, by one operator after another. One object is kept at a
time, for the operator that ran last; an operator that keeps nothing drops it. What a
task has used goes back to the system when it ends, whatever is kept.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa

#: Texts of a batch that are Python objects at the same time.
TEXTS = 256

_kept: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The object of this key, made if another one or none is kept."""
    if key not in _kept:
        drop()
        _kept[key] = make()
    return _kept[key]


def give_back() -> None:
    """Return free memory to the system where that is possible."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def drop() -> None:
    """Forget what is kept."""
    if _kept:
        _kept.clear()
        give_back()


def tidy(run: Callable[..., Iterator[Any]]) -> Callable[..., Iterator[Any]]:
    """A function over batches that forgets what others kept before it runs, and gives its memory back after."""

    @functools.wraps(run)
    def tidied(*args: Any) -> Iterator[Any]:
        drop()
        try:
            yield from run(*args)
        finally:
            give_back()

    return tidied


def texts(batch: pa.RecordBatch, column: int | str = "text") -> Iterator[bytes]:
    """The texts of a batch in UTF-8, null as empty; few of them are there at a time."""
    at = batch.schema.get_field_index(column) if isinstance(column, str) else column
    whole = batch.column(at).cast(pa.binary())
    for start in range(0, len(whole), TEXTS):
        for text in whole.slice(start, TEXTS).to_pylist():
            yield text or b""
