"""Memory of Python workers: what is freed goes back to the machine.

A worker outlives its task and waits for the next, perhaps of another step, with all that Arrow's pool and the C
library keep of what was freed.  An executor has several such workers beside those at work, so what they keep adds up.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Hand unused pages of Arrow's pool and, where the C library can do so, of its heap to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Run) -> Run:
    """``run`` for ``mapInArrow``, giving back what it has freed after each batch and at the end."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from run(handed())
        give_back()

    return out
