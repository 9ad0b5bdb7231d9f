"""Memory of Python workers between tasks.

Workers are used again by later tasks and keep what the allocators hold.  A task that has
built large objects hands the free memory back when it ends, so that an executor's memory is
that of the task it runs, not of the largest one it ever ran.
"""

from __future__ import annotations

import ctypes
import gc
from functools import wraps

import pyarrow as pa


def hand_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):      # another C library
        pass


def handing_back(run):
    """A generator function of batches that hands memory back when it is done."""
    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped
