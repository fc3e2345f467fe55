"""One thread for matrix products: a task has one core, and threads that wait for small products only burn its time. Memory for their results is kept."""

from __future__ import annotations

import ctypes
import glob
import os
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1)
def _threads() -> list[tuple]:
    """The functions of numpy's own OpenBLAS that get and set the number of its threads; none where it has another library."""
    found = []
    for path in glob.glob(os.path.join(os.path.dirname(np.__file__), os.pardir, "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in ("scipy_openblas_{}_num_threads64_", "scipy_openblas_{}_num_threads", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
            if hasattr(lib, name.format("set")) and hasattr(lib, name.format("get")):
                found.append((getattr(lib, name.format("get")), getattr(lib, name.format("set"))))
                break
    return found


@contextmanager
def one_thread() -> Iterator[None]:
    before = [get() for get, _ in _threads()]
    for _, put in _threads():
        put(1)
    try:
        yield
    finally:
        for n, (_, put) in zip(before, _threads(), strict=True):
            put(n)


@lru_cache(maxsize=1)
def keep_memory() -> None:
    """Lets this process keep up to 64 MB that it has freed, where its C library can: to get pages of small results again and again takes as long as to compute them."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        for option in (-1, -3):  # M_TRIM_THRESHOLD, M_MMAP_THRESHOLD; at most 32 MB for the second
            mallopt(option, 32 << 20 if option == -3 else 64 << 20)
