"""Giving memory back when a worker is done with a partition."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def let_go() -> None:
    """Workers live on between stages: hand back what Arrow and the C library hold but don't use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)
