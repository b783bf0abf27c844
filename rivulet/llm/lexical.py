"""Hashes of words and runs of words, for whole texts at a time."""

from __future__ import annotations

from functools import cache

import numpy as np

from .common import mix64

#: Odd multipliers of the hashes of letters in words and of words in runs, and their inverses modulo 2^64.
LETTER, WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_BACK = {x: pow(x, -1, 1 << 64) for x in (LETTER, WORD)}
#: Powers that are kept; longer texts make their own.
_KEPT = 1 << 17


@cache
def _kept_powers(base: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(_KEPT, base, np.uint64)])


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^n modulo 2^64."""
    return _kept_powers(base)[: n + 1] if n <= _KEPT else np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of the runs start .. end - 1 of the values, equal for equal runs wherever they stand."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * _powers(base, n)[:n], out=total[1:])
    back = _powers(_BACK[base], n)
    return mix64((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))


def lowered(text: str) -> str:
    """The text in lower case, letter by letter where it would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
