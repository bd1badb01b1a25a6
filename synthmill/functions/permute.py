"""Bijections on row ordinals: uniqueness without a shared set and without a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column

from synthmill.functions.draws import div, draw, draw_key, long

_HALF = 2 ** 30
MAX_CAPACITY = 2 ** 60


def capacity_of(size: int) -> int:
    """Ordinals that :func:`permute` can serve for a value space of the given size."""
    if size < 2 ** 31:
        return size
    return _HALF * min(size // _HALF, _HALF)


def affine(seed: int, path: str, size: int) -> tuple[int, int]:
    """Multiplier (coprime to size) and offset of the small-space permutation."""
    mult = max(1, int(size * 0.6180339887498949)) | 1
    while math.gcd(mult, size) != 1:
        mult += 2
    return mult % size if size > 1 else 0, draw_key(seed, path, "offset") % size


def permute(ordinal: Column, size: int, seed: int, path: str) -> Column:
    """A distinct value in [0, capacity_of(size)) for each ordinal in that range.

    Products stay below 2**62, so ANSI overflow checks never fire.  Large spaces are split
    into two halves that are shifted by a hash of each other, which is again a bijection.
    """
    i = long(ordinal)
    if size < 2 ** 31:
        mult, offset = affine(seed, path, size)
        return (i % long(size) * long(mult) + long(offset)) % long(size)
    high_size = min(size // _HALF, _HALF)
    low, high = i % long(_HALF), div(i, _HALF) % long(high_size)
    high = (high + draw(draw_key(seed, path, "high"), low) % long(high_size)) % long(high_size)
    low = (low + draw(draw_key(seed, path, "low"), high) % long(_HALF)) % long(_HALF)
    return high * long(_HALF) + low
