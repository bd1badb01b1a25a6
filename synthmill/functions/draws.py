"""Addressable random draws.

Every random decision is a pure function of an address: seed, field path, purpose, row id,
attempt, position and array index.  There is no generator state, so a run gives the same
rows for any number of partitions, a lost task is recomputed to the same values, and any
single row can be produced on its own.  ``xxhash64`` keeps the draw inside codegen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, functions as F

UNIT = 1_000_000  # resolution of chance()


def draw_key(seed: int, path: str, purpose: str) -> int:
    """Signed 64-bit constant that names one stream of draws."""
    digest = hashlib.sha256(f"{seed}|{path}|{purpose}".encode("utf-8")).digest()
    return int.from_bytes(digest[:8], "big", signed=True)


@lru_cache(maxsize=8192)
def _literal(value: int) -> Column:
    return F.expr(f"{value}L") if value > -(2 ** 63) else F.lit(value)


@lru_cache(maxsize=16)
def _letters(alphabet: str) -> Column:
    # The split of a literal folds to a constant array, so a letter is one array access.
    return F.split(F.lit(" ".join(alphabet)), " ")


def long(value: int | Column) -> Column:
    """A long column or literal; literals are kept, since a wide schema needs thousands of them."""
    return value.cast("long") if isinstance(value, Column) else _literal(value)


def raw_draw(key: int, row: Column, k: int | Column = 0, p: int | Column = 0,
             idx: Sequence[Column] = ()) -> Column:
    """64 random bits at the address, as a signed long.  Columns of the address must be longs."""
    return F.xxhash64(_literal(key), *[x if isinstance(x, Column) else _literal(x) for x in (k, p)], row, *idx)


def draw(key: int, row: Column, k: int | Column = 0, p: int | Column = 0,
         idx: Sequence[Column] = ()) -> Column:
    """63 random bits at the address, never negative."""
    return F.shiftrightunsigned(raw_draw(key, row, k, p, idx), 1)


def chance(bits: Column, probability: float) -> Column:
    """True with the given probability."""
    return bits % _literal(UNIT) < _literal(round(probability * UNIT))


def below(bits: Column, n: int) -> Column:
    """Uniform long in [0, n)."""
    return bits % _literal(n)


def div(a: Column, b: int | Column) -> Column:
    """Integer division of longs."""
    return F.call_function("div", a, b if isinstance(b, Column) else _literal(b))


LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
DIGITS = "0123456789"
ALNUM = LOWER + UPPER + DIGITS
TOKEN = LOWER + DIGITS


def spell(value: Column, alphabet: str, width: int) -> Column:
    """``value`` written in base len(alphabet) with ``width`` digits, most significant first."""
    if alphabet == DIGITS:
        return F.lpad(value.cast("string"), width, "0")
    letters, base = _letters(alphabet), len(alphabet)
    digits = [div(value, base ** (width - 1 - j)) if j < width - 1 else value for j in range(width)]
    chars = [F.get(letters, (digit % long(base) if j else digit).cast("int")) for j, digit in enumerate(digits)]
    return chars[0] if width == 1 else F.concat(*chars)


def word(bits: Column, alphabet: str, width: int) -> Column:
    """Random word over the alphabet; width must stay within 63 bits (see MAX_WORD)."""
    return spell(below(bits, len(alphabet) ** width), alphabet, width)


def max_word(alphabet: str) -> int:
    """Longest word one draw can fill with a negligible bias."""
    width = 1
    while len(alphabet) ** (width + 1) < 2 ** 58:
        width += 1
    return width


def random_text(key: int, row: Column, alphabet: str, width: int, k: int | Column = 0,
                idx: Sequence[Column] = ()) -> Column:
    """Random text of a fixed width, one draw per word."""
    size = max_word(alphabet)
    parts = [word(draw(key, row, k, i, idx), alphabet, min(size, width - i * size))
             for i in range((width + size - 1) // size)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def uuid4(key: int, row: Column, k: int | Column = 0, idx: Sequence[Column] = ()) -> Column:
    """8-4-4-4-12 lower-case hex with version nibble 4."""
    a = F.lower(F.lpad(F.hex(raw_draw(key, row, k, 0, idx)), 16, "0"))
    b = F.lower(F.lpad(F.hex(raw_draw(key, row, k, 1, idx)), 16, "0"))
    return uuid_from_hex(a, b)


def name_uuid(key: int, row: Column) -> Column:
    """As ``uuid4``, with the variant digit (8, 9, a or b) too, as names of files have it."""
    value = uuid4(key, row)
    variant = F.translate(F.substring(value, 20, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(value, 1, 19), variant, F.substring(value, 21, 16))


def uuid_from_hex(a: Column, b: Column) -> Column:
    return F.concat(F.substring(a, 1, 8), F.lit("-"), F.substring(a, 9, 4), F.lit("-4"),
                    F.substring(a, 13, 3), F.lit("-"), F.substring(b, 1, 4), F.lit("-"),
                    F.substring(b, 5, 12))
