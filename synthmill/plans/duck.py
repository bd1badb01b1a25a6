"""DuckDB text for the draws, written independently of the Spark columns.

The hash is spelled out in 128-bit arithmetic modulo 2**64; each step is bound once by a
one-element ``list_transform`` so that the text does not grow with every use.
"""

from __future__ import annotations

import itertools

from synthmill.functions.draws import ALNUM, DIGITS, LOWER, UPPER, draw_key, max_word

# The primes of the public XXH64 algorithm.
P1 = 11400714785074694791
P2 = 14029467366897019727
P3 = 1609587929392839161
P4 = 9650029242287828579
P5 = 2870177450012600261
M = 2 ** 64
_names = itertools.count()


def _big(v: int) -> str:
    return f"{v % M}::UHUGEINT"


_M = f"{M}::UHUGEINT"


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) % M


def _hash(value: int, seed: int) -> int:
    h = (seed + P5 + 8) % M ^ _rotl(value % M * P2 % M, 31) * P1 % M
    h = (_rotl(h, 27) * P1 + P4) % M
    h = (h ^ h >> 33) * P2 % M
    h = (h ^ h >> 29) * P3 % M
    return h ^ h >> 32


def let(value: str, body) -> str:
    """Bind ``value`` to a name used in ``body(name)``."""
    name = f"v{next(_names)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def _hash_sql(value: str, seed: str) -> str:
    x = let(f"(({value})::UHUGEINT * {_big(P2)}) % {_M}",
            lambda v: f"((({v} * {2 ** 31}::UHUGEINT) % {_M} + {v} // {2 ** 33}::UHUGEINT) * {_big(P1)}) % {_M}")
    x = f"xor({x}, ({seed} + {_big(P5 + 8)}) % {_M})"
    x = let(x, lambda v: f"((({v} * {2 ** 27}::UHUGEINT) % {_M} + {v} // {2 ** 37}::UHUGEINT) * {_big(P1)} + {_big(P4)}) % {_M}")
    x = let(x, lambda v: f"(xor({v}, {v} // {2 ** 33}::UHUGEINT) * {_big(P2)}) % {_M}")
    x = let(x, lambda v: f"(xor({v}, {v} // {2 ** 29}::UHUGEINT) * {_big(P3)}) % {_M}")
    return let(x, lambda v: f"xor({v}, {v} // {2 ** 32}::UHUGEINT)")


def bits64(key: int, *parts: int | str) -> str:
    """UHUGEINT hash of the key and the address parts; leading numbers fold into the seed."""
    seed, known = _hash(key, 42), True
    for part in parts:
        if known and isinstance(part, int):
            seed = _hash(part, seed)
        else:
            seed, known = _hash_sql(str(part), _big(seed) if known else seed), False
    return _big(seed) if known else seed


class Leaf:
    """Draws of one leaf, over a row expression and optional array indexes."""

    def __init__(self, seed: int, path: str, row: str, *idx: str):
        self.seed, self.path, self.row, self.idx = seed, path, row, idx

    def raw(self, purpose: str, k: int | str = 0, p: int | str = 0) -> str:
        return bits64(draw_key(self.seed, self.path, purpose), k, p, self.row, *self.idx)

    def draw(self, purpose: str, k: int | str = 0, p: int | str = 0) -> str:
        return f"(({self.raw(purpose, k, p)}) // 2)::BIGINT"

    def chance(self, purpose: str, probability: float, k: int | str = 0, p: int | str = 0) -> str:
        return f"({self.draw(purpose, k, p)} % 1000000 < {round(probability * 1_000_000)})"

    def below(self, purpose: str, n: int | str, k: int | str = 0, p: int | str = 0) -> str:
        return f"({self.draw(purpose, k, p)} % ({n}))"

    def pick(self, purpose: str, values: list[str] | str, k: int | str = 0) -> str:
        listed = values if isinstance(values, str) else "[" + ", ".join(quote(v) for v in values) + "]"
        size = f"len({listed})" if isinstance(values, str) else len(values)
        return f"({listed})[1 + {self.below(purpose, size, k)}]"

    def word(self, purpose: str, alphabet: str, width: int, k: int | str = 0, p: int | str = 0) -> str:
        return spell(self.below(purpose, len(alphabet) ** width, k, p), alphabet, width)

    def text(self, purpose: str, alphabet: str, width: int, k: int | str = 0) -> str:
        size = max_word(alphabet)
        return " || ".join(self.word(purpose, alphabet, min(size, width - i), k, i // size)
                           for i in range(0, width, size))

    def fill(self, purpose: str, template: str, k: int | str = 0) -> str:
        """Template with every run of digits or letters redrawn."""
        parts, runs = [], []
        for ch in template:
            alphabet = next((a for a in (DIGITS, LOWER, UPPER) if ch in a), "")
            if runs and runs[-1][0] == alphabet:
                runs[-1][1] += ch
            else:
                runs.append([alphabet, ch])
        j = 0
        for alphabet, text in runs:
            if not alphabet:
                parts.append(quote(text))
                j += 1
                continue
            size = max_word(alphabet)
            for start in range(0, len(text), size):
                parts.append(self.word(purpose, alphabet, min(size, len(text) - start), k, j))
                j += 1
        return "(" + " || ".join(parts) + ")"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def spell(value: str, alphabet: str, width: int) -> str:
    base = len(alphabet)
    if alphabet == DIGITS:
        return f"lpad(({value})::VARCHAR, {width}, '0')"
    return let(value, lambda v: "(" + " || ".join(
        f"substr('{alphabet}', 1 + ({v} // {base ** (width - 1 - j)}) % {base}, 1)" for j in range(width)) + ")")


def permuted(ordinal: str, size: int, seed: int, path: str) -> str:
    """Affine permutation of a small space; constants come from the plan."""
    from synthmill.functions.permute import affine
    mult, offset = affine(seed, path, size)
    return f"((({ordinal}) % {size} * {mult} + {offset}) % {size})"


def permuted_wide(ordinal: str, size: int, seed: int, path: str) -> str:
    half = 2 ** 30
    high_size = min(size // half, half)

    def shift(value: str, by: str, name: str, modulus: int) -> str:
        return f"(({value}) + {Leaf(seed, path, by).below(name, modulus)}) % {modulus}"
    return let(f"{{'l': ({ordinal}) % {half}, 'h': (({ordinal}) // {half}) % {high_size}}}", lambda a:
               let(f"{{'l': {a}.l, 'h': {shift(f'{a}.h', f'{a}.l', 'high', high_size)}}}", lambda b:
                   f"({b}.h * {half} + {shift(f'{b}.l', f'{b}.h', 'low', half)})"))


def date_text(ms: str, kind: str) -> str:
    form = {"date-iso": "%Y-%m-%d", "date-us": "%m/%d/%Y", "date-eu": "%d/%m/%Y",
            "date-slash-ymd": "%Y/%m/%d", "datetime-iso": "%Y-%m-%dT%H:%M:%S.%gZ"}[kind]
    return f"strftime(epoch_ms({ms}), '{form}')"


__all__ = ["ALNUM", "DIGITS", "LOWER", "UPPER", "Leaf", "bits64", "date_text", "let", "permuted",
           "permuted_wide", "quote", "spell"]

TOKEN_TEXT = LOWER + DIGITS


def uuid_text(leaf: Leaf, purpose: str) -> str:
    halves = ", ".join(f"lower(lpad(to_hex(({leaf.raw(purpose, 0, p)})::UBIGINT), 16, '0'))" for p in (0, 1))
    return let(f"[{halves}]", lambda h: (
        f"({h}[1][1:8] || '-' || {h}[1][9:12] || '-4' || {h}[1][13:15] || '-' || translate({h}[2][1], '0123456789abcdef', '89ab89ab89ab89ab') || {h}[2][2:4] || '-' || {h}[2][5:16])"))
