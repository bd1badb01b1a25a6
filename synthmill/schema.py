"""The schema tree: small driver-side metadata that compiles to Spark columns.

A schema holds one :class:`Field` per key.  Leaves carry the format sample and the
generation constraints; objects and arrays carry children.  The tree never holds data.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

VALUE, OBJECT, ARRAY = "value", "object", "array"


@dataclass(frozen=True)
class Field:
    key: str
    kind: str = VALUE
    sample: str | None = None
    null_rate: float = 0.0
    enum: tuple[str, ...] = ()
    min_length: int | None = None
    max_length: int | None = None
    min: float | None = None
    max: float | None = None
    pattern: str | None = None
    is_primary: bool = False
    is_unique: bool = False
    relationship: str | None = None
    override: str | None = None
    pool: str | None = None
    source_keys: tuple[str, ...] = ()
    children: tuple["Field", ...] = ()

    def __post_init__(self):
        if self.kind not in (VALUE, OBJECT, ARRAY):
            raise ValueError(f"unknown field kind {self.kind!r}")
        object.__setattr__(self, "enum", tuple(v for v in (str(e).strip() for e in self.enum) if v))
        object.__setattr__(self, "source_keys", tuple(self.source_keys))
        object.__setattr__(self, "children", tuple(self.children))
        _reject_duplicates(self.children, self.name)

    @property
    def name(self) -> str:
        """Trimmed key; a blank key is called ``field``."""
        return (self.key or "").strip() or "field"

    @property
    def is_leaf(self) -> bool:
        return self.kind == VALUE and not self.children

    @property
    def unique(self) -> bool:
        return self.is_primary or self.is_unique

    @property
    def holds_scalars(self) -> bool:
        """An array with exactly one scalar child is an array of scalars."""
        return self.kind == ARRAY and len(self.children) == 1 and self.children[0].is_leaf

    def write_key(self, path: str) -> str:
        """Bank key the values of this leaf are stored under."""
        if (self.pool or "").strip():
            return f"pool:{self.pool.strip()}"
        override = (self.override or "").strip()
        if override and override.lower() != self.name.lower():
            return f"{override}/{path}"
        return path

    def read_keys(self, path: str) -> list[str]:
        """Bank keys this leaf draws from, in order, without case-insensitive repeats."""
        keys: dict[str, str] = {}
        for key in (self.write_key(path), path, *self.source_keys):
            if key.strip():
                keys.setdefault(key.strip().lower(), key.strip())
        return list(keys.values())


def _reject_duplicates(fields: tuple[Field, ...], where: str) -> None:
    names = [f.name for f in fields]
    if len(set(names)) != len(names):
        raise ValueError(f"repeated key below {where!r}: {sorted(n for n in set(names) if names.count(n) > 1)}")


@dataclass(frozen=True)
class Schema:
    name: str
    root: tuple[Field, ...]
    id: str | None = None
    tied_paths: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "root", tuple(self.root))
        object.__setattr__(self, "tied_paths", tuple(p.strip() for p in self.tied_paths if p.strip()))
        _reject_duplicates(self.root, self.name)

    def leaves(self) -> Iterator[tuple[str, Field]]:
        """(dot path, leaf) of every value leaf, in tree order."""
        yield from _leaves(self.root, "")

    def leaf_paths(self) -> list[str]:
        return [path for path, _ in self.leaves()]

    def samples(self) -> list[tuple[str, str]]:
        """(write key, sample) of every leaf with a non-blank sample."""
        return [(f.write_key(p), f.sample) for p, f in self.leaves() if (f.sample or "").strip()]

    def hash(self) -> str:
        """First 16 hex digits of the SHA-256 of the canonical tree, without ids and times."""
        text = json.dumps(
            {"name": self.name, "csvTiedFieldPaths": list(self.tied_paths),
             "root": [_canonical(f) for f in self.root]},
            separators=(",", ":"), ensure_ascii=False)
        return hashlib.sha256(text.encode("utf-8")).hexdigest()[:16]

    def with_modes(self, modes: dict[str, str] | None = None, default: str = "random") -> "Schema":
        """Rewrite leaf flags from per-path modes.

        ``same`` ties the leaf to its sample, ``unique`` forbids repeats, ``random`` drops both flags.
        """
        modes = modes or {}
        tied: list[str] = []

        def visit(node: Field, prefix: str) -> Field:
            path = f"{prefix}.{node.name}" if prefix else node.name
            if not node.is_leaf:
                return replace(node, children=tuple(visit(c, path) for c in node.children))
            mode = modes.get(path) or modes.get(path.lower()) or default
            if mode == "same":
                tied.append(path)
            elif mode not in ("unique", "random"):
                raise ValueError(f"unknown field mode {mode!r}")
            return replace(node, is_unique=mode == "unique",
                           is_primary=node.is_primary and mode == "unique")

        root = tuple(visit(f, "") for f in self.root)
        return replace(self, root=root, tied_paths=tuple(tied))

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), ensure_ascii=False)

    @staticmethod
    def from_json(text: str) -> "Schema":
        doc = json.loads(text)
        return Schema(doc["name"], tuple(_field(f) for f in doc["root"]), doc.get("id"),
                      tuple(doc.get("tied_paths") or ()))


def _field(doc: dict) -> Field:
    return Field(**{**doc, "children": tuple(_field(c) for c in doc.get("children", ()))})


def _leaves(fields: tuple[Field, ...], prefix: str) -> Iterator[tuple[str, Field]]:
    for f in fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        if f.is_leaf:
            yield path, f
        else:
            yield from _leaves(f.children, path)


def _number(v: float | None):
    return int(v) if v is not None and float(v).is_integer() else v


def _canonical(f: Field) -> dict:
    # Names and order of the canonical properties; absent ones are left out.
    pairs = [
        ("key", f.key), ("kind", f.kind), ("sampleValue", f.sample),
        ("nullRate", _number(f.null_rate) or None), ("enumValues", list(f.enum) or None),
        ("minLength", f.min_length), ("maxLength", f.max_length),
        ("min", _number(f.min)), ("max", _number(f.max)), ("pattern", f.pattern),
        ("isPrimary", f.is_primary), ("isUnique", f.is_unique),
        ("relationship", f.relationship), ("categoryOverride", f.override),
        ("historyPool", f.pool), ("historySourceKeys", list(f.source_keys) or None),
        ("children", [_canonical(c) for c in f.children]),
    ]
    return {k: v for k, v in pairs if v is not None}
