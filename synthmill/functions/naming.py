"""File name templates compiled to a column."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, types as T, functions as F

from synthmill.functions import draws as d
from synthmill.functions.paths import get_path
from synthmill.functions.text import is_scalar, scalar_text

# Defaults and limits of the naming rules.
DEFAULT_PATTERN = "{schema}_{index:04}.{ext}"
EPOCH_MS = 1_700_000_000_000
DAY_MS = 86_400_000
STAMP_FORMAT = "yyyyMMdd_HHmmss_SSS"
TIME_FORMAT = "HHmmss_SSS"
ILLEGAL = r'[<>:"|?*\x00-\x1f]'
NOT_ASCII = r"[^A-Za-z0-9_.\-()+@#&=,;\[\]{}!~$%^ ]+"
DEVICE = r"^(?i:con|prn|aux|nul|com[1-9]|lpt[1-9])$"
EXTENSIONS = {"yaml": "yml"}

RANDOM_PATH = "__name__"  # draw path of the random tokens


@dataclass(frozen=True)
class Naming:
    pattern: str = DEFAULT_PATTERN
    prefix: str = ""
    suffix: str = ""
    index_pad: int = 4
    collision: str = "suffix"      # suffix, skip or overwrite
    sanitize: str = "windows"      # windows or ascii
    deterministic: bool = False
    ensure_unique: bool = True

    @property
    def policy(self) -> str:
        """With unique names every record keeps a file, so clashes always get a suffix."""
        return "suffix" if self.ensure_unique else self.collision


def clean_segment(text: str, mode: str = "windows") -> str:
    """One path segment made safe, on the driver."""
    s = re.sub(ILLEGAL, "", text)
    if mode == "ascii":
        s = re.sub(NOT_ASCII, "_", s)
    s = re.sub(r"[. ]+$", "", s).strip()
    s = f"_{s}" if re.match(DEVICE, s) else s
    return s or "unnamed"


def clean_path(path: Column, mode: str = "windows") -> Column:
    """Every segment of a relative path made safe."""

    def clean(part: Column) -> Column:
        s = F.regexp_replace(part, ILLEGAL, "")
        if mode == "ascii":
            s = F.regexp_replace(s, NOT_ASCII, "_")
        s = F.trim(F.regexp_replace(s, r"[. ]+$", ""))
        return F.when(s == "", "unnamed").when(s.rlike(DEVICE), F.concat(F.lit("_"), s)).otherwise(s)

    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    return F.array_join(F.transform(parts, clean), "/")


def clock(row: Column, seed: int, deterministic: bool, now_ms: int) -> Column:
    """Milliseconds of a record: one apart in a live run, one second apart in a deterministic one."""
    if deterministic:
        return d.long(EPOCH_MS + seed % DAY_MS + 1000) + d.long(row) * d.long(1000)
    return d.long(now_ms) + d.long(row)


def format_clock(ms: Column, pattern: str) -> Column:
    """Milliseconds (UTC) in a pattern of yyyy, yy, MM, dd, HH, mm, ss and SSS."""
    iso = F.date_from_unix_date(d.div(ms, DAY_MS).cast("int")).cast("string")
    rest = ms % d.long(DAY_MS)

    def part(step: int, modulus: int, width: int) -> Column:
        return F.lpad((d.div(rest, step) % d.long(modulus)).cast("string"), width, "0")

    fields = {"yyyy": F.substring(iso, 1, 4), "yy": F.substring(iso, 3, 2), "MM": F.substring(iso, 6, 2),
              "dd": F.substring(iso, 9, 2), "HH": part(3_600_000, 24, 2), "mm": part(60_000, 60, 2),
              "ss": part(1000, 60, 2), "SSS": part(1, 1000, 3)}
    pieces = re.split(r"(yyyy|yy|MM|dd|HH|mm|ss|SSS)", pattern)
    return F.concat(*[fields.get(p, F.lit(p)) for p in pieces if p])


def field_fragment(schema: T.StructType, path: str) -> Column:
    """Record value as a name fragment: '' when absent, objects as JSON."""
    c = get_path(schema, path)
    dtype: T.DataType | None = schema
    for part in path.split("."):
        dtype = dtype[part].dataType if isinstance(dtype, T.StructType) and part in dtype.names else None
    if dtype is None:
        return F.lit("")
    text = scalar_text(c, dtype) if is_scalar(dtype) else F.to_json(c)
    return F.coalesce(text, F.lit(""))


def tokens(pattern: str) -> list[tuple[str, str]]:
    """('text' | 'token', content) pieces of a template."""
    out = []
    for i, piece in enumerate(re.split(r"\{([^{}]+)\}", (pattern or DEFAULT_PATTERN).strip() or DEFAULT_PATTERN)):
        if piece:
            out.append(("token" if i % 2 else "text", piece.strip() if i % 2 else piece))
    return out


def split_field(body: str) -> tuple[str, str]:
    """(path, flag) of a field token."""
    path, bar, flag = body[len("field:"):].strip().rpartition("|")
    if not bar:
        return flag.strip(), ""
    flag = flag.strip().lower()
    return path.strip(), flag if flag in ("unique", "rand") else ""


@dataclass(frozen=True)
class NameContext:
    """What the tokens of a template stand for in one run."""

    schema: T.StructType
    schema_name: str
    fmt: str
    count: int
    seed: int
    now_ms: int = 0
    ext: str | None = None

    @property
    def extension(self) -> str:
        return (self.ext or EXTENSIONS.get(self.fmt, self.fmt) or "dat").lstrip(".")


def compile_name(naming: Naming, ctx: NameContext, row: Column,
                 fragments: Callable[[str], Column] | None = None) -> Column:
    """Relative path of each record, before collisions; ``row`` is 0-based, indexes are 1-based.

    ``fragments`` gives the resolved column of a ``{field:path|unique}`` token.
    """
    row = d.long(row)
    index = row + 1
    pad = min(max(naming.index_pad, 1), 12)
    ms = clock(row, ctx.seed, naming.deterministic, ctx.now_ms)

    def random(purpose: str, at: int) -> int:
        return d.draw_key(ctx.seed, RANDOM_PATH, f"{purpose}{at}")

    def number(width: int) -> Column:
        text = index.cast("string")
        return F.lpad(text, F.greatest(F.length(text), F.lit(width)), "0")

    def letters(at: int, n: int) -> Column:
        return d.random_text(random("rand", at), row, d.TOKEN, n)

    def token(body: str, at: int) -> Column:
        name, _, arg = body.partition(":")
        if body.lower().startswith("field:"):
            path, flag = split_field(body)
            value = field_fragment(ctx.schema, path)
            if flag == "rand":
                extra = letters(at, 6)
                return F.when(value == "", extra).otherwise(F.concat(value, F.lit("_"), extra))
            if flag == "unique":
                return fragments(path) if fragments else F.when(
                    value == "", F.concat(F.lit("v"), index.cast("string"))).otherwise(
                    F.concat(value, F.lit("_"), index.cast("string")))
            return value
        if name == "index":
            width = int(arg) if re.fullmatch(r"[0-9]+", arg) and int(arg) > 0 else pad
            return number(min(width, 12))
        if name in ("time", "datetime", "date"):
            return format_clock(ms, arg or (TIME_FORMAT if name == "time" else STAMP_FORMAT))
        if name == "rand":
            n = int(arg) if re.fullmatch(r"-?[0-9]+", arg) else 8
            return letters(at, min(max(n, 1), 64))
        fixed = {"count": str(ctx.count), "schema": clean_segment(ctx.schema_name or "schema", naming.sanitize),
                 "ext": ctx.extension, "format": ctx.fmt, "prefix": naming.prefix, "suffix": naming.suffix,
                 "seed": str(ctx.seed & 0xFFFFFFFF)}
        if body in fixed:
            return F.lit(fixed[body])
        if body == "seq":
            return number(pad)
        if body in ("ts", "timestamp"):
            return ms.cast("string")
        if body in ("uuid", "uuid8"):
            value = d.name_uuid(random("uuid", at), row)
            return value if body == "uuid" else F.substring(value, 1, 8)
        return F.lit("")

    pieces = tokens(naming.pattern)
    path = F.concat(*[F.lit(p) if kind == "text" else token(p, i) for i, (kind, p) in enumerate(pieces)])
    if "{ext}" not in naming.pattern and ctx.extension:
        leaf = F.element_at(F.split(path, "/"), -1)
        path = F.when(leaf.rlike(r"\.[A-Za-z0-9]+$"), path).otherwise(F.concat(path, F.lit(f".{ctx.extension}")))
    return clean_path(path, naming.sanitize)
