"""Format kinds: the seventeen ways a text value can look.

The same rules exist twice, on purpose: :func:`kind_columns` runs over whole columns in
one aggregation, :func:`detect` decides for one field on the driver when a schema compiles.
Both read the patterns below.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, functions as F

# Kind patterns, restricted to syntax that Java, Python and RE2 share.
BOOL = r"^(?i:true|false)$"
DATE_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,3})?(Z|[+-][0-9]{2}:[0-9]{2})?$"
DATE_US = r"^(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])/[0-9]{4}$"
DATE_EU = r"^(0?[1-9]|[12][0-9]|3[01])/(0?[1-9]|1[0-2])/[0-9]{4}$"
DATE_SLASH_YMD = r"^[0-9]{4}/(0?[1-9]|1[0-2])/(0?[1-9]|[12][0-9]|3[01])$"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
UUID = r"^(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$"
PERCENT = r"^-?[0-9]+(\.[0-9]+)?%$"
CURRENCY = r"^[$€£]?-?([0-9]{1,3}(,[0-9]{3})*|[0-9]+)(\.[0-9]+)?$"
CURRENCY_MARK = r"[$€£,]"
INT = r"^-?[0-9]+$"
INT_PADDED = r"^-?0[0-9]+$"
FLOAT = r"^-?[0-9]+\.[0-9]+$"
PHONE = r"^\+?[0-9\s().-]{7,20}$"
ALPHA = r"^[A-Za-z]+$"
ALNUM = r"^[A-Za-z0-9_-]+$"

WHITESPACE = " \t\n\r\f\x0b\u00a0\ufeff"

DATE_KINDS = ("date-iso", "datetime-iso", "date-us", "date-eu", "date-slash-ymd")
NUMERIC_KINDS = ("int", "int-padded", "float", "currency", "percent")

# The order in which kinds are tried.  "intent" lets plain numbers stay numbers; "reference"
# tests currency first, so that bare numbers become amounts.
_PLAIN = ("int-padded", "int", "float")
ORDERS = {
    "intent": ("percent", *_PLAIN, "currency"),
    "reference": ("percent", "currency", *_PLAIN),
}
_TEXT_TESTS = (("bool", BOOL), ("date-iso", DATE_ISO), ("datetime-iso", DATETIME_ISO))
_SLASH_DATES = (("date-slash-ymd", DATE_SLASH_YMD), ("date-us", DATE_US), ("date-eu", DATE_EU))
_ID_TESTS = (("email", EMAIL), ("uuid", UUID))
_NUMBER_TESTS = {"percent": PERCENT, "currency": CURRENCY, "int": INT, "float": FLOAT}


def trim(c: Column) -> Column:
    """Strip white space as text tools do, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def loose_number(c: Column) -> Column:
    """Number behind currency signs, thousands commas and percent; NULL when there is none."""
    return F.regexp_replace(trim(c), r"[$€£,%]", "").try_cast("double")


def coerced_type(c: Column) -> Column:
    """Type tag a schema sample is read as."""
    s = trim(c)
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(s == "", "text").when(s.isin("true", "false"), "bool").when(s == "null", "null")
            .when(_exact_int(s), "int").when(s.rlike(FLOAT), "float").otherwise("text"))


def _exact_int(s: Column) -> Column:
    """Whole numbers that a double holds; few characters are few enough digits."""
    return s.rlike(INT) & ((F.length(s) <= 15) | (F.abs(s.try_cast("decimal(38,0)")) <= F.lit(2 ** 53 - 1)))


def coerced_text(c: Column) -> Column:
    """Text that goes with :func:`coerced_type`; scalars are trimmed, other text is kept.

    The tests are those of the type, each made once: with the type itself in several branches, a stage that holds both
    columns exceeds the size HotSpot compiles.
    """
    s = trim(c)
    return (F.when(s == "null", F.lit(None).cast("string")).when((s == "") | s.isin("true", "false"), s)
            .when(_exact_int(s), F.when(F.length(s) <= 15, s.try_cast("bigint").cast("string")).otherwise(s.try_cast("decimal(38,0)").cast("string")))
            .when(s.rlike(FLOAT), s).otherwise(c))


def coerce_sample(text: str):
    """Driver-side form for one sample: bool, int, float, None or the text itself."""
    s = text.strip(WHITESPACE)
    if s in ("true", "false"):
        return s == "true"
    if s == "null":
        return None
    if re.search(INT, s) and abs(int(s)) < 2 ** 53:
        return int(s)
    if re.search(FLOAT, s):
        return float(s)
    return "" if s == "" else text


def phone_like(c: Column) -> Column:
    return c.rlike(PHONE) & (F.length(F.regexp_replace(c, r"[^0-9]", "")) >= 7)


def match_flags(value: Column) -> dict[str, Column]:
    """One boolean per kind test; aggregate each with ``bool_and``.

    Cheap looks at the length and the first and last character keep most patterns from running.
    """
    n, first, last = F.length(value), F.left(value, F.lit(1)), F.right(value, F.lit(1))
    ends_in_digit = (last >= "0") & (last <= "9")
    starts_number = ((first >= "0") & (first <= "9")) | first.isin("-", "$", "€", "£")
    numeric = ends_in_digit & starts_number
    slashes = F.contains(value, F.lit("/")) & n.between(8, 10)
    likely = {
        "bool": n.between(4, 5), "date-iso": n == 10, "datetime-iso": n.between(19, 29),
        "email": F.contains(value, F.lit("@")), "uuid": n == 36, "percent": last == "%",
        "currency": numeric, "int": numeric & ~first.isin("$", "€", "£"),
        "float": numeric & F.contains(value, F.lit(".")),
    }
    likely |= {name: slashes for name, _ in _SLASH_DATES}
    patterns = dict((*_TEXT_TESTS, *_SLASH_DATES, *_ID_TESTS)) | _NUMBER_TESTS
    flags = {name: likely[name] & value.rlike(rx) for name, rx in patterns.items()}
    flags["phone"] = n.between(7, 20) & phone_like(value)
    flags["alpha"] = ~ends_in_digit & value.rlike(ALPHA)
    flags["alnum"] = value.rlike(ALNUM)
    return flags


def kind_columns(every: dict[str, Column], any_padded: Column, sample: Column,
                 order: str = "intent") -> Column:
    """Kind from aggregated flags.  A sample, where given, decides alone unless the values agree.

    ``every`` maps test name to "all pooled values match"; the pool includes the sample.
    """
    has = sample.isNotNull() & (sample != "")

    def test(name: str, rx: str | None = None) -> Column:
        own = phone_like(sample) if name == "phone" else sample.rlike(rx or _NUMBER_TESTS[name])
        return F.coalesce(has & own, F.lit(False)) | F.coalesce(every[name], F.lit(False))

    us, eu = sample.rlike(DATE_US), sample.rlike(DATE_EU)
    iso = F.when(has, sample.rlike(DATE_ISO)).otherwise(every["date-iso"])
    chain: list[tuple[Column, str]] = [
        (test("bool", BOOL), "bool"), (F.coalesce(iso, F.lit(False)), "date-iso"),
        (test("datetime-iso", DATETIME_ISO), "datetime-iso"),
        (F.coalesce(has & us & ~eu, F.lit(False)), "date-us"),
        (F.coalesce(has & eu, F.lit(False)), "date-eu"),
    ]
    chain += [(test(n, rx), n) for n, rx in (*_SLASH_DATES, *_ID_TESTS)]
    for name in ORDERS[order]:
        if name == "int-padded":
            padded = F.coalesce(has & sample.rlike(INT_PADDED), F.lit(False)) | (
                test("int") & F.coalesce(any_padded, F.lit(False)))
            chain.append((padded, name))
        else:
            chain.append((test(name), name))
    chain += [(test("phone"), "phone"), (test("alpha", ALPHA), "alpha"), (test("alnum", ALNUM), "alnum")]
    out = F
    for condition, name in chain:
        out = out.when(condition, name)
    return out.otherwise("string")


@dataclass(frozen=True)
class Pattern:
    """What a field looks like: its kind and the statistics its synthesiser needs."""

    kind: str
    samples: tuple[str, ...] = ()
    min_len: int = 4
    max_len: int = 12
    low: Fraction | None = None
    high: Fraction | None = None
    decimals: int = 0
    pad_width: int = 0
    prefix: str = ""
    thousands: bool = False


def parse_number(text: str) -> Fraction | None:
    s = re.sub(r"[$€£,%]", "", text)
    return Fraction(s) if re.fullmatch(r"-?[0-9]+(\.[0-9]+)?", s) else None


def decimal_places(text: str) -> int:
    m = re.search(r"\.([0-9]+)", text)
    return len(m.group(1)) if m else 0


def detect(values: Iterable[str], sample: str | None = None, order: str = "intent") -> Pattern:
    """Kind and statistics of one field from its sample and up to 500 bank values."""
    sample = (sample or "").strip(WHITESPACE)
    pool = list(dict.fromkeys(v for v in [sample, *(v.strip(WHITESPACE) for v in values)] if v))
    if not pool:
        return Pattern("string")
    lead = [sample] if sample else pool

    def all_match(rx: str, texts: list[str]) -> bool:
        return all(re.search(rx, t) for t in texts)

    def either(rx: str) -> bool:
        return all_match(rx, lead) or all_match(rx, pool)

    def phone(t: str) -> bool:
        return bool(re.search(PHONE, t)) and len(re.sub(r"[^0-9]", "", t)) >= 7

    lens = [len(p) for p in pool]
    base = dict(samples=tuple(pool), min_len=min(lens), max_len=max(lens))

    def numeric(kind: str) -> Pattern:
        # Only values that are numbers of the kind's own sort feed the range.
        tests = {"int": (INT,), "int-padded": (INT,), "float": (INT, FLOAT)}.get(kind, (PERCENT, CURRENCY))
        fitting = [p for p in pool if any(re.search(rx, p) for rx in tests)]
        nums = [parse_number(p) for p in fitting] or [Fraction(0), Fraction(999)]
        places = max((decimal_places(p) for p in fitting), default=0)
        thousands = kind == "currency" and any("," in p for p in fitting)
        mark = re.match(r"[$€£]", sample or pool[0])
        return Pattern(
            kind, **base, low=min(nums), high=max(nums),
            decimals={"percent": places, "float": max(places, 1), "currency": max(places, 2 if thousands else 0) or 2}.get(kind, 0),
            pad_width=max(len(p.removeprefix("-")) for p in ([sample] if re.search(INT_PADDED, sample) else fitting))
            if kind == "int-padded" else 0,
            prefix=(mark.group(0) if mark else "$") if kind == "currency" else "", thousands=thousands)

    if either(BOOL):
        return Pattern("bool", **{**base, "min_len": 4, "max_len": 5})
    if all_match(DATE_ISO, lead):
        return Pattern("date-iso", **base)
    if either(DATETIME_ISO):
        return Pattern("datetime-iso", **base)
    if sample and re.search(DATE_EU, sample):
        return Pattern("date-eu", **base)
    if sample and re.search(DATE_US, sample):
        return Pattern("date-us", **base)
    for kind, rx in (*_SLASH_DATES, *_ID_TESTS):
        if either(rx):
            return Pattern(kind, **base)
    for kind in ORDERS[order]:
        if kind == "int-padded":
            if (sample and re.search(INT_PADDED, sample)) or (
                    either(INT) and any(re.search(INT_PADDED, p) for p in pool)):
                return numeric(kind)
        elif either(_NUMBER_TESTS[kind]):
            return numeric(kind)
    if (sample and phone(sample)) or all(phone(p) for p in pool):
        return Pattern("phone", **base)
    if either(ALPHA):
        return Pattern("alpha", **base)
    if either(ALNUM):
        return Pattern("alnum", **base)
    return Pattern("string", **base)
