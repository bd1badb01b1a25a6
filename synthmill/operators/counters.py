"""Counters of a run.

Whatever makes or changes values registers its own counter beside its code, and reports events of it per value.  A report
has the registered counters in the order of their registration; a counter without events in a run is 0.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

_meanings: dict[str, str] = {}

#: What happened to one value: 0, 1 or more events by counter.
Events = dict[str, Column]


def counter(name: str, meaning: str) -> str:
    if name in _meanings:
        raise ValueError(f"counter {name} is there already")
    _meanings[name] = meaning
    return name


def names() -> list[str]:
    return list(_meanings)


def meanings() -> dict[str, str]:
    return dict(_meanings)


def together(parts: Iterable[Events]) -> Events:
    """Events of several values."""
    out: Events = {}
    for events in parts:
        for name, n in events.items():
            out[name] = out[name] + n if name in out else n
    return out


def where(condition: Column, events: Events) -> Events:
    """Events that happen under a condition only."""
    return {name: F.when(condition, n).otherwise(0) for name, n in events.items()}


def columns(events: Events) -> list[Column]:
    """One column for each counter."""
    return [events.get(name, F.lit(0)).cast("long").alias(name) for name in names()]
