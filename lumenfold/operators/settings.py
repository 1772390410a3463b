"""Edits to a person's settings: small lists and weights, on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def added(old: Iterable[str], new: Iterable[str]) -> list[str]:
    """The list with what it doesn't have yet, letters' case aside."""
    out = list(old)
    seen = {x.strip().lower() for x in out}
    for x in new:
        key = x.strip().lower()
        if key and key not in seen:
            seen.add(key)
            out.append(x.strip())
    return out


def removed(old: Iterable[str], gone: Iterable[str]) -> list[str]:
    keys = {x.strip().lower() for x in gone}
    return [x for x in old if x.strip().lower() not in keys]


def weighted(old: Mapping[str, float] | None, changes: Mapping[str, float], defaults: Mapping[str, float], low: float = 0, high: float = 5) -> dict[str, float]:
    """Weights with changes within bounds; where none were set, the full defaults are written down first, as a value replaces them whole."""
    out = dict(defaults if old is None else old)
    for k, v in changes.items():
        out[k] = max(low, min(high, v))
    return out


def edited(old: Iterable[str] | None, defaults: Iterable[str], add: Iterable[str] = (), remove: Iterable[str] = ()) -> list[str]:
    """A list setting after additions and removals; an unset one starts from the defaults."""
    return removed(added(defaults if old is None else old, add), remove)
