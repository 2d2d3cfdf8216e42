"""Names of result columns."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime


def unique_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, or with the first of _1, _2, … that is free."""
    taken = set(taken)
    name, n = wanted, 0
    while name in taken:
        n += 1
        name = f"{wanted}_{n}"
    return name


def unique_names(wanted: Sequence[str], taken: Iterable[str] = ()) -> list[str]:
    """Names for all of ``wanted``, each free when its turn comes."""
    used, out = set(taken), []
    for w in wanted:
        out.append(unique_name(w, used))
        used.add(out[-1])
    return out


def shown(value: object) -> str:
    """A value as it appears in a column name."""
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, date):
        return value.isoformat()
    return str(value)


def require(columns: Iterable[str], names: Iterable[str]) -> None:
    """KeyError for names that are no columns."""
    if missing := [n for n in names if n not in set(columns)]:
        raise KeyError(f"no such column: {missing}")
