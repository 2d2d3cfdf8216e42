"""Python values as JSON values and back, and ranks of value lists."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, time, timedelta

from lathe.functions.infer import NONES
from lathe.sources.markup import plain

# Rank of each kind of value by collation.
UNIX_KINDS = (type(None), bool, int, float, time, date, datetime, timedelta, str)
EXCEL_KINDS = (int, float, time, date, datetime, timedelta, str, bool, type(None))


def to_json(value: object) -> object:
    return plain(value)


def from_json(value: object, kind: type) -> object:
    """A JSON value as a type; texts that mean no value are None, but '' is a text."""
    if value is None or isinstance(value, str) and value in NONES:
        return "" if kind is str and value == "" else None
    if kind is bool:
        if value in ("True", "False"):
            return value == "True"
        raise ValueError(value)
    if kind in (int, float, str):
        return kind(value)
    if kind in (date, datetime, time):
        return kind.fromisoformat(value)
    if kind is timedelta:
        days, _, seconds = value.partition("DT")
        return timedelta(int(days.lstrip("P")), float(seconds.rstrip("S")))
    raise TypeError(f"the type {kind} is not supported")


def _number(value: object) -> object:
    """Numbers and times on one scale: days since 1900."""
    if isinstance(value, datetime):
        return (value - datetime(1900, 1, 1)) / timedelta(days=1)
    if isinstance(value, date):
        return float((value - date(1900, 1, 1)).days)
    if isinstance(value, time):
        return (value.hour * 3600 + value.minute * 60 + value.second + value.microsecond / 1e6) / 86400
    if isinstance(value, timedelta):
        return value / timedelta(days=1)
    return value


def _ranked(values: Iterable, key, reverse: bool) -> dict:
    out: dict = {}
    for v in sorted(dict.fromkeys((type(v), v) for v in values), key=lambda x: key(x[1]), reverse=reverse):
        out.setdefault(v[1], len(out))
    return out


def _fold(text: str) -> tuple:
    return (text.casefold(), [c.isupper() for c in text])


def text_sort(values: Iterable[str], reverse: bool = False) -> dict:
    """Rank of each text: letters before their capitals."""
    return _ranked(values, _fold, reverse)


def unix_sort(values: Iterable, reverse: bool = False) -> dict:
    """Rank of each value: None, booleans, numbers, times, dates, durations, text; reverse leaves text last."""
    values = list(values)
    rank = {k: i for i, k in enumerate(UNIX_KINDS)} | {float: 2, int: 2}
    texts = [v for v in values if isinstance(v, str)]
    rest = [v for v in values if not isinstance(v, str)]
    out = _ranked(rest, lambda v: (rank[type(v)], 0 if v is None else _number(v)), reverse)
    for v in _ranked(texts, _fold, reverse):
        out.setdefault(v, len(out))
    return out


def excel_sort(values: Iterable, reverse: bool = False) -> dict:
    """Rank of each value: numbers and times, text, booleans, None; reverse turns all of it."""
    rank = {k: 0 for k in EXCEL_KINDS} | {str: 1, bool: 2, type(None): 3}
    key = lambda v: (rank[type(v)], 0 if v is None else _fold(v) if isinstance(v, str) else _number(v))
    return _ranked(values, key, reverse)
