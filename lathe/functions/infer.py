"""Text to typed values, and the type that a column of texts has.

Parsers are Column expressions that give null where a text is no such value.
Numbers come plain, with European separators (1.234,5) or with American ones
(1,234.5); where both fit, European wins.  Dates come year first or day first, with
- . / or blank, or as eight digits.  A column's type is decided by one aggregation
that counts, for all columns at once, how many texts each parser takes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.session import enable_time

# Texts that mean no value.
NONES = ("null", "Null", "NULL", "#N/A", "#n/a", "", "None")
TYPES = ("bool", "int", "float", "date", "datetime", "time", "str")
SPARK = {"bool": "boolean", "int": "bigint", "float": "double", "date": "date", "datetime": "timestamp_ntz", "time": "time(6)", "str": "string"}

_EU_INT, _US_INT = r"^[+-]?[0-9]+(\.[0-9]{3})+$", r"^[+-]?[0-9]+(,[0-9]{3})+$"
_EXP = r"([eE][+-]?[0-9]+)?$"
_PLAIN_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)" + _EXP
_EU_FLOAT = r"^[+-]?([0-9]+(\.[0-9]{3})*(,[0-9]*)?|,[0-9]+)" + _EXP
_US_FLOAT = r"^[+-]?([0-9]+(,[0-9]{3})*(\.[0-9]*)?|\.[0-9]+)" + _EXP
_YMD = r"^([0-9]{4})([-./ ])([0-9]{1,2})\2([0-9]{1,2})"
_DMY = r"^([0-9]{1,2})([-./ ])([0-9]{1,2})\2([0-9]{4})"
_COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})"
_CLOCK = r"([0-9]{1,2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]{1,9}))?)?$"
_ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"
_FRACTION = r"(?:[.,]([0-9]{1,6})[0-9]{0,3})?$"
#: What may follow a date, and what it becomes: nothing, a clock with colons, or one without; a missing fraction leaves a last 0.
_TAILS = (
    (r"$", ""), (r"[T ]?([0-9]{1,2}):([0-9]{2}):([0-9]{2})" + _FRACTION, " {h}:{m}:{s}.{f}0"), (r"[T ]?([0-9]{1,2}):([0-9]{2})$", " {h}:{m}:00"),
    (r"[T ]?([0-9]{2})([0-9]{2})([0-9]{2})" + _FRACTION, " {h}:{m}:{s}.{f}0"), (r"[T ]?([0-9]{2})([0-9]{2})" + _FRACTION, " {h}:{m}:00.{g}0"),
)


def is_none(text: Column) -> Column:
    return text.isNull() | text.isin(*NONES)


def _bare(text: Column) -> Column:
    return F.translate(text, "\"' ", "")


def parse_int(text: Column, locale: str | None = None) -> Column:
    """locale: plain, eu, us or None for the first that fits."""
    t = _bare(text)
    ways = {
        "plain": t.try_cast("bigint"),
        "eu": F.when(t.rlike(_EU_INT), F.translate(t, ".", "").try_cast("bigint")),
        "us": F.when(t.rlike(_US_INT), F.translate(t, ",", "").try_cast("bigint")),
    }
    return F.coalesce(*ways.values()) if locale is None else F.coalesce(ways["plain"], ways[locale]) if locale != "plain" else ways["plain"]


def parse_float(text: Column, locale: str | None = None) -> Column:
    t = _bare(text)
    eu = F.translate(t, ",.", ".")
    ways = {
        "plain": F.when(t.rlike(_PLAIN_FLOAT), t.try_cast("double")).when(F.lower(t).isin("nan", "inf", "-inf", "infinity", "-infinity"), t.try_cast("double")),
        "eu": F.when(t.rlike(_EU_FLOAT), eu.try_cast("double")),
        "us": F.when(t.rlike(_US_FLOAT), F.translate(t, ",", "").try_cast("double")),
    }
    return F.coalesce(*ways.values()) if locale is None else F.coalesce(ways["plain"], ways[locale]) if locale != "plain" else ways["plain"]


def parse_bool(text: Column) -> Column:
    return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)


def _dates(american: bool) -> tuple[tuple[str, str], ...]:
    """The forms of a date at the front of a text, and the replacement that makes yyyy-M-d of each; no text has two of them."""
    return (_YMD, "$1-$3-$4"), (_DMY, "$4-$1-$3" if american else "$4-$3-$1"), (_COMPACT, "$1-$2-$3")


def parse_date(text: Column, american: bool = False) -> Column:
    """A text that is a date and nothing else."""
    out = None
    for form, new in _dates(american):
        fits, value = text.rlike(form + "$"), F.regexp_replace(text, form, new).try_cast("date")
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def parse_datetime(text: Column, american: bool = False) -> Column:
    """A date with a time of day; a bare date is midnight."""
    # what is in ISO form already needs no replacement
    out = F.when(text.rlike(_ISO), text.try_cast("timestamp_ntz"))
    for form, new in _dates(american):
        n = 3 if form == _COMPACT else 4  # groups of the date
        clock = None
        for tail, time in _TAILS:
            value = F.regexp_replace(text, form + tail, new + time.format(h=f"${n + 1}", m=f"${n + 2}", s=f"${n + 3}", f=f"${n + 4}", g=f"${n + 3}")).try_cast("timestamp_ntz")
            fits = text.rlike(form + tail)
            clock = F.when(fits, value) if clock is None else clock.when(fits, value)
        out = out.when(text.rlike(form), clock)
    return out


def time_text(text: Column) -> Column:
    """A time of day as HH:mm:ss.ffffff; it has a colon."""
    get = lambda i: F.regexp_extract(text, "^" + _CLOCK, i)
    second, fraction = F.when(get(3) == "", "00").otherwise(get(3)), F.when(get(4) == "", "0").otherwise(F.substring(get(4), 1, 6))
    full = F.concat(F.lpad(get(1), 2, "0"), F.lit(":"), get(2), F.lit(":"), second, F.lit("."), F.rpad(fraction, 6, "0"))
    return F.when(text.rlike("^" + _CLOCK) & (F.lpad(get(1), 2, "0") < "24") & (get(2) < "60") & (second < "60"), full)


def parse_time(text: Column) -> Column:
    """A time of day, in a session that has the type."""
    return time_text(text).try_cast("time(6)")


PARSERS = {
    "bool": parse_bool,
    "int_plain": lambda t: parse_int(t, "plain"),
    "int_eu": lambda t: parse_int(t, "eu"),
    "int_us": lambda t: parse_int(t, "us"),
    "float_plain": lambda t: parse_float(t, "plain"),
    "float_eu": lambda t: parse_float(t, "eu"),
    "float_us": lambda t: parse_float(t, "us"),
    "date": parse_date,
    "date_us": lambda t: parse_date(t, american=True),
    "datetime": parse_datetime,
    "datetime_us": lambda t: parse_datetime(t, american=True),
    "time": time_text,
}
#: What a column may be, in the order in which it is tried: a parser has to take every value.
ORDER = ("bool", "int_plain", "int_eu", "int_us", "float_plain", "float_eu", "float_us", "date", "date_us", "datetime", "datetime_us", "time")


#: Rows that rule out parsers before the whole column is read.
HEAD = 1_000


@dataclass(frozen=True)
class Vote:
    """How many texts of a column are values, and the parser that takes all of them, or str."""

    values: int
    parser: str

    @property
    def type(self) -> str:
        return self.parser.split("_")[0]


def _taken(df: DataFrame, wanted: dict[str, list[str]]) -> dict[str, tuple[int, set[str]]]:
    """By column the number of values, and which of its parsers take all of them: one aggregation."""
    aggs = []
    for i, (c, parsers) in enumerate(wanted.items()):
        text = F.col(f"`{c}`")
        value = ~is_none(text)
        aggs.append(F.count(F.when(value, 1)).alias(f"n{i}"))
        aggs += [F.count(F.when(value & PARSERS[p](text).isNull(), 1)).alias(f"p{i}_{p}") for p in parsers]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], {p for p in parsers if not row[f"p{i}_{p}"]}) for i, (c, parsers) in enumerate(wanted.items())}


def vote(df: DataFrame, columns: list[str] | None = None) -> dict[str, Vote]:
    """The parsers of all text columns.

    A parser that fails on one of the first rows is none of a column, so those rows rule
    parsers out; the whole table is then read once to confirm the first parser left
    of every column, and again only for columns whose parser a later row refutes.
    A column without values is str.
    """
    columns = [c for c, t in df.dtypes if t == "string" and not c.startswith("__")] if columns is None else columns
    if not columns:
        return {}
    texts = df.select(*[f"`{c}`" for c in columns])
    left = {c: [p for p in ORDER if p in ok] for c, (_, ok) in _taken(texts.limit(HEAD), {c: list(ORDER) for c in columns}).items()}
    out: dict[str, Vote] = {}
    while len(out) < len(columns):
        asked = {c: left[c][:1] for c in columns if c not in out}
        for c, (n, ok) in _taken(texts, asked).items():
            if not n or not left[c]:
                out[c] = Vote(n, "str")
            elif ok:
                out[c] = Vote(n, left[c][0])
            else:
                left[c].pop(0)
    return out


def typed(df: DataFrame, votes: dict[str, Vote] | None = None) -> DataFrame:
    """The frame with every text column as its type.  In typed columns texts that mean no value are null; text columns keep them."""
    votes = vote(df) if votes is None else votes
    out = []
    for c in df.columns:
        text = F.col(f"`{c}`")
        parser = votes[c].parser if c in votes else "str"
        if parser == "time":
            enable_time(df.sparkSession)
        parse = parse_time if parser == "time" else PARSERS.get(parser)
        out.append(text if parse is None else F.when(~is_none(text), parse(text)).alias(c))
    return df.select(*out)


def infer(text: Column, kind: str) -> Column:
    """One text column as one type, null where it is none."""
    if kind not in TYPES:
        raise TypeError(f"the type {kind!r} is not supported; use one of {TYPES}")
    parse = {"bool": parse_bool, "int": parse_int, "float": parse_float, "date": parse_date, "datetime": parse_datetime, "time": parse_time, "str": lambda t: t}[kind]
    return text if kind == "str" else F.when(~is_none(text), parse(text))


def guess(texts: list[str | None], spark) -> list:
    """Typed Python values of a list of texts."""
    if not texts:
        return []
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r["v"] for r in typed(df, vote(df, ["v"])).orderBy("i").collect()]
