"""HTML, JSON and SQL text, and tables as plain text."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable, Sequence
from datetime import date, datetime, time, timedelta
from decimal import Decimal
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.functions import infer
from lathe.operators import position
from lathe.operators.naming import unique_names
from lathe.sources.sheets import frame


def plain(value: object) -> object:
    """A value as JSON has it: booleans and times as text, durations as P…DT…S."""
    if isinstance(value, bool):
        return str(value)
    if value is None or isinstance(value, (int, float, str)):
        return value
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, timedelta):
        return f"P{value.days}DT{value.seconds + value.microseconds / 1e6}S"
    if isinstance(value, datetime):
        return value.isoformat(sep=" ")
    if isinstance(value, (date, time)):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    return str(value)


class _Rows(HTMLParser):
    """Cells of the table rows, whatever else stands around them."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.close_cell()
            self.cell = []

    def close_cell(self) -> None:
        if self.cell is not None:
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append("".join(self.cell).strip())
        self.cell = None

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.close_cell()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def read_html(spark: SparkSession, text: str, columns: Sequence[str] | None = None, guess_datatypes: bool = True) -> DataFrame:
    """The table of an HTML document; a leading column ``#`` of row numbers is dropped."""
    parser = _Rows()
    parser.feed(text)
    rows = [r for r in parser.rows if r]
    if not rows:
        return frame(spark, [], [])
    head, body = rows[0], rows[1:]
    if body and len(body[0]) == 1 and len(head) > 1:
        body = body[1:]
    names = unique_names(head)
    df = frame(spark, [[None if c == "None" else c for c in r] for r in body], names)
    if names and names[0] in ("#", "~"):
        df = df.drop(names[0])
        names = names[1:]
    if columns is not None:
        df = df.select(*[f"`{c}`" for c in columns], position.POS)
    return infer.typed(df) if guess_datatypes else df


def write_html(names: Sequence[str], rows: Iterable[Sequence], first: int = 0) -> str:
    line = lambda cells: "<tr>" + "".join(f"<th>{html.escape(str(c))}</th>" for c in cells) + "</tr>"
    body = "".join(line([n, *r]) for n, r in enumerate(rows, first))
    return f"<div><table border=1>{line(['#', *names])}{body}</table></div>"


def read_json(spark: SparkSession, text: str) -> DataFrame:
    """``{"columns": {name: [values]}}``; columns of different length are filled with nulls."""
    columns = json.loads(text)["columns"]
    n = max(map(len, columns.values()), default=0)
    return frame(spark, [[v[i] if i < len(v) else None for v in columns.values()] for i in range(n)], list(columns))


def write_json(names: Sequence[str], rows: Sequence[Sequence]) -> str:
    row_id = unique_names([*names, "row id"])[-1]
    columns: dict[str, list] = {row_id: list(range(1, len(rows) + 1))}
    columns |= {n: [plain(r[i]) for r in rows] for i, n in enumerate(names)}
    return json.dumps({"columns": columns, "total_rows": len(rows)})


def write_sql(name: str, df: DataFrame, rows: Iterable[Sequence]) -> str:
    """CREATE TABLE and INSERT in one transaction; null is NULL."""
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "double": "REAL", "float": "REAL"}
    visible = [(c, kinds.get(t, "TEXT")) for c, t in df.dtypes if not c.startswith("__")]
    quote = lambda c: '"' + c.replace('"', '""') + '"'

    def value(v: object, kind: str) -> str:
        if v is None:
            return "NULL"
        if kind != "TEXT":
            return repr(v)
        return "'" + str(plain(v)).replace("'", "''") + "'"

    lines = ["begin;", f"CREATE TABLE {quote(name)} ({', '.join(f'{quote(c)} {k}' for c, k in visible)});"]
    for r in rows:
        lines.append(f"INSERT INTO {quote(name)} VALUES ({', '.join(value(v, k) for v, (_, k) in zip(r, visible))});")
    return "\n".join([*lines, "commit;"])


def shown(names: Sequence[str], kinds: Sequence[str] | None, rows: Sequence[tuple[int, Sequence] | None], blanks: str | None = None) -> str:
    """Rows as a plain-text table; None stands for rows left out."""
    cells: list[list[str]] = [["#", *names]]
    if kinds:
        cells.append(["row", *kinds])
    for r in rows:
        cells.append(["..."] * (len(names) + 1) if r is None else [str(r[0]), *[blanks if v is None and blanks is not None else str(v) for v in r[1]]])
    width = [max(len(r[i]) for r in cells) for i in range(len(names) + 1)]
    rule = "+" + "+".join("=" * w for w in width) + "+"
    body = ["|" + "|".join(c.center(w) if n == 0 else c.rjust(w) for c, w in zip(r, width)) + "|" for n, r in enumerate(cells)]
    head = 2 if kinds else 1
    return "\n".join([rule, *body[:head], "+" + "+".join("-" * w for w in width) + "+", *body[head:], rule])


def from_columns(spark: SparkSession, columns: dict[str, Sequence]) -> DataFrame:
    n = max((len(v) for v in columns.values()), default=0)
    return frame(spark, [[v[i] if i < len(v) else None for v in columns.values()] for i in range(n)], list(columns))


def synthetic_orders(spark: SparkSession, rows: int, seed: int = 11) -> DataFrame:
    """Synthetic order lines, 12 columns, the same for a seed."""
    n = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1 << 40))
    pick = lambda salt, *values: F.element_at(F.array(*map(F.lit, values)), (n(salt) % len(values) + 1).cast("int"))
    day = F.date_add(F.lit("2021-01-01").cast("date"), (n(2) % 700).cast("int"))
    return spark.range(rows).select(
        (F.col("id") + 1).alias("#"), (n(1) % 18_000 + 1_000_000).alias("1"), F.concat(day.cast("string"), F.lit("T00:00:00")).alias("2"), (n(3) % 50_000).alias("3"),
        F.when(n(4) % 2 == 0, 0).otherwise(1).cast("bigint").alias("4"), (n(5) % 30).alias("5"), pick(6, "ABC", "DEF", "GHI", "JKL", "").alias("6"), pick(7, "A1", "B2", "C3", "D4").alias("7"),
        pick(8, "Hot", "Cold", "Dry", "Wet").alias("8"), pick(9, "XYZ", "UVW", "RST").alias("9"), (F.lit(1.0) * (n(10) % 1_000_000) / 1_000_000).alias("10"), (n(11) % 1_000_000 + 1_000_000).cast("string").alias("11"),
    )
