"""Workbooks: xlsx and ods, read and written as zip archives of XML.

A workbook is one file that one process writes and reads; sizes are bounded by the
format (1,048,576 rows a sheet), and writers refuse more.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Sequence
from datetime import date, datetime, time, timedelta
from xml.etree import ElementTree as X
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lathe.operators import position
from lathe.operators.naming import unique_names
from lathe.session import enable_time

MAX_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_T, _O, _TEXT = ("{urn:oasis:names:tc:opendocument:xmlns:%s:1.0}" % n for n in ("table", "office", "text"))
#: Built-in number formats that show a date or time.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _letters(n: int) -> str:
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _serial(value: float) -> datetime | time:
    if value < 1:
        return (datetime(1900, 1, 1) + timedelta(days=value)).time()
    return datetime(1899, 12, 30) + timedelta(microseconds=round(value * 86_400_000_000))


def xlsx_sheets(raw: bytes) -> dict[str, list[list]]:
    """Cells of every sheet by name."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in X.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        dates: list[bool] = []
        if "xl/styles.xml" in names:
            root = X.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
            shows = {k for k, v in own.items() if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", v), re.I)}
            formats = root.find(f"{_MAIN}cellXfs")
            dates = [int(f.get("numFmtId", 0)) in _DATE_FORMATS | shows for f in formats] if formats is not None else []
        targets = {r.get("Id"): r.get("Target") for r in X.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in X.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")].lstrip("/")
            rows: list[list] = []
            for row in X.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{_MAIN}row"):
                at = int(row.get("r", len(rows) + 1))
                rows += [[] for _ in range(at - len(rows))]
                cells = rows[at - 1]
                for cell in row.iter(f"{_MAIN}c"):
                    col = _number(re.match(r"[A-Z]+", cell.get("r", _letters(len(cells)) + "1")).group())
                    cells += [None] * (col + 1 - len(cells))
                    cells[col] = _xlsx_value(cell, shared, dates)
            out[sheet.get("name")] = rows
        return out


def _xlsx_value(cell: X.Element, shared: list[str], dates: list[bool]) -> object:
    kind, v = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e"):
        return v.text
    if kind == "d":
        return datetime.fromisoformat(v.text)
    number = float(v.text)
    style = int(cell.get("s", 0))
    if style < len(dates) and dates[style]:
        return _serial(number)
    return int(number) if number.is_integer() and "." not in v.text and "E" not in v.text.upper() else number


def ods_sheets(raw: bytes) -> dict[str, list[list]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = X.fromstring(z.read("content.xml"))
    out = {}
    for sheet in root.iter(f"{_T}table"):
        rows: list[list] = []
        blank = 0
        for row in sheet.iter(f"{_T}table-row"):
            cells: list = []
            for cell in row:
                if cell.tag in (f"{_T}table-cell", f"{_T}covered-table-cell"):
                    cells += [_ods_value(cell)] * min(int(cell.get(f"{_T}number-columns-repeated", 1)), 16_384)
            while cells and cells[-1] is None:
                cells.pop()
            times = int(row.get(f"{_T}number-rows-repeated", 1))
            if not cells:
                # blank rows count only if something follows them
                blank += times
                continue
            if len(rows) + blank + times > MAX_ROWS:
                raise ValueError(f"a sheet has {MAX_ROWS} rows at most")
            rows += [[] for _ in range(blank)] + [list(cells) for _ in range(times)]
            blank = 0
        out[sheet.get(f"{_T}name")] = rows
    return out


def _ods_value(cell: X.Element) -> object:
    kind = cell.get(f"{_O}value-type")
    text = "\n".join("".join(p.itertext()) for p in cell.iter(f"{_TEXT}p"))
    if kind == "float":
        number = float(cell.get(f"{_O}value"))
        return int(number) if number.is_integer() else number
    if kind == "boolean":
        return cell.get(f"{_O}boolean-value") == "true"
    if kind == "date":
        value = cell.get(f"{_O}date-value")
        return datetime.fromisoformat(value) if "T" in value else date.fromisoformat(value)
    if kind == "time":
        h, m, s = re.match(r"PT(\d+)H(\d+)M(\d+)", cell.get(f"{_O}time-value")).groups()
        return time(int(h) % 24, int(m), int(s))
    return text or None


def peek(raw: bytes, kind: str, rows: int, start: int = 0) -> dict[str, list[list]]:
    """The first rows of every sheet by name, as wide as the widest of them."""
    out = {}
    for name, cells in (xlsx_sheets if kind == "xlsx" else ods_sheets)(raw).items():
        head = cells[start : start + rows]
        width = max((i + 1 for r in head for i, v in enumerate(r) if v is not None), default=0)
        out[name] = [[*r[:width], *[None] * (width - len(r))] for r in head]
    return out


def frame(spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str]) -> DataFrame:
    """Rows of Python values as a frame: one type per column, text where values differ in kind; hidden row order."""
    kinds = []
    for i in range(len(names)):
        seen = {type(r[i]) for r in rows if i < len(r) and r[i] is not None}
        big = any(isinstance(r[i], int) and not -(2**63) <= r[i] < 2**63 for r in rows if i < len(r))
        if seen == {bool}:
            kinds.append(T.BooleanType())
        elif seen == {int}:
            kinds.append(T.DecimalType(38, 0) if big else T.LongType())
        elif seen and seen <= {int, float}:
            kinds.append(T.DoubleType())
        elif seen == {date}:
            kinds.append(T.DateType())
        elif seen and seen <= {date, datetime}:
            kinds.append(T.TimestampNTZType())
        elif seen == {time}:
            enable_time(spark)
            kinds.append(T.TimeType())
        elif seen == {timedelta}:
            kinds.append(T.DayTimeIntervalType())
        elif seen == {bytes}:
            kinds.append(T.BinaryType())
        else:
            kinds.append(T.StringType())

    def fit(value: object, kind: T.DataType) -> object:
        if value is None:
            return None
        if isinstance(kind, T.StringType):
            return value if isinstance(value, str) else str(value)
        if isinstance(kind, T.DoubleType):
            return float(value)
        if isinstance(kind, T.DecimalType):
            from decimal import Decimal

            return Decimal(value)
        if isinstance(kind, T.TimestampNTZType) and not isinstance(value, datetime):
            return datetime(value.year, value.month, value.day)
        return value

    data = [(*[fit(r[i] if i < len(r) else None, k) for i, k in enumerate(kinds)], n) for n, r in enumerate(rows)]
    schema = T.StructType([*[T.StructField(n, k) for n, k in zip(names, kinds)], T.StructField(position.POS, T.LongType())])
    return spark.createDataFrame(data, schema)


def read_sheet(spark: SparkSession, raw: bytes, kind: str, sheet: str | None = None, columns: Sequence[str] | None = None, first_row_has_headers: bool = True, header_row_index: int = 0, start: int = 0, limit: int | None = None, skip_empty: str = "NONE") -> DataFrame:
    """One sheet (the first by default) with its own cell types."""
    sheets = (xlsx_sheets if kind == "xlsx" else ods_sheets)(raw)
    if sheet is not None and sheet not in sheets:
        raise ValueError(f"no sheet {sheet!r}; there are {list(sheets)}")
    rows = sheets[sheet] if sheet is not None else next(iter(sheets.values()), [])
    rows = rows[header_row_index:]
    width = max(map(len, rows), default=0)
    tidy = lambda v: re.sub(r"[\t\n\r]+", " ", v).strip() if isinstance(v, str) else v
    if first_row_has_headers and rows:
        head, rows = [*rows[0], *[None] * (width - len(rows[0]))], rows[1:]
        names = unique_names(["" if v is None else str(tidy(v)) for v in head])
    else:
        names = [str(i) for i in range(width)] if kind == "xlsx" else [f"_{i + 1}" for i in range(width)]
    rows = [[tidy(v) for v in r] + [None] * (width - len(r)) for r in rows]
    if skip_empty != "NONE":
        test = any if skip_empty == "ANY" else all
        rows = [r for r in rows if not test(v is None for v in r)]
    rows = rows[start : None if limit is None else start + limit]
    if columns is not None:
        if missing := [c for c in columns if c not in names]:
            raise OSError(f"no such columns: {missing}")
        rows, names = [[r[names.index(c)] for c in columns] for r in rows], list(columns)
    return frame(spark, rows, names)


def write_xlsx(names: Sequence[str], rows: Iterable[Sequence]) -> bytes:
    out = io.StringIO()
    out.write('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="%s"><sheetData>' % _MAIN[1:-1])
    for r, row in enumerate([names, *rows]):
        if r >= MAX_ROWS:
            raise ValueError(f"a sheet has {MAX_ROWS} rows at most")
        out.write(f'<row r="{r + 1}">')
        for c, v in enumerate(row):
            at = f"{_letters(c)}{r + 1}"
            if v is None:
                continue
            if isinstance(v, bool):
                out.write(f'<c r="{at}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)) and abs(v) < 2**53:
                out.write(f'<c r="{at}"><v>{v!r}</v></c>')
            elif isinstance(v, (datetime, date)):
                stamp = v if isinstance(v, datetime) else datetime(v.year, v.month, v.day)
                out.write(f'<c r="{at}" s="1"><v>{(stamp - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>')
            else:
                out.write(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        out.write("</row>")
    out.write("</sheetData></worksheet>")
    doc, rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    main = _MAIN[1:-1]
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{rel}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{rel}/relationships"><Relationship Id="rId1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{doc}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{rel}/relationships"><Relationship Id="rId1" Type="{doc}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{doc}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": out.getvalue(),
    }
    return _zipped(parts)


def write_ods(names: Sequence[str], rows: Iterable[Sequence]) -> bytes:
    out = io.StringIO()
    out.write('<?xml version="1.0" encoding="UTF-8"?><office:document-content xmlns:office="%s" xmlns:table="%s" xmlns:text="%s" office:version="1.2"><office:body><office:spreadsheet><table:table table:name="Sheet1">' % (_O[1:-1], _T[1:-1], _TEXT[1:-1]))
    for r, row in enumerate([names, *rows]):
        if r >= MAX_ROWS:
            raise ValueError(f"a sheet has {MAX_ROWS} rows at most")
        out.write("<table:table-row>")
        for v in row:
            if v is None:
                out.write("<table:table-cell/>")
                continue
            if isinstance(v, bool):
                tag = f'office:value-type="boolean" office:boolean-value="{str(v).lower()}"'
            elif isinstance(v, (int, float)) and abs(v) <= 2**32:
                tag = f'office:value-type="float" office:value="{v!r}"'
            elif isinstance(v, (datetime, date)):
                tag = f'office:value-type="date" office:date-value="{v.isoformat()}"'
            elif isinstance(v, time):
                tag = f'office:value-type="time" office:time-value="PT{v.hour:02}H{v.minute:02}M{v.second:02}S"'
            else:
                tag = 'office:value-type="string"'
            out.write(f"<table:table-cell {tag}><text:p>{escape(str(v))}</text:p></table:table-cell>")
        out.write("</table:table-row>")
    out.write("</table:table></office:spreadsheet></office:body></office:document-content>")
    kind = "application/vnd.oasis.opendocument.spreadsheet"
    return _zipped({
        "mimetype": kind,
        "META-INF/manifest.xml": f'<manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"><manifest:file-entry manifest:full-path="/" manifest:media-type="{kind}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>',
        "content.xml": out.getvalue(),
    })


def _zipped(parts: dict[str, str]) -> bytes:
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return raw.getvalue()
