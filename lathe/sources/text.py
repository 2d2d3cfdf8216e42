"""Separated text: csv, tsv, txt.  Lines are read in parallel; types are inferred by one vote."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions import infer
from lathe.operators import position
from lathe.operators.naming import unique_names

SKIP = ("NONE", "ANY", "ALL")
#: Bytes in which encoding and separator are looked for.
PEEK = 10_000


#: What Windows-1252 has where ISO-8859-1 has controls; Spark reads the latter.
_C1 = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
_C1 = [(a, b) for a, b in _C1 if b]


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole file, by Spark's own reader, so any store works."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def head_bytes(spark: SparkSession, path: str, size: int = PEEK) -> bytes:
    """The first bytes of a file, or of the first file of a folder, from any store, without reading more."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    found = [f for f in fs.globStatus(at) or []]
    if found and found[0].isDirectory():
        found = sorted((f for f in fs.listStatus(found[0].getPath()) if f.isFile() and f.getPath().getName()[0] not in "._"), key=lambda f: f.getPath().getName())
    if not found:
        raise FileNotFoundError(path)
    stream = fs.open(found[0].getPath())
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def peek(spark: SparkSession, path: str, lines: int = 10, encoding: str | None = None) -> list[str]:
    if encoding not in (None, "UTF-8"):
        return head_bytes(spark, path).decode(encoding, "ignore").splitlines()[:lines]
    return [r["value"] for r in spark.read.text(path).limit(lines).collect()]


def detect_encoding(raw: bytes) -> str:
    """By byte-order mark, else UTF-8 if it decodes, else Windows-1252 if its extra signs occur, else ISO-8859-1."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16"), (b"\xfe\xff", "UTF-16")):
        if raw.startswith(mark):
            return name
    try:
        raw.decode("utf-8")
        return "UTF-8"
    except UnicodeDecodeError as e:
        if e.start >= len(raw) - 4 and e.reason == "unexpected end of data":
            return "UTF-8"
    return "windows-1252" if any(0x80 <= b <= 0x9F for b in raw) else "ISO-8859-1"


def detect_separator(text: str) -> str:
    """The most frequent of , tab ; : | — else a blank, else a newline."""
    counts = Counter(c for c in text if c in ",\t;:|")
    if counts:
        return max(counts, key=lambda c: (counts[c], -",\t;:|".index(c)))
    if " " in text:
        return " "
    if "\n" in text:
        return "\n"
    raise ValueError("separator not detected")


def split_line(line: str, delimiter: str, openings: str = "({[", closures: str = "]})", qualifier: str | None = None, strip: bool = False) -> list[str]:
    """One line at its delimiters, but not inside brackets or qualifiers."""
    parts, depth, quoted, part = [], 0, False, []
    i = 0
    while i < len(line):
        c = line[i]
        if qualifier and c == qualifier:
            quoted = not quoted
        elif not quoted and c in openings:
            depth += 1
            part.append(c)
        elif not quoted and c in closures and depth:
            depth -= 1
            part.append(c)
        elif not quoted and not depth and line.startswith(delimiter, i):
            parts.append("".join(part))
            part = []
            i += len(delimiter) - 1
        else:
            part.append(c)
        i += 1
    parts.append("".join(part))
    return [p.strip() for p in parts] if strip else parts


def split_by_sequence(text: str, sequence: Sequence[str]) -> list[str]:
    """A text at separators that follow in a fixed order."""
    out = []
    for s in sequence:
        head, _, text = text.partition(s)
        out.append(head)
    return [*out, text]


def get_headers(spark: SparkSession, path: str, delimiter: str | None = None, header_row_index: int = 0, text_qualifier: str | None = None, linecount: int = 10) -> dict:
    """The first lines as cells, by file name, and the delimiter."""
    encoding = detect_encoding(head_bytes(spark, path))
    lines = peek(spark, path, linecount + header_row_index, encoding)[header_row_index:]
    try:
        delimiter = delimiter or detect_separator("\n".join(lines))
    except ValueError:
        delimiter = ","
    cells = [split_line(line.lstrip("﻿"), delimiter, "", "", text_qualifier) for line in lines]
    return {path.rsplit("/", 1)[-1]: cells, "delimiter": delimiter}


def _clean(name: str | None) -> str:
    return re.sub(r"[\t\r\n]", lambda m: {"\t": "\\t", "\n": "\\n", "\r": "\\r"}[m.group()], name or "")


def read_text(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, first_row_has_headers: bool = True, header_row_index: int = 0, encoding: str | None = None, start: int = 0,
    limit: int | None = None, guess_datatypes: bool = True, text_qualifier: str | None = None, delimiter: str | None = None, strip_leading_and_tailing_whitespace: bool = True,
    skip_empty: str = "NONE", multiline: bool | None = None, newline: str = "\n", text_escape_openings: str = "", text_escape_closures: str = "",
) -> DataFrame:
    """Rows of a separated text file, with hidden row order.

    Without a qualifier, lines are rows and are read in parallel.  With one, a field may
    hold newlines and a file is one task, unless ``multiline`` is False.  Short rows are
    filled up, surplus fields dropped.  A missing column raises OSError.  A delimiter between a
    ``text_escape_openings`` sign and its closure separates nothing; such lines are split in
    Python, and their fields hold no newlines.  Both newlines, \\n and \\r\\n, end a line whatever ``newline`` says.
    """
    if newline not in ("\n", "\r\n"):
        raise ValueError("newline is \\n or \\r\\n")
    if len(text_escape_openings or "") != len(text_escape_closures or ""):
        raise ValueError("every text_escape opening has a closure")
    escapes = (text_escape_openings, text_escape_closures) if text_escape_openings else None
    if skip_empty not in SKIP:
        raise ValueError(f"skip_empty is one of {SKIP}")
    if not isinstance(start, int) or start < 0 or not (limit is None or isinstance(limit, int) and limit > 0):
        raise ValueError("start is 0 or more, limit more than 0")
    encoding = encoding or detect_encoding(head_bytes(spark, path))
    delimiter = delimiter or ","
    options = {"sep": delimiter, "quote": text_qualifier or "\u0000", "escape": "\\" if text_qualifier else "\u0000", "charToEscapeQuoteEscaping": "\u0000", "encoding": "ISO-8859-1" if encoding == "windows-1252" else encoding, "maxColumns": "100000", "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
    multiline = bool(text_qualifier) and not escapes if multiline is None else multiline
    if escapes and (multiline or encoding != "UTF-8"):
        raise ValueError("text escapes need UTF-8 lines")

    def rows(width: int) -> DataFrame:
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
        if multiline or encoding != "UTF-8":
            # Spark's own lines are UTF-8; other encodings go through the csv reader, which leaves blank lines out
            return spark.read.options(**options, multiLine=str(multiline or encoding.startswith("UTF-16")).lower()).schema(schema).csv(path).withColumn(position.POS, F.monotonically_increasing_id())
        lines = spark.read.text(path).withColumn(position.POS, F.monotonically_increasing_id())
        line = F.regexp_replace("value", "^﻿", "")
        if escapes:
            return _split_lines(lines.select(line.alias("value"), position.POS), schema, delimiter, escapes, text_qualifier)
        return lines.withColumn("v", F.from_csv(line, schema.simpleString()[7:-1].replace(":", " "), {k: v for k, v in options.items() if k != "encoding"})).select("v.*", position.POS)

    first = peek(spark, path, header_row_index + 1, encoding)
    if len(first) <= header_row_index or not "".join(first).strip("﻿\r\n\t "):
        return spark.createDataFrame([], T.StructType([T.StructField(position.POS, T.LongType())]))
    wide = max(line.count(delimiter) for line in first) + 1
    head = rows(max(wide, 1)).where(F.col(position.POS) >= header_row_index).orderBy(position.POS).limit(1).collect()
    cells = [head[0][f"c{i}"] for i in range(wide)]
    while cells and cells[-1] is None and not first_row_has_headers:
        cells.pop()
    cells = [(c or "").lstrip("﻿") for c in cells]
    if escapes:
        cells = cells[: len(split_line(first[header_row_index], delimiter, *escapes, text_qualifier))]
    elif text_qualifier or first_row_has_headers:
        width = _width(cells, first[header_row_index], delimiter, text_qualifier)
        cells = cells[:width]
    names = unique_names([_clean(c.strip() if strip_leading_and_tailing_whitespace else c) for c in cells]) if first_row_has_headers else [str(i) for i in range(len(cells))]
    if columns is not None and (missing := [c for c in columns if c not in names]):
        raise OSError(f"no such columns: {missing}")
    df = rows(len(names)).where(F.col(position.POS) >= header_row_index + bool(first_row_has_headers))
    fields = []
    for i, n in enumerate(names):
        text = F.col(f"c{i}")
        if encoding == "windows-1252":
            text = F.translate(text, "".join(a for a, _ in _C1), "".join(b for _, b in _C1))
        if text_qualifier:
            text = F.replace(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
        text = F.trim(text) if strip_leading_and_tailing_whitespace else text
        fields.append(F.coalesce(text, F.lit("")).alias(f"f{i}"))
    df = df.select(*fields, position.POS)
    empty = [F.col(f"f{i}") == "" for i in range(len(names))]
    if skip_empty != "NONE":
        bad = empty[0]
        for e in empty[1:]:
            bad = (bad | e) if skip_empty == "ANY" else (bad & e)
        df = df.where(~bad)
    if start or limit is not None:
        numbered = position.with_ordinals(df, [position.POS])
        at = F.col(position.ORDINAL)
        df = numbered.where((at >= start) & (at < start + limit) if limit is not None else at >= start).drop(position.ORDINAL)
    wanted = names if columns is None else list(columns)
    df = df.select(*[F.col(f"f{names.index(n)}").alias(n) for n in wanted], position.POS)
    return infer.typed(df, infer.vote(df, wanted)) if guess_datatypes else df


def _split_lines(lines: DataFrame, schema: T.StructType, delimiter: str, escapes: tuple[str, str], qualifier: str | None) -> DataFrame:
    """The fields of (value, position) lines with bracketed delimiters."""
    import pyarrow as pa

    width = len(schema)

    def run(batches):
        for batch in batches:
            rows = [split_line(v or "", delimiter, *escapes, qualifier)[:width] for v in batch.column(0).to_pylist()]
            fields = [pa.array([r[i] if i < len(r) else None for r in rows], pa.string()) for i in range(width)]
            yield pa.RecordBatch.from_arrays([*fields, batch.column(1)], names=[*schema.names, position.POS])

    return lines.mapInArrow(run, T.StructType([*schema.fields, T.StructField(position.POS, T.LongType())]))


def _width(cells: list[str], line: str, delimiter: str, qualifier: str | None) -> int:
    """Number of fields of the header line."""
    return min(len(split_line(line, delimiter, "", "", qualifier)), len(cells)) if "\n" not in "".join(cells) else len(cells)
