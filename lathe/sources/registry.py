"""Readers by file suffix.  Users add their own with ``file_readers['fmt'] = function``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lathe.sources import markup, sheets, text

Reader = Callable[..., DataFrame]


def _sheet(kind: str) -> Reader:
    allowed = ("sheet", "columns", "first_row_has_headers", "header_row_index", "start", "limit", "skip_empty")
    return lambda spark, path, **kw: sheets.read_sheet(spark, text.read_bytes(spark, path), kind, **{k: v for k, v in kw.items() if k in allowed and v is not None})


def _html(spark: SparkSession, path: str, columns=None, guess_datatypes=True, **_: object) -> DataFrame:
    return markup.read_html(spark, text.read_bytes(spark, path).decode("utf-8", "replace"), columns, guess_datatypes)


def _json(spark: SparkSession, path: str, **_: object) -> DataFrame:
    return markup.read_json(spark, text.read_bytes(spark, path).decode("utf-8"))


def _hdf5(spark: SparkSession, path: str, **_: object) -> DataFrame:
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading hdf5 needs the library h5py") from e
    with h5py.File(path) as f:
        columns = {k: [v.decode() if isinstance(v, bytes) else v.item() if hasattr(v, "item") else v for v in f[k][()]] for k in f}
    return markup.from_columns(spark, columns)


def _parquet(spark: SparkSession, path: str, **_: object) -> DataFrame:
    return spark.read.parquet(path)


def _fixed(sep: str) -> Reader:
    return lambda spark, path, **kw: text.read_text(spark, path, **{k: v for k, v in (kw | {"delimiter": kw.get("delimiter") or sep}).items() if v is not None and k != "sheet"})


file_readers: dict[str, Reader] = {
    "csv": _fixed(","), "tsv": _fixed("\t"), "txt": _fixed(","), "ssv": _fixed(";"), "xlsx": _sheet("xlsx"), "xlsm": _sheet("xlsx"), "ods": _sheet("ods"),
    "html": _html, "json": _json, "hdf5": _hdf5, "h5": _hdf5, "parquet": _parquet,
}


#: What a reader may be asked for; a reader takes what concerns its format and leaves the others.
OPTIONS = (
    "columns", "first_row_has_headers", "header_row_index", "encoding", "start", "limit", "sheet", "guess_datatypes", "newline", "text_qualifier", "delimiter",
    "strip_leading_and_tailing_whitespace", "text_escape_openings", "text_escape_closures", "skip_empty", "multiline",
)
_OWN = dict(file_readers)


def suffix_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rpartition(".")[2].lower()


def read(spark: SparkSession, path: str, **options: object) -> DataFrame:
    suffix = suffix_of(path)
    if suffix not in file_readers:
        raise ValueError(f"no reader for {suffix!r}; there are {sorted(file_readers)}")
    # readers that users add take what they like
    if file_readers[suffix] is _OWN.get(suffix) and (unknown := sorted(options.keys() - set(OPTIONS))):
        raise TypeError(f"no such options: {unknown}; there are {sorted(OPTIONS)}")
    return file_readers[suffix](spark, path, **options)


def get_headers(spark: SparkSession, path: str, delimiter: str | None = None, header_row_index: int = 0, text_qualifier: str | None = None, linecount: int = 10) -> dict:
    """The first rows as cells, by file name or by sheet, and the delimiter (None for workbooks)."""
    suffix = suffix_of(path)
    if suffix in ("xlsx", "xlsm", "ods"):
        return sheets.peek(text.read_bytes(spark, path), "ods" if suffix == "ods" else "xlsx", linecount, header_row_index) | {"delimiter": None}
    return text.get_headers(spark, path, delimiter, header_row_index, text_qualifier, linecount)


def head(spark: SparkSession, path: str, linecount: int = 5, delimiter: str | None = None) -> dict:
    return get_headers(spark, path, delimiter, linecount=linecount)
