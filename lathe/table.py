"""The table: an immutable, lazy wrapper of a DataFrame with an optional row order.

Methods give new tables.  What needs row order names its keys (``order``) or gets a
hidden scan id; everything else never makes one.  Nothing is collected but by what
returns plain values: to_dict, show, statistics, exporters and the like.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.operators import aggregate, cast, combine, filters, impute, joins, lookup, ordering, position, predicates, values
from lathe.operators.aggregate import GroupBy
from lathe.operators.naming import require, unique_name
from lathe.sources import markup, registry, sheets


class Table:
    """Columns by name over a DataFrame; ``order`` names columns that order the rows totally."""

    #: Rows that an exporter brings to the driver at most.
    MAX_EXPORT = 5_000_000

    def __init__(self, df: DataFrame, order: Sequence[str] | None = None):
        self.df = df
        self.order = list(order) if order else [position.POS] if position.POS in df.columns else None

    def _new(self, df: DataFrame, order: Sequence[str] | None = None) -> Table:
        order = [o for o in (order or self.order or ()) if o in df.columns]
        return type(self)(df, order or None)

    def _ordered(self) -> tuple[DataFrame, list[str]]:
        return position.ensure(self.df, self.order)

    # ---- construction

    @classmethod
    def from_columns(cls, spark: SparkSession, columns: Mapping[str, Sequence] | None = None, headers: Sequence[str] | None = None, rows: Iterable[Sequence] | None = None) -> Table:
        """Either ``columns``, or ``headers`` and ``rows``."""
        if (columns is None) == (headers is None or rows is None):
            raise ValueError("give columns, or headers and rows")
        if columns is not None:
            return cls(markup.from_columns(spark, dict(columns)))
        rows = list(rows or ())
        if any(len(r) != len(headers or ()) for r in rows):
            raise ValueError("a row has not as many values as there are headers")
        return cls(sheets.frame(spark, rows, list(headers or ())))

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, **options: object) -> Table:
        return cls(registry.read(spark, path, **options))

    @classmethod
    def from_pandas(cls, spark: SparkSession, frame) -> Table:
        return cls(spark.createDataFrame(frame))

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> Table:
        return cls(markup.read_json(spark, text))

    @classmethod
    def from_html(cls, spark: SparkSession, text: str) -> Table:
        return cls(markup.read_html(spark, text))

    @classmethod
    def from_hdf5(cls, spark: SparkSession, path: str) -> Table:
        return cls(registry.file_readers["hdf5"](spark, path))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Table:
        """A table that ``save`` wrote, with its row order."""
        return cls(spark.read.parquet(path))

    def save(self, path: str) -> None:
        self._ordered()[0].write.mode("overwrite").parquet(path)

    # ---- shape and access

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]

    def __len__(self) -> int:
        return self.df.count()

    def __contains__(self, name: object) -> bool:
        return name in self.columns

    def __iter__(self):
        yield from self.columns

    def __getitem__(self, keys) -> Table:
        """Columns by name, rows by slice or index, or both."""
        flat: list = []
        for k in keys if isinstance(keys, (tuple, list)) else [keys]:
            flat += list(k) if isinstance(k, (tuple, list)) else [k]
        names, rows = [k for k in flat if isinstance(k, str)], [k for k in flat if not isinstance(k, str)]
        if len(rows) > 1 or not all(isinstance(r, (int, slice)) for r in rows) or (names and rows and isinstance(rows[0], int)):
            raise KeyError(f"not understood: {keys!r}")
        require(self.columns, names)
        out = self
        if rows:
            at = rows[0] if isinstance(rows[0], slice) else slice(rows[0], rows[0] + 1 or None)
            df, order = self._ordered()
            out = Table(ordering.sliced(df, at, order), order if (at.step or 1) > 0 else None)
        if names:
            names = list(dict.fromkeys(names))
            hidden = [o for o in (out.order or ()) if o not in names]
            out = out._new(out.df.select(*[f"`{n}`" for n in names], *[F.col(f"`{h}`").alias(h if h.startswith("__") else position.POS) for h in hidden[:1]]), None)
        return out

    def rows(self) -> list[tuple]:
        """All rows, in order; a table of more than MAX_EXPORT rows raises ValueError rather than fill the driver."""
        df, order = self._ordered()
        chosen = df.orderBy(*order).select(*[f"`{c}`" for c in self.columns]).limit(self.MAX_EXPORT + 1)
        out = [tuple(r) for r in chosen.toLocalIterator()]
        if len(out) > self.MAX_EXPORT:
            raise ValueError(f"more than {self.MAX_EXPORT} rows; use save() or df.write")
        return out

    def row(self, index: int) -> tuple:
        if index < 0:
            index += len(self)
        got = self[index : index + 1].rows()
        if not got:
            raise IndexError(index)
        return got[0]

    def items(self):
        yield from self.to_dict().items()

    def to_dict(self, columns: Sequence[str] | None = None, rows: slice | None = None) -> dict[str, list]:
        table = self if rows is None else self[rows]
        names = list(columns) if columns is not None else self.columns
        got = table[tuple(names)].rows() if names != self.columns else table.rows()
        return {n: [r[i] for r in got] for i, n in enumerate(names)}

    def copy(self) -> Table:
        return self._new(self.df)

    def clear(self) -> Table:
        return self._new(self.df.limit(0))

    def equals(self, other: Table) -> bool:
        return ordering.same_rows(self.df, other.df, self.order, other.order)

    def __eq__(self, other: object) -> bool:
        """The same names and rows; also against a dictionary of columns."""
        if isinstance(other, Mapping):
            return set(self.columns) == set(other) and self.to_dict() == {k: list(v) for k, v in other.items()}
        return isinstance(other, Table) and (self is other or self.equals(other))

    __hash__ = None

    def nbytes(self) -> int:
        """Bytes of the values: the width of the type, or the length of texts and binaries."""
        widths = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
        shown = [(F.col(f"`{c}`"), t) for c, t in self.df.dtypes if not c.startswith("__")]
        one = [F.sum(F.octet_length(c)) if t in ("string", "binary") else F.count(c) * widths.get(t, 8) for c, t in shown]
        return sum(x or 0 for x in self.df.agg(*one).first()) if one else 0

    def types(self) -> dict[str, dict[str, int]]:
        return values.types_of(self.df)

    # ---- columns and rows

    def select(self, *names: str) -> Table:
        return self[list(names)]

    def with_column(self, name: str, value: Column | Callable[[Table], Column]) -> Table:
        return self._new(self.df.withColumn(name, value(self) if callable(value) else value))

    def apply(self, function: Callable, schema: str) -> Table:
        """The rows through a function from an iterator of pandas frames to an iterator of such, of the given schema: for what no operator does."""
        return Table(self.df.select(*[f"`{c}`" for c in self.columns]).mapInPandas(function, schema))

    def add_column(self, name: str, data: Sequence) -> Table:
        """A column of values in row order; nulls where they run out."""
        if name in self.columns:
            raise ValueError(f"{name!r} is a column already")
        df, order = self._ordered()
        spark = df.sparkSession
        given = sheets.frame(spark, [[v] for v in data], [name]).withColumnRenamed(position.POS, "__at")
        numbered = position.with_ordinals(df, order)
        return self._new(numbered.join(given, F.col(position.ORDINAL) == F.col("__at"), "left").drop(position.ORDINAL, "__at"), order)

    def add_columns(self, *names: str) -> Table:
        df = self.df
        for n in names:
            df = df.withColumn(unique_name(n, df.columns), F.lit(None).cast("string"))
        return self._new(df)

    def add_rows(self, *rows: Sequence | Mapping, **columns: object) -> Table:
        """Rows at the end: sequences, mappings, lists of either, or one value or list by column."""
        given: list[Sequence] = []
        if rows and not isinstance(rows[0], (list, tuple, Mapping)):
            rows = (list(rows),)
        for r in rows:
            many = r if isinstance(r, (list, tuple)) and r and isinstance(r[0], (list, tuple, dict)) else [r]
            given += [[x.get(c) for c in self.columns] if isinstance(x, Mapping) else list(x) for x in many]
        if columns:
            require(self.columns, columns)
            n = max(len(v) if isinstance(v, (list, tuple)) else 1 for v in columns.values())
            cell = lambda v, i: v[i] if isinstance(v, (list, tuple)) else v
            given += [[cell(columns[c], i) if c in columns else None for c in self.columns] for i in range(n)]
        if any(len(r) != len(self.columns) for r in given):
            raise ValueError("a row has not as many values as there are columns")
        return self + Table(sheets.frame(self.df.sparkSession, given, self.columns))

    def drop_columns(self, *names: str) -> Table:
        require(self.columns, names)
        return self._new(self.df.drop(*names))

    def delete_rows(self, rows: slice | int) -> Table:
        df, order = self._ordered()
        return self._new(ordering.deleted(df, rows, order), order)

    def update(self, column: str, rows: slice | int, value: object) -> Table:
        df, order = self._ordered()
        return self._new(ordering.updated(df, column, rows, value, order), order)

    def assign(self, column: str, key: slice | int, values: object) -> Table:
        """Values put into a column as into a list: one at an index, or several into a slice, which may make the table longer."""
        require(self.columns, [column])
        df, order = self._ordered()
        return Table(ordering.assigned(df, column, key, values, order), order if isinstance(key, int) else None)

    def extend(self, column: str, values: Sequence) -> Table:
        """A column with values after its last row; the other columns are null there."""
        return self.assign(column, slice(len(self), None), values)

    def get_by_indices(self, indices: Sequence[int] | DataFrame) -> Table:
        """Rows by ordinal; -1 gives nulls."""
        df, order = self._ordered()
        if not isinstance(indices, DataFrame):
            indices = df.sparkSession.createDataFrame(list(enumerate(indices)), "ord long, pos long")
        return Table(ordering.reindex(df, indices, order))

    reindex = get_by_indices

    def column_select(self, columns: Sequence[Mapping]) -> tuple[Table, Table]:
        good, bad = cast.column_select(self.df, columns)
        return Table(good), Table(bad)

    def merge(self, left: str, right: str, new: str, criteria: Column | str) -> Table:
        where = predicates.expression(self.df, criteria) if isinstance(criteria, str) else criteria
        return self._new(values.merge(self.df, left, right, new, where))

    def replace(self, mapping: Mapping, columns: Sequence[str] | None = None) -> Table:
        return self._new(values.replace(self.df, mapping, columns))

    def remove_all(self, column: str, *gone: object) -> Table:
        """A column without some of its values."""
        one = self.df.select(f"`{column}`")
        return Table(one.where(predicates.negated(filters.any_of(one, **{column: gone[0]}))) if len(gone) == 1 else filters.without(one, *gone))

    def replace_missing_values(self, *_: object, **__: object) -> None:
        raise AttributeError("see imputation")

    # ---- filters

    def filter(self, given: Sequence[Mapping] | str, filter_type: str = "all", **options: bool) -> tuple[Table, Table]:
        """(pass, fail)."""
        if not isinstance(given, str) and not given:
            return self.copy(), self.clear()
        good, bad = filters.split(self.df, filters.filter_predicate(self.df, given, filter_type, **options))
        return self._new(good), self._new(bad)

    def expression(self, text: str, allow_udf: bool = False) -> Column:
        return predicates.expression(self.df, text, allow_udf)

    def all(self, **wanted: object) -> Table:
        return self._new(self.df.where(filters.all_of(self.df, **wanted)))

    def any(self, **wanted: object) -> Table:
        return self._new(self.df.where(filters.any_of(self.df, **wanted)))

    def drop(self, *gone: object) -> Table:
        return self._new(filters.without(self.df, *gone))

    # ---- joins

    def join(self, other: Table, left_keys: Sequence[str] = (), right_keys: Sequence[str] = (), left_columns: Sequence[str] | None = None, right_columns: Sequence[str] | None = None, kind: str = "inner", merge_keys: bool = False, ordered: bool = False) -> Table:
        left, right = self.df, other.df
        lo, ro = (), ()
        if ordered:
            (left, lo), (right, ro) = self._ordered(), other._ordered()
        return Table(joins.join(left, right, kind, left_keys, right_keys, left_columns or self.columns, right_columns or other.columns, merge_keys, lo, ro, ordered))

    def inner_join(self, other: Table, left_keys, right_keys, left_columns=None, right_columns=None, merge_keys: bool = False, ordered: bool = False) -> Table:
        return self.join(other, left_keys, right_keys, left_columns, right_columns, "inner", merge_keys, ordered)

    def left_join(self, other: Table, left_keys, right_keys, left_columns=None, right_columns=None, merge_keys: bool = False, ordered: bool = False) -> Table:
        return self.join(other, left_keys, right_keys, left_columns, right_columns, "left", merge_keys, ordered)

    def outer_join(self, other: Table, left_keys, right_keys, left_columns=None, right_columns=None, merge_keys: bool = False, ordered: bool = False) -> Table:
        return self.join(other, left_keys, right_keys, left_columns, right_columns, "outer", merge_keys, ordered)

    def cross_join(self, other: Table, left_keys=(), right_keys=(), left_columns=None, right_columns=None, merge_keys: bool = False, ordered: bool = False) -> Table:
        return self.join(other, left_keys, right_keys, left_columns, right_columns, "cross", merge_keys, ordered)

    def lookup(self, other: Table, *criteria: tuple, all: bool = True) -> Table:  # noqa: A002
        right, order = other._ordered()
        return Table(lookup.lookup(self.df, right, *criteria, all=all, right_order=order))

    def match(self, other: Table, *criteria: tuple, keep_left: Sequence[str] | None = None, keep_right: Sequence[str] | None = None) -> Table:
        right, order = other._ordered()
        return Table(lookup.match(self.df, right, *criteria, keep_left=keep_left, keep_right=keep_right, right_order=order))

    # ---- order

    def sort(self, mapping: Mapping[str, bool], sort_mode: str = "excel") -> Table:
        df, order = self._ordered()
        out = ordering.sorted_rows(df, mapping, sort_mode, order)
        # the sorted order becomes the row order
        return Table(out.drop(position.POS).withColumn(position.POS, F.monotonically_increasing_id()))

    sorted = sort

    def sort_index(self, mapping: Mapping[str, bool], sort_mode: str = "excel") -> list[int]:
        self._bounded()
        df, order = self._ordered()
        return [r["position"] for r in ordering.sort_index(df, mapping, sort_mode, order).collect()]

    def is_sorted(self, mapping: Mapping[str, bool], sort_mode: str = "excel") -> bool:
        df, order = self._ordered()
        return ordering.is_sorted(df, mapping, sort_mode, order)

    # ---- aggregation and shape

    def groupby(self, keys: Sequence[str], functions: Sequence[tuple[str, str]] = (), ordered: bool = False) -> Table:
        return Table(aggregate.groupby(self.df, keys, functions, self.order, ordered))

    def pivot(self, rows: Sequence[str] | str, columns: Sequence[str] | str, functions: Sequence[tuple[str, str]], values_as_rows: bool = True, ordered: bool = False) -> Table:
        as_list = lambda x: [x] if isinstance(x, str) else list(x)
        return Table(aggregate.pivot(self.df, as_list(rows), as_list(columns), functions, values_as_rows, self.order, ordered))

    def pivot_transpose(self, columns: Sequence[str], keep: Sequence[str] | None = None, column_name: str = "transpose", value_name: str = "value") -> Table:
        return Table(aggregate.unpivot(self.df, columns, keep or [], column_name, value_name))

    def transpose(self) -> Table:
        return Table(aggregate.transpose(self.df, self.order))

    def drop_duplicates(self, *columns: str) -> Table:
        return self._new(aggregate.drop_duplicates(self.df, columns, self.order))

    def unique_index(self, *columns: str) -> list[int]:
        """Ordinals of the first row of each combination."""
        found = self.index(*columns).df.select(F.col("positions")[0].alias("p")).limit(self.MAX_EXPORT + 1).collect()
        if len(found) > self.MAX_EXPORT:
            raise ValueError(f"more than {self.MAX_EXPORT} combinations; use index()")
        return sorted(r["p"] for r in found)

    def index(self, *columns: str) -> Table:
        require(self.columns, columns)
        df, order = self._ordered()
        return Table(aggregate.index(df, columns, order))

    def unique(self, column: str) -> list:
        found = self.df.select(f"`{column}`").distinct().orderBy(f"`{column}`").limit(self.MAX_EXPORT + 1).collect()
        if len(found) > self.MAX_EXPORT:
            raise ValueError(f"more than {self.MAX_EXPORT} values; use histogram()")
        return [r[0] for r in found]

    def histogram(self, column: str) -> Table:
        return Table(aggregate.histogram(self.df, column))

    def count(self, column: str, value: object) -> int:
        return values.count_value(self.df, column, value)

    def statistics(self, column: str) -> dict:
        return values.statistics(self.df, column)

    # ---- several tables

    def __add__(self, other: Table) -> Table:
        (a, _), (b, _) = position.ensure(self.df.select(*[f"`{c}`" for c in self.columns], *self._hidden()), None), position.ensure(other.df.select(*[f"`{c}`" for c in other.columns], *other._hidden()), None)
        # the first table's rows, then the other's
        parts = [x.withColumn("__part", F.lit(i)) for i, x in enumerate((a, b))]
        both = combine.append(*parts)
        numbered = position.with_ordinals(both, ["__part", position.POS]).drop("__part", position.POS)
        return Table(numbered.withColumnRenamed(position.ORDINAL, position.POS))

    def _hidden(self) -> list[Column]:
        if not self.order or self.order == [position.POS]:
            return [F.col(position.POS)] if position.POS in self.df.columns else []
        return [F.col(f"`{self.order[0]}`").alias(position.POS)] if len(self.order) == 1 else []

    def stack(self, other: Table) -> Table:
        return Table(combine.stack(self.df.select(*[f"`{c}`" for c in self.columns]), other.df.select(*[f"`{c}`" for c in other.columns])))

    def __mul__(self, times: int) -> Table:
        df, order = self._ordered()
        out = combine.repeat(df, times, order).drop(position.POS)
        return Table(out.withColumn(position.POS, F.monotonically_increasing_id()))

    def diff(self, other: Table, columns: Sequence[str] | None = None, as_sets: bool = False) -> Table:
        if as_sets:
            return Table(combine.diff_sets(self.df, other.df, columns or self.columns))
        return Table(combine.diff_sequences(self.df, other.df, columns or self.columns, self.order, other.order))

    # ---- missing values

    def imputation(self, targets: str | Sequence[str], missing: Iterable | None = None, method: str = "carry forward", sources: Sequence[str] | None = None, exact: bool = False) -> Table:
        df, order = self._ordered() if method in ("carry forward", "nearest neighbour") else (self.df, self.order)
        return self._new(impute.impute(df, targets, missing, method, sources, order, exact), order)

    # ---- exports

    def _bounded(self) -> None:
        if self.df.count() > self.MAX_EXPORT:
            raise ValueError(f"more than {self.MAX_EXPORT} rows; use save() or df.write")

    def _export(self) -> list[tuple]:
        self._bounded()
        return self.rows()

    def to_pandas(self):
        self._bounded()
        df, order = self._ordered()
        return df.orderBy(*order).select(*[f"`{c}`" for c in self.columns]).toPandas()

    def to_json(self) -> str:
        return markup.write_json(self.columns, self._export())

    def to_sql(self, name: str) -> str:
        return markup.write_sql(name, self.df, self._export())

    def to_html(self, path: str | None = None) -> str:
        return self._written(path, "html", markup.write_html(self.columns, self._export()))

    def to_xlsx(self, path: str) -> None:
        self._written(path, "xlsx", sheets.write_xlsx(self.columns, self._export()))

    def to_ods(self, path: str) -> None:
        self._written(path, "ods", sheets.write_ods(self.columns, self._export()))

    def to_csv(self, path: str) -> None:
        self._separated(path, "csv", ",")

    def to_tsv(self, path: str) -> None:
        self._separated(path, "tsv", "\t")

    def to_text(self, path: str) -> None:
        self._separated(path, "txt", "|")

    def to_hdf5(self, path: str) -> None:
        try:
            import h5py
        except ImportError as e:
            raise ImportError("writing hdf5 needs the library h5py") from e
        with h5py.File(path, "w") as f:
            for name, column in self.to_dict().items():
                try:
                    f[name] = column
                except TypeError:
                    f[name] = [str(markup.plain(v)) for v in column]

    def write_csv(self, folder: str, sep: str = ",") -> None:
        """A folder of files, written in parallel; the way for large tables."""
        self.df.select(*[f"`{c}`" for c in self.columns]).write.mode("overwrite").csv(folder, sep=sep, header=True, emptyValue="", nullValue="")

    def _separated(self, path: str, suffix: str, sep: str) -> None:
        import csv
        import io

        out = io.StringIO()
        writer = csv.writer(out, delimiter=sep, lineterminator="\n")
        writer.writerow(self.columns)
        writer.writerows(["" if v is None else markup.plain(v) for v in r] for r in self._export())
        self._written(path, suffix, out.getvalue())

    def _written(self, path: str | None, suffix: str, content: str | bytes):
        if path is None:
            return content
        if not path.endswith(f".{suffix}"):
            raise TypeError(f"the path ends with .{suffix}")
        with open(path, "wb") as f:
            f.write(content.encode() if isinstance(content, str) else content)
        return content

    # ---- display

    def to_ascii(self, rows: slice | None = None, blanks: str | None = None, dtype: bool = False) -> str:
        """Up to 20 rows whole, else the first and last 7."""
        table = self if rows is None else self[rows]
        n = len(table)
        if n <= 20:
            shown = list(enumerate(table.rows()))
        else:
            shown = [*enumerate(table[:7].rows()), None, *enumerate(table[-7:].rows(), n - 7)]
        kinds = [t for c, t in self.df.dtypes if not c.startswith("__")] if dtype else None
        return markup.shown(self.columns, kinds, shown, blanks)

    def show(self, rows: slice | None = None, blanks: str | None = None, dtype: bool = False) -> None:
        print(self.to_ascii(rows, blanks, dtype))

    def _repr_html_(self) -> str:
        return markup.write_html(self.columns, self[:20].rows())


__all__ = ["GroupBy", "Table"]
