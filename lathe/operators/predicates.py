"""Predicates: criteria dictionaries and expressions as text, both as Columns.

A comparison that Python would answer is answered here too: null equals null, a
null is neither smaller nor larger than anything, and values of different kinds
are unequal and unordered.  A predicate may be null, which counts as false: comparisons stay
as they are, so that scans can use them, and only what is negated is made two-valued.
"""

from __future__ import annotations

import ast
import operator
import warnings
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import PySparkTypeError, PySparkValueError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathe.functions.text import as_text, kind_of

OPERATORS = {">": operator.gt, ">=": operator.ge, "==": operator.eq, "<": operator.lt, "<=": operator.le, "!=": operator.ne}
SIDES = {"column1": 0, "value1": 0, "column2": 1, "value2": 1}
Typed = tuple[Column, T.DataType]


def literal(value: object) -> Typed:
    """A literal with its type; integers beyond 64 bits become decimals."""
    if value is None:
        return F.lit(None), T.NullType()
    if isinstance(value, bool):
        return F.lit(value), T.BooleanType()
    if isinstance(value, int) and not -(2**63) <= value < 2**63:
        return F.lit(str(value)).cast("decimal(38,0)"), T.DecimalType(38, 0)
    if isinstance(value, int):
        return F.lit(value).cast("bigint"), T.LongType()
    if isinstance(value, float):
        return F.lit(value), T.DoubleType()
    if isinstance(value, str):
        return F.lit(value), T.StringType()
    from datetime import date, datetime, time, timedelta

    if isinstance(value, datetime):
        return F.lit(value).cast("timestamp_ntz"), T.TimestampNTZType()
    for python, kind in ((date, T.DateType()), (time, T.TimeType()), (timedelta, T.DayTimeIntervalType()), (bytes, T.BinaryType())):
        if isinstance(value, python):
            return F.lit(value), kind
    raise TypeError(f"{value!r} is no literal of a column type")


def compare(left: Typed, op: str, right: Typed, strict_kinds: bool = False) -> Column:
    """One comparison.  ``strict_kinds``: != is false too between different kinds and against null."""
    (a, ta), (b, tb) = left, right
    ka, kb = kind_of(ta), kind_of(tb)
    if op == "in":
        found = F.contains(as_text(b, tb), as_text(a, ta))
        return F.coalesce(found, a.isNull() & b.isNull())
    if op not in OPERATORS:
        raise ValueError(f"unknown criteria {op!r}; use one of {[*OPERATORS, 'in']}")
    if "null" in (ka, kb):
        same = a.isNull() & b.isNull()
        return same if op == "==" else ~same & F.lit(not strict_kinds) if op == "!=" else F.lit(False)
    if ka != kb:
        return F.lit(op == "!=" and not strict_kinds)
    if op == "==":
        return a.eqNullSafe(b)
    if op == "!=":
        return a != b if strict_kinds else ~a.eqNullSafe(b)
    return OPERATORS[op](a, b)


def negated(predicate: Column) -> Column:
    """Not true: false or null."""
    return ~F.coalesce(predicate, F.lit(False))


def column(df: DataFrame, name: str) -> Typed:
    if name not in df.columns:
        raise ValueError(f"no such column: {name!r}")
    return F.col(f"`{name}`"), df.schema[name].dataType


def criterion(df: DataFrame, given: Mapping, strict_kinds: bool = False) -> Column:
    """One dictionary: two of column1 / value1 / column2 / value2, one for each side, and criteria."""
    if len(given) != 3 or "criteria" not in given or {SIDES.get(k) for k in given if k != "criteria"} != {0, 1}:
        raise ValueError(f"a filter has criteria and one of column1, value1 and one of column2, value2: {dict(given)}")
    sides: list = [None, None]
    for k, v in given.items():
        if k != "criteria":
            sides[SIDES[k]] = column(df, v) if k.startswith("column") else literal(v)
    return compare(sides[0], given["criteria"], sides[1], strict_kinds)


def conjunction(parts: list[Column]) -> Column:
    return reduce(operator.and_, parts, F.lit(True)) if parts else F.lit(True)


def disjunction(parts: list[Column]) -> Column:
    return reduce(operator.or_, parts) if parts else F.lit(False)


class _Reader(ast.NodeVisitor):
    """Turns the safe subset of Python expressions into typed Columns."""

    COMPARE = {ast.Gt: ">", ast.GtE: ">=", ast.Eq: "==", ast.Lt: "<", ast.LtE: "<=", ast.NotEq: "!="}
    TEXT = {"startswith": lambda c, x: c.startswith(x), "endswith": lambda c, x: c.endswith(x), "lower": F.lower, "upper": F.upper, "strip": F.trim}

    def __init__(self, df: DataFrame):
        self.df = df

    def generic_visit(self, node: ast.AST):
        raise ValueError(f"not understood in an expression: {ast.unparse(node)}")

    def visit_Expression(self, node):
        return self.visit(node.body)

    def visit_Constant(self, node):
        return literal(node.value)

    def visit_Name(self, node):
        return column(self.df, node.id)

    def truth(self, node: ast.AST) -> Column:
        col, kind = self.visit(node)
        if isinstance(kind, T.BooleanType):
            return col
        if isinstance(kind, T.NumericType):
            return col != 0
        if isinstance(kind, T.StringType):
            return col != ""
        return col.isNotNull()

    def visit_BoolOp(self, node):
        join = conjunction if isinstance(node.op, ast.And) else disjunction
        return join([self.truth(v) for v in node.values]), T.BooleanType()

    def visit_UnaryOp(self, node):
        if isinstance(node.op, ast.Not):
            return negated(self.truth(node.operand)), T.BooleanType()
        col, kind = self.visit(node.operand)
        if isinstance(node.op, ast.USub) and isinstance(kind, T.NumericType):
            return -col, kind
        return self.generic_visit(node)

    def visit_BinOp(self, node):
        (a, ta), (b, tb) = self.visit(node.left), self.visit(node.right)
        if isinstance(node.op, ast.Add) and isinstance(ta, T.StringType) and isinstance(tb, T.StringType):
            return F.concat(a, b), T.StringType()
        if not (isinstance(ta, T.NumericType) and isinstance(tb, T.NumericType)):
            return self.generic_visit(node)
        whole = isinstance(ta, T.IntegralType) and isinstance(tb, T.IntegralType)
        kind = T.LongType() if whole else T.DoubleType()
        zero = F.when(b == 0, None)
        if isinstance(node.op, (ast.Add, ast.Sub, ast.Mult)):
            return {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul}[type(node.op)](a, b), kind
        if isinstance(node.op, ast.Div):
            return zero.otherwise(a.cast("double") / b), T.DoubleType()
        if isinstance(node.op, ast.FloorDiv):
            return zero.otherwise(F.floor(a.cast("double") / b).cast(kind)), kind
        if isinstance(node.op, ast.Mod):
            return zero.otherwise(((a % b) + b) % b), kind
        if isinstance(node.op, ast.Pow):
            return F.pow(a, b), T.DoubleType()
        return self.generic_visit(node)

    def visit_IfExp(self, node):
        (a, ta), (b, tb) = self.visit(node.body), self.visit(node.orelse)
        if kind_of(ta) != kind_of(tb):
            return self.generic_visit(node)
        return F.when(self.truth(node.test), a).otherwise(b), ta

    def visit_Compare(self, node):
        parts, left = [], node.left
        for op, right in zip(node.ops, node.comparators):
            parts.append(self._compare(left, op, right, node))
            left = right
        return conjunction(parts), T.BooleanType()

    def _compare(self, left, op, right, node) -> Column:
        if isinstance(op, (ast.Is, ast.IsNot)):
            if not (isinstance(right, ast.Constant) and right.value is None):
                self.generic_visit(node)
            col = self.visit(left)[0].isNull()
            return col if isinstance(op, ast.Is) else ~col
        if isinstance(op, (ast.In, ast.NotIn)):
            if isinstance(right, (ast.List, ast.Tuple, ast.Set)):
                found = disjunction([compare(self.visit(left), "==", self.visit(x)) for x in right.elts])
            else:
                a, b = self.visit(left), self.visit(right)
                if not (isinstance(a[1], T.StringType) and isinstance(b[1], T.StringType)):
                    self.generic_visit(node)
                found = F.contains(b[0], a[0])
            return found if isinstance(op, ast.In) else negated(found)
        if type(op) not in self.COMPARE:
            self.generic_visit(node)
        return compare(self.visit(left), self.COMPARE[type(op)], self.visit(right))

    def visit_Call(self, node):
        if node.keywords:
            return self.generic_visit(node)
        if isinstance(node.func, ast.Attribute) and node.func.attr in self.TEXT:
            col, kind = self.visit(node.func.value)
            if isinstance(kind, T.StringType) and all(isinstance(a, ast.Constant) for a in node.args):
                out = self.TEXT[node.func.attr](col, *[a.value for a in node.args])
                return out, T.BooleanType() if node.func.attr in ("startswith", "endswith") else T.StringType()
        name = node.func.id if isinstance(node.func, ast.Name) else None
        if name in ("all", "any") and len(node.args) == 1 and isinstance(node.args[0], (ast.Tuple, ast.List)):
            parts = [self.truth(x) for x in node.args[0].elts]
            return (conjunction if name == "all" else disjunction)(parts), T.BooleanType()
        if name in ("min", "max") and len(node.args) > 1:
            cols = [self.visit(a) for a in node.args]
            if len({kind_of(k) for _, k in cols}) == 1:
                return (F.least if name == "min" else F.greatest)(*[c for c, _ in cols]), cols[0][1]
        if len(node.args) == 1 and name in ("len", "abs", "str", "int", "float", "bool", "round"):
            if name == "bool":
                return self.truth(node.args[0]), T.BooleanType()
            col, kind = self.visit(node.args[0])
            if name == "len" and isinstance(kind, T.StringType):
                return F.length(col), T.LongType()
            if name == "abs" and isinstance(kind, T.NumericType):
                return F.abs(col), kind
            if name == "str":
                return F.coalesce(as_text(col, kind), F.lit("None")), T.StringType()
            if name == "int" and isinstance(kind, (T.NumericType, T.StringType)):
                return col.try_cast("double").cast("bigint") if isinstance(kind, T.NumericType) else col.try_cast("bigint"), T.LongType()
            if name == "float" and isinstance(kind, (T.NumericType, T.StringType)):
                return col.try_cast("double"), T.DoubleType()
            if name == "round" and isinstance(kind, T.NumericType):
                return F.bround(col, 0).cast("bigint"), T.LongType()
        return self.generic_visit(node)


def expression(df: DataFrame, text: str, allow_udf: bool = False) -> Column:
    """A Python expression over column names as a boolean Column.

    What the safe subset cannot express raises ValueError, or runs as a Python UDF
    without builtins other than plain functions if ``allow_udf`` is set.
    """
    if not isinstance(text, str):
        raise TypeError(f"{text!r} is no text")
    try:
        tree = ast.parse(text.strip(), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"no expression: {text!r}") from e
    try:
        return _Reader(df).truth(tree.body)
    except ValueError:
        if not allow_udf:
            raise
    names = sorted({n.id for n in ast.walk(tree) if isinstance(n, ast.Name)} & set(df.columns))
    plain = {f.__name__: f for f in (all, any, abs, min, max, len, sum, round, int, float, str, bool, sorted, set)}
    code = ast.unparse(tree)

    def run(*values):
        return bool(eval(code, {"__builtins__": plain}, dict(zip(names, values))))  # noqa: S307

    return F.udf(run, T.BooleanType())(*[F.col(f"`{n}`") for n in names])


def callable_or_value(df: DataFrame, name: str, wanted: object) -> Column:
    """A value to equal, or a function of the value; a function that works on Columns stays in the engine."""
    col, kind = column(df, name)
    if not callable(wanted):
        return compare((col, kind), "==", literal(wanted))
    return call(wanted, [col])


def call(function: Callable, columns: list[Column]) -> Column:
    """A function of Columns as it is; one that only takes plain values, which shows when it asks a Column for its truth or for what values have, as a UDF."""
    try:
        out = function(*columns)
    except (PySparkTypeError, PySparkValueError, TypeError, AttributeError) as e:
        warnings.warn(f"{getattr(function, '__name__', function)} takes no Columns ({e}), so it runs row by row in Python", stacklevel=2)
        out = None
    if isinstance(out, Column):
        return out.cast("boolean")
    return F.coalesce(F.udf(lambda *v: bool(function(*v)), T.BooleanType())(*columns), F.lit(False))
