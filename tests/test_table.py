"""Behaviour of the table, operator by operator, with values written out."""

import math
from datetime import date, datetime, time, timedelta

import pytest
from pyspark.sql import functions as F

from lathe import GroupBy as G
from lathe import Table
from lathe.functions import infer, scalars
from lathe.operators import combine, ordering, position
from lathe.operators.naming import unique_name, unique_names
from lathe.sources import markup, text


@pytest.fixture
def make(spark):
    return lambda **columns: Table.from_columns(spark, columns)


def values(table):
    return table.to_dict()


# ---- construction and access


def test_construction(spark, make):
    t = Table.from_columns(spark, headers=["a", "b"], rows=[[1, "x"], [2, None]])
    assert t.columns == ["a", "b"] and values(t) == {"a": [1, 2], "b": ["x", None]}
    with pytest.raises(ValueError):
        Table.from_columns(spark, {"a": []}, ["a"], [[1]])
    with pytest.raises(ValueError):
        Table.from_columns(spark, headers=["a"], rows=[[1, 2]])
    ragged = make(a=[1, 2, 3], b=["x"])
    assert values(ragged) == {"a": [1, 2, 3], "b": ["x", None, None]}
    assert len(ragged) == 3 and "a" in ragged and list(ragged) == ["a", "b"]


def test_types_round_trip(make):
    given = {
        "A": [-1, 1], "B": [None, 1], "C": [-1.1, 1.1], "D": ["", "é"], "F": [False, True], "G": [datetime(2023, 1, 2, 3, 4, 5), datetime(1999, 1, 1)],
        "H": [date(2020, 1, 1), date(1900, 1, 1)], "I": [time(1, 2, 3), time(0)], "J": [timedelta(1), timedelta(2, 400)], "M": [float("inf"), -float("inf")], "K": ["中国", "한국"],
    }
    t = make(**given)
    assert values(t) == given
    assert t.types()["B"] == {"int": 1, "NoneType": 1}
    big = make(L=[10**23, 1])
    assert [int(v) for v in values(big)["L"]] == [10**23, 1]


def test_access(make):
    t = make(a=list(range(20)), b=[str(i) for i in range(20)], c=[i * 2 for i in range(20)])
    assert t["b", "a"].columns == ["b", "a"]
    assert t[["a", "a"]].columns == ["a"]
    assert values(t[3:10:3])["a"] == [3, 6, 9]
    assert values(t["a", slice(-3, None)])["a"] == [17, 18, 19]
    assert values(t[::-5])["a"] == [19, 14, 9, 4]
    assert t.row(0) == (0, "0", 0) and t.row(-1) == (19, "19", 38)
    with pytest.raises(IndexError):
        t.row(20)
    with pytest.raises(KeyError):
        t["z"]
    with pytest.raises(KeyError):
        t["a", 3]
    assert values(t.delete_rows(slice(-3, None)))["a"] == list(range(17))
    assert values(t.delete_rows(0))["a"] == list(range(1, 20))
    assert values(t.delete_rows(-1))["a"] == list(range(19))
    assert values(t.update("a", slice(0, 4, 2), 99))["a"][:5] == [99, 1, 99, 3, 4]
    assert t.drop_columns("a").columns == ["b", "c"]
    assert t.clear().columns == t.columns and len(t.clear()) == 0


def test_rows_and_columns(make):
    t = make(a=[1], b=["x"])
    assert values(t.add_rows([2, "y"], [3, "z"]))["a"] == [1, 2, 3]
    assert values(t.add_rows(2, "y"))["b"] == ["x", "y"]
    assert values(t.add_rows({"a": 4}))["b"] == ["x", None]
    assert values(t.add_rows(a=[5, 6], b=["p", "q"]))["a"] == [1, 5, 6]
    with pytest.raises(ValueError):
        t.add_rows([1, 2, 3])
    two = make(a=[1, 2, 3])
    assert values(two.add_column("c", [7, 8]))["c"] == [7, 8, None]
    with pytest.raises(ValueError):
        two.add_column("a", [1])
    assert values(two.add_columns("e", "f"))["e"] == [None] * 3
    assert values(two.get_by_indices([2, -1, 0, 0]))["a"] == [3, None, 1, 1]
    assert make(a=[1, 2], b=[3, 4]).equals(make(b=[3, 4], a=[1, 2]))
    assert not make(a=[1, 2]).equals(make(a=[2, 1]))


def test_ordinals_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(7)
    got = position.with_ordinals(df, ["k"], ranges=9).orderBy("k").collect()
    assert [r[position.ORDINAL] for r in got] == list(range(1000))
    carried = position.carry(df.withColumn("v", F.when(F.col("k") % 100 == 3, F.col("k"))), ["k"], {"v": F.col("v")}, ranges=9).orderBy("k").collect()
    last = None
    for r in carried:
        last = r.k if r.k % 100 == 3 else last
        assert r.v == last


# ---- filters


def test_filter(make):
    t = make(a=[1, 2, 3, 4], b=[10, 20, 30, 40])
    good, bad = t.filter([{"column1": "a", "criteria": ">=", "value2": 3}])
    assert values(good)["a"] == [3, 4] and values(bad)["a"] == [1, 2]
    assert values(t.filter([{"column1": "a", "criteria": "==", "value2": 1}, {"column1": "b", "criteria": ">", "value2": 30}], "any")[0])["a"] == [1, 4]
    assert values(t.filter([{"value1": 2, "criteria": "<", "column2": "a"}])[0])["a"] == [3, 4]
    assert values(t.filter("all((a > 1, b != 30))")[0])["a"] == [2, 4]
    everything, nothing = t.filter([])
    assert len(everything) == 4 and len(nothing) == 0
    for wrong in ([{"column1": "a", "criteria": ">"}], [{"column1": "z", "criteria": ">", "value2": 1}], [{"column1": "a", "criteria": "~", "value2": 1}]):
        with pytest.raises(ValueError):
            t.filter(wrong)
    with pytest.raises(ValueError):
        t.filter([{"column1": "a", "criteria": ">", "value2": 1}], "some")


def test_filter_in_is_substring(make):
    t = make(A=["abc", "xyz", None])
    assert values(t.filter([{"value1": "b", "criteria": "in", "column2": "A"}])[0])["A"] == ["abc"]
    assert values(t.filter([{"column1": "A", "criteria": "in", "value2": "wxyz"}])[0])["A"] == ["xyz"]


def test_filter_nulls_and_kinds(make):
    t = make(a=[1, None, 3], s=["x", None, "z"])
    take = lambda c, strict=False: values(t.filter([c], strict_kinds=strict)[0])["a"]
    assert take({"column1": "a", "criteria": "==", "value2": None}) == [None]
    assert take({"column1": "a", "criteria": "!=", "value2": 1}) == [None, 3]
    assert take({"column1": "a", "criteria": "!=", "value2": 1}, True) == [3]
    assert take({"column1": "a", "criteria": "<", "value2": 5}) == [1, 3]
    assert take({"column1": "a", "criteria": "==", "column2": "s"}) == []
    assert take({"column1": "a", "criteria": "!=", "value2": "1"}) == [1, None, 3]
    assert take({"column1": "a", "criteria": "!=", "value2": "1"}, True) == []


@pytest.mark.parametrize(
    "text,want",
    [
        ("a > 1 and b < 40", [2, 3]), ("not a == 2", [1, 3, 4]), ("a in (1, 4)", [1, 4]), ("a + b >= 33 or s is None", [3, 4]), ("1 < a <= 3", [2, 3]), ("len(s) == 2", [2]),
        ("s.startswith('x')", [1]), ("any((a == 1, b == 40))", [1, 4]), ("'y' in s", [2]), ("b // 7 == 2", [2]), ("b % 20 == 0", [2, 4]), ("s is not None and int(a / 2) == 1", [2, 3]),
        ("(a if b > 20 else 0) > 0", [3, 4]), ("abs(-a) == 3", [3]), ("s not in ['x', 'yy']", [3, 4]), ("max(a, 3) == 3", [1, 2, 3]), ("a ** 2 == 16", [4]), ("str(a) == '2'", [2]),
    ],
)
def test_expressions(make, text, want):
    t = make(a=[1, 2, 3, 4], b=[10, 20, 30, 40], s=["x", "yy", "zzz", None])
    assert values(t.filter(text)[0])["a"] == want


def test_expression_refusals(make):
    t = make(a=[1, 2, 3])
    for bad in ("__import__('os')", "a.b", "open('x')", "a >", "z > 1", "[x for x in a]"):
        with pytest.raises(ValueError):
            t.filter(bad)
    with pytest.raises(TypeError):
        t.expression(3)
    assert values(t.filter("sum([a, 1]) == 3", allow_udf=True)[0])["a"] == [2]


def test_all_any_drop(make):
    t = make(a=[1, 2, None, 4], b=["x", None, "x", "y"])
    assert values(t.all(a=1, b="x"))["a"] == [1]
    assert values(t.any(a=4, b=None))["a"] == [2, 4]
    assert values(t.all(a=lambda v: v is not None and v > 1))["a"] == [2, 4]
    assert values(t.all(a=lambda v: v > 1))["a"] == [2, 4]
    assert len(t.all()) == 4 and len(t.any()) == 0
    assert values(t.drop(None))["a"] == [1, 4]
    assert values(t.drop(4, "x"))["a"] == [2]
    with pytest.raises(ValueError):
        t.drop()
    with pytest.raises(ValueError):
        t.all(z=1)


# ---- joins


def test_joins_match_nulls(make):
    n = make(number=[1, 2, 3, 4, None], colour=["black", "blue", "white", "white", "blue"])
    l = make(letter=["a", "b", "c", "d", None], color=["blue", "white", "orange", "white", "blue"])
    got = n.left_join(l, ["colour"], ["color"], ["number"], ["letter"], ordered=True).df.collect()
    assert [tuple(r) for r in got] == [(1, None), (2, "a"), (2, None), (None, "a"), (None, None), (3, "b"), (3, "d"), (4, "b"), (4, "d")]
    outer = [tuple(r) for r in n.outer_join(l, ["colour"], ["color"], ["number"], ["letter"], ordered=True).df.collect()]
    assert outer[:9] == [tuple(r) for r in got] and outer[9:] == [(None, "c")]
    assert len(n.inner_join(l, ["colour"], ["color"])) == 8
    null = make(k=[None, 1])
    assert len(null.inner_join(null, ["k"], ["k"])) == 2
    nan = make(k=[float("nan"), 1.0])
    assert len(nan.inner_join(nan, ["k"], ["k"])) == 1


def test_join_merge_keys(make):
    a, b = make(A=[1, 2, 3, None], B=[10, 20, 30, 40]), make(C=[2, 3, 4, 5], D=["x", "y", "z", None])
    rows = lambda t: sorted(map(tuple, t.df.collect()), key=repr)
    assert rows(a.outer_join(b, ["A"], ["C"], merge_keys=True)) == sorted([(1, 10, None), (2, 20, "x"), (3, 30, "y"), (None, 40, None), (4, None, "z"), (5, None, None)], key=repr)
    assert a.left_join(b, ["A"], ["C"], merge_keys=True).columns == ["A", "B", "D"]
    assert a.inner_join(a, ["A"], ["A"]).columns == ["A", "B", "A_1", "B_1"]
    with pytest.raises(ValueError):
        a.join(b, ["A"], ["C"], kind="sideways")
    with pytest.raises(ValueError):
        a.inner_join(b, ["A", "B"], ["C"])
    with pytest.raises(KeyError):
        a.inner_join(b, ["A"], ["Q"])
    with pytest.raises(TypeError):
        a.inner_join(b, ["A"], ["D"])
    assert len(a.cross_join(b)) == 16
    assert len(a.clear().cross_join(b)) == 0


def test_lookup(make):
    friends = make(name=["Alice", "Betty", "Charlie", "Dorethy", "Edward", "Fred"], stop=["Downtown-1", "Downtown-2", "Hillside View", "Hillside Crescent", "Downtown-2", "Chicago"])
    buses = make(time=[3, 5, 5, 9, 7], stop=["Downtown-1", "Downtown-2", "Downtown-1", "Hillside View", "Downtown-2"], route=[1, 2, 3, 4, 5])
    got = friends.with_column("now", F.lit(4)).lookup(buses, ("now", "<=", "time"), ("stop", "==", "stop"))
    assert {r.name: r.route for r in got.df.collect()} == {"Alice": 3, "Betty": 2, "Charlie": 4, "Dorethy": None, "Edward": 2, "Fred": None}
    assert got.columns == ["name", "stop", "now", "time", "stop_1", "route"]
    one = friends.lookup(buses, ("stop", "==", "stop"))
    assert {r.name: r.route for r in one.df.collect()}["Alice"] == 1
    anyway = friends.lookup(buses, ("stop", "==", "stop"), ("name", "==", "Fred"), all=False)
    assert {r.name: r.route for r in anyway.df.collect()} == {"Alice": 1, "Betty": 2, "Charlie": 4, "Dorethy": None, "Edward": 2, "Fred": 1}
    fn = friends.lookup(buses, ("stop", lambda a, b: a.lower() == b.lower(), "stop"))
    assert {r.name: r.route for r in fn.df.collect()}["Edward"] == 2
    literal = friends.lookup(buses, (7, "==", "time"))
    assert {r.route for r in literal.df.collect()} == {5}
    assert {r.route for r in friends.lookup(buses, ("name", "not in", "stop")).df.collect()} == {1}
    with pytest.raises(ValueError):
        friends.lookup(buses, ("name", "~", "stop"))


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_range_lookup_against_loops(make, op):
    import operator

    left, right = [5, 1, None, 9, 3, 3], [4, 9, None, 2, 7, 4]
    f = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    got = make(i=list(range(6)), v=left).lookup(make(w=right, j=list(range(6))), ("v", op, "w"))
    want = {i: next((j for j, w in enumerate(right) if v is not None and w is not None and f(v, w)), None) for i, v in enumerate(left)}
    assert {r.i: r.j for r in got.df.collect()} == want


def test_match(make):
    bom = make(bom_id=[1, 2, 3, 4, 5], sku=["A", "B", None, "D", "Q"], moq=[10, 20, 10, 40, 99])
    other = make(sku=["B", "A", "A", None], moq=[40, 1, 10, 10], label=["w", "x", "y", "z"])
    got = bom.match(other, ("sku", "==", "sku"), ("moq", "==", "moq"))
    assert {r.bom_id: r.label for r in got.df.collect()} == {1: "x", 2: "w", 3: "y", 4: "w"}
    assert bom.match(other, ("sku", "==", "sku"), keep_left=["bom_id"], keep_right=["label"]).columns == ["bom_id", "label"]
    with pytest.raises(ValueError):
        bom.match(other, ("sku", "<", "sku"))


# ---- aggregation


def test_groupby(make):
    t = make(a=[1, 1, 2, 2, None], b=[1.0, 3.0, None, 4.0, 7.0])
    every = [("b", f) for f in G.functions]
    got = {r[0]: r.asDict() for r in t.groupby(["a"], every).df.collect()}
    two = got[2]
    assert (two["Sum(b)"], two["Count(b)"], two["CountUnique(b)"], two["First(b)"], two["Last(b)"], two["Average(b)"], two["StandardDeviation(b)"]) == (4.0, 2, 2, None, 4.0, 4.0, 0.0)
    assert got[1]["Product(b)"] == 3.0 and got[1]["Median(b)"] == 2.0 and got[1]["Mode(b)"] == 3.0 and math.isclose(got[1]["StandardDeviation(b)"], math.sqrt(2))
    assert None in got
    assert [r[0] for r in t.groupby(["a"], [("b", G.sum)], ordered=True).df.collect()] == [1, 2, None]
    assert len(t.groupby(["a"])) == 3 and len(t.groupby([], [("b", G.max)])) == 1
    for bad in (([], []), (["a", "a"], []), (["a"], [("b", "Average-ish")])):
        with pytest.raises(ValueError):
            t.groupby(*bad)
    with pytest.raises(TypeError):
        make(s=["x"]).groupby([], [("s", G.sum)])


def test_pivot(make):
    t = make(A=[1, 1, 2, 2, 3, 3] * 2, B=[1, 2, 3, 4, 5, 6] * 2, C=[6, 5, 4, 3, 2, 1] * 2)
    wide = t.pivot(["C"], ["A"], [("B", G.sum)], values_as_rows=False, ordered=True)
    assert wide.columns == ["C", "Sum(B,A=1)", "Sum(B,A=2)", "Sum(B,A=3)"]
    assert [tuple(r) for r in wide.df.collect()][:3] == [(6, 2.0, None, None), (5, 4.0, None, None), (4, None, 6.0, None)]
    long = t.pivot(["C"], ["A"], [("B", G.sum), ("B", G.count)], ordered=True)
    assert long.columns == ["C", "function", "(A=1)", "(A=2)", "(A=3)"]
    assert [tuple(r) for r in long.df.collect()][:2] == [(6, "Sum(B)", 2.0, None, None), (6, "Count(B)", 2.0, None, None)]
    nulls = make(r=[1, 1], c=[None, "x"], v=[5, 6]).pivot("r", "c", [("v", G.max)], values_as_rows=False)
    assert nulls.columns == ["r", "Max(v,c=None)", "Max(v,c=x)"]
    assert t.clear().pivot("C", "A", [("B", G.sum)]).columns == ["C", "function"]


def test_unpivot_and_transpose(make):
    t = make(a=[1, 2], b=[10, None], c=["x", "y"])
    got = t.pivot_transpose(["b", "c"], ["a"])
    assert sorted(map(tuple, got.df.collect()), key=repr) == sorted([(1, "b", "10"), (1, "c", "x"), (2, "b", None), (2, "c", "y")], key=repr)
    assert t.pivot_transpose(["b"], ["a"], "a", "a").columns == ["a", "a_1", "a_2"]
    with pytest.raises(ValueError):
        t.pivot_transpose(["b", "b"])
    across = make(k=["p", "q", "p"], v=[1, 2, 3], w=[4, 5, 6]).transpose()
    assert across.columns == ["k", "p", "q"] and [tuple(r) for r in across.df.collect()] == [("v", 3, 2), ("w", 6, 5)]


def test_distinct_rows(make):
    t = make(a=[2, 1, 2, 1], b=["p", "q", "r", "q"])
    assert sorted(map(tuple, t.drop_duplicates("a").df.select("a", "b").collect())) == [(1, "q"), (2, "p")]
    assert len(t.drop_duplicates()) == 3
    assert t.unique_index("a") == [0, 1]
    assert {r.a: r.positions for r in t.index("a").df.collect()} == {2: [0, 2], 1: [1, 3]}
    assert t.unique("a") == [1, 2]
    assert {r["value"]: r["count"] for r in t.histogram("b").df.collect()} == {"p": 1, "q": 2, "r": 1}
    assert t.count("b", "q") == 2 and make(a=[None, 1]).count("a", None) == 1
    assert len(make(a=[-1, -2]).drop_duplicates("a")) == 2


def test_statistics(make):
    s = make(v=[1, 1, 2, 3, 4]).statistics("v")
    assert (s["min"], s["max"], s["mean"], s["median"], s["mode"], s["distinct"], s["sum"], s["summary type"]) == (1, 4, 2.2, 2, 1, 4, 11, "int")
    assert (s["iqr_low"], s["iqr_high"], s["iqr"]) == (1, 3, 2)
    even = make(v=[0, 1, 2, 3]).statistics("v")
    assert (even["median"], even["iqr_low"], even["iqr_high"]) == (1.5, 0.75, 2.25)
    assert make(v=["a", "bbb"]).statistics("v")["max"] == "3 characters"
    assert make(v=[None, None]).statistics("v")["min"] == "n/a"
    assert make(v=[1]).clear().statistics("v") == {}
    days = make(v=[date(2020, 1, 1), date(2020, 1, 3)]).statistics("v")
    assert days["min"] == date(2020, 1, 1) and days["iqr"].endswith("days")
    assert make(v=[True, True, False]).statistics("v")["mode"] is True


# ---- order


def test_sort_modes(make, spark):
    t = make(A=[1, None, 8, 3, 4, 6, 5, 7, 9], C=[0, 1, 0, 1, 0, 1, 0, 1, 0])
    assert values(t.sort({"A": False}))["A"] == [1, 3, 4, 5, 6, 7, 8, 9, None]
    assert values(t.sort({"A": True}))["A"] == [None, 9, 8, 7, 6, 5, 4, 3, 1]
    assert values(t.sort({"A": False}, "unix"))["A"][0] is None
    assert values(t.sort({"A": True}, "unix"))["A"][-1] is None
    assert values(t.sort({"C": False}))["A"] == [1, 8, 4, 5, 9, None, 3, 6, 7]
    assert values(make(A=[10, 9, 1]).sort({"A": False}, "alphanumeric"))["A"] == [1, 10, 9]
    assert values(make(s=["b", "A", "a", "B"]).sort({"s": False}))["s"] == ["a", "A", "b", "B"]
    with pytest.raises(ValueError):
        t.sort({"A": False}, "sideways")
    with pytest.raises(ValueError):
        t.sort({"A": 1})
    mixed = spark.createDataFrame([(v,) for v in ordering.tagged([None, True, 2.0, 3, 4, "5"])], f"A {ordering.MIXED.simpleString()}")
    kinds = lambda mode, down=False: [r.A.kind for r in ordering.sorted_rows(mixed, {"A": down}, mode).collect()]
    assert kinds("excel") == ["number", "number", "number", "text", "bool", "null"]
    assert kinds("excel", True) == ["null", "bool", "text", "number", "number", "number"]
    assert kinds("unix") == ["null", "bool", "number", "number", "number", "text"]
    assert kinds("unix", True) == ["number", "number", "number", "bool", "null", "text"]


def test_sort_index_and_is_sorted(make):
    t = make(A=[3, 1, None, 2])
    assert t.sort_index({"A": False}) == [1, 3, 0, 2]
    assert not t.is_sorted({"A": False})
    assert t.sort({"A": False}).is_sorted({"A": False}) and t.sort({"A": True}).is_sorted({"A": True})
    assert t.sort({"A": False}, "unix").is_sorted({"A": False}, "unix")
    assert make(A=[1, 1, 2], B=[2, 1, 0]).is_sorted({"A": False, "B": True})
    assert not make(A=[1, 1, 2], B=[1, 2, 0]).is_sorted({"A": False, "B": True})


# ---- several tables


def test_combinations(make):
    a, b = make(a=[1, 2], b=[3, 4]), make(b=[5], a=[6])
    assert values(a + b) == {"a": [1, 2, 6], "b": [3, 4, 5]}
    with pytest.raises(ValueError):
        a + make(c=[1])
    stacked = a.stack(make(b=[9], c=["x"]))
    assert stacked.columns == ["a", "b", "c"] and sorted(map(tuple, stacked.df.collect()), key=repr) == sorted([(1, 3, None), (2, 4, None), (None, 9, "x")], key=repr)
    assert values(a * 2)["a"] == [1, 2, 1, 2]
    for bad in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            a * bad


def test_diff(make):
    a, b = make(A=[1, 2, 3, 4]), make(A=[2, 3, 5, 4, 6])
    got = [tuple(r) for r in a.diff(b).df.collect()]
    assert got == [(1, "+", "-"), (2, "=", "="), (3, "=", "="), (5, "-", "+"), (4, "=", "="), (6, "-", "+")]
    assert [tuple(r) for r in make(A=[1, 2]).diff(make(A=[1, 3])).df.collect()] == [(1, "=", "="), (3, "r", "r")]
    sets = sorted(map(tuple, make(A=[1, 1, None]).diff(make(A=[1, None, None]), as_sets=True).df.collect()), key=repr)
    assert sets == sorted([(1, "=", "="), (1, "+", "-"), (None, "=", "="), (None, "-", "+")], key=repr)
    with pytest.raises(ValueError):
        combine.diff_sequences(a.df, b.df, rows=3)


# ---- values


def test_replace_and_merge(make):
    t = make(a=[1, None, 3], b=["x", "y", None])
    assert values(t.replace({1: 10, None: 0})) == {"a": [10, 0, 3], "b": ["x", "y", None]} or values(t.replace({1: 10, None: 0}))["a"] == [10, 0, 3]
    assert values(t.replace({"x": "z"}, ["b"]))["b"] == ["z", "y", None]
    m = make(a=[1, 2], b=[3, 4], c=[0, 1])
    assert values(m.merge("a", "b", "d", "c == 0")) == {"c": [0, 1], "d": [1, 4]}
    assert m.merge("a", "b", "b", "c == 0").columns == ["b", "c"]
    with pytest.raises(AttributeError):
        m.replace_missing_values()
    assert values(make(a=[1, 2, 1]).remove_all("a", 1))["a"] == [2]


def test_column_select(make):
    t = make(n=["1", "0.4", "x", "", None, "1.234,5"], d=["2020-01-02", "02/01/2020", "2.1.2020", "2020-01-02 03:04", "x", "20200102"])
    good, bad = t.column_select([{"column": "n", "type": "int"}, {"column": "d", "type": "date", "rename": "day"}])
    assert sorted(map(tuple, good.df.collect())) == [(0, date(2020, 1, 2)), (1, date(2020, 1, 2)), (1234, date(2020, 1, 2))]
    assert bad.columns == ["reject_reason", "n", "d"]
    assert sorted(r[0] for r in bad.df.collect()) == ["'n' cannot be empty string in 'n[int]'.", "'n[int]' cannot be empty.", "Cannot cast 'x' from 'n[str]' to 'n[int]'."]
    ok, none = t.column_select([{"column": "n", "type": str, "allow_empty": True, "rename": " m "}])
    assert ok.columns == ["m"] and len(ok) == 6 and len(none) == 0
    same = t.column_select([{"column": "d", "type": "str"}, {"column": "d", "type": "datetime"}])[0]
    assert same.columns == ["d", "d_1"]
    with pytest.raises(ValueError):
        t.column_select([{"column": "n", "type": "int", "rename": "  "}])
    with pytest.raises(KeyError):
        t.column_select([{"column": "q", "type": "int"}])


@pytest.mark.parametrize(
    "value,target,want",
    [
        (True, "int", 1), (True, "str", "True"), (5, "bool", True), (0, "bool", False), (5, "float", 5.0), (5, "str", "5"), (86400, "date", date(1970, 1, 2)), (3661, "time", time(1, 1, 1)),
        (3661, "datetime", datetime(1970, 1, 1, 1, 1, 1)), (2.9, "int", 2), (-2.9, "int", -2), (2.5, "str", "2.5"), (1.5, "datetime", datetime(1970, 1, 1, 0, 0, 1, 500000)), ("true", "bool", True),
        ("0.4", "int", 0), ("1,234.5", "float", 1234.5), ("10:20:30", "time", time(10, 20, 30)), (date(1970, 1, 2), "int", 86400), (date(2020, 1, 2), "datetime", datetime(2020, 1, 2)),
        (date(2020, 1, 2), "str", "2020-01-02"), (date(2020, 1, 2), "time", None), (time(0, 1), "int", 60), (time(1, 2, 3), "str", "01:02:03"), (time(1), "date", None),
        (datetime(2020, 1, 2, 3, 4, 5), "date", date(2020, 1, 2)), (datetime(2020, 1, 2, 3, 4, 5), "time", time(3, 4, 5)), (datetime(1970, 1, 1, 0, 0, 1), "float", 1.0),
        (datetime(2020, 1, 2, 3, 4, 5), "str", "2020-01-02 03:04:05"), ("maybe", "bool", None),
    ],
)
def test_cast_matrix(make, value, target, want):
    good, bad = make(v=[value]).column_select([{"column": "v", "type": target, "rename": "w"}])
    got = good.df.collect()
    if want is None:
        assert not got and len(bad) == 1
    else:
        assert got[0].w == want


@pytest.mark.parametrize(
    "texts,kind",
    [
        (["1", "2", ""], "int"), (["1.000", "2.000.000"], "int"), (["1,000", "2"], "int"), (["1", "2.5"], "float"), (["1.234,5", "2"], "float"), (["1,234.5"], "float"), (["true", "False"], "bool"),
        (["2020-01-02", "2020-1-3"], "date"), (["31.12.2020"], "date"), (["20201231"], "int"), (["2020-01-02 03:04:05", "2020-01-02T03:04"], "datetime"), (["13/04/2014 00:00", "1/4/2014 10:05"], "datetime"),
        (["10:11", "10:11:12"], "time"), (["x", "1"], "str"), ([None, ""], "str"), (["1e3", "-.5"], "float"), (["#N/A", "7"], "int"), (["2020-13-40"], "str"),
    ],
)
def test_inference(spark, texts, kind):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert infer.vote(df)["v"].type == kind


def test_typed_values(spark):
    df = spark.createDataFrame([("1.234,5", "31.12.2020", "", "a"), ("2", "1/2/2021", "None", "")], "f string, d string, n string, s string")
    got = [tuple(r) for r in infer.typed(df).collect()]
    assert got == [(1234.5, date(2020, 12, 31), "", "a"), (2.0, date(2021, 2, 1), "None", "")]
    assert infer.guess(["1", None, "3"], spark) == [1, None, 3]
    with pytest.raises(TypeError):
        infer.infer(F.lit("x"), "complex")


def test_rounding_and_ranges(spark):
    df = spark.createDataFrame([(1.0,), (1.5,), (2.0,), (2.6,), (-0.4,)], "v double")
    assert [r[0] for r in df.select(scalars.xround(F.col("v"), 1)).collect()] == [1.0, 1.0, 2.0, 3.0, 0.0]
    assert [r[0] for r in df.select(scalars.xround(F.col("v"), 2, True)).collect()] == [2.0, 2.0, 2.0, 4.0, 0.0]
    at = spark.createDataFrame([(datetime(2022, 8, 18, 11, 14, 53),)], "t timestamp_ntz")
    assert at.select(scalars.xround_time(F.col("t"), timedelta(hours=1))).first()[0] == datetime(2022, 8, 18, 11)
    got = scalars.date_range(spark, datetime(2020, 1, 3), datetime(2020, 1, 1), timedelta(days=-1)).collect()
    assert [r[0] for r in got] == [datetime(2020, 1, 3), datetime(2020, 1, 2)]
    for a, b in ((range(0, 20, 3), range(1, 30, 4)), (range(5), range(5, 9)), (range(10, 0, -2), range(0, 12)), (range(0), range(3)), (range(2, 40, 6), range(0, 40, 4))):
        assert sorted(scalars.range_intercept(a, b)) == sorted(set(a) & set(b))


# ---- missing values


def test_imputation(make):
    t = make(a=[None, 1, None, 3, None], b=["x", None, "y", "y", None])
    assert values(t.imputation("a"))["a"] == [None, 1, 1, 3, 3]
    assert values(t.imputation(["a"], method="mean"))["a"] == [2, 1, 2, 3, 2]
    assert values(t.imputation("b", method="mode"))["b"] == ["x", "y", "y", "y", "y"]
    assert values(make(a=[-1, 5, -1]).imputation("a", missing={-1}))["a"] == [-1, 5, 5] or values(make(a=[-1, 5, -1]).imputation("a", missing={-1}))["a"] == [None, 5, 5]
    with pytest.raises(TypeError):
        t.imputation("b", method="mean")
    with pytest.raises(ValueError):
        t.imputation("a", method="guess")


@pytest.mark.parametrize("exact", [False, True])
def test_nearest_neighbour(make, exact):
    t = make(a=[1, 2, 3, 10, 11, None], b=[10, 20, 30, 100, None, 100])
    got = values(t.imputation(["a", "b"], method="nearest neighbour", sources=["a", "b"], exact=exact))
    assert got["b"][4] == 100 and got["a"][5] == 10


# ---- files


def test_csv(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("a,b, c ,a\n1,2.5,x,9\n2,,y\n\n3,3.5,z,8,77\n")
    t = Table.from_file(spark, str(p))
    assert t.columns == ["a", "b", "c", "a_1"]
    assert values(t) == {"a": [1, 2, None, 3], "b": [2.5, None, None, 3.5], "c": ["x", "y", "", "z"], "a_1": [9, None, None, 8]}
    assert values(Table.from_file(spark, str(p), skip_empty="ANY"))["a"] == [1, 3]
    assert values(Table.from_file(spark, str(p), skip_empty="ALL"))["a"] == [1, 2, 3]
    assert values(Table.from_file(spark, str(p), start=1, limit=2, columns=["a"]))["a"] == [2, None]
    assert Table.from_file(spark, str(p), first_row_has_headers=False, guess_datatypes=False).columns == ["0", "1", "2", "3"]
    for bad in ({"columns": ["q"]}, {"limit": 0}, {"start": -1}, {"skip_empty": "some"}):
        with pytest.raises((OSError, ValueError)):
            Table.from_file(spark, str(p), **bad)
    with pytest.raises(ValueError):
        Table.from_file(spark, "x.unknown")


def test_quoted_csv_encodings_and_headers(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_bytes("﻿name;n\n\"a;b\nc\";\"1.248,00\"\n\"é\";\"2,5\"\n".encode())
    t = Table.from_file(spark, str(p), delimiter=";", text_qualifier='"')
    assert values(t) == {"name": ["a;b\\nc", "é"], "n": [1248.0, 2.5]}
    w = tmp_path / "w.csv"
    w.write_bytes("a,b\né,1\n€,2\n".encode("windows-1252"))
    assert values(Table.from_file(spark, str(w)))["a"] == ["é", "€"]
    head = text.get_headers(spark, str(p), linecount=2)
    assert head["delimiter"] == ";" and head["q.csv"][0] == ["name", "n"]
    j = tmp_path / "j.csv"
    j.write_text("junk\nheader\n1\n2\n")
    assert values(Table.from_file(spark, str(j), header_row_index=1)) == {"header": [1, 2]}
    assert text.detect_separator("a b c") == " " and text.detect_separator("a\nb") == "\n"
    with pytest.raises(ValueError):
        text.detect_separator("abc")
    assert text.split_line('a,"b,c",(d,e),f', ",", qualifier='"') == ["a", "b,c", "(d,e)", "f"]
    assert text.split_by_sequence("a=1;b", ["=", ";"]) == ["a", "1", "b"]
    (tmp_path / "e.csv").write_text("\n")
    assert len(Table.from_file(spark, str(tmp_path / "e.csv"))) == 0


def test_exports(make, spark, tmp_path):
    t = make(a=[1, None, 3], s=["x,y", None, "<b>"], f=[1.5, 2.0, None], d=[date(2020, 1, 2), None, date(1999, 12, 31)], b=[True, False, None], ts=[datetime(2020, 1, 2, 3, 4), None, None])
    t.to_csv(str(tmp_path / "o.csv"))
    back = Table.from_file(spark, str(tmp_path / "o.csv"), text_qualifier='"')
    assert values(back)["a"] == [1, None, 3] and values(back)["s"] == ["x,y", "", "<b>"]
    for kind, write in (("xlsx", t.to_xlsx), ("ods", t.to_ods)):
        write(str(tmp_path / f"o.{kind}"))
        sheet = values(Table.from_file(spark, str(tmp_path / f"o.{kind}")))
        assert sheet["a"] == [1, None, 3] and sheet["s"] == ["x,y", None, "<b>"] and sheet["b"] == [True, False, None] and sheet["f"] == [1.5, 2.0, None]
        assert [None if v is None else (v.year, v.month, v.day) for v in sheet["d"]] == [(2020, 1, 2), None, (1999, 12, 31)]
    json = Table.from_json(spark, t.to_json())
    assert json.columns[0] == "row id" and values(json)["a"] == [1, None, 3]
    assert values(Table.from_html(spark, t.to_html()))["a"] == [1, None, 3]
    sql = t.to_sql("tab")
    assert "NULL" in sql and "'NULL'" not in sql
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.executescript(sql)
    assert con.execute("select a, s from tab").fetchall() == [(1, "x,y"), (None, None), (3, "<b>")]
    assert t.to_pandas().shape == (3, 6)
    t.save(str(tmp_path / "saved"))
    assert Table.load(spark, str(tmp_path / "saved")).equals(t)
    with pytest.raises(TypeError):
        t.to_csv(str(tmp_path / "o.txt"))
    assert "x,y" in t.to_ascii() and "..." in make(a=list(range(30))).to_ascii(dtype=True)
    assert markup.synthetic_orders(spark, 10).count() == 10
    t.write_csv(str(tmp_path / "parts"))
    assert spark.read.csv(str(tmp_path / "parts"), header=True).count() == 3


def test_registered_reader(spark, tmp_path):
    from lathe.sources.registry import file_readers

    file_readers["pairs"] = lambda spark, path, **_: spark.createDataFrame([(1, 2)], "a int, b int")
    try:
        assert Table.from_file(spark, "x.pairs").columns == ["a", "b"]
    finally:
        del file_readers["pairs"]


def test_codec_and_ranks():
    from lathe.functions import codec

    for v in (True, 1, 2.5, "x", date(2020, 1, 2), datetime(2020, 1, 2, 3, 4), time(1, 2), timedelta(1, 2.5)):
        assert codec.from_json(codec.to_json(v), type(v)) == v
    assert codec.from_json("NULL", int) is None and codec.from_json("", str) == ""
    with pytest.raises(ValueError):
        codec.from_json("maybe", bool)
    with pytest.raises(TypeError):
        codec.from_json("x", complex)
    assert list(codec.text_sort(["B", "a", "b", "A"])) == ["a", "A", "b", "B"]
    assert list(codec.excel_sort([None, True, "5", 3, 2.0])) == [2.0, 3, "5", True, None]
    assert list(codec.excel_sort([None, "5", 3], reverse=True)) == [None, "5", 3]
    assert list(codec.unix_sort(["5", 3, None, False])) == [None, False, 3, "5"]
    assert list(codec.unix_sort(["5", 3, None], reverse=True)) == [3, None, "5"]


def test_predominant_types(make):
    from lathe.operators.values import predominant_types

    assert predominant_types(make(a=[1, None], b=["x", "y"], c=[None, None]).df) == {"a": "int", "b": "str", "c": "NoneType"}


def test_names():
    assert unique_name("a", ["a", "a_1"]) == "a_2"
    assert unique_names(["a", "a", "b"]) == ["a", "a_1", "b"]


# ---- streams


def test_streams(spark, tmp_path):
    from lathe.streaming import stateless

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    good, _ = stateless.apply(stream, "filter", [{"column1": "value", "criteria": ">", "value2": 5.0}])
    q = good.writeStream.format("memory").queryName("lathe_good").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("lathe_good").count() == events.where("value > 5").count()
    with pytest.raises(ValueError):
        stateless.apply(stream, "sort", {"value": False})
    hourly = stateless.windowed(stream, "ts", "1 hour", "10 minutes", ["event_type"], {"n": F.count(F.lit(1))})
    q = hourly.writeStream.format("memory").outputMode("complete").queryName("lathe_hours").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("lathe_hours").agg(F.sum("n")).first()[0] == events.count()


def test_rows_are_never_cut_off(make, monkeypatch):
    table = make(a=list(range(10)))
    monkeypatch.setattr(Table, "MAX_EXPORT", 9)
    for f in (table.rows, table.to_dict, table.to_pandas, table.to_json, lambda: table.unique("a"), lambda: table.unique_index("a"), lambda: table.sort_index({"a": True})):
        with pytest.raises(ValueError):
            f()
    monkeypatch.setattr(Table, "MAX_EXPORT", 10)
    assert table.to_dict() == {"a": list(range(10))}


def test_equality_and_size(make):
    a = make(x=[1, 2, None], y=["a", "bc", None])
    assert a == make(x=[1, 2, None], y=["a", "bc", None]) and a == {"x": [1, 2, None], "y": ["a", "bc", None]}
    assert a != make(x=[1, 2, 3], y=["a", "bc", None]) and a != {"x": [1]} and a != 3
    assert a == {"y": ["a", "bc", None], "x": [1, 2, None]} and a.nbytes() == 2 * 8 + 3


def test_functions_of_frames(make):
    doubled = make(a=[1, 2], b=["x", "y"]).apply(lambda frames: (f.assign(a=f["a"] * 2) for f in frames), "a bigint, b string")
    assert sorted(map(tuple, doubled.df.collect())) == [(2, "x"), (4, "y")]


class Rows:
    """A list that is assigned to as a column is."""

    def __init__(self, items):
        self.items = list(items)

    def put(self, key, values):
        if isinstance(key, int):
            self.items[key] = values
        elif key.step in (None, 1):
            start, stop, _ = key.indices(len(self.items))
            start, stop = (0 if key.start is None else start), (len(self.items) if key.stop is None else stop)
            self.items[start : max(start, stop)] = values
        else:
            for i, v in zip(range(*key.indices(len(self.items))), values):
                self.items[i] = v
        return self.items


@pytest.mark.parametrize(
    ("key", "values"),
    [
        (slice(None), [1, 2, 3]), (slice(0, None), [1]), (slice(4, None), [1, 2, 3, 4, 5]), (slice(None, 3), [1, 2]), (slice(3, 5), [1, 2, 3]), (slice(2, 2), [7]), (slice(5, 2), [8, 9]),
        (slice(0, 9, 3), [1, 2, 3]), (slice(None, None, -1), [1, 2]), (slice(3, 6), []), (4, 99), (-1, 98), (slice(20, None), [5]),
    ],
)
def test_assignment(make, key, values):
    table = make(a=list(range(10, 19)), b=list("abcdefghi"))
    want = Rows(range(10, 19)).put(key, values)
    got = table.assign("a", key, values).to_dict()
    n = max(len(want), 9)
    assert got == {"a": want + [None] * (n - len(want)), "b": [*"abcdefghi"] + [None] * (n - 9)}


def test_assignment_refusals(make):
    table = make(a=[1, 2, 3])
    with pytest.raises(ValueError):
        table.assign("a", slice(0, 3, 2), [1, 2, 3])
    with pytest.raises(IndexError):
        table.assign("a", 3, 1)
    with pytest.raises(TypeError):
        table.assign("a", 1, [1])
    assert table.extend("a", [4]).to_dict() == {"a": [1, 2, 3, 4]}


def test_reader_options(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("k,v\n1,(a,b)\n2,[c,(d,e)]\n3,f)\n")
    got = Table.from_file(spark, str(path), text_escape_openings="([", text_escape_closures=")]", newline="\n").to_dict()
    assert got == {"k": [1, 2, 3], "v": ["(a,b)", "[c,(d,e)]", "f)"]}
    for wrong in ({"delimitr": ";"}, {"tqdmm": 1}):
        with pytest.raises(TypeError):
            Table.from_file(spark, str(path), **wrong)
    with pytest.raises(ValueError):
        Table.from_file(spark, str(path), newline=";")
    assert Table.from_file(spark, str(path), sheet="x", limit=1).to_dict()["k"] == [1]
    (tmp_path / "a.ssv").write_text("k;v\n1;2\n")
    assert Table.from_file(spark, str(tmp_path / "a.ssv")).to_dict() == {"k": [1], "v": [2]}


def test_blank_rows_of_a_sheet_keep_their_place(spark):
    from lathe.sources import sheets

    raw = sheets.write_ods(["a"], [[1], [2]])
    import io
    import zipfile

    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        content = z.read("content.xml").decode()
    first, second, third = content.split("</table:table-row>")[:3]
    blank = '<table:table-row table:number-rows-repeated="3"><table:table-cell/></table:table-row>'
    end = '<table:table-row table:number-rows-repeated="1048000"><table:table-cell/></table:table-row>'
    made = "</table:table-row>".join([first, second, blank.removesuffix("</table:table-row>"), third, end.removesuffix("</table:table-row>"), content.split("</table:table-row>")[3]])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", made)
    assert sheets.ods_sheets(out.getvalue())["Sheet1"] == [["a"], [1], [], [], [], [2]]
    assert sheets.peek(out.getvalue(), "ods", 3) == {"Sheet1": [["a"], [1], [None]]}


def test_own_aggregates(make):
    import pandas as pd

    def spread(v):
        return F.max(v) - F.min(v)

    @F.pandas_udf("double")
    def middle(v: pd.Series) -> float:
        return float(v.median())

    got = make(k=["a", "a", "b"], v=[1, 5, 7]).groupby(["k"], [("v", spread), ("v", middle), ("v", G.sum)])
    assert sorted(map(tuple, got.df.collect())) == [("a", 4, 3.0, 6.0), ("b", 0, 7.0, 7.0)]


def test_histogram_of_statistics(make, monkeypatch):
    from lathe.operators import values

    assert make(a=[3, 1, 3, None]).statistics("a")["histogram"] == [[1, 3, None], [1, 2, 1]]
    assert make(a=[None, None]).statistics("a")["histogram"] == [[None], [2]]
    monkeypatch.setattr(values, "HISTOGRAM", 2)
    assert make(a=[3, 1, 3, None]).statistics("a")["histogram"] is None


def test_quartiles_over_many_ranges(make, monkeypatch):
    from lathe.operators import position

    data = [(i * 37) % 101 for i in range(400)] + [5] * 150
    want = make(v=data).statistics("v")
    monkeypatch.setattr(position, "RANGE_ROWS", 9)
    assert make(v=data).statistics("v") == want
    ordered = sorted(data)
    assert want["median"] == (ordered[274] + ordered[275]) / 2


def test_range_lookup_of_a_hot_key(make, monkeypatch):
    from lathe.operators import lookup, position

    left = make(k=[i % 3 for i in range(60)], v=[(i * 7) % 50 for i in range(60)])
    right = make(k=[0] * 80 + [1, 1, None], w=[(i * 13) % 60 for i in range(83)], n=list(range(83)))
    want = {op: left.lookup(right, ("k", "==", "k"), ("v", op, "w")).rows() for op in ("<", "<=", ">", ">=")}
    monkeypatch.setattr(lookup, "HOT_ROWS", 10)
    monkeypatch.setattr(position, "RANGE_ROWS", 7)
    for op, rows in want.items():
        assert sorted(left.lookup(right, ("k", "==", "k"), ("v", op, "w")).rows(), key=repr) == sorted(rows, key=repr)


def test_theta_lookup_without_broadcast(make, monkeypatch):
    from lathe.operators import lookup

    left, right = make(a=[1, 5, 9], b=[2, 2, 8]), make(c=[0, 6, 3], d=[9, 1, 5])
    want = left.lookup(right, ("a", "<", "c"), ("b", "<", "d"), all=False).rows()
    monkeypatch.setattr(lookup, "THETA_BYTES", 0)
    assert left.lookup(right, ("a", "<", "c"), ("b", "<", "d"), all=False).rows() == want


ANY_LOOKUPS = {
    "equal or below": [("a", "==", "p"), ("b", "<", "q")],
    "two ranges": [("a", ">=", "p"), ("b", "<=", "q")],
    "one range": [("b", ">", "q")],
    "unequal": [("b", "!=", "q")],
    "unequal or equal": [("s", "!=", "u"), ("a", "==", "p")],
    "inside": [("s", "in", "u"), ("b", ">", "q")],
    "not inside": [("s", "not in", "u"), ("a", "==", "p")],
    "literals": [("s", "==", "x"), (7, "==", "p"), ("a", "==", "p")],
    "other kinds": [("t", "==", "p"), ("t", "<", "q"), ("a", "==", "p")],
    "wider type": [("n", "==", "d"), ("n", "<", "d")],
    "equal in the wider type": [("n", "==", "d"), ("a", ">", "p")],
}


@pytest.mark.parametrize("name", ANY_LOOKUPS)
def test_any_lookup_against_loops(make, monkeypatch, name):
    """In many ranges, with nulls, equal values and values that only differ in the narrower type."""
    import operator

    monkeypatch.setattr(position, "RANGE_ROWS", 5)
    big = 2**53
    left = {"a": [i % 5 if i % 7 else None for i in range(40)], "b": [(i * 17) % 50 if i % 6 else None for i in range(40)], "s": [["x", "xy", "z", None][i % 4] for i in range(40)], "t": ["x"] * 40, "n": [big + i % 4 for i in range(40)]}
    right = {"p": [(i * 3) % 9 + 2 if i % 5 else None for i in range(30)], "q": [(i * 13) % 40 if i % 4 else None for i in range(30)], "u": [["xyz", "y", "x", None][(i // 3) % 4] for i in range(30)], "d": [float(big - 6 + 2 * ((i * 7) % 5)) for i in range(30)]}
    order = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}

    def meets(x, op, y):
        if "in" in op:
            return ((x is None and y is None) or (x is not None and y is not None and x in y)) is (op == "in")
        if isinstance(x, float) or isinstance(y, float):
            x, y = (None if v is None else float(v) for v in (x, y))
        if op in order:
            return type(x) is type(y) and x is not None and order[op](x, y)
        return (x == y) is (op == "==")

    def side(table, given, i):
        return table[given][i] if given in table else given

    want = [next((j for j in range(30) if any(meets(side(left, l, i), op, side(right, r, j)) for l, op, r in ANY_LOOKUPS[name])), None) for i in range(40)]
    got = make(i=list(range(40)), **left).lookup(make(j=list(range(30)), **right), *ANY_LOOKUPS[name], all=False)
    assert sorted((r.i, r.j) for r in got.df.select("i", "j").collect()) == list(enumerate(want))


def test_any_lookup_pairs_no_rows(spark):
    from lathe.plans.catalogue import QUERIES

    plan = QUERIES["lookup_any"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_lookup_in_a_sorted_table(spark):
    """The row order that sorting makes is the same where positions are found and where their rows are."""
    n = 20_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(n).select((F.col("id") * 7919 % n).alias("w"), F.col("id").alias("k"), F.col("id").cast("string").alias("text")).repartition(7)
        left = Table(spark.range(500).select((F.col("id") * 40).alias("v")))
        got = left.lookup(Table(rows).sort({"w": True}), ("v", "==", "w"), all=False).df.select("v", "k", "text").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(map(tuple, got)) == [(v, k := v * pow(7919, -1, n) % n, str(k)) for v in range(0, n, 40)]


def test_gathered_rows_keep_their_places(spark, monkeypatch):
    """A gathered or sorted table over many ranges, read once for its sizes and once for its rows."""
    monkeypatch.setattr(position, "RANGE_ROWS", 2_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        n = 20_000
        rows = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 7919 % n).alias("v"), F.col("id").cast("string").alias("ord")).repartition(7)
        wanted = spark.range(n).select(F.col("id").alias("ord"), (n - 1 - F.col("id")).alias("pos"))
        turned = Table(rows, ["k"]).get_by_indices(wanted)
        assert turned.columns == ["k", "v", "ord"]
        for table, key, want in ((turned, "k", lambda p: n - 1 - p), (Table(rows, ["k"]).sort({"v": False}), "v", lambda p: p), (Table(rows, ["k"]).sort({"v": True}), "v", lambda p: n - 1 - p)):
            places = position.with_ordinals(table.df, [position.POS]).select(position.ORDINAL, key, "ord").collect()  # sizes need no ord
            assert sorted(r[0] for r in places) == list(range(n))
            assert all(r[1] == want(r[0]) for r in places)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_reindex_over_many_ranges(spark, monkeypatch):
    from lathe.plans.catalogue import QUERIES

    monkeypatch.setattr(position, "RANGE_ROWS", 1_000)
    keys = [r.o_orderkey for r in spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey").collect()]
    # joined and dealt as large tables are
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        places = QUERIES["reindex"](spark, "/root/testdata/sf0.01").select("place", "o_orderkey").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, places)) == list(enumerate(sorted(keys, reverse=True)))


def test_steady_frames(spark):
    """Only ids over rows that are dealt are written, columns without a type among them."""
    scan = spark.range(9).withColumn(position.POS, F.monotonically_increasing_id())
    assert position.steady(scan) is scan
    assert position.steady(dealt := scan.orderBy("id")) is dealt
    loose = spark.range(9).orderBy(F.col("id").desc()).select("id", F.lit(None).alias("none"), F.monotonically_increasing_id().alias(position.POS))
    kept = position.steady(loose)
    assert kept.dtypes == loose.dtypes
    assert [r.id for r in kept.orderBy(position.POS).collect()] == list(range(8, -1, -1))
    assert position.steady(kept) is kept


def test_nearest_neighbour_by_one_rank(make, monkeypatch):
    """Against loops over all donors, in many ranges."""
    from lathe.operators import position

    monkeypatch.setattr(position, "RANGE_ROWS", 5)
    v = [(i * 29) % 47 if i % 9 else None for i in range(60)]
    x = [f"x{i}" if i % 4 else None for i in range(60)]
    got = make(v=v, x=x).imputation("x", method="nearest neighbour", sources=["v"]).to_dict()["x"]
    known = sorted({a for a in v if a is not None})
    rank = {a: i / len(known) for i, a in enumerate(known)}
    for i in range(60):
        if x[i] is None:
            far = lambda j: 0.0 if v[i] is None else float("inf") if v[j] is None else abs(rank[v[i]] - rank[v[j]])
            best = min((far(j), j) for j in range(60) if x[j] is not None)
            assert got[i] == x[best[1]], i


def test_functions_of_plain_values_are_named(make):
    with pytest.warns(UserWarning, match="row by row"):
        assert make(a=["x", "yy"]).all(a=lambda v: len(v) > 1).to_dict() == {"a": ["yy"]}
    with pytest.raises(ZeroDivisionError):
        make(a=[1]).all(a=lambda v: 1 // 0)
