"""The queries over the standard tables, with their SQL.

Every query runs an operator of the engine over whole tables; ORACLE_SQL says the
same in ANSI SQL.  Row order that a result depends on is named by a key, so it
is the same in any engine and for any partitioning.
"""

from __future__ import annotations

import atexit
import os
import shutil
import sqlite3
import tempfile
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lathe.functions import infer, scalars
from lathe.operators import aggregate, combine, impute, lookup, ordering, position, values
from lathe.operators.aggregate import GroupBy as G
from lathe.sources import registry
from lathe.table import Table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
KEYS = {"orders": ["o_orderkey"], "events": ["event_id"], "customer": ["c_custkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "documents": ["doc_id"]}


class Tables:
    """The standard tables of one folder, each with its row order."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> Table:
        return Table(self.spark.read.parquet(f"{self.folder}/{name}.parquet"), KEYS.get(name))


def query(name: str, sql: str | None = None):
    """Register a query that takes Tables and gives a Table or DataFrame."""

    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = f(Tables(spark, folder))
            df = out.df if isinstance(out, Table) else out
            return df.select(*[f"`{c}`" for c in df.columns if not c.startswith("__")])

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["groupby_filtered"](spark, folder)


# ---- filters

_BIG = [{"column1": "l_quantity", "criteria": ">", "value2": 25.0}, {"column1": "l_returnflag", "criteria": "==", "value2": "R"}]
_BIG_SQL = "l_quantity > 25 AND l_returnflag = 'R'"


@query("filter_all_pass", f"SELECT * FROM lineitem WHERE coalesce({_BIG_SQL}, false)")
def _(t):
    return t.lineitem.filter(_BIG)[0]


@query("filter_all_fail", f"SELECT * FROM lineitem WHERE NOT coalesce({_BIG_SQL}, false)")
def _(t):
    return t.lineitem.filter(_BIG)[1]


@query("filter_any", "SELECT * FROM orders WHERE o_totalprice > 300000 OR o_orderstatus = 'F' OR o_orderpriority != '5-LOW'")
def _(t):
    return t.orders.filter([{"column1": "o_totalprice", "criteria": ">", "value2": 300000.0}, {"column1": "o_orderstatus", "criteria": "==", "value2": "F"}, {"column1": "o_orderpriority", "criteria": "!=", "value2": "5-LOW"}], "any")[0]


@query("filter_in_substring", "SELECT * FROM part WHERE contains(p_type, 'ST') AND contains('Brand#1 Brand#12 Brand#23 Brand#34', p_brand)")
def _(t):
    return t.part.filter([{"value1": "ST", "criteria": "in", "column2": "p_type"}, {"column1": "p_brand", "criteria": "in", "value2": "Brand#1 Brand#12 Brand#23 Brand#34"}])[0]


@query("filter_column_vs_column", "SELECT * FROM lineitem WHERE l_discount > l_tax")
def _(t):
    return t.lineitem.filter([{"column1": "l_discount", "criteria": ">", "column2": "l_tax"}])[0]


@query("filter_not_equal_nulls", "SELECT * FROM (SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders) WHERE p IS DISTINCT FROM '5-LOW'")
def _(t):
    orders = Table(t.orders.df.select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p")))
    return orders.filter([{"column1": "p", "criteria": "!=", "value2": "5-LOW"}])[0]


@query("filter_expression", "SELECT * FROM lineitem WHERE l_quantity * 2 >= 60 AND (l_returnflag IN ('A', 'N') OR NOT l_tax < 0.05) AND l_extendedprice / l_quantity < 1500")
def _(t):
    return t.lineitem.filter("all((l_quantity * 2 >= 60, l_returnflag in ['A', 'N'] or not l_tax < 0.05, l_extendedprice / l_quantity < 1500))")[0]


@query("all_kwargs", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0")
def _(t):
    return t.customer.all(c_mktsegment="BUILDING", c_acctbal=lambda v: v > 0)


@query("any_kwargs", "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 7")
def _(t):
    return t.customer.any(c_mktsegment="BUILDING", c_nationkey=7)


@query("drop_values", "SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, o_orderpriority AS p FROM orders) WHERE s IS NOT NULL AND p != '5-LOW'")
def _(t):
    return Table(t.orders.df.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"), F.col("o_orderpriority").alias("p"))).drop(None, "5-LOW")


# ---- projection, slices, replacement


@query("select_columns", "SELECT o_totalprice, o_orderkey FROM orders")
def _(t):
    return t.orders["o_totalprice", "o_orderkey"]


_POS_SQL = "(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)"


@query("slice_rows", f"SELECT * EXCLUDE (pos) FROM {_POS_SQL} WHERE pos >= 100 AND pos < 2000 AND (pos - 100) % 7 = 0")
def _(t):
    return t.orders[100:2000:7]


@query("slice_last", f"SELECT o_orderkey, o_totalprice FROM {_POS_SQL} WHERE pos >= (SELECT count(*) FROM orders) - 25")
def _(t):
    return t.orders["o_orderkey", "o_totalprice", slice(-25, None)]


@query("delete_rows", f"SELECT * EXCLUDE (pos) FROM {_POS_SQL} WHERE NOT (pos >= 10 AND pos < 5000)")
def _(t):
    return t.orders.delete_rows(slice(10, 5000))


@query("update_rows", f"SELECT o_orderkey, CASE WHEN pos < 50 AND pos % 2 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM {_POS_SQL}")
def _(t):
    return t.orders["o_orderkey", "o_orderstatus"].update("o_orderstatus", slice(0, 50, 2), "X")


@query("reindex", "SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS place, o_orderkey, o_totalprice FROM orders")
def _(t):
    n = t.orders.df.count()
    wanted = t.spark.range(n).select(F.col("id").alias("ord"), (n - 1 - F.col("id")).alias("pos"))
    turned = t.orders["o_orderkey", "o_totalprice"].get_by_indices(wanted).df
    return position.with_ordinals(turned, [position.POS]).select(F.col(position.ORDINAL).alias("place"), "o_orderkey", "o_totalprice")


@query("reindex_nulls", "SELECT r_name FROM region UNION ALL SELECT NULL FROM region")
def _(t):
    return t.region["r_name",].get_by_indices([0, 1, 2, 3, 4, -1, -1, -1, -1, -1])


@query("replace_map", "SELECT o_orderkey, CASE WHEN s = 'F' THEN 'done' WHEN s IS NULL THEN 'none' ELSE s END AS s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders)")
def _(t):
    return Table(t.orders.df.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))).replace({"F": "done", None: "none"})


@query("merge_where", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_name ELSE c_mktsegment END AS label FROM customer")
def _(t):
    return t.customer["c_custkey", "c_name", "c_mktsegment", "c_acctbal"].merge("c_name", "c_mktsegment", "label", "c_acctbal > 0").drop_columns("c_acctbal")


@query("remove_all", "SELECT p_brand FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#12')")
def _(t):
    return t.part.remove_all("p_brand", "Brand#1", "Brand#12")


@query("add_column_positional", f"SELECT o_orderkey, CASE WHEN pos < 3 THEN pos * 10 END AS extra FROM {_POS_SQL}")
def _(t):
    return t.orders["o_orderkey",].add_column("extra", [0, 10, 20])


# ---- joins


@query("inner_join", "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey")
def _(t):
    return t.customer.inner_join(t.orders, ["c_custkey"], ["o_custkey"], ["c_custkey", "c_name"], ["o_orderkey", "o_totalprice"])


@query("left_join", "SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def _(t):
    big = t.orders.filter("o_totalprice > 400000")[0]
    return t.customer.left_join(big, ["c_custkey"], ["o_custkey"], ["c_custkey", "c_name"], ["o_orderkey"])


@query("outer_join", "SELECT n_nationkey, n_name, s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey < 15) FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 5) ON n_nationkey = s_nationkey")
def _(t):
    return t.nation.filter("n_nationkey < 15")[0].outer_join(t.supplier.filter("s_nationkey > 5")[0], ["n_nationkey"], ["s_nationkey"], ["n_nationkey", "n_name"], ["s_suppkey"])


@query("cross_join", "SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation CROSS JOIN region")
def _(t):
    return t.nation.cross_join(t.region, [], [], ["n_nationkey", "n_name"], ["r_regionkey", "r_name"])


@query("outer_join_merge_keys", "SELECT coalesce(n_nationkey, s_nationkey) AS n_nationkey, n_name, s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey < 15) FULL JOIN (SELECT * FROM supplier WHERE s_nationkey > 5) ON n_nationkey = s_nationkey")
def _(t):
    return t.nation.filter("n_nationkey < 15")[0].outer_join(t.supplier.filter("s_nationkey > 5")[0], ["n_nationkey"], ["s_nationkey"], ["n_nationkey", "n_name"], ["s_suppkey", "s_nationkey"], merge_keys=True)


@query("join_null_keys", "SELECT a.o_orderkey, b.n FROM (SELECT o_orderkey, nullif(o_orderpriority, '2-HIGH') AS p FROM orders) a JOIN (SELECT nullif(o_orderpriority, '2-HIGH') AS p, count(*) AS n FROM orders GROUP BY 1) b ON a.p IS NOT DISTINCT FROM b.p")
def _(t):
    left = Table(t.orders.df.select("o_orderkey", F.nullif("o_orderpriority", F.lit("2-HIGH")).alias("p")))
    right = Table(left.df.groupBy("p").agg(F.count(F.lit(1)).alias("n")))
    return left.inner_join(right, ["p"], ["p"], ["o_orderkey"], ["n"])


@query("join_name_collision", "SELECT a.n_nationkey, a.n_name, b.n_nationkey AS n_nationkey_1, b.n_name AS n_name_1 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def _(t):
    pair = ["n_nationkey", "n_name"]
    return t.nation.inner_join(t.nation, ["n_regionkey"], ["n_regionkey"], pair, pair)


@query("semi_join", "SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t):
    return t.customer.join(t.orders.all(o_orderstatus="P"), ["c_custkey"], ["o_custkey"], kind="semi")


@query("anti_join", "SELECT * FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def _(t):
    return t.customer.join(t.orders.all(o_orderstatus="P"), ["c_custkey"], ["o_custkey"], kind="anti")


# ---- lookup and match


@query("lookup_eq", "SELECT c_custkey, f.o_orderkey FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) f ON c_custkey = f.o_custkey")
def _(t):
    return t.customer["c_custkey",].lookup(t.orders, ("c_custkey", "==", "o_custkey"))["c_custkey", "o_orderkey"]


@query(
    "lookup_eq_range",
    "SELECT e.event_id, min(o.o_orderkey) AS o_orderkey FROM (SELECT event_id, user_id, value * 1000 AS price FROM events) e LEFT JOIN orders o ON e.user_id = o.o_custkey AND e.price <= o.o_totalprice GROUP BY 1",
)
def _(t):
    left = Table(t.events.df.select("event_id", "user_id", (F.col("value") * 1000).alias("price")))
    return lookup.lookup(left.df, t.orders.df, ("user_id", "==", "o_custkey"), ("price", "<=", "o_totalprice"), right_order=["o_orderkey"]).select("event_id", "o_orderkey")


@query("lookup_range", "SELECT p_partkey, (SELECT min(s_suppkey) FROM supplier WHERE p_retailprice < s_acctbal) AS s_suppkey FROM part")
def _(t):
    return t.part["p_partkey", "p_retailprice"].lookup(t.supplier, ("p_retailprice", "<", "s_acctbal"))["p_partkey", "s_suppkey"]


@query("lookup_asof", "SELECT o_orderkey, min(event_id) AS event_id FROM orders LEFT JOIN events ON o_custkey = user_id AND o_orderdate <= ts GROUP BY 1")
def _(t):
    out = lookup.lookup(t.orders.df, t.events.df, ("o_custkey", "==", "user_id"), ("o_orderdate", "<=", "ts"), right_order=["event_id"])
    return out.select("o_orderkey", "event_id")


@query("lookup_two_ranges", "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND c_acctbal * 10 < o_totalprice AND c_nationkey <= o_orderkey GROUP BY 1")
def _(t):
    left = t.customer.df.select("c_custkey", "c_nationkey", (F.col("c_acctbal") * 10).alias("b"))
    return lookup.lookup(left, t.orders.df, ("c_custkey", "==", "o_custkey"), ("b", "<", "o_totalprice"), ("c_nationkey", "<=", "o_orderkey"), right_order=["o_orderkey"]).select("c_custkey", "o_orderkey")


@query("lookup_any", "SELECT c_custkey, (SELECT min(s_suppkey) FROM supplier WHERE c_nationkey = s_nationkey OR c_acctbal < s_acctbal) AS s_suppkey FROM customer")
def _(t):
    return t.customer["c_custkey", "c_nationkey", "c_acctbal"].lookup(t.supplier, ("c_nationkey", "==", "s_nationkey"), ("c_acctbal", "<", "s_acctbal"), all=False)["c_custkey", "s_suppkey"]


@query("lookup_in", "SELECT p_partkey, (SELECT min(n_nationkey) FROM nation WHERE contains(n_name, substr(p_name, 1, 1))) AS n_nationkey FROM part")
def _(t):
    left = Table(t.part.df.select("p_partkey", F.substring("p_name", 1, 1).alias("c")))
    return left.lookup(t.nation, ("c", "in", "n_name"))["p_partkey", "n_nationkey"]


@query(
    "match_priority",
    "SELECT c_custkey, coalesce(a.k, b.k) AS s_suppkey FROM customer LEFT JOIN (SELECT s_suppkey AS k FROM supplier) a ON c_custkey = a.k LEFT JOIN (SELECT s_nationkey, min(s_suppkey) AS k FROM supplier GROUP BY 1) b ON c_nationkey = b.s_nationkey WHERE coalesce(a.k, b.k) IS NOT NULL",
)
def _(t):
    return t.customer.match(t.supplier, ("c_custkey", "==", "s_suppkey"), ("c_nationkey", "==", "s_nationkey"), keep_left=["c_custkey"], keep_right=["s_suppkey"])


# ---- aggregation

_FLAGS = ["l_returnflag", "l_linestatus"]
_BY = "l_returnflag, l_linestatus"


@query("groupby_filtered", f'SELECT {_BY}, sum(l_quantity) AS "Sum(l_quantity)", avg(l_quantity) AS "Average(l_quantity)", count(*) AS "Count(l_quantity)" FROM lineitem WHERE l_quantity > 25 GROUP BY {_BY}')
def _(t):
    big = t.lineitem.filter([{"column1": "l_quantity", "criteria": ">", "value2": 25.0}])[0]
    return big.groupby(_FLAGS, [("l_quantity", G.sum), ("l_quantity", G.avg), ("l_quantity", G.count)])


@query("groupby_max_min_sum_count", f'SELECT {_BY}, max(l_extendedprice) AS "Max(l_extendedprice)", min(l_extendedprice) AS "Min(l_extendedprice)", sum(l_quantity) AS "Sum(l_quantity)", count(*) AS "Count(l_tax)" FROM lineitem GROUP BY {_BY}')
def _(t):
    return t.lineitem.groupby(_FLAGS, [("l_extendedprice", G.max), ("l_extendedprice", G.min), ("l_quantity", G.sum), ("l_tax", G.count)])


@query("groupby_revenue", f"SELECT {_BY}, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY {_BY}")
def _(t):
    out = t.lineitem.groupby(_FLAGS, [("l_extendedprice", G.sum), ("l_discount", G.avg)]).df
    return out.select(*_FLAGS, F.round("Sum(l_extendedprice)", 2).alias("revenue"), F.round("Average(l_discount)", 6).alias("discount"))


@query("groupby_first_last", 'SELECT user_id, arg_min(event_type, event_id) AS "First(event_type)", arg_max(value, event_id) AS "Last(value)" FROM events GROUP BY 1')
def _(t):
    return t.events.groupby(["user_id"], [("event_type", G.first), ("value", G.last)])


@query("groupby_count_unique", "SELECT o_custkey, count(DISTINCT p) + max(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS \"CountUnique(p)\" FROM (SELECT o_custkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders) GROUP BY 1")
def _(t):
    return Table(t.orders.df.select("o_custkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"))).groupby(["o_custkey"], [("p", G.count_unique)])


@query("groupby_stdev", "SELECT l_suppkey, round(coalesce(stddev_samp(l_quantity), 0), 6) AS stdev FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupby(["l_suppkey"], [("l_quantity", G.stdev)]).df.select("l_suppkey", F.round("StandardDeviation(l_quantity)", 6).alias("stdev"))


@query("groupby_product", "SELECT n_regionkey, product(n_nationkey + 1) AS \"Product(k)\" FROM nation GROUP BY 1")
def _(t):
    return Table(t.nation.df.select("n_regionkey", (F.col("n_nationkey") + 1).alias("k"))).groupby(["n_regionkey"], [("k", G.product)])


@query("groupby_median", 'SELECT l_suppkey, median(l_quantity) AS "Median(l_quantity)" FROM lineitem GROUP BY 1')
def _(t):
    return t.lineitem.groupby(["l_suppkey"], [("l_quantity", G.median)])


@query("groupby_mode", "SELECT l_suppkey, arg_max(l_linenumber, n * 100 + l_linenumber) AS \"Mode(l_linenumber)\" FROM (SELECT l_suppkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return t.lineitem.groupby(["l_suppkey"], [("l_linenumber", G.mode)])


@query("groupby_keys_only", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def _(t):
    return t.orders.groupby(["o_orderstatus", "o_orderpriority"])


@query("groupby_global", 'SELECT max(o_totalprice) AS "Max(o_totalprice)", count(*) AS "Count(o_orderkey)" FROM orders')
def _(t):
    return t.orders.groupby([], [("o_totalprice", G.max), ("o_orderkey", G.count)])


@query("groupby_null_key", "SELECT nullif(o_orderstatus, 'F') AS s, count(*) AS \"Count(o_orderkey)\" FROM orders GROUP BY 1")
def _(t):
    return Table(t.orders.df.select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"))).groupby(["s"], [("o_orderkey", G.count)])


def _pivot_sql(name: str, status: str) -> str:
    return f"max(CASE WHEN o_orderstatus = '{status}' THEN {name} END)"


_PIVOT = "(SELECT o_orderpriority, o_orderstatus, count(*) AS c, max(o_orderkey) AS m FROM orders GROUP BY 1, 2)"


@query("pivot_columns", "SELECT o_orderpriority, " + ", ".join(f'{_pivot_sql(c, s)} AS "{f}(o_orderkey,o_orderstatus={s})"' for s in "FOP" for c, f in (("c", "Count"), ("m", "Max"))) + f" FROM {_PIVOT} GROUP BY 1")
def _(t):
    return t.orders.pivot("o_orderpriority", "o_orderstatus", [("o_orderkey", G.count), ("o_orderkey", G.max)], values_as_rows=False)


@query(
    "pivot_rows",
    " UNION ALL ".join(f"SELECT o_orderpriority, '{f}(o_orderkey)' AS function, " + ", ".join(f'{_pivot_sql(c, s)} AS "(o_orderstatus={s})"' for s in "FOP") + f" FROM {_PIVOT} GROUP BY 1" for c, f in (("c", "Count"), ("m", "Max"))),
)
def _(t):
    return t.orders.pivot("o_orderpriority", "o_orderstatus", [("o_orderkey", G.count), ("o_orderkey", G.max)])


@query("unpivot", "SELECT p_partkey, 'p_name' AS attribute, p_name AS value FROM part UNION ALL SELECT p_partkey, 'p_brand', p_brand FROM part UNION ALL SELECT p_partkey, 'p_type', nullif(p_type, 'x') FROM part")
def _(t):
    return t.part.pivot_transpose(["p_name", "p_brand", "p_type"], ["p_partkey"], "attribute", "value")


@query("transpose_small", "SELECT 'r_regionkey' AS r_name, " + ", ".join(f"max(CASE WHEN r_name = '{r}' THEN r_regionkey END) AS \"{r}\"" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM region")
def _(t):
    return t.region["r_name", "r_regionkey"].transpose()


@query("drop_duplicates_first", "SELECT DISTINCT ON (user_id, event_type) event_id, ts, user_id, event_type, value, props FROM events ORDER BY user_id, event_type, event_id")
def _(t):
    return t.events.drop_duplicates("user_id", "event_type")


@query("unique", "SELECT DISTINCT p_brand FROM part")
def _(t):
    return t.spark.createDataFrame([(v,) for v in t.part.unique("p_brand")], "p_brand string")


@query("histogram", "SELECT p_size AS value, count(*) AS count FROM part GROUP BY 1")
def _(t):
    return t.part.histogram("p_size")


@query("index_positions", "SELECT p_brand, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM (SELECT p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) GROUP BY 1")
def _(t):
    return t.part.index("p_brand").df.select("p_brand", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("count_value", "SELECT count(*) AS n FROM part WHERE p_size = 7")
def _(t):
    return t.spark.createDataFrame([(t.part.count("p_size", 7),)], "n bigint")


@query("column_statistics", "SELECT min(p_size)::DOUBLE AS min, max(p_size)::DOUBLE AS max, round(avg(p_size), 9) AS mean, median(p_size) AS median, round(stddev_samp(p_size), 9) AS stdev, sum(p_size)::DOUBLE AS sum, count(DISTINCT p_size) AS distinct_values, (SELECT p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)::DOUBLE AS mode FROM part")
def _(t):
    s = values.statistics(t.part.df, "p_size")
    row = {k: float(s[k]) for k in ("min", "max", "mean", "median", "stdev", "sum", "mode")} | {"distinct_values": s["distinct"]}
    row |= {k: round(row[k], 9) for k in ("mean", "stdev")}
    return t.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'bigint' if k == 'distinct_values' else 'double'}" for k in row))


@query("types", "SELECT 'o_orderkey' AS column_name, count(o_orderkey) AS n FROM orders UNION ALL SELECT 'o_orderstatus', count(o_orderstatus) FROM orders")
def _(t):
    found = t.orders["o_orderkey", "o_orderstatus"].types()
    return t.spark.createDataFrame([(c, sum(n for k, n in v.items() if k != "NoneType")) for c, v in found.items()], "column_name string, n bigint")


# ---- order


@query("sort_excel_desc_topk", "SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_totalprice, (SELECT max(o_totalprice) FROM orders)) AS p FROM orders) ORDER BY p DESC NULLS FIRST, o_orderkey LIMIT 20")
def _(t):
    top = t.orders.df.agg(F.max("o_totalprice")).first()[0]
    df = t.orders.df.select("o_orderkey", F.nullif("o_totalprice", F.lit(top)).alias("p"))
    return ordering.top(df, {"p": True}, 20, "excel", ["o_orderkey"])


@query("sort_unix_topk", "SELECT o_orderkey, s FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders) ORDER BY s NULLS FIRST, o_orderkey LIMIT 20")
def _(t):
    df = t.orders.df.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("s"))
    return ordering.top(df, {"s": False}, 20, "unix", ["o_orderkey"])


@query("sort_alphanumeric_topk", "SELECT o_orderkey FROM orders ORDER BY o_orderkey::VARCHAR LIMIT 50")
def _(t):
    return ordering.top(t.orders.df.select("o_orderkey"), {"o_orderkey": False}, 50, "alphanumeric", ["o_orderkey"])


@query("sort_index", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank, pos AS position FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)")
def _(t):
    out = ordering.sort_index(t.orders.df, {"o_totalprice": True}, "excel", ["o_orderkey"])
    return position.with_ordinals(out.withColumn(position.POS, F.monotonically_increasing_id()), [position.POS]).select(F.col(position.ORDINAL).alias("rank"), "position")


@query("is_sorted", "SELECT true AS by_key, false AS by_price")
def _(t):
    return t.spark.createDataFrame([(t.orders.is_sorted({"o_orderkey": False}), t.orders.is_sorted({"o_totalprice": False}))], "by_key boolean, by_price boolean")


# ---- several tables


@query("union_add", "SELECT c_custkey AS k, c_name AS n FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def _(t):
    a = Table(t.customer.df.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n")), ["k"])
    return a + Table(t.supplier.df.select(F.col("s_name").alias("n"), F.col("s_suppkey").alias("k")), ["k"])


@query("stack", "SELECT c_custkey, c_acctbal AS bal, NULL AS s_suppkey FROM customer UNION ALL SELECT NULL, s_acctbal, s_suppkey FROM supplier")
def _(t):
    return combine.stack(t.customer.df.select("c_custkey", F.col("c_acctbal").alias("bal")), t.supplier.df.select("s_suppkey", F.col("s_acctbal").alias("bal")))


@query("repeat", "SELECT n_name FROM nation, range(3)")
def _(t):
    return t.nation["n_name",] * 3


_COUNTED = "(SELECT {0} AS k, {1} AS v, row_number() OVER (PARTITION BY {0}, {1}) AS r FROM {2})"


@query(
    "diff_sets",
    "SELECT k, v, CASE WHEN a.r IS NULL THEN '-' WHEN b.r IS NULL THEN '+' ELSE '=' END AS \"1st\", CASE WHEN a.r IS NULL THEN '+' WHEN b.r IS NULL THEN '-' ELSE '=' END AS \"2nd\" FROM "
    f"(SELECT *, r AS n FROM {_COUNTED.format('c_nationkey', 'c_acctbal > 0', 'customer')}) a FULL JOIN (SELECT *, r AS n FROM {_COUNTED.format('s_nationkey', 's_acctbal > 0', 'supplier')}) b USING (k, v, n)",
)
def _(t):
    a = t.customer.df.select(F.col("c_nationkey").alias("k"), (F.col("c_acctbal") > 0).alias("v"))
    return combine.diff_sets(a, t.supplier.df.select(F.col("s_nationkey").alias("k"), (F.col("s_acctbal") > 0).alias("v")))


# ---- typed selection and inference

_CAST = "SELECT event_id, user_id::VARCHAR AS u, event_type, regexp_extract(props, '[0-9]+') AS k, value FROM events"
_SPEC = [{"column": "event_id", "type": "int"}, {"column": "u", "type": "float", "rename": "user"}, {"column": "k", "type": "int", "allow_empty": False}, {"column": "value", "type": "int", "rename": "whole"}]


def _cast_input(t) -> Table:
    return Table(t.events.df.select("event_id", F.col("user_id").cast("string").alias("u"), "event_type", F.when(F.col("event_id") % 97 == 0, "none").when(F.col("event_id") % 89 == 0, "").otherwise(F.regexp_extract("props", "[0-9]+", 0)).alias("k"), "value"))


_CAST_SQL = "(SELECT event_id, user_id::VARCHAR AS u, event_type, CASE WHEN event_id % 97 = 0 THEN 'none' WHEN event_id % 89 = 0 THEN '' ELSE regexp_extract(props, '[0-9]+') END AS k, value FROM events)"


@query("column_select_pass", f"SELECT event_id, u::DOUBLE AS user, k::BIGINT AS k, trunc(value)::BIGINT AS whole FROM {_CAST_SQL} WHERE k NOT IN ('', 'none')")
def _(t):
    return _cast_input(t).column_select(_SPEC)[0]


@query("column_select_fail", f"SELECT CASE WHEN k = '' THEN '''k'' cannot be empty string in ''k[int]''.' ELSE 'Cannot cast ''none'' from ''k[str]'' to ''k[int]''.' END AS reject_reason, * FROM {_CAST_SQL} WHERE k IN ('', 'none')")
def _(t):
    return _cast_input(t).column_select(_SPEC)[1]


@query("column_select_times", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, epoch(o_orderdate)::BIGINT AS seconds, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS text, o_totalprice >= 1 AS flag FROM orders")
def _(t):
    spec = [{"column": "o_orderkey", "type": "int"}, {"column": "o_orderdate", "type": "date", "rename": "day"}, {"column": "o_orderdate", "type": "int", "rename": "seconds"}, {"column": "o_orderdate", "type": "str", "rename": "text"}, {"column": "o_totalprice", "type": "bool", "rename": "flag"}]
    return t.orders.column_select(spec)[0]


@query("infer_types", "SELECT 'day' AS column_name, 'datetime' AS type UNION ALL SELECT 'key', 'int' UNION ALL SELECT 'price', 'float' UNION ALL SELECT 'status', 'str'")
def _(t):
    text = t.orders.df.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").cast("string").alias("price"), F.date_format("o_orderdate", "dd/MM/yyyy HH:mm").alias("day"), F.col("o_orderstatus").alias("status"))
    return t.spark.createDataFrame(sorted((c, v.type) for c, v in infer.vote(text).items()), "column_name string, type string")


@query("typed_values", "SELECT o_orderkey AS key, CAST(o_orderdate AS DATE) AS day, floor(o_totalprice)::BIGINT AS price FROM orders")
def _(t):
    text = t.orders.df.select(F.col("o_orderkey").cast("string").alias("key"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"), F.regexp_replace(F.format_number(F.floor("o_totalprice"), 0), ",", ".").alias("price"))
    return infer.typed(text)


# ---- missing values

_GAPS = "(SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 != 0 THEN value END AS v, CASE WHEN event_id % 7 != 0 THEN event_type END AS e FROM events)"


def _gaps(t) -> DataFrame:
    return t.events.df.select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("v"), F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("e"))


@query("impute_carry_forward", f"SELECT event_id, user_id, event_type, last_value(v IGNORE NULLS) OVER w AS v, last_value(e IGNORE NULLS) OVER w AS e FROM {_GAPS} WINDOW w AS (ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    return impute.impute(_gaps(t), ["v", "e"], method="carry forward", order=["event_id"])


@query("impute_mean", f"SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM {_GAPS})), 6) AS v FROM {_GAPS}")
def _(t):
    return impute.impute(_gaps(t), "v", method="mean").select("event_id", F.round("v", 6).alias("v"))


@query("impute_mode", f"SELECT event_id, coalesce(e, (SELECT e FROM {_GAPS} WHERE e IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS e FROM {_GAPS}")
def _(t):
    return impute.impute(_gaps(t), "e", method="mode").select("event_id", "e")


_NEAR = "(SELECT p_partkey, p_size, CASE WHEN p_partkey % 10 != 0 THEN p_brand END AS b FROM part)"


@query("impute_nearest", f"SELECT p_partkey, p_size, coalesce(b, (SELECT d.b FROM {_NEAR} d WHERE d.b IS NOT NULL ORDER BY abs(d.p_size - n.p_size), d.p_partkey LIMIT 1)) AS b FROM {_NEAR} n")
def _(t):
    # sizes are 1, 2, 3, …: ranks differ as sizes do
    df = t.part.df.select("p_partkey", "p_size", F.when(F.col("p_partkey") % 10 != 0, F.col("p_brand")).alias("b"))
    return impute.impute(df, "b", method="nearest neighbour", sources=["p_size"], order=["p_partkey"])


# ---- scalars


@query("xround_number", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - floor(l_quantity / 7) * 7 > 3.5 THEN floor(l_quantity / 7) * 7 + 7 ELSE floor(l_quantity / 7) * 7 END AS nearest, floor(l_quantity / 7) * 7 AS low, ceil(l_quantity / 7) * 7 AS high FROM lineitem")
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.df.select("l_orderkey", "l_linenumber", scalars.xround(q, 7).alias("nearest"), scalars.xround(q, 7, False).alias("low"), scalars.xround(q, 7, True).alias("high"))


@query("xround_datetime", "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2000-01-01') AS low FROM events")
def _(t):
    return t.events.df.select("event_id", scalars.xround_time(F.col("ts"), timedelta(minutes=15), False).alias("low"))


@query("date_range", "SELECT range AS value FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-01', INTERVAL 6 HOUR)")
def _(t):
    return scalars.date_range(t.spark, datetime(2024, 1, 1), datetime(2024, 3, 1), timedelta(hours=6))


# ---- additions of the engine beyond the reference's surface: they come with Spark


@query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return t.orders.df.cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("top_per_group", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def _(t):
    return aggregate.rank_filter(t.orders.df.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey")


@query("running_total", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total FROM events")
def _(t):
    return t.events.df.select("event_id", F.round(F.sum("value").over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)), 4).alias("total"))


@query("intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def _(t):
    return t.orders.df.select(F.col("o_custkey").alias("k")).intersect(t.events.df.select(F.col("user_id").alias("k")))


# ---- sources and sinks: a table is written and read back.  What the driver writes as one file goes
# to a folder of its own, which goes with the process; the engine's folders are written in parallel.


class _Files:
    folder: str | None = None

    @classmethod
    def new(cls, spark: SparkSession, name: str) -> str:
        """A path that the driver can write and the executors can read: below spark.checkpoint.dir where that is a folder of files, and a temporary one in local mode alone."""
        if cls.folder is None:
            shared = spark.conf.get("spark.checkpoint.dir", "").removeprefix("file://")
            if "://" in shared or not shared and not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("these queries write files on the driver, so spark.checkpoint.dir has to name a folder of files that all share")
            if shared:
                os.makedirs(shared, exist_ok=True)
            cls.folder = tempfile.mkdtemp(prefix="catalogue-", dir=shared or None)
            atexit.register(shutil.rmtree, cls.folder, True)
        return f"{tempfile.mkdtemp(dir=cls.folder)}/{name}"


_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal FROM supplier"


@query("csv_round_trip", _SUPPLIER)
def _(t):
    t.supplier.to_csv(path := _Files.new(t.spark, "supplier.csv"))
    return Table.from_file(t.spark, path)


@query("tsv_texts", "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name, n_regionkey::VARCHAR AS n_regionkey FROM nation")
def _(t):
    t.nation.to_tsv(path := _Files.new(t.spark, "nation.tsv"))
    return Table.from_file(t.spark, path, guess_datatypes=False)


@query("text_slice", "SELECT n_name, n_nationkey::BIGINT AS n_nationkey FROM nation WHERE n_nationkey BETWEEN 5 AND 14")
def _(t):
    t.nation.to_text(path := _Files.new(t.spark, "nation.txt"))
    return Table.from_file(t.spark, path, delimiter="|", columns=["n_name", "n_nationkey"], start=5, limit=10)


@query("csv_without_headers", "SELECT s_suppkey AS \"0\", s_name AS \"1\" FROM supplier")
def _(t):
    t.supplier["s_suppkey", "s_name"].df.coalesce(1).write.csv(path := _Files.new(t.spark, "supplier.csv"), header=False)
    return Table.from_file(t.spark, path, first_row_has_headers=False)


@query("csv_skip_empty", "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS n FROM customer WHERE c_custkey % 5 != 0")
def _(t):
    hole = F.col("c_custkey") % 5 == 0
    rows = t.customer.df.select(F.when(~hole, F.col("c_custkey")).alias("k"), F.when(hole | (F.col("c_custkey") % 3 == 0), "").otherwise(F.col("c_name")).alias("n"))
    Table(rows).to_csv(path := _Files.new(t.spark, "customer.csv"))
    return Table.from_file(t.spark, path, skip_empty="ALL")


@query("csv_bracketed_fields", "SELECT n_nationkey::BIGINT AS k, '(' || n_name || ',' || n_regionkey || ')' AS place FROM nation")
def _(t):
    lines = t.nation.df.select(F.format_string("%d,(%s,%d)", "n_nationkey", "n_name", "n_regionkey").alias("value"))
    head = t.spark.createDataFrame([("k,place",)], "value string")
    head.unionByName(lines).coalesce(1).write.text(path := _Files.new(t.spark, "nation.csv"))
    return Table.from_file(t.spark, path, text_escape_openings="(", text_escape_closures=")")


@query("csv_quoted_newlines", "SELECT r_regionkey::BIGINT AS k, r_name || ', with a\\n\"line\"' AS said FROM region")
def _(t):
    rows = t.region.df.select(F.col("r_regionkey").alias("k"), F.concat("r_name", F.lit(', with a\n\\"line\\"')).alias("said"))
    text = "k,said\n" + "".join(f'{r["k"]},"{r["said"]}"\n' for r in rows.orderBy("k").collect())
    with open(path := _Files.new(t.spark, "region.csv"), "w") as f:
        f.write(text)
    return Table.from_file(t.spark, path, text_qualifier='"')


@query("csv_latin_text", "SELECT r_regionkey::BIGINT AS k, 'Überfluß in ' || r_name AS said FROM region")
def _(t):
    rows = t.region.df.orderBy("r_regionkey").collect()
    with open(path := _Files.new(t.spark, "region.csv"), "wb") as f:
        f.write(("k,said\n" + "".join(f"{r['r_regionkey']},Überfluß in {r['r_name']}\n" for r in rows)).encode("latin-1"))
    return Table.from_file(t.spark, path)


@query("csv_utf16", "SELECT r_regionkey::BIGINT AS k, '日本 ' || r_name AS said FROM region")
def _(t):
    rows = t.region.df.orderBy("r_regionkey").collect()
    with open(path := _Files.new(t.spark, "region.csv"), "wb") as f:
        f.write(("k,said\n" + "".join(f"{r['r_regionkey']},日本 {r['r_name']}\n" for r in rows)).encode("utf-16"))
    return Table.from_file(t.spark, path)


@query("xlsx_round_trip", _SUPPLIER)
def _(t):
    t.supplier.to_xlsx(path := _Files.new(t.spark, "supplier.xlsx"))
    return Table.from_file(t.spark, path)


@query("xlsx_times", "SELECT o_orderkey, o_orderdate, o_totalprice >= 150000 AS big FROM orders WHERE o_orderkey <= 500")
def _(t):
    few = t.orders.df.where("o_orderkey <= 500").select("o_orderkey", "o_orderdate", (F.col("o_totalprice") >= 150000).alias("big"))
    Table(few, ["o_orderkey"]).to_xlsx(path := _Files.new(t.spark, "orders.xlsx"))
    return Table.from_file(t.spark, path)


@query("ods_round_trip", _SUPPLIER)
def _(t):
    t.supplier.to_ods(path := _Files.new(t.spark, "supplier.ods"))
    return Table.from_file(t.spark, path)


@query("html_round_trip", _SUPPLIER)
def _(t):
    t.supplier.to_html(path := _Files.new(t.spark, "supplier.html"))
    return Table.from_file(t.spark, path)


@query("json_round_trip", f"SELECT row_number() OVER (ORDER BY s_suppkey) AS \"row id\", * FROM ({_SUPPLIER})")
def _(t):
    return Table.from_json(t.spark, t.supplier.to_json())


@query("sql_round_trip", _SUPPLIER)
def _(t):
    con = sqlite3.connect(":memory:")
    con.executescript(t.supplier.to_sql("supplier"))
    return t.spark.createDataFrame(con.execute("SELECT * FROM supplier").fetchall(), "s_suppkey bigint, s_name string, s_nationkey bigint, s_acctbal double")


@query("save_and_load", "SELECT * FROM events")
def _(t):
    t.events.save(path := _Files.new(t.spark, "events"))
    return Table.load(t.spark, path)


@query("pandas_round_trip", "SELECT * FROM part")
def _(t):
    return Table.from_pandas(t.spark, t.part.to_pandas())


@query("construction", "SELECT n_nationkey::BIGINT AS k, n_name AS n FROM nation")
def _(t):
    rows = t.nation["n_nationkey", "n_name"].rows()
    return Table.from_columns(t.spark, headers=["k", "n"], rows=rows)


@query("headers_of_files", "SELECT * FROM (VALUES ('csv', 'n_nationkey|n_name|n_regionkey', 4), ('ods', 'n_nationkey|n_name|n_regionkey', 4), ('xlsx', 'n_nationkey|n_name|n_regionkey', 4)) x(kind, names, lines)")
def _(t):
    out = []
    for kind in ("csv", "ods", "xlsx"):
        getattr(t.nation, f"to_{kind}")(path := _Files.new(t.spark, f"nation.{kind}"))
        lines = next(iter(registry.head(t.spark, path, 4).values()))
        out.append((kind, "|".join(lines[0]), len(lines)))
    return t.spark.createDataFrame(out, "kind string, names string, lines int")


# ---- more of rows, columns and values


@query("add_rows", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT * FROM (VALUES (7, 'ATLANTIS'), (8, NULL))")
def _(t):
    return Table(t.region.df, ["r_regionkey"]).add_rows((7, "ATLANTIS"), {"r_regionkey": 8}).df.select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


_PUT = "(SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_nationkey, n_name FROM nation)"


@query("assign_insert", f"SELECT a.n_nationkey, CASE WHEN p.i BETWEEN 2 AND 4 THEN 'new' || p.i ELSE b.n_name END AS n_name FROM range(0, 26) p(i) LEFT JOIN {_PUT} a ON a.pos = p.i LEFT JOIN {_PUT} b ON b.pos = CASE WHEN p.i < 2 THEN p.i ELSE p.i - 1 END")
def _(t):
    return t.nation["n_nationkey", "n_name"].assign("n_name", slice(2, 4), ["new2", "new3", "new4"])


@query("assign_steps", f"SELECT n_nationkey, CASE pos WHEN 1 THEN 'a' WHEN 4 THEN 'b' WHEN 7 THEN 'c' ELSE n_name END AS n_name FROM {_PUT}")
def _(t):
    return t.nation["n_nationkey", "n_name"].assign("n_name", slice(1, 20, 3), ["a", "b", "c"])


@query("slice_backwards", "SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS place, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos > 100 AND pos <= 900 AND (900 - pos) % 4 = 0")
def _(t):
    out = t.orders["o_orderkey", slice(900, 100, -4)]
    return position.with_ordinals(out.df, [position.POS]).select(F.col(position.ORDINAL).alias("place"), "o_orderkey")


@query("unique_index", "SELECT min(pos) AS first FROM (SELECT p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) GROUP BY p_brand")
def _(t):
    return t.spark.createDataFrame([(i,) for i in t.part.unique_index("p_brand")], "first bigint")


@query("right_join", "SELECT n_name, r_name FROM (SELECT * FROM nation WHERE n_nationkey < 8) n RIGHT JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return Table(t.nation.df.where("n_nationkey < 8")).join(t.region, ["n_regionkey"], ["r_regionkey"], ["n_name"], ["r_name"], kind="right")


@query("groupby_own_aggregate", 'SELECT o_orderstatus, max(o_totalprice) - min(o_totalprice) AS "spread(o_totalprice)" FROM orders GROUP BY 1')
def _(t):
    def spread(v):
        return F.max(v) - F.min(v)

    return t.orders.groupby(["o_orderstatus"], [("o_totalprice", spread)])


@query(
    "quartiles",
    "SELECT quantile_cont(x, 0.5) AS median, (SELECT count(DISTINCT p_size) FROM part) AS values, (SELECT count(*) FROM part) AS rows FROM (SELECT p_size::DOUBLE AS x FROM part)",
)
def _(t):
    s = t.part.statistics("p_size")
    return t.spark.createDataFrame([(float(s["median"]), len(s["histogram"][0]), sum(s["histogram"][1]))], "median double, values bigint, rows bigint")


@query("lookup_nearest_of_a_key", "SELECT c_custkey, min(o_orderkey) AS o_orderkey FROM customer LEFT JOIN orders ON c_nationkey = o_custkey % 25 AND c_acctbal * 20 < o_totalprice GROUP BY 1")
def _(t):
    left = t.customer.df.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("n"), (F.col("c_acctbal") * 20).alias("b"))
    right = t.orders.df.select("o_orderkey", (F.col("o_custkey") % 25).alias("m"), "o_totalprice")
    return lookup.lookup(left, right, ("n", "==", "m"), ("b", "<", "o_totalprice"), right_order=["o_orderkey"]).select("c_custkey", "o_orderkey")


@query("diff_sequences", "SELECT r_regionkey, r_name, '=' AS \"1st\", '=' AS \"2nd\" FROM region WHERE r_regionkey != 2 UNION ALL SELECT r_regionkey, r_name, '+', '-' FROM region WHERE r_regionkey = 2 UNION ALL SELECT 9, 'NOWHERE', '-', '+'")
def _(t):
    more = t.spark.createDataFrame([(9, "NOWHERE")], "r_regionkey int, r_name string")
    return Table(t.region.df, ["r_regionkey"]).diff(Table(t.region.df.where("r_regionkey != 2").unionByName(more), ["r_regionkey"]))


# ---- more of inference and order


@query("typed_bools_and_gaps", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 != 0 THEN o_orderstatus = 'F' END AS b, CASE WHEN o_orderkey % 5 != 0 THEN o_orderkey % 100 END AS n FROM orders")
def _(t):
    b = F.when(F.col("o_orderkey") % 7 == 0, "None").when(F.col("o_orderstatus") == "F", "TRUE").otherwise("false")
    return infer.typed(t.orders.df.select(F.col("o_orderkey").cast("string").alias("k"), b.alias("b"), F.when(F.col("o_orderkey") % 5 == 0, "#N/A").otherwise((F.col("o_orderkey") % 100).cast("string")).alias("n")))


@query("typed_times", "SELECT event_id AS k, strftime(ts, '%H:%M:%S') AS clock FROM events")
def _(t):
    out = infer.typed(t.events.df.select(F.col("event_id").cast("string").alias("k"), F.date_format("ts", "HH:mm:ss").alias("clock")))
    return out.select("k", F.col("clock").cast("string").alias("clock"))


@query("typed_american_numbers", "SELECT o_orderkey AS k, round(o_totalprice, 2) AS price FROM orders")
def _(t):
    return infer.typed(t.orders.df.select(F.col("o_orderkey").cast("string").alias("k"), F.format_number("o_totalprice", 2).alias("price"))).select("k", F.round("price", 2).alias("price"))


@query("typed_datetimes", "SELECT o_orderkey AS k, o_orderdate AS day FROM orders")
def _(t):
    return infer.typed(t.orders.df.select(F.col("o_orderkey").cast("string").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("day")))


@query("typed_mixed_column", "SELECT o_orderkey AS k, CASE WHEN o_orderkey = 1 THEN 'one' ELSE o_custkey::VARCHAR END AS v FROM orders")
def _(t):
    return infer.typed(t.orders.df.select(F.col("o_orderkey").cast("string").alias("k"), F.when(F.col("o_orderkey") == 1, "one").otherwise(F.col("o_custkey").cast("string")).alias("v")))


@query("column_select_clocks", "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS seconds FROM events")
def _(t):
    first = Table(t.events.df.select("event_id", F.date_trunc("second", F.col("ts")).cast("timestamp_ntz").alias("ts"))).column_select([{"column": "event_id", "type": "int"}, {"column": "ts", "type": "time", "rename": "clock"}])[0]
    again = first.column_select([{"column": "event_id", "type": "int"}, {"column": "clock", "type": "str"}, {"column": "clock", "type": "int", "rename": "seconds"}])[0]
    return again.df


@query("sort_text_collation", "SELECT * FROM (VALUES (0, 'äpfel'), (1, 'apple'), (2, 'Apple'), (3, 'banana'), (4, 'Banana'), (5, 'zebra')) x(place, word)")
def _(t):
    words = t.spark.createDataFrame([(w,) for w in ("Banana", "zebra", "Apple", "banana", "äpfel", "apple")], "word string")
    out = ordering.sorted_rows(words, {"word": False}).withColumn("place", F.monotonically_increasing_id())
    return position.with_ordinals(out, ["place"]).select(F.col(position.ORDINAL).cast("int").alias("place"), "word")


@query("sort_mixed_kinds", "SELECT * FROM (VALUES (0, 'number', 2.0, NULL), (1, 'number', 3.0, NULL), (2, 'number', 4.0, NULL), (3, 'text', NULL, '5'), (4, 'bool', 1.0, NULL), (5, 'null', NULL, NULL)) x(place, kind, num, text)")
def _(t):
    rows = t.spark.createDataFrame([(i, v) for i, v in enumerate(ordering.tagged([None, True, 2.0, 3, 4, "5"]))], f"i int, v {ordering.MIXED.simpleString()}")
    out = ordering.sorted_rows(rows, {"v": False}, "excel", ["i"]).withColumn("place", F.monotonically_increasing_id())
    return position.with_ordinals(out, ["place"]).select(F.col(position.ORDINAL).cast("int").alias("place"), "v.kind", "v.num", "v.text")


@query("stream_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(t):
    from lathe.streaming import stateless

    stream = t.spark.readStream.schema(t.events.df.schema).parquet(f"{t.folder}/events.parquet*")
    name = f"w{id(t)}"
    counted = stateless.windowed(stream, "ts", "1 day", "1 hour", ["event_type"], {"n": F.count(F.lit(1))})
    counted.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", _Files.new(t.spark, "checkpoint")).start().awaitTermination()
    return t.spark.table(name).select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "n")
