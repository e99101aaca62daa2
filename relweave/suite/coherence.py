"""Coherent places, lookups, derived columns and spec-driven columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions import words
from relweave.functions.draws import Cell
from relweave.operators.coherence import derive_columns, geo_coherence, lookup_columns
from relweave.plans.spec import ColumnSpec, TableSpec, generate_table_from_spec, spec_column
from relweave.suite.base import SEED, between_sql, draw_sql, pick_sql, query, unit_sql

_n = len(words.PLACES)
_values = ", ".join(f"({i}, '{c}', '{s}', '{z}')" for i, (c, s, z) in enumerate(words.PLACES))


@query(
    "geo_coherence",
    f"SELECT c.c_custkey, p.city AS \"City\", p.zip AS zip_code, c.c_name FROM customer c JOIN (VALUES {_values}) p(ix, city, state, zip) "
    f"ON p.ix = {draw_sql('customer', 'geo', 'c.c_custkey')} % {_n}",
)
def geo(t):
    none = F.lit(None).cast("string")
    df = t.customer.select("c_custkey", none.alias("City"), none.alias("zip_code"), "c_name")
    return geo_coherence(df, seed=SEED, table="customer", row_id="c_custkey")


_places = (
    "(SELECT *, row_number() OVER (ORDER BY substr(md5(city || chr(31) || state || chr(31) || zip), 1, 4), city, state, zip) - 1 AS pos "
    "FROM (SELECT c_name AS city, c_mktsegment AS state, (10000 + c_custkey)::VARCHAR AS zip FROM customer))"
)


@query(
    "geo_coherence_lookup",
    f"SELECT o.o_orderkey, p.city AS town, p.state AS region FROM orders o JOIN {_places} p "
    f"ON p.pos = {draw_sql('orders', 'geo', 'o.o_orderkey')} % (SELECT count(*) FROM customer)",
)
def geo_lookup(t):
    none = F.lit(None).cast("string")
    places = t.customer.selectExpr(
        "c_name AS city", "c_mktsegment AS state", "string(10000 + c_custkey) AS zip"
    )
    df = t.orders.select("o_orderkey", none.alias("town"), none.alias("region"))
    return geo_coherence(df, seed=SEED, table="orders", row_id="o_orderkey", places=places).select(
        "o_orderkey", "town", "region"
    )


_nations = (
    "(SELECT n_name, n_regionkey, row_number() OVER (ORDER BY substr(md5(n_nationkey::VARCHAR || chr(31) || n_name || chr(31) || n_regionkey::VARCHAR), 1, 4), n_nationkey) - 1 AS pos FROM nation)"
)


@query(
    "lookup_correlation",
    f"SELECT o.o_orderkey, n.n_name AS ship_nation, n.n_regionkey AS ship_region FROM orders o JOIN {_nations} n "
    f"ON n.pos = {draw_sql('orders', 'lookup', 'o.o_orderkey')} % (SELECT count(*) FROM nation)",
)
def lookup(t):
    return lookup_columns(
        t.orders.select("o_orderkey"), t.nation, {"ship_nation": "n_name", "ship_region": "n_regionkey"},
        seed=SEED, table="orders", row_id="o_orderkey",
    )


@query(
    "derived_column",
    "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS double_qty, l_quantity * 2 + l_linenumber AS total, upper(l_returnflag) || '-' || l_linestatus AS code FROM lineitem",
)
def derived(t):
    df = derive_columns(
        t.lineitem,
        [
            ("total", "double_qty + l_linenumber", ["double_qty", "l_linenumber"]),
            ("double_qty", "l_quantity * 2", ["l_quantity"]),
            ("code", "upper(l_returnflag) || '-' || l_linestatus", ["l_returnflag", "l_linestatus"]),
        ],
    )
    return df.select("l_orderkey", "l_linenumber", "double_qty", "total", "code")


def _spec(column: str, spec: ColumnSpec):
    return spec_column(Cell(SEED, "orders", column, F.col("o_orderkey")), spec).alias(column)


def _b(column: str, lo: int, hi: int) -> str:
    return between_sql("orders", column, "o_orderkey", lo, hi)


@query(
    "spec_uniform",
    f"SELECT o_orderkey, {_b('u', 0, 100000)} / 100.0::DOUBLE AS u, {_b('v', -500, 1250)} / 100.0::DOUBLE AS v FROM orders",
)
def spec_uniform(t):
    return t.orders.select(
        "o_orderkey", _spec("u", ColumnSpec("numpy.uniform")),
        _spec("v", ColumnSpec("numpy.random", min_value=-5, max_value=12.5)),
    )


def _normal(c: str, lo: float, hi: float, mean: float, std: float) -> str:
    u1, u2 = unit_sql("orders", c, "o_orderkey"), unit_sql("orders", c, "o_orderkey", 1)
    value = f"{mean}::DOUBLE + {std}::DOUBLE * (sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u1})) * cos(6.283185307179586::DOUBLE * {u2}))"
    return f"round(least(greatest({value}, {lo}::DOUBLE), {hi}::DOUBLE), 2)"


@query(
    "spec_normal",
    f"SELECT o_orderkey, {_normal('n', 0, 1000, 500.0, 1000 / 6)} AS n, {_normal('m', 10, 20, 12.0, 3.0)} AS m FROM orders",
)
def spec_normal(t):
    return t.orders.select(
        "o_orderkey", _spec("n", ColumnSpec("numpy.normal", distribution="normal")),
        _spec("m", ColumnSpec("numpy.normal", distribution="normal", min_value=10, max_value=20,
                              distribution_params={"mean": 12, "std": 3})),
    )


@query("spec_enum", f"SELECT o_orderkey, {pick_sql(('x', 'y'), 'orders', 'e', 'o_orderkey')} AS e FROM orders")
def spec_enum(t):
    return t.orders.select("o_orderkey", _spec("e", ColumnSpec("mimesis.Person.email", enum_values=("x", "y"))))


@query(
    "spec_nullable",
    f"SELECT o_orderkey, CASE WHEN {unit_sql('orders', 'k:null', 'o_orderkey')} >= 0.4::DOUBLE THEN {_b('k', 0, 10000)}::VARCHAR END AS k FROM orders",
)
def spec_nullable(t):
    k = _spec("k", ColumnSpec("builtin.random_int", nullable_rate=0.4))
    return t.orders.select("o_orderkey", k).withColumn("k", F.col("k").cast("string"))


@query("spec_unknown_provider", "SELECT o_orderkey, 'val_' || o_orderkey AS w, NULL::VARCHAR AS d FROM orders")
def spec_unknown(t):
    cell = Cell(SEED, "orders", "w", F.col("o_orderkey"))
    return t.orders.select(
        "o_orderkey", spec_column(cell, ColumnSpec("third.party.thing"), strict=False).alias("w"),
        _spec("d", ColumnSpec("builtin.default")),
    )


@query(
    "spec_table",
    f"SELECT o_orderkey AS row, {between_sql('sheet', 'a', 'o_orderkey', 0, 10000)}::INT AS a, {pick_sql(words.STATUS, 'sheet', 'b', 'o_orderkey')} AS b, "
    f"NULL::VARCHAR AS ref, NULL::VARCHAR AS missing, {between_sql('sheet', 'a', 'o_orderkey', 0, 10000)}::INT + 1 AS a1 FROM orders",
)
def spec_table(t):
    """As many generated rows as there are orders."""
    table = S.Table(
        "sheet",
        (S.Column("a", "integer"), S.Column("b", "varchar"), S.Column("ref", "bigint"), S.Column("missing", "varchar")),
        foreign_keys=(S.ForeignKey(("ref",), "orders", ("o_orderkey",)),),
    )
    spec = TableSpec(
        "sheet",
        {"a": ColumnSpec("builtin.random_int"), "b": ColumnSpec("builtin.status"), "ref": ColumnSpec("builtin.random_int")},
        derived=[("a1", "a + 1", ["a"])],
    )
    made = generate_table_from_spec(t.spark, table, spec, t.orders.count(), seed=SEED)
    return made.withColumnRenamed("_row", "row").withColumn("ref", F.col("ref").cast("string"))
