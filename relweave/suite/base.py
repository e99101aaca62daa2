"""Registry of queries over the test tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relweave import schema as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEED = 42
LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Tables:
    """The Parquet tables of one folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(tables) -> DataFrame``."""

    def add(fn: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# --- SQL text of the deterministic draws --------------------------------------
def hex_sql(table: str, column: str, row: str, part: int | str = 0) -> str:
    if isinstance(part, str):
        return f"md5('{SEED}:{table}:{column}#' || ({part})::VARCHAR || ':' || ({row})::VARCHAR)"
    tail = f"#{part}" if part else ""
    return f"md5('{SEED}:{table}:{column}{tail}:' || ({row})::VARCHAR)"


def draw_sql(table: str, column: str, row: str, part: int | str = 0) -> str:
    return f"(('0x' || substr({hex_sql(table, column, row, part)}, 1, 15))::BIGINT)"


def unit_sql(table: str, column: str, row: str, part: int = 0) -> str:
    return f"({draw_sql(table, column, row, part)}::DOUBLE / 1152921504606846976.0::DOUBLE)"


def between_sql(table: str, column: str, row: str, lo: int, hi: int, part: int | str = 0) -> str:
    return f"({lo} + {draw_sql(table, column, row, part)} % {hi - lo + 1})"


def letters_sql(number: str, count: int = 10) -> str:
    return "(" + " || ".join(
        f"substr('{LETTERS}', (({number} // {26**k}) % 26)::INT + 1, 1)" for k in reversed(range(count))
    ) + ")"


def pick_sql(values, table: str, column: str, row: str, part: int | str = 0) -> str:
    listed = ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{listed}])[({draw_sql(table, column, row, part)} % {len(values)})::INT + 1]"


def base36_sql(number: str) -> str:
    digits = "0123456789" + LETTERS
    places = " || ".join(
        f"substr('{digits}', (({number} // {36**k}) % 36)::INT + 1, 1)" for k in reversed(range(6))
    )
    return f"(CASE WHEN {number} = 0 THEN '0' ELSE ltrim({places}, '0') END)"


# --- the star schema of the test tables ---------------------------------------
def _table(name: str, columns: str, pk: tuple[str, ...] = (), fks=(), indexes=(), uniques=(), nullable=()) -> S.Table:
    parsed = []
    for item in columns.split(","):
        column, kind = item.split()
        parsed.append(
            S.Column(column, kind, nullable=column in nullable, primary_key=column in pk, unique=column in uniques)
        )
    return S.Table(name, tuple(parsed), pk, tuple(fks), tuple(indexes))


def _fk(column: str, table: str, ref: str) -> S.ForeignKey:
    return S.ForeignKey((column,), table, (ref,))


STAR = S.Database(
    (
        _table("region", "r_regionkey integer,r_name varchar", ("r_regionkey",), uniques=("r_name",)),
        _table("nation", "n_nationkey integer,n_name varchar,n_regionkey integer", ("n_nationkey",),
               [_fk("n_regionkey", "region", "r_regionkey")], uniques=("n_name",)),
        _table("customer", "c_custkey bigint,c_name varchar,c_nationkey integer,c_acctbal float,c_mktsegment varchar",
               ("c_custkey",), [_fk("c_nationkey", "nation", "n_nationkey")], uniques=("c_name",)),
        _table("supplier", "s_suppkey bigint,s_name varchar,s_nationkey integer,s_acctbal float",
               ("s_suppkey",), [_fk("s_nationkey", "nation", "n_nationkey")]),
        _table("part", "p_partkey bigint,p_name varchar,p_brand varchar,p_type varchar,p_size integer,p_retailprice float",
               ("p_partkey",)),
        _table("orders", "o_orderkey bigint,o_custkey bigint,o_orderstatus varchar,o_totalprice float,o_orderdate timestamp,o_orderpriority varchar",
               ("o_orderkey",), [_fk("o_custkey", "customer", "c_custkey")]),
        _table("lineitem", "l_orderkey bigint,l_partkey bigint,l_suppkey bigint,l_linenumber integer,l_quantity float,"
               "l_extendedprice float,l_discount float,l_tax float,l_returnflag varchar,l_linestatus varchar,l_shipdate timestamp",
               ("l_orderkey", "l_linenumber"),
               [_fk("l_orderkey", "orders", "o_orderkey"), _fk("l_partkey", "part", "p_partkey"), _fk("l_suppkey", "supplier", "s_suppkey")],
               [S.Index(("l_orderkey", "l_partkey", "l_suppkey"), True)]),
    ),
    name="star",
)


def star_tables(t: Tables) -> dict[str, DataFrame]:
    return {table.name: getattr(t, table.name) for table in STAR.tables}


#: Columns of the test tables beside the star schema that are neither nested nor listed above, by class of values.
OTHER_COLUMNS = {
    "events": {"event_id": "exact", "ts": "timestamp", "user_id": "exact", "event_type": "text", "value": "float", "props": "text"},
    "documents": {"doc_id": "exact", "text": "text", "lang": "text", "source": "text", "n_chars": "exact"},
    "embeddings": {"vec_id": "exact", "label": "exact"},
    "pages": {"page_id": "exact", "url": "text", "html": "text"},
    "benchmark": {"item_id": "exact", "text": "text"},
    "labels": {"doc_id": "exact", "quality": "exact", "toxic": "exact"},
    "conversations": {"conv_id": "exact", "turn": "exact", "role": "text", "text": "text"},
}
_CLASS = {"integer": "exact", "bigint": "exact", "varchar": "text"}
ALL_COLUMNS = {t.name: {c.name: _CLASS.get(c.data_type, c.data_type) for c in t.columns} for t in STAR.tables} | OTHER_COLUMNS


def all_tables(t: Tables) -> dict[str, DataFrame]:
    return {name: getattr(t, name) for name in ALL_COLUMNS}
