"""Text renderers and read-back of file sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions import literals as L
from relweave.operators import file_table
from relweave.session import scratch_path
from relweave.sinks import files, statements
from relweave.sources.reference import read_reference_csv, read_reference_set
from relweave.suite.base import STAR, query

# --- SQL literals -----------------------------------------------------------------
_VALUES = (
    "event_id", "event_type", "props", "value", "flag", "raw", "day", "ts", "sparse",
)


def _values(t):
    """Events with one column per kind of value; quotes, backslashes and gaps included."""
    return t.events.selectExpr(
        "event_id", r"concat(event_type, '''s \\ ', substr(event_type, 1, 1)) AS event_type", "props",
        "value", "user_id % 2 = 0 AS flag", "cast(event_type AS binary) AS raw",
        "to_date(ts) AS day", "if(user_id % 2 = 0, cast(date_trunc('second', ts) AS timestamp_ntz), ts) AS ts",
        "CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN double('NaN') ELSE user_id / 4D END AS sparse",
    )


_VALUES_SQL = (
    "(SELECT event_id, event_type || '''s \\ ' || substr(event_type, 1, 1) AS event_type, props, value, user_id % 2 = 0 AS flag, "
    "lower(hex(event_type::BLOB)) AS raw, strftime(ts, '%Y-%m-%d') AS day, "
    "CASE WHEN user_id % 2 = 0 OR ts = date_trunc('second', ts) THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END AS ts, "
    "CASE WHEN user_id % 3 = 2 THEN (user_id / 4.0::DOUBLE)::VARCHAR END AS sparse FROM events)"
)


def _literals_sql(dialect: str) -> str:
    d = L.DIALECTS[dialect]

    def text(c: str) -> str:
        if d.backslash:
            return f"'''' || replace(replace({c}, '\\', '\\\\'), '''', '\\''') || ''''"
        return f"'''' || replace({c}, '''', '''''') || ''''"

    prefix, suffix = (x.replace("'", "''") for x in (d.binary_prefix, d.binary_suffix))
    cells = {
        "event_id": "event_id::VARCHAR", "event_type": text("event_type"), "props": text("props"),
        "value": "value::VARCHAR", "flag": f"CASE WHEN flag THEN '{d.true}' ELSE '{d.false}' END",
        "raw": f"'{prefix}' || raw || '{suffix}'", "day": f"'''' || day || ''''", "ts": f"'''' || ts || ''''",
        "sparse": "coalesce(sparse, 'NULL')",
    }
    return ", ".join(f"{v} AS {k}" for k, v in cells.items())


for _dialect in L.DIALECTS:

    @query(f"snk_literal_{_dialect}", f"SELECT {_literals_sql(_dialect)} FROM {_VALUES_SQL}")
    def literals(t, dialect=_dialect):
        df = _values(t)
        return df.select(
            *[L.sql_literal(F.col(c), df.schema[c].dataType, L.DIALECTS[dialect]).alias(c) for c in df.columns]
        )


@query(
    "snk_number_text",
    "SELECT o_orderkey, (o_totalprice::VARCHAR || 'e' || (o_orderkey % 31 - 15))::DOUBLE::VARCHAR AS number FROM orders",
)
def number_text(t):
    """Plain and exponent notation over thirty orders of magnitude."""
    value = F.expr("double(concat(o_totalprice, 'E', o_orderkey % 31 - 15))")
    return t.orders.withColumn("n", value).select("o_orderkey", L.double_text(F.col("n")).alias("number"))


# --- statements -------------------------------------------------------------------
def _position(key: str) -> str:
    return f"row_number() OVER (ORDER BY substr(md5({key}::VARCHAR), 1, 4), {key}) - 1"


def statements_sql(table: str, key: str, columns: dict[str, str], dialect: str, upsert: bool, rows: int, source: str | None = None) -> str:
    d = L.DIALECTS[dialect]
    head, tail = statements.statement_frame(table, list(columns), (key,), d, upsert)
    line = "'(' || " + " || ', ' || ".join(columns.values()) + " || ')'"

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    return (
        f"SELECT batch, count(*) AS n_rows, {quoted(head)} || string_agg(line, ',' || chr(10) ORDER BY pos) || {quoted(tail)} AS statement "
        f"FROM (SELECT *, pos // {rows} AS batch FROM (SELECT {line} AS line, {_position(key)} AS pos FROM {source or table})) GROUP BY batch"
    )


_CUSTOMER = {
    "c_custkey": "c_custkey::VARCHAR",
    "c_name": "'''' || c_name || ''''",
    "c_nationkey": "coalesce(nullif(c_nationkey, 7)::VARCHAR, 'NULL')",
    "c_acctbal": "c_acctbal::VARCHAR",
}


def _customer(t):
    return t.customer.selectExpr("c_custkey", "c_name", "nullif(c_nationkey, 7) AS c_nationkey", "c_acctbal")


for _dialect in L.DIALECTS:

    @query(f"snk_insert_{_dialect}", statements_sql("customer", "c_custkey", _CUSTOMER, _dialect, False, 1000))
    def insert(t, dialect=_dialect):
        return statements.render_statements(_customer(t), "customer", dialect, row_key=["c_custkey"])

    @query(f"snk_upsert_{_dialect}", statements_sql("customer", "c_custkey", _CUSTOMER, _dialect, True, 250))
    def upsert(t, dialect=_dialect):
        return statements.render_statements(
            _customer(t), "customer", dialect, pk=["c_custkey"], upsert=True, batch_rows=250,
            row_key=["c_custkey"],
        )

    @query(
        f"snk_upsert_keys_{_dialect}",
        statements_sql("keys", "o_orderkey", {"o_orderkey": "o_orderkey::VARCHAR"}, _dialect, True, 500, "orders"),
    )
    def upsert_keys(t, dialect=_dialect):
        """All columns are key: nothing to update."""
        return statements.render_statements(
            t.orders.select("o_orderkey"), "keys", dialect, pk=["o_orderkey"], upsert=True,
            batch_rows=500, row_key=["o_orderkey"],
        )


_body = statements_sql("supplier", "s_suppkey", {"s_suppkey": "s_suppkey::VARCHAR", "s_name": "'''' || s_name || ''''"}, "postgresql", False, 30)


@query(
    "snk_sql_script",
    f"SELECT batch AS part, statement AS text FROM ({_body}) UNION ALL "
    "SELECT -1, '-- Table: supplier (' || count(*) || ' rows)' || chr(10) || chr(10) || 'BEGIN;' || chr(10) FROM supplier UNION ALL "
    "SELECT (count(*) - 1) // 30 + 1, 'COMMIT;' || chr(10) FROM supplier",
)
def sql_script(t):
    return statements.sql_script(
        t.supplier.select("s_suppkey", "s_name"), "supplier", "postgresql", batch_rows=30, row_key=["s_suppkey"]
    )


# --- lines ------------------------------------------------------------------------
_csv_text = (
    "CASE WHEN regexp_matches({c}, '[,\"\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
)


@query(
    "snk_csv_fmt",
    f"SELECT doc_id, doc_id::VARCHAR || ',' || {_csv_text.format(c='text')} || ',' || {_csv_text.format(c='lang')} || ',' || coalesce(nullif(n_chars, 100)::VARCHAR, '') "
    "|| ',' || (n_chars % 2 = 0)::VARCHAR AS line FROM documents",
)
def csv_fmt(t):
    df = t.documents.selectExpr(
        "doc_id", "text", "lang", "nullif(n_chars, 100) AS n_chars", "n_chars % 2 = 0 AS even"
    )
    return df.select("doc_id", L.csv_line(df).alias("line"))


@query(
    "snk_csv_values",
    f"SELECT event_id, event_id::VARCHAR || ',' || event_type || ',' || {_csv_text.format(c='props')} || ',' || value::VARCHAR || ',' || flag::VARCHAR || ',' || raw || ',' || day || ',' || ts || ',' || coalesce(sparse, '') AS line FROM {_VALUES_SQL}",
)
def csv_values(t):
    df = _values(t)
    return df.select("event_id", L.csv_line(df).alias("line"))


@query(
    "snk_jsonl",
    "SELECT o_orderkey, '{\"o_orderkey\":' || o_orderkey || ',\"o_totalprice\":' || o_totalprice::VARCHAR || ',\"o_orderdate\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') "
    "|| '\",\"o_orderstatus\":' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '\"' || o_orderstatus || '\"' END || ',\"ratio\":null}' AS line FROM orders",
)
def jsonl(t):
    df = t.orders.selectExpr(
        "o_orderkey", "o_totalprice", "o_orderdate", "nullif(o_orderstatus, 'P') AS o_orderstatus",
        "double('NaN') AS ratio",
    )
    return df.select("o_orderkey", L.json_line(df).alias("line"))


@query(
    "snk_json_array",
    "WITH d AS (SELECT o_orderkey, o_orderstatus, (row_number() OVER (ORDER BY substr(md5(o_orderkey::VARCHAR), 1, 4), o_orderkey) - 1) AS pos FROM orders) "
    "SELECT pos // 2000 AS batch, count(*) AS n, sum(o_orderkey)::BIGINT AS keys, min(pos) AS first_pos FROM d GROUP BY 1",
)
def json_array(t):
    """Documents are parsed again: order, count and content of each array."""
    df = t.orders.select("o_orderkey", "o_orderstatus")
    docs = files.json_documents(df, 2000, row_key=["o_orderkey"])
    parsed = docs.select(
        "batch", F.from_json("document", "array<struct<o_orderkey:bigint,o_orderstatus:string>>").alias("rows")
    )
    return parsed.select(
        "batch", F.size("rows").cast("bigint").alias("n"),
        F.aggregate(F.transform("rows", lambda r: r["o_orderkey"]), F.lit(0).cast("bigint"), lambda a, k: a + k).alias("keys"),
        (F.col("batch") * 2000).alias("first_pos"),
    )


def _bulk_sql(true: str, false: str, prefix: str) -> str:
    def esc(c: str) -> str:
        return f"replace(replace(replace(replace({c}, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')"

    cells = [
        "event_id::VARCHAR", esc("event_type"), esc("props"), "value::VARCHAR",
        f"CASE WHEN flag THEN '{true}' ELSE '{false}' END", f"'{prefix}' || raw", "day", "ts", "coalesce(sparse, '\\N')",
    ]
    return f"SELECT event_id, {' || chr(9) || '.join(cells)} AS line FROM {_VALUES_SQL}"


@query("snk_copy", _bulk_sql("t", "f", "\\\\x"))
def copy(t):
    df = _values(t)
    return df.select("event_id", L.bulk_line(df, L.COPY_TEXT).alias("line"))


@query("snk_load_data", _bulk_sql("1", "0", ""))
def load_data(t):
    df = _values(t)
    return df.select("event_id", L.bulk_line(df, L.LOAD_DATA_TEXT).alias("line"))


_escaped = "replace(replace(replace(replace(text, '\\', '\\\\'), chr(9), '\\t'), chr(10), '\\n'), chr(13), '\\r')"


@query("snk_copy_texts", f"SELECT doc_id, doc_id || chr(9) || {_escaped} AS line FROM documents")
def copy_texts(t):
    df = t.documents.select("doc_id", "text")
    return df.select("doc_id", L.bulk_line(df, L.COPY_TEXT).alias("line"))


# --- files, read back ---------------------------------------------------------------
@query(
    "snk_parquet",
    "SELECT vec_id, label, CASE WHEN label > 3 THEN label::DOUBLE END AS score, place, embedding[place + 1]::DOUBLE AS value "
    "FROM embeddings, unnest(range(len(embedding))) AS t(place)",
)
def parquet(t):
    """Arrays are JSON text in the file and NaN is NULL; every element is read back and compared."""
    df = t.embeddings.selectExpr("vec_id", "embedding", "label", "if(label > 3, double(label), double('NaN')) AS score")
    folder = scratch_path(t.spark, "parquet")
    (path,) = files.write_parquet({"embeddings": df}, ["embeddings"], folder)
    read = t.spark.read.parquet(path).withColumn("embedding", F.from_json("embedding", "array<float>"))
    return read.select("vec_id", "label", "score", F.posexplode("embedding").alias("place", "value")).withColumns(
        {"place": F.col("place").cast("bigint"), "value": F.col("value").cast("double")}
    )


_SET = {"customer": ("c_custkey", "c_mktsegment"), "nation": ("n_nationkey", "n_name"), "orders": ("o_orderkey", "o_orderpriority"), "part": ("p_partkey", "p_name")}


@query(
    "src_reference_set",
    " UNION ALL ".join(
        f"SELECT '{name}' AS \"table\", {key}::BIGINT AS key, {text} AS text, {n} AS columns FROM {name}"
        for (name, (key, text)), n in zip(_SET.items(), (5, 3, 6, 6))
    ),
)
def reference_set(t):
    """A folder with tables as CSV and as Parquet, and one that the schema does not know."""
    folder = scratch_path(t.spark, "set")
    for name in ("nation", "orders"):
        getattr(t, name).write.option("header", True).option("escape", '"').csv(f"{folder}/{name}.csv")
    for name in ("customer", "part"):
        getattr(t, name).write.parquet(f"{folder}/{name}.parquet")
    t.region.write.parquet(f"{folder}/other.parquet")
    found = read_reference_set(t.spark, folder, STAR)
    parts = [
        df.select(F.lit(name).alias("table"), F.col(_SET[name][0]).cast("bigint").alias("key"), F.col(_SET[name][1]).alias("text"), F.lit(len(df.columns)).alias("columns"))
        for name, df in found.items()
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


_CHANGES = (
    "SELECT o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 10000000 ELSE 0 END AS o_orderkey, 'new' AS o_orderstatus, NULL::DOUBLE AS o_totalprice "
    "FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey BETWEEN (SELECT max(o_orderkey) // 8 FROM orders) AND (SELECT max(o_orderkey) // 5 FROM orders)"
)


@query(
    "snk_upsert_files",
    f"WITH c AS ({_CHANGES}) SELECT coalesce(c.o_orderkey, o.o_orderkey) AS o_orderkey, CASE WHEN c.o_orderkey IS NOT NULL THEN c.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus, "
    "CASE WHEN c.o_orderkey IS NULL THEN o.o_totalprice END AS o_totalprice, true AS files_stay FROM orders o FULL JOIN c ON c.o_orderkey = o.o_orderkey",
)
def upsert_by_files(t):
    """An upsert of a narrow range of orders: the whole table afterwards, and whether most files were left in place."""
    target = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    top = t.orders.agg(F.max("o_orderkey")).first()[0] or 0
    changes = t.orders.where(f"o_custkey % 3 = 0 AND o_orderkey BETWEEN {top // 8} AND {top // 5}").selectExpr(
        "o_orderkey + if(o_orderkey % 5 = 0, 10000000, 0) AS o_orderkey", "'new' AS o_orderstatus", "double(NULL) AS o_totalprice"
    )
    path = scratch_path(t.spark, "file-table")
    file_table.write_files(target, path, ["o_orderkey"], files=16)
    done = file_table.upsert_files(t.spark, path, changes, ["o_orderkey"], files=4)
    return file_table.read_files(t.spark, path).withColumn("files_stay", F.lit(len(done.kept) > 2 * len(done.replaced)))


@query(
    "src_reference_csv",
    "SELECT doc_id, text, lang, source, n_chars FROM documents",
)
def reference_csv(t):
    """Whole texts, with line breaks and quotes, through a CSV file and back."""
    table = S.Table(
        "documents",
        (S.Column("doc_id", "bigint"), S.Column("text", "text"), S.Column("lang", "varchar"),
         S.Column("source", "varchar"), S.Column("n_chars", "bigint")),
    )
    (path,) = files.write_csv({"documents": t.documents}, ["documents"], scratch_path(t.spark, "csv"))
    return read_reference_csv(t.spark, path, table)


@query(
    "src_reference_orders",
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders",
)
def reference_orders(t):
    (path,) = files.write_csv({"orders": t.orders}, ["orders"], scratch_path(t.spark, "csv"))
    read = read_reference_csv(t.spark, path, STAR.table("orders"), multi_line=False)
    return read.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("snk_sequences", "SELECT 'orders' AS \"table\", 'id' AS \"column\", max(o_orderkey) + 1 AS value FROM orders")
def sequences(t):
    from relweave.sinks.jdbc import sequence_values

    table = S.Table("orders", (S.Column("id", "bigint", primary_key=True, autoincrement=True),), ("id",))
    df = t.orders.select((F.col("o_orderkey") + 1).alias("id"))
    return sequence_values({"orders": df}, S.Database((table,)))
