"""Integrity checks over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from relweave.operators import integrity as I
from relweave.plans.report import row_counts
from relweave.suite.base import STAR, query, star_tables


def _detail(n: str, noun: str) -> str:
    return f"{n} = 0 AS passed, CASE WHEN {n} = 0 THEN '' ELSE {n}::BIGINT::VARCHAR || ' {noun}' END AS details"


def pk_sql(table: str, columns: tuple[str, ...]) -> str:
    keys = ", ".join(columns)
    return (
        f"SELECT 'pk_uniqueness' AS \"check\", '{table}' AS \"table\", '{keys}' AS \"column\", "
        + _detail("n", "duplicate PK values")
        + f" FROM (SELECT (SELECT count(*) FROM {table}) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {table})) AS n)"
    )


def unique_sql(table: str, columns: tuple[str, ...], source: str | None = None) -> str:
    keys = ", ".join(columns)
    full = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    source = source or table
    noun = "duplicate values" if len(columns) == 1 else "duplicate tuples"
    return (
        f"SELECT 'unique' AS \"check\", '{table}' AS \"table\", '{keys}' AS \"column\", " + _detail("n", noun)
        + f" FROM (SELECT (SELECT count(*) FROM {source} WHERE {full}) - (SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {source} WHERE {full})) AS n)"
    )


def not_null_sql(table: str, column: str, source: str | None = None) -> str:
    return (
        f"SELECT 'not_null' AS \"check\", '{table}' AS \"table\", '{column}' AS \"column\", "
        + _detail("n", "NULL values")
        + f" FROM (SELECT count(*) FILTER ({column} IS NULL) AS n FROM {source or table})"
    )


def fk_sql(table: str, columns, parent: str, refs, child_source: str | None = None, parent_source: str | None = None) -> str:
    full = " AND ".join(f"c.{c} IS NOT NULL" for c in columns)
    match = " AND ".join(f"p.{r} = c.{c}" for c, r in zip(columns, refs, strict=True))
    return (
        f"SELECT 'fk_satisfaction' AS \"check\", '{table}' AS \"table\", '{', '.join(columns)}' AS \"column\", "
        + _detail("n", "orphaned FK values")
        + f" FROM (SELECT count(*) AS n FROM {child_source or table} c WHERE {full} AND NOT EXISTS "
        f"(SELECT 1 FROM {parent_source or parent} p WHERE {match}))"
    )


def report_sql() -> str:
    parts = []
    for t in STAR.tables:
        parts.append(pk_sql(t.name, t.primary_key))
        parts += [unique_sql(t.name, columns) for columns in t.unique_sets]
        parts += [not_null_sql(t.name, c.name) for c in t.columns if not c.nullable]
        parts += [fk_sql(t.name, fk.columns, fk.ref_table, fk.ref_columns) for fk in t.foreign_keys]
    return " UNION ALL ".join(parts)


@query("int_pk_single", pk_sql("orders", ("o_orderkey",)))
def int_pk_single(t):
    return I.pk_uniqueness(t.orders, "orders", ["o_orderkey"])


@query("int_pk_composite", pk_sql("lineitem", ("l_orderkey", "l_linenumber")))
def int_pk_composite(t):
    return I.pk_uniqueness(t.lineitem, "lineitem", ["l_orderkey", "l_linenumber"])


@query("int_pk_conversations", pk_sql("conversations", ("conv_id", "turn")))
def int_pk_conversations(t):
    return I.pk_uniqueness(t.conversations, "conversations", ["conv_id", "turn"])


_NULLED = "(SELECT *, nullif(o_orderpriority, '5-LOW') AS priority FROM orders)"


@query("int_unique_single", unique_sql("orders", ("priority",), _NULLED))
def int_unique_single(t):
    df = t.orders.withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return I.unique(df, "orders", ["priority"])


@query("int_unique_composite", unique_sql("orders", ("o_custkey", "priority"), _NULLED))
def int_unique_composite(t):
    df = t.orders.withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return I.unique(df, "orders", ["o_custkey", "priority"])


@query(
    "int_not_null",
    " UNION ALL ".join(not_null_sql("orders", c, _NULLED) for c in ("o_orderkey", "o_custkey", "priority", "o_totalprice")),
)
def int_not_null(t):
    df = t.orders.withColumn("priority", F.nullif("o_orderpriority", F.lit("5-LOW")))
    return I.not_null(df, "orders", ["o_orderkey", "o_custkey", "priority", "o_totalprice"])


@query("int_fk_single", fk_sql("lineitem", ("l_partkey",), "part", ("p_partkey",), None, "(SELECT * FROM part WHERE p_size > 5)"))
def int_fk_single(t):
    return I.fk_satisfaction(t.lineitem, t.part.where("p_size > 5"), "lineitem", ["l_partkey"], ["p_partkey"])


_PAIRS = "(SELECT l_orderkey, nullif(l_suppkey, 7) AS l_suppkey FROM lineitem)"
_PARENT = "(SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber < 6)"


@query("int_fk_composite", fk_sql("pairs", ("l_orderkey", "l_suppkey"), "lines", ("l_orderkey", "l_suppkey"), _PAIRS, _PARENT))
def int_fk_composite(t):
    child = t.lineitem.select("l_orderkey", F.nullif("l_suppkey", F.lit(7).cast("bigint")).alias("l_suppkey"))
    parent = t.lineitem.where("l_linenumber < 6").select("l_orderkey", "l_suppkey")
    return I.fk_satisfaction(child, parent, "pairs", ["l_orderkey", "l_suppkey"], ["l_orderkey", "l_suppkey"])


@query("int_report", report_sql())
def int_report(t):
    return I.validate_integrity(star_tables(t), STAR)


@query(
    "int_verdict",
    f"SELECT count(*) AS checks, count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS passed FROM ({report_sql()})",
)
def int_verdict(t):
    return I.integrity_passed(I.validate_integrity(star_tables(t), STAR))


@query(
    "rpt_row_counts",
    " UNION ALL ".join(
        f"SELECT '{x}' AS \"table\", count(*) AS rows FROM {x}"
        for x in ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
    ),
)
def rpt_row_counts(t):
    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
    return row_counts({n: getattr(t, n) for n in names.split()})
