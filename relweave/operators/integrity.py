"""Integrity checks: primary key, UNIQUE, NOT NULL and foreign keys.

Every check yields rows ``(check, table, column, passed, details)``.  Keys are
pre-aggregated before any exchange, so a key held by a third of all rows is one
row per task, and a foreign key is tested without a join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave import schema as S
from relweave.functions.texts import array_sql, name_sql, sql_value_text, stack_rows, text_sql


def _row(check: str, table: str, column: str, bad: Column, noun: str) -> list[Column]:
    return [
        F.lit(check).alias("check"),
        F.lit(table).alias("table"),
        F.lit(column).alias("column"),
        (bad == 0).alias("passed"),
        F.when(bad == 0, "").otherwise(F.concat(bad.cast("string"), F.lit(f" {noun}"))).alias("details"),
    ]


def _repeats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows in total, and rows beyond the first of their key."""
    return df.groupBy(*columns).agg(F.count("*").alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("_rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("_bad"),
    )


def pk_uniqueness(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """NULL counts as a key value here; an empty table has no row."""
    found = _repeats(df, columns).where("_rows > 0")
    return found.select(*_row("pk_uniqueness", table, ", ".join(columns), F.col("_bad"), "duplicate PK values"))


def unique(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Only complete keys count; an empty table has no row."""
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    grouped = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    found = grouped.agg(
        F.sum("_n").alias("_rows"),
        F.coalesce(F.sum(F.when(complete, F.col("_n") - 1)), F.lit(0)).alias("_bad"),
    ).where("_rows > 0")
    noun = "duplicate values" if len(columns) == 1 else "duplicate tuples"
    return found.select(*_row("unique", table, ", ".join(columns), F.col("_bad"), noun))


def not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """All columns in one scan, one result row per column."""
    counts = df.select(
        F.expr("count(*)").alias("_rows"),
        *[F.expr(f"count_if({name_sql(c)} IS NULL)").alias(f"_c{k}") for k, c in enumerate(columns)],
    ).where("_rows > 0")
    rows = [[text_sql(c), f"_c{k}"] for k, c in enumerate(columns)]
    return counts.select(stack_rows(rows, ["column", "bad"])).selectExpr(
        "'not_null' AS check", f"{text_sql(table)} AS table", "column", "bad = 0 AS passed",
        "if(bad = 0, '', concat(string(bad), ' NULL values')) AS details",
    )


def fk_satisfaction(
    child: DataFrame,
    parent: DataFrame,
    table: str,
    columns: Sequence[str],
    ref_columns: Sequence[str],
) -> DataFrame:
    """Child rows whose complete key is not in the parent; no row if either side is empty."""
    names = [f"_k{i}" for i in range(len(columns))]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    child_side = child.select(
        *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)],
        F.lit(1).alias("_child"),
        F.lit(0).alias("_parent"),
        F.when(complete, 1).otherwise(0).alias("_tested"),
    )
    parent_side = parent.select(
        *[F.col(c).alias(n) for c, n in zip(ref_columns, names, strict=True)],
        F.lit(0).alias("_child"),
        F.lit(1).alias("_parent"),
        F.lit(0).alias("_tested"),
    )
    by_key = child_side.unionByName(parent_side).groupBy(*names).agg(
        F.sum("_child").alias("_child"),
        F.sum("_parent").alias("_parent"),
        F.sum("_tested").alias("_tested"),
    )
    found = by_key.agg(
        F.sum("_child").alias("_children"),
        F.sum("_parent").alias("_parents"),
        F.coalesce(F.sum(F.when(F.col("_parent") == 0, F.col("_tested"))), F.lit(0)).alias("_bad"),
    ).where("_children > 0 AND _parents > 0")
    return found.select(
        *_row("fk_satisfaction", table, ", ".join(columns), F.col("_bad"), "orphaned FK values")
    )


@dataclass(frozen=True)
class _KeyCheck:
    check: str
    table: str
    columns: tuple[str, ...]
    noun: str
    nulls_count: bool = False
    ref_table: str | None = None
    ref_columns: tuple[str, ...] = ()


def _key_checks(table: S.Table, present: Mapping[str, DataFrame]) -> list[_KeyCheck]:
    out = []
    if table.primary_key:
        out.append(_KeyCheck("pk_uniqueness", table.name, tuple(table.primary_key), "duplicate PK values", True))
    for columns in table.unique_sets:
        noun = "duplicate values" if len(columns) == 1 else "duplicate tuples"
        out.append(_KeyCheck("unique", table.name, columns, noun))
    for fk in table.foreign_keys:
        if fk.ref_table in present:
            out.append(
                _KeyCheck(
                    "fk_satisfaction", table.name, fk.columns, "orphaned FK values",
                    ref_table=fk.ref_table, ref_columns=fk.ref_columns,
                )
            )
    return out


def _common_type(own: DataFrame, column: str, ref: DataFrame, ref_column: str) -> T.DataType:
    """The type in which both sides are compared: what a union makes of them; text if one side is text or nothing fits."""
    left, right = own.schema[column].dataType, ref.schema[ref_column].dataType
    if left == right:
        return left
    if isinstance(left, T.StringType) or isinstance(right, T.StringType):
        return T.StringType()
    try:
        both = own.select(F.col(name_sql(column)).alias("k")).union(ref.select(F.col(name_sql(ref_column)).alias("k")))
        return both.schema["k"].dataType
    except AnalysisException:
        return T.StringType()


def _key_slots(df: DataFrame, columns: Sequence[str], types: Sequence[T.DataType], width: int) -> list[str]:
    """A key in the given types: integers as ``width`` bigint slots, others as an array of texts."""
    values = [
        name_sql(c) if df.schema[c].dataType == t else f"CAST({name_sql(c)} AS {t.simpleString()})"
        for c, t in zip(columns, types, strict=True)
    ]
    if all(isinstance(t, T.IntegralType) for t in types):
        numbers = [f"bigint({v})" for v in values]
        return [*numbers, *["bigint(NULL)"] * (width - len(numbers)), "cast(NULL AS array<string>)"]
    texts = ", ".join(sql_value_text(v, t) for v, t in zip(values, types, strict=True))
    return [*["bigint(NULL)"] * width, _texts(texts)]


def _texts(texts: str) -> str:
    """An array whose elements may be NULL in every row, so that all slots have one type."""
    return f"array({texts}, string(NULL))"


def validate_integrity(tables: Mapping[str, DataFrame], db: S.Database) -> DataFrame:
    """All checks of all tables; a missing or empty table, or parent, is skipped.

    Each table is read once, for the keys it owns, those others refer to, and its NOT NULL
    columns.  The keys of all checks meet in one exchange, combined on the map side.  Keys of
    a foreign key are compared in the common type of both sides.  A row's NOT NULL columns
    are one key too: the list of those that are NULL, nearly always empty.
    """
    known = [t for t in db.tables if t.name in tables]
    checks = [c for t in known for c in _key_checks(t, tables)]
    required = {t.name: [c.name for c in t.columns if not c.nullable] for t in known}
    required = {name: columns for name, columns in required.items() if columns}
    if not checks and not required:
        raise ValueError("no table of the schema has data")
    width = max((len(c.columns) for c in checks), default=1)
    cells: dict[str, list[list[str]]] = {}
    for number, check in enumerate(checks):
        own = tables[check.table]
        ref = tables[check.ref_table] if check.ref_table else None
        if ref is None:
            types = [own.schema[c].dataType for c in check.columns]
        else:
            types = [_common_type(own, c, ref, r) for c, r in zip(check.columns, check.ref_columns, strict=True)]
        complete = " AND ".join(f"{name_sql(c)} IS NOT NULL" for c in check.columns)
        tested = "1" if check.nulls_count else f"int({complete})"
        slots = _key_slots(own, check.columns, types, width)
        cells.setdefault(check.table, []).append([str(number), *slots, "1", tested, "0"])
        if ref is not None:
            slots = _key_slots(ref, check.ref_columns, types, width)
            cells.setdefault(check.ref_table, []).append([str(number), *slots, "0", "0", "1"])
    # rows of the report: the key checks, then one for each NOT NULL column
    rows = [(c.check, c.table, ", ".join(c.columns), c.noun) for c in checks]
    spread = []
    for number, (name, columns) in enumerate(required.items(), len(checks)):
        flags = ", ".join(f"if({name_sql(c)} IS NULL, '{k}', NULL)" for k, c in enumerate(columns))
        slots = [*["bigint(NULL)"] * width, _texts(f"concat_ws(',', {flags})")]
        cells.setdefault(name, []).append([str(number), *slots, "1", "0", "0"])
        spread.append(
            f"WHEN number = {number} THEN transform(sequence(0, {len(columns) - 1}), k -> named_struct('number', {len(rows)} + k, "
            "'bad', if(array_contains(split(nulls, ','), string(k)), rows, 0L)))"
        )
        rows += [("not_null", name, c, "NULL values") for c in columns]
    slot_names = [*[f"k{i}" for i in range(width)], "texts"]
    names = ["number", *slot_names, "rows", "tested", "parents"]
    keys = [tables[name].select(stack_rows(entries, names)) for name, entries in cells.items()]
    by_key = reduce(DataFrame.unionByName, keys).groupBy("number", *slot_names).agg(
        F.sum("rows").alias("rows"), F.sum("tested").alias("tested"), F.sum("parents").alias("parents")
    )
    is_fk = f"coalesce(get({array_sql([c.ref_table is not None for c in checks])}, number), false)" if checks else "false"
    # summed up before rows of the report are made: one row a check, and one for each list of NULL columns
    summed = by_key.select(
        "number", F.expr(f"if(number < {len(checks)}, NULL, texts[0])").alias("nulls"), "rows", "parents",
        F.expr(f"if({is_fk}, if(parents = 0, tested, 0L), greatest(tested - 1, 0L))").alias("bad"),
    ).groupBy("number", "nulls").agg(F.sum("rows").alias("rows"), F.sum("parents").alias("parents"), F.sum("bad").alias("bad"))
    own_row = "array(named_struct('number', number, 'bad', bad))"
    found = summed.select(
        "rows", "parents", F.expr(is_fk).alias("is_fk"),
        F.expr(f"inline(CASE {' '.join(spread)} ELSE {own_row} END)" if spread else f"inline({own_row})"),
    ).groupBy("number", "is_fk").agg(
        F.sum("rows").alias("rows"), F.sum("parents").alias("parents"), F.sum("bad").alias("bad"),
    ).where("rows > 0 AND (NOT is_fk OR parents > 0)")

    def text(k: int, name: str) -> Column:
        return F.expr(f"get({array_sql([r[k] for r in rows])}, number)").alias(name)

    return found.select(text(0, "check"), text(1, "table"), text(2, "column"), "bad", text(3, "noun")).selectExpr(
        "check", "table", "column", "bad = 0 AS passed", "if(bad = 0, '', concat_ws(' ', string(bad), noun)) AS details",
    )


def integrity_passed(report: DataFrame) -> DataFrame:
    """One row: number of checks, failures, overall verdict (true when there are no checks)."""
    return report.agg(
        F.count("*").alias("checks"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"),
    )
