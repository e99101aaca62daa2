"""INSERT and UPSERT statements, one per batch of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relweave.functions.literals import Dialect, dialect_named, quote_identifier, sql_tuple
from relweave.operators.positions import dense_index

BATCH_ROWS = 1000


def batched(
    df: DataFrame, batch_rows: int, *, position: str | None = None, row_key: Sequence[str] | None = None
) -> DataFrame:
    """Add ``_pos`` and ``batch``.

    ``position`` is a dense row number already present; ``row_key`` is a unique key to
    number by; without either, rows are numbered by all their columns.
    """
    if position:
        df = df.withColumn("_pos", F.col(position))
    elif row_key:
        df = dense_index(df, row_key, index="_pos")
    else:
        df = dense_index(df, df.columns, index="_pos", unique=False)
    return df.withColumn("batch", F.call_function("div", F.col("_pos"), F.lit(batch_rows).cast("bigint")))


def statement_frame(
    table: str, columns: Sequence[str], pk: Sequence[str], dialect: Dialect, upsert: bool
) -> tuple[str, str]:
    """The text before and after the VALUES list."""
    name = quote_identifier(table, dialect)
    quoted = {c: quote_identifier(c, dialect) for c in [*columns, *pk]}
    listed = ", ".join(quoted[c] for c in columns)
    insert = f"INSERT INTO {name} ({listed}) VALUES\n"
    if not (upsert and pk):
        return insert, ";\n"
    updated = [c for c in columns if c not in pk]
    if dialect.upsert == "on_conflict":
        sets = ", ".join(f"{quoted[c]} = {dialect.excluded}.{quoted[c]}" for c in updated)
        action = f"DO UPDATE SET {sets}" if updated else "DO NOTHING"
        return insert, f"\nON CONFLICT ({', '.join(quoted[c] for c in pk)}) {action};\n"
    if dialect.upsert == "on_duplicate_key":
        if not updated:
            return insert.replace("INSERT INTO", "INSERT IGNORE INTO", 1), ";\n"
        sets = ", ".join(f"{quoted[c]} = VALUES({quoted[c]})" for c in updated)
        return insert, f"\nON DUPLICATE KEY UPDATE {sets};\n"
    source = dialect.excluded
    matches = " AND ".join(f"target.{quoted[c]} = {source}.{quoted[c]}" for c in pk)
    tail = [f"\n) AS {source} ({listed})", f"ON {matches}"]
    if updated:
        sets = ", ".join(f"target.{quoted[c]} = {source}.{quoted[c]}" for c in updated)
        tail.append(f"WHEN MATCHED THEN UPDATE SET {sets}")
    values = ", ".join(f"{source}.{quoted[c]}" for c in columns)
    tail.append(f"WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({values});")
    return f"MERGE {name} AS target\nUSING (VALUES\n", "\n".join(tail) + "\n"


def render_statements(
    df: DataFrame,
    table: str,
    dialect: str,
    *,
    pk: Sequence[str] = (),
    upsert: bool = False,
    batch_rows: int = BATCH_ROWS,
    position: str | None = None,
    row_key: Sequence[str] | None = None,
) -> DataFrame:
    """(batch, n_rows, statement).  A group never exceeds ``batch_rows`` rows."""
    config = dialect_named(dialect)
    columns = [c for c in df.columns if c != position]
    head, tail = statement_frame(table, columns, pk, config, upsert)
    numbered = batched(df, batch_rows, position=position, row_key=row_key)
    rows = numbered.select("batch", "_pos", sql_tuple(df, columns, config).alias("_tuple"))
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", "_tuple"))), lambda r: r["_tuple"]
    )
    return rows.groupBy("batch").agg(F.count("*").alias("n_rows"), lines.alias("_lines")).select(
        "batch", "n_rows",
        F.concat(F.lit(head), F.array_join("_lines", ",\n"), F.lit(tail)).alias("statement"),
    )


def sql_script(df: DataFrame, table: str, dialect: str, **options) -> DataFrame:
    """(part, text): header with the row count, the statements, and the commit, in part order."""
    config = dialect_named(dialect)
    statements = render_statements(df, table, dialect, **options)
    safe = table.replace("\n", " ").replace("\r", " ")
    total = statements.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("_rows"),
        F.coalesce(F.max("batch"), F.lit(-1)).alias("_last"),
    )
    header: Column = F.concat(
        F.lit(f"-- Table: {safe} ("), F.col("_rows").cast("string"), F.lit(f" rows)\n\n{config.begin}\n")
    )
    ends = F.array(
        F.struct(F.lit(-1).cast("bigint").alias("part"), header.alias("text")),
        F.struct((F.col("_last") + 1).cast("bigint").alias("part"), F.lit(config.commit + "\n").alias("text")),
    )
    frame = total.select(F.explode(ends).alias("e")).select("e.part", "e.text")
    return frame.unionByName(statements.select(F.col("batch").alias("part"), F.col("statement").alias("text")))
