"""Loading tables into a database through JDBC, parents first."""

from __future__ import annotations

import re
import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions import literals as L

BATCH_ROWS = 10_000
MSSQL_PARAMETERS = 2100  # most parameters of one SQL Server statement
IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def batch_size(url: str, columns: int, batch_rows: int = BATCH_ROWS) -> int:
    if url.startswith("jdbc:sqlserver"):
        return max(1, min(batch_rows, MSSQL_PARAMETERS // max(columns, 1)))
    return batch_rows


def write_jdbc(
    tables: Mapping[str, DataFrame],
    order: Sequence[str],
    url: str,
    *,
    batch_rows: int = BATCH_ROWS,
    mode: str = "append",
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Write in order; one row ``(tables_inserted, total_rows, duration_seconds)``.

    Rows are counted while they are written.  Spark retries lost tasks, and a target
    without keys may then hold rows twice: load into keyed tables.
    """
    started, done, rows, spark = time.monotonic(), 0, 0, None
    for name in order:
        df = tables.get(name)
        if df is None:
            continue
        spark = df.sparkSession
        for identifier in (name, *df.columns):
            if not IDENTIFIER.match(identifier):
                raise ValueError(f"unsafe identifier {identifier!r}")
        clean = df.select(*[L.finite(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns])
        seen = Observation()
        (
            clean.observe(seen, F.count(F.lit(1)).alias("rows"))
            .write.format("jdbc").mode(mode)
            .options(url=url, dbtable=name, batchsize=batch_size(url, len(df.columns), batch_rows), **(properties or {}))
            .save()
        )
        written = seen.get["rows"]
        done += 1 if written else 0
        rows += written
    if spark is None:
        raise ValueError("nothing to write")
    return spark.createDataFrame(
        [(done, rows, time.monotonic() - started)],
        "tables_inserted int, total_rows long, duration_seconds double",
    )


def sequence_values(tables: Mapping[str, DataFrame], db: S.Database) -> DataFrame | None:
    """(table, column, value): the number each autoincrement sequence must continue from."""
    out = None
    for table in db.tables:
        if table.name not in tables:
            continue
        for column in table.auto_columns:
            part = tables[table.name].agg(F.max(column).cast("bigint").alias("value")).where(
                "value IS NOT NULL"
            ).select(F.lit(table.name).alias("table"), F.lit(column).alias("column"), "value")
            out = part if out is None else out.unionByName(part)
    return out
