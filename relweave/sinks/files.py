"""File sinks.  Every table gets a directory ``NNN_table.ext`` of part files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions import literals as L
from relweave.sinks.statements import BATCH_ROWS, batched, sql_script

SAFE_NAME = re.compile(r"^[A-Za-z0-9_.\- ]+$")
ROWS_PER_DOCUMENT = 10_000


def _targets(
    tables: Mapping[str, DataFrame], order: Sequence[str], folder: str, extension: str, skip_empty: bool = True
):
    """Tables in insertion order with their numbered path; names that leave the folder are cleaned."""
    for number, name in enumerate(order, 1):
        df = tables.get(name)
        if df is None or skip_empty and df.isEmpty():
            continue
        safe = name if SAFE_NAME.match(name) and ".." not in name else re.sub(r"\W", "_", name)
        yield name, df, f"{folder}/{number:03d}_{safe}.{extension}"


def write_csv(tables: Mapping[str, DataFrame], order: Sequence[str], folder: str) -> list[str]:
    """Header, minimal quoting with doubled quotes, LF, empty nulls."""
    paths = []
    for _, df, path in _targets(tables, order, folder, "csv"):
        fields = df.select(*[L.csv_field(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns])
        (
            fields.write.mode("overwrite")
            .options(
                header=True, quote='"', escape='"', nullValue="", emptyValue="", lineSep="\n",
                ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8",
            )
            .csv(path)
        )
        paths.append(path)
    return paths


def write_jsonl(tables: Mapping[str, DataFrame], order: Sequence[str], folder: str) -> list[str]:
    paths = []
    for _, df, path in _targets(tables, order, folder, "jsonl"):
        df.select(L.json_line(df).alias("value")).write.mode("overwrite").text(path)
        paths.append(path)
    return paths


def json_documents(
    df: DataFrame, rows_per_document: int = ROWS_PER_DOCUMENT, **numbering
) -> DataFrame:
    """(batch, document): pretty-printed arrays of at most ``rows_per_document`` objects."""
    columns = [c for c in df.columns if c != numbering.get("position")]
    numbered = batched(df, rows_per_document, **numbering)
    rows = numbered.select("batch", F.struct("_pos", L.json_struct(df, columns).alias("row")).alias("r"))
    ordered = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"])
    document = F.to_json(ordered, {"pretty": "true", "ignoreNullFields": "false"})
    return rows.groupBy("batch").agg(document.alias("document"))


def write_json_array(
    tables: Mapping[str, DataFrame], order: Sequence[str], folder: str,
    rows_per_document: int = ROWS_PER_DOCUMENT,
) -> list[str]:
    """One valid array document per batch of rows."""
    paths = []
    for _, df, path in _targets(tables, order, folder, "json"):
        json_documents(df, rows_per_document).select("document").write.mode("overwrite").text(path)
        paths.append(path)
    return paths


def parquet_ready(df: DataFrame, table: S.Table | None = None) -> DataFrame:
    """Columns in schema order and type; NaN and infinities NULL, structs and maps as JSON text."""
    out = []
    for name in [c.name for c in table.columns if c.name in df.columns] if table else df.columns:
        dtype = df.schema[name].dataType
        value = F.col(name)
        if isinstance(dtype, L.FLOATING):
            value = L.finite(value, dtype)
        elif isinstance(dtype, L.NESTED):
            value = F.to_json(value)
        if table and not isinstance(dtype, L.NESTED):
            value = value.cast(table.column(name).spark_type)
        out.append(value.alias(name))
    return df.select(*out)


def write_parquet(
    tables: Mapping[str, DataFrame], order: Sequence[str], folder: str, db: S.Database | None = None
) -> list[str]:
    """Snappy Parquet; an empty table leaves its schema."""
    schemas = {t.name: t for t in db.tables} if db else {}
    paths = []
    for name, df, path in _targets(tables, order, folder, "parquet", skip_empty=False):
        ready = parquet_ready(df, schemas.get(name))
        ready.write.mode("overwrite").option("compression", "snappy").parquet(path)
        paths.append(path)
    return paths


def write_sql(
    tables: Mapping[str, DataFrame], order: Sequence[str], folder: str, dialect: str,
    db: S.Database | None = None, *, upsert: bool = False, batch_rows: int = BATCH_ROWS,
) -> list[str]:
    """SQL scripts; the part files in name order are the script."""
    schemas = {t.name: t for t in db.tables} if db else {}
    paths = []
    for name, df, path in _targets(tables, order, folder, "sql"):
        pk = schemas[name].primary_key if name in schemas else ()
        script = sql_script(df, name, dialect, pk=pk, upsert=upsert, batch_rows=batch_rows)
        ordered = script.repartitionByRange("part").sortWithinPartitions("part")
        ordered.select("text").write.mode("overwrite").text(path)
        paths.append(path)
    return paths


def write_bulk(
    tables: Mapping[str, DataFrame], order: Sequence[str], folder: str, form: L.BulkFormat
) -> list[str]:
    """COPY or LOAD DATA text."""
    paths = []
    for _, df, path in _targets(tables, order, folder, "tsv"):
        df.select(L.bulk_line(df, form).alias("value")).write.mode("overwrite").text(path)
        paths.append(path)
    return paths
