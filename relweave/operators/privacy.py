"""Redaction of catalogs and pseudonyms for table values."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relweave.functions.hashing import hashed_name

VALUE_DIGITS = 64  # the whole digest: values, unlike names, may be many


def new_salt() -> bytes:
    return os.urandom(16)


def redact_catalog(catalog: DataFrame, salt: bytes, *, only_pii: bool = False) -> DataFrame:
    """Hash table and column names; drop comments, defaults, checks and enum values.

    ``only_pii`` needs the ``is_pii`` flag and leaves the other column names as they are.
    """
    hashed = hashed_name(F.col("column"), "col_", salt)
    if only_pii:
        hashed = F.when(F.col("is_pii"), hashed).otherwise(F.col("column"))
    new = {
        "table": hashed_name(F.col("table"), "tbl_", salt),
        "column": hashed,
    }
    for name in ("default", "check_expr", "comment", "enum_values"):
        if name in catalog.columns:
            new[name] = F.lit(None).cast(catalog.schema[name].dataType)
    return catalog.withColumns(new)


def redact_references(references: DataFrame, salt: bytes) -> DataFrame:
    """Foreign keys and indexes as rows ``(kind, name, table, columns, ref_table, ref_columns)``.

    The hash depends on the name alone, so references stay consistent with the catalog,
    also when they point outside it.
    """

    def columns(name: str):
        return F.transform(F.col(name), lambda c: hashed_name(c, "col_", salt))

    name = F.when(F.col("kind") == "fk", hashed_name(F.col("name"), "fk_", salt)).otherwise(
        hashed_name(F.col("name"), "idx_", salt)
    )
    return references.withColumns(
        {
            "name": name,
            "table": hashed_name(F.col("table"), "tbl_", salt),
            "columns": columns("columns"),
            "ref_table": hashed_name(F.col("ref_table"), "tbl_", salt),
            "ref_columns": columns("ref_columns"),
        }
    )


def redact_enums(enums: DataFrame, salt: bytes) -> DataFrame:
    """Enumerations ``(name, values)``: hashed names and values."""
    return enums.withColumns(
        {
            "name": hashed_name(F.col("name"), "enum_", salt),
            "values": F.transform(F.col("values"), lambda v: hashed_name(v, "val_", salt)),
        }
    )


def redaction_map(catalog: DataFrame, salt: bytes) -> DataFrame:
    """(table_hash, column_hash, table, column): keep it away from the redacted data."""
    return catalog.select(
        hashed_name(F.col("table"), "tbl_", salt).alias("table_hash"),
        hashed_name(F.col("column"), "col_", salt).alias("column_hash"),
        "table", "column",
    ).distinct()


def de_redact(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Put names back into ``table`` and ``column``; unknown names stay.

    ``mapped`` tells whether the table name was known.
    """
    tables = mapping.select(
        F.col("table_hash").alias("table"), F.col("table").alias("_table")
    ).distinct()
    columns = mapping.select(
        F.col("table_hash").alias("table"), F.col("column_hash").alias("column"),
        F.col("column").alias("_column"),
    )
    joined = df.join(tables, "table", "left").join(columns, ["table", "column"], "left")
    return joined.select(
        *[
            F.coalesce(f"_{c}", c).alias(c) if c in ("table", "column") else F.col(c)
            for c in df.columns
        ],
        F.col("_table").isNotNull().alias("mapped"),
    )


def pseudonymize(df: DataFrame, columns: Sequence[str], salt: bytes) -> DataFrame:
    """Replace values by keyed hashes; equal values stay equal, so keys still join."""
    return df.withColumns({c: hashed_name(F.col(c).cast("string"), "val_", salt, VALUE_DIGITS) for c in columns})
