"""Reference data: CSV or Parquet tables read with their declared types."""

from __future__ import annotations

import os.path
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relweave import schema as S

TABLE_NAME = re.compile(r"^[\w][\w.\- ]*$")


def _typed(name: str, dtype: T.DataType) -> Column:
    text = F.col(name)
    if isinstance(dtype, T.StringType):
        return F.coalesce(text, F.lit(""))  # CSV text has no NULL
    if isinstance(dtype, T.BinaryType):
        return F.unhex(text)
    if isinstance(dtype, T.ArrayType):
        return F.from_json(text, dtype)
    return F.trim(text).try_cast(dtype)


def read_reference_csv(
    spark: SparkSession, path: str, schema: S.Table | T.StructType, *, multi_line: bool = True
) -> DataFrame:
    """A CSV with header; each value takes its declared type, what does not fit becomes NULL.

    Quoted line breaks need ``multi_line``, which keeps a file in one task; turn it off
    for large files without them.
    """
    wanted = schema.spark_schema if isinstance(schema, S.Table) else schema
    raw = (
        spark.read.options(
            header=True, multiLine=multi_line, quote='"', escape='"',
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, inferSchema=False,
        )
        .csv(path)
    )
    present = [f for f in wanted if f.name in raw.columns]
    return raw.select(*[_typed(f.name, f.dataType).alias(f.name) for f in present])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_reference_set(spark: SparkSession, path: str, db: S.Database) -> dict[str, DataFrame]:
    """A folder of ``<table>.csv`` or ``<table>.parquet``, or one file named after its table."""
    stem, extension = os.path.splitext(os.path.basename(path.rstrip("/")))
    if extension in (".csv", ".parquet"):
        names, folder = [stem], os.path.dirname(path.rstrip("/"))
    else:
        names, folder = [t.name for t in db.tables], path.rstrip("/")
    known = {t.name: t for t in db.tables}
    found: dict[str, DataFrame] = {}
    for name in names:
        if name not in known or not TABLE_NAME.match(name) or ".." in name:
            continue
        if _exists(spark, f"{folder}/{name}.parquet"):
            found[name] = spark.read.parquet(f"{folder}/{name}.parquet")
        elif _exists(spark, f"{folder}/{name}.csv"):
            found[name] = read_reference_csv(spark, f"{folder}/{name}.csv", known[name])
    if not found:
        raise FileNotFoundError(f"no reference data for the schema in {path}")
    return found
