"""A table of Parquet files with a manifest; an upsert rewrites only the files that hold a key of the source.

``path/data/<write>/`` holds the files of one write and ``path/manifest/<version>/`` the list of live files with
rows and key range of each.  A version is written aside and renamed into place, so readers see the old list or the new
one, and a job that dies leaves the old one.  Files are never changed; those no list names are garbage.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relweave.operators.upsert import upsert_apply

SOURCE_RANGES = 1000


def _filesystem(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def latest_version(spark: SparkSession, path: str) -> int | None:
    folder, files = _filesystem(spark, f"{path}/manifest")
    if not files.exists(folder):
        return None
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return max((int(n) for n in names if n.isdigit()), default=None)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(file, rows, low, high): live files with the least and greatest key, a struct of the key columns."""
    version = latest_version(spark, path) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no table in {path}")
    return spark.read.parquet(f"{path}/manifest/{version}")


def read_files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    files = [r["file"] for r in manifest(spark, path, version).select("file").collect()]  # names, as a listing would give
    return spark.read.parquet(*files)


def _written(df: DataFrame, path: str, pk: Sequence[str], files: int | None) -> DataFrame:
    """Write rows in ranges of the key and list the files made."""
    folder = f"{path}/data/{uuid.uuid4().hex}"
    parted = df.repartitionByRange(files, *pk) if files else df.repartitionByRange(*pk)
    parted.sortWithinPartitions(*pk).write.parquet(folder)
    key = F.struct(*pk)
    rows = df.sparkSession.read.schema(df.schema).parquet(folder).select(F.col("_metadata.file_path").alias("file"), key.alias("key"))
    return rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("key").alias("low"), F.max("key").alias("high"))


def _publish(spark: SparkSession, path: str, version: int, listed: DataFrame) -> None:
    aside = f"{path}/manifest/_{uuid.uuid4().hex}"
    listed.coalesce(1).write.parquet(aside)  # one row to a file of the table
    source, files = _filesystem(spark, aside)
    target, _ = _filesystem(spark, f"{path}/manifest/{version}")
    if files.exists(target) or not files.rename(source, target):
        raise RuntimeError(f"version {version} of {path} was published by another job")


def write_files(df: DataFrame, path: str, pk: Sequence[str], *, files: int | None = None) -> None:
    """A new table, cut into ``files`` ranges of the key."""
    _publish(df.sparkSession, path, 0, _written(df, path, pk, files))


def _overlaps(source: DataFrame, pk: Sequence[str]) -> Column:
    """Whether a file's key range meets one of at most SOURCE_RANGES ranges that hold all keys of the source.

    Ranges are cut by the first key column; one that is no number or text is one range.
    """
    first, key = F.col(pk[0]), F.struct(*pk)
    kind = source.schema[pk[0]].dataType.typeName()
    slot = F.lit(0)
    if kind in ("byte", "short", "integer", "long"):
        low, high = source.agg(F.min(first), F.max(first)).first()
        if low is not None:
            width = (high - low) // SOURCE_RANGES + 1
            slot = F.floor((first - F.lit(low)) / F.lit(width))
    elif kind == "string":
        slot = F.ascii(first) % SOURCE_RANGES
    ranges = source.where(first.isNotNull()).groupBy(slot.alias("slot")).agg(F.min(key).alias("low"), F.max(key).alias("high"))
    known = ranges.agg(F.collect_list(F.struct("low", "high")).alias("r")).first()["r"]  # at most SOURCE_RANGES rows

    def value(row) -> Column:
        return F.struct(*[F.lit(v).cast(source.schema[c].dataType).alias(c) for c, v in zip(pk, row, strict=True)])

    tests = F.array(*[F.struct(value(r["low"]).alias("low"), value(r["high"]).alias("high")) for r in known]) if known else None
    if tests is None:
        return F.lit(False)
    return F.exists(tests, lambda r: (F.col("low") <= r["high"]) & (F.col("high") >= r["low"]))


@dataclass(frozen=True)
class Rewritten:
    version: int
    kept: list[str]
    replaced: list[str]


def upsert_files(spark: SparkSession, path: str, source: DataFrame, pk: Sequence[str], *, files: int | None = None) -> Rewritten:
    """Apply an upsert: rows of the same key are replaced whole, others are added; files without such a key stay.

    Key ranges rule out most files from the manifest alone.  Of the others only the key columns are read, each row with
    the name of its file, and joined with the source's keys; just the files found are read whole and written anew.
    """
    version = latest_version(spark, path)
    listed = manifest(spark, path, version)
    near = [r["file"] for r in listed.where(_overlaps(source, pk)).select("file").collect()]
    replaced: list[str] = []
    if near:
        keys = spark.read.parquet(*near).select(*pk, F.col("_metadata.file_path").alias("_file"))
        hit = keys.join(source.select(*pk).distinct(), list(pk), "left_semi").select("_file").distinct()
        replaced = sorted(r["_file"] for r in hit.collect())
    old = spark.read.parquet(*replaced) if replaced else source.limit(0)
    fresh = _written(upsert_apply(old.select(*source.columns), source, pk), path, pk, files)
    rest = listed.where(~F.col("file").isin(replaced)) if replaced else listed
    _publish(spark, path, version + 1, rest.unionByName(fresh))
    return Rewritten(version + 1, sorted(r["file"] for r in rest.select("file").collect()), replaced)
