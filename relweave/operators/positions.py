"""Dense positions and ranks without a global sort.

A window over all rows would pass the table through one task.  Here rows fall into
buckets, are numbered inside their bucket, and a small table of bucket offsets,
whose size is fixed by the bucket count, is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX_LENGTH = 4  # hex digits: 65,536 buckets
BUCKET_ROWS = 1_000_000  # a bucket with more is split by further digits
COPIES_PER_CHUNK = 100_000
CUT_LENGTH = 256
TASK_ROWS = 500_000  # of a generated table in one task


def key_text(columns: Sequence[str]) -> Column:
    """The key as one string; nulls keep their place."""
    return F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])


def running_before(value: str, order: str, *groups: str) -> Column:
    """Sum of ``value`` over the earlier rows of a small bucket table."""
    window = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    window = window.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(window), F.lit(0).cast("bigint"))


def spread_rows(df: DataFrame, n_rows: int | None, *columns: str) -> DataFrame:
    """A table of known size spread by the columns so that a task has about TASK_ROWS rows; left alone if they fit one task.

    Partitions that follow bytes alone hold millions of narrow rows, each of which makes several keys in a check.
    """
    if n_rows is None or n_rows <= TASK_ROWS:
        return df
    return df.repartition(max(math.ceil(n_rows / TASK_ROWS), df.sparkSession.sparkContext.defaultParallelism), *columns)


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    *,
    index: str = "pos",
    unique: bool = True,
    prefix_length: int = PREFIX_LENGTH,
) -> DataFrame:
    """Add a dense 0-based position, ordered by (md5 prefix of the key, key).

    The keys are unique, so buckets are even.  The prefix grows with the number of rows, counted inside the same plan, so
    that a bucket holds about BUCKET_ROWS rows at most.  With ``unique=False`` the keys must be all columns of ``df``: equal rows are
    counted first, and a group of copies is spread again in chunks, so that a row
    repeated very often does not gather in one task.
    """
    keys = list(keys)
    if not unique:
        return _dense_index_of_copies(df, keys, index, prefix_length)
    keyed = split_buckets(df, keys, df, prefix_length)
    offsets = bucket_offsets(keyed, F.count("*"))
    within = W.partitionBy("_bucket", "_sub").orderBy(*keys)
    return (
        keyed.withColumn("_rank", F.row_number().over(within).cast("bigint") - 1)
        .join(offsets, ["_bucket", "_sub"])
        .select(*df.columns, (F.col("_offset") + F.col("_rank")).alias(index))
    )


def split_buckets(rows: DataFrame, keys: Sequence[str], counted: DataFrame, prefix_length: int) -> DataFrame:
    """Add ``_bucket``, the first digits of the key's md5, and ``_sub``, as many more as the rows of ``counted`` ask for."""
    # 16^k buckets inside each bucket, k from the number of rows
    size = counted.agg(F.count("*").cast("double")).scalar()
    share = size / F.lit(float(16**prefix_length * BUCKET_ROWS))
    digits = F.greatest(F.ceil(F.log(F.greatest(share, F.lit(1.0))) / F.lit(math.log(16))), F.lit(0)).cast("int")
    digest = F.md5(key_text(keys))
    return rows.withColumn("_bucket", F.substring(digest, 1, prefix_length)).withColumn("_sub", F.substring(digest, F.lit(prefix_length + 1), digits))


def bucket_offsets(keyed: DataFrame, amount: Column) -> DataFrame:
    """(_bucket, _sub, _offset): the amount in all buckets before.

    The sums of whole buckets, a number fixed by the prefix, are added up in one task, those inside a bucket in the bucket's.
    """
    parts = keyed.groupBy("_bucket", "_sub").agg(amount.alias("_n"))
    whole = parts.groupBy("_bucket").agg(F.sum("_n").alias("_n"))
    first = whole.select("_bucket", running_before("_n", "_bucket").alias("_first"))
    inside = parts.select("_bucket", "_sub", running_before("_n", "_sub", "_bucket").alias("_inside"))
    return inside.join(F.broadcast(first), "_bucket").select(  # 16^prefix_length rows
        "_bucket", "_sub", (F.col("_first") + F.col("_inside")).alias("_offset")
    )


def _dense_index_of_copies(
    df: DataFrame, keys: list[str], index: str, prefix_length: int
) -> DataFrame:
    if set(keys) != set(df.columns):
        raise ValueError("keys that repeat must be all columns of the table")
    counted = df.groupBy(*keys).agg(F.count("*").alias("_copies"))
    grouped = split_buckets(counted, keys, counted, prefix_length)
    within = W.partitionBy("_bucket", "_sub").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    placed = (
        grouped.withColumn("_before", F.coalesce(F.sum("_copies").over(within), F.lit(0)))
        .join(bucket_offsets(grouped, F.sum("_copies")), ["_bucket", "_sub"])
        .withColumn("_start", F.col("_offset") + F.col("_before"))
    )
    return spread_copies(placed).select(*df.columns, (F.col("_start") + F.col("_copy")).alias(index))


def spread_copies(grouped: DataFrame, count: str = "_copies") -> DataFrame:
    """One row per copy, numbered from 0 in ``_copy``.

    Copies come in chunks; the chunks of large groups are shuffled apart first, so no
    task writes out one large group alone.
    """
    chunk = F.lit(COPIES_PER_CHUNK).cast("bigint")
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1, chunk))
    small = grouped.where(F.col(count) <= chunk).withColumn("_first", F.lit(0).cast("bigint"))
    large = grouped.where(F.col(count) > chunk).withColumn("_first", first)
    large = large.repartition(*large.columns)  # by group and chunk together
    last = F.least(F.col(count), F.col("_first") + chunk) - 1
    return (
        small.unionByName(large)
        .withColumn("_copy", F.explode(F.sequence(F.col("_first"), last)))
        .drop("_first")
    )


def split_points(
    values: DataFrame, groups: Sequence[str], value: str, target: int
) -> DataFrame:
    """Per group, about ``target`` sorted cut values from a hash sample of the distinct values.

    The sampling rate follows from the number of distinct values, so the arrays stay
    near ``target`` entries whatever the size of the data.  Text is cut to
    CUT_LENGTH characters: any cut keeps the order, and the arrays stay small.
    """
    sizes = values.groupBy(*groups).agg(F.count("*").alias("_distinct"))
    # sizes has one row per measured column, a number fixed by the schema
    sampled = values.join(F.broadcast(sizes), list(groups)).where(
        F.pmod(F.xxhash64(value), F.col("_distinct")) < target
    )
    cut = F.col(value)
    if isinstance(values.schema[value].dataType, T.StringType):
        cut = F.substring(cut, 1, CUT_LENGTH)
    return sampled.groupBy(*groups).agg(F.array_sort(F.collect_set(cut)).alias("_cuts"))


def slot_of(value: Column, cuts: Column, steps: int) -> Column:
    """How many of the sorted ``cuts`` are <= value, by binary search in ``steps`` probes."""
    widths = F.array(*[F.lit(2**k) for k in reversed(range(steps))])

    def probe(slot: Column, width: Column) -> Column:
        at = slot + width
        hit = (at <= F.size(cuts)) & (F.get(cuts, at - 1) <= value)
        return F.when(hit, at).otherwise(slot)

    return F.aggregate(widths, F.lit(0), probe)


def bucket_by_value(
    values: DataFrame, groups: Sequence[str], value: str, target: int = 1024
) -> DataFrame:
    """Add ``_slot``, an order-preserving bucket of ``value`` within its group."""
    cuts = split_points(values, groups, value, target)
    steps = target.bit_length() + 1  # room for twice the expected number of cuts
    joined = values.join(F.broadcast(cuts), list(groups), "left")  # one row per measured column
    slot = F.coalesce(slot_of(F.col(value), F.col("_cuts"), steps), F.lit(0))
    return joined.withColumn("_slot", slot).drop("_cuts")


def dense_codes(
    values: DataFrame, groups: Sequence[str], value: str, *, code: str = "code", target: int = 1024
) -> DataFrame:
    """Number the distinct values of each group from 0 in value order.

    ``values`` holds each (group, value) once.
    """
    slotted = bucket_by_value(values, groups, value, target)
    offsets = (
        slotted.groupBy(*groups, "_slot").agg(F.count("*").alias("_n"))
        .select(*groups, "_slot", running_before("_n", "_slot", *groups).alias("_offset"))
    )
    within = W.partitionBy(*groups, "_slot").orderBy(value)
    return (
        slotted.withColumn("_rank", F.row_number().over(within).cast("bigint") - 1)
        .join(F.broadcast(offsets), [*groups, "_slot"])  # about `target` rows per group
        .select(*values.columns, (F.col("_offset") + F.col("_rank")).alias(code))
    )
