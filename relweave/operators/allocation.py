"""UNIQUE repair in one pass: the k-th row in excess gets the k-th free value of the domain.

A domain is a range of whole numbers; codecs map integers, decimals, letters, dates and listed
values to it.  The free values are the gaps between neighbouring values in use.

Rows belong to groups, the other columns of a composite key; a single column is one group.
Groups are laid out one after another in ranges of about ``RANGE_ROWS`` rows.  A group with more values
or excess rows than that is hot and split: its values at cut points of a sample, its rows by digest.  No
window runs over more than a range, and only tables with a row per range are gathered.  Free
values and excess rows are numbered in the same order of groups and joined on the number, so a group
holding a third of all rows makes no task larger.
"""

from __future__ import annotations

import datetime
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from relweave import schema as S
from relweave.functions.draws import BASE26, LETTERS
from relweave.operators.positions import slot_of, spread_copies
from relweave.session import written

RANGE_ROWS = 20_000
MOST_RANGES = 100_000
TEXT_LETTERS = 12  # 26^12 < 2^63
EPOCH = datetime.date(1970, 1, 1)
LAST_DAY = (datetime.date(2069, 12, 31) - EPOCH).days


class DomainExhausted(ValueError):
    """A domain with fewer free values than rows in excess."""

    def __init__(self, missing: int) -> None:
        super().__init__(f"{missing} rows find no free value")
        self.missing = missing


@dataclass(frozen=True)
class Codec:
    """Values of a column as whole numbers ``first..last``; ``encode`` gives NULL outside of them."""

    first: int
    last: int
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


def integers(first: int, last: int, dtype: str = "bigint") -> Codec:
    def encode(value: Column) -> Column:
        number = value.cast("bigint")
        return F.when(number.between(first, last), number)

    return Codec(first, last, encode, lambda code: code.cast(dtype))


def decimals(first: float, last: float, scale: int, dtype: str) -> Codec:
    """Numbers of ``scale`` places; others are in use but in no one's way."""
    unit = 10**scale
    lo, hi = -int(-first * unit // 1), int(last * unit // 1)
    places = f"decimal(38,{scale})"

    def encode(value: Column) -> Column:
        exact = F.when(value.cast(places) == value, value.cast(places))
        code = (exact * F.lit(unit)).cast("decimal(38,0)")
        return F.when(code.between(lo, hi), code.cast("bigint"))

    return Codec(lo, hi, encode, lambda code: (code.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(dtype))


def letters(count: int) -> Codec:
    """Texts of exactly ``count`` lower-case letters."""

    def encode(value: Column) -> Column:
        return F.when(value.rlike(f"^[a-z]{{{count}}}$"), F.conv(F.translate(value, LETTERS, BASE26), 26, 10).cast("bigint"))

    def decode(code: Column) -> Column:
        return F.translate(F.lpad(F.conv(code.cast("string"), 10, 26), count, "0"), BASE26, LETTERS)

    return Codec(0, 26**count - 1, encode, decode)


def listed(values: Sequence[str], dtype: str = "string") -> Codec:
    names = F.array(*[F.lit(str(v)) for v in values])

    def encode(value: Column) -> Column:
        return F.nullif(F.array_position(names, value.cast("string")), F.lit(0)).cast("bigint")

    return Codec(1, len(values), encode, lambda code: F.get(names, (code - 1).cast("int")).cast(dtype))


def days(dtype: str = "date") -> Codec:
    def encode(value: Column) -> Column:
        day = F.datediff(value, F.lit(EPOCH))
        return F.when((day.between(0, LAST_DAY)) & (value.cast("date").cast(dtype) == value), day.cast("bigint"))

    return Codec(0, LAST_DAY, encode, lambda code: F.date_add(F.lit(EPOCH), code.cast("int")).cast(dtype))


def codec_of(column: S.Column, domain=None) -> Codec | None:
    """The codec of a schema column inside its CHECK domain; None for types that are not counted off."""
    kind, dtype = column.data_type, column.spark_type.simpleString()
    if domain is not None and domain.allowed is not None:
        return listed(domain.allowed, dtype)
    if kind in S.INTEGERS:
        lo, hi = domain.bounds(True) if domain else (0, 2**15 - 1 if kind == "smallint" else 2**31 - 1)
        return integers(int(lo), int(hi), dtype)
    if kind in ("decimal", "float"):
        scale = column.spark_type.scale if kind == "decimal" else 2
        most = 10 ** (column.spark_type.precision - scale) - 1 if kind == "decimal" else 10_000
        lo, hi = domain.bounds(False) if domain else (0, min(most, 10 ** (18 - scale)))
        return decimals(lo, hi, scale, dtype)
    if kind == "boolean":
        return listed(("false", "true"), dtype)
    if kind == "enum" and column.enum_values:
        return listed(column.enum_values, dtype)
    if kind in ("date", "datetime", "timestamp"):
        return days(dtype)
    if kind in ("varchar", "text", "unknown"):
        return letters(min(column.max_length or TEXT_LETTERS, TEXT_LETTERS))
    return None


# --- layout -------------------------------------------------------------------
_SLOT = ["hot", "part", "sub"]  # groups in order of (hot, part), a hot group's own parts by sub


def _range_rows(rows: int) -> int:
    return max(RANGE_ROWS, rows // MOST_RANGES)


def _offsets(df: DataFrame, amount: Column, name: str) -> DataFrame:
    """One row to a range: ``name`` is the sum of ``amount`` over all ranges before it."""
    per = df.groupBy(*_SLOT).agg(F.sum(amount).alias("_amount"))
    order = W.partitionBy(F.lit(0)).orderBy(*_SLOT).rowsBetween(W.unboundedPreceding, -1)
    return per.select(*_SLOT, F.coalesce(F.sum("_amount").over(order), F.lit(0)).cast("bigint").alias(name))


def _free_values(used: DataFrame, codec: Codec, hot: DataFrame, parts: int, step: int) -> DataFrame:
    """(_n, code): the free values the groups need, numbered in the order of groups.

    ``used`` has a row (g, code, excess) for each value in use and one, just below the domain, for
    each group, which stands for the values outside.
    """
    big = used.join(F.broadcast(hot), "g")  # at most rows / step groups are hot
    sampled = big.where(F.pmod(F.xxhash64("code"), F.lit(step)) == 0)
    cuts = sampled.groupBy("g").agg(F.array_sort(F.collect_set("code")).alias("cuts"))
    marks = F.broadcast(hot.join(F.broadcast(cuts), "g", "left"))  # about rows / step cuts in all
    placed = used.join(marks.withColumn("hot", F.lit(True)), "g", "left")
    sub = slot_of(F.col("code"), F.coalesce("cuts", F.array().cast("array<bigint>")), (2 * MOST_RANGES).bit_length())
    placed = placed.select(
        "g", "code", "excess", F.coalesce("hot", F.lit(False)).alias("hot"),
        F.when(F.col("hot"), F.col("g")).otherwise(F.pmod("g", F.lit(parts).cast("bigint"))).alias("part"),
        F.when(F.col("hot"), sub).otherwise(0).alias("sub"),
    )
    # the next value in use: inside the range, else the first of the hot group's next range, else the domain's end
    inside = W.partitionBy(*_SLOT, "g").orderBy("code")
    firsts = placed.where("hot").groupBy(*_SLOT).agg(F.min("code").alias("_first"))
    following = W.partitionBy("hot", "part").orderBy("sub")
    firsts = firsts.select(*_SLOT, F.lead("_first").over(following).alias("_after"))
    gaps = placed.withColumn("_next", F.lead("code").over(inside)).join(F.broadcast(firsts), _SLOT, "left")
    gaps = gaps.withColumn("_next", F.coalesce("_next", "_after", F.lit(codec.last + 1)))
    gaps = gaps.withColumn("_size", F.col("_next") - F.col("code") - 1)
    # free values of the group before each gap, and what the group needs in all
    before = inside.rowsBetween(W.unboundedPreceding, -1)
    earlier = following.rowsBetween(W.unboundedPreceding, -1)
    wide = "decimal(38,0)"  # sizes of several gaps may pass 2^63
    sums = gaps.where("hot").groupBy(*_SLOT).agg(F.sum(F.col("_size").cast(wide)).alias("_s"), F.sum("excess").alias("_e"))
    sums = sums.select(
        *_SLOT, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).cast(wide).alias("_past"),
        F.sum("_e").over(W.partitionBy("hot", "part")).alias("_all"),
    )
    gaps = gaps.join(F.broadcast(sums), _SLOT, "left")  # one row to a range of a hot group
    past = F.coalesce(F.sum(F.col("_size").cast(wide)).over(before), F.lit(0).cast(wide)) + F.coalesce("_past", F.lit(0).cast(wide))
    need = F.when(F.col("hot"), F.col("_all")).otherwise(F.sum("excess").over(W.partitionBy(*_SLOT, "g")))
    gaps = gaps.withColumn("_take", F.greatest(F.least(F.col("_size").cast(wide), need.cast(wide) - past), F.lit(0).cast(wide)).cast("bigint"))
    taken = gaps.where("_take > 0").select(*_SLOT, "g", "code", F.col("_take").alias("_copies"))
    inner = W.partitionBy(*_SLOT).orderBy("g", "code").rowsBetween(W.unboundedPreceding, -1)
    placed = taken.withColumn("_inner", F.coalesce(F.sum("_copies").over(inner), F.lit(0)))
    placed = placed.join(F.broadcast(_offsets(taken, F.col("_copies"), "_start")), _SLOT)  # one row to a range
    placed = placed.select((F.col("_start") + F.col("_inner")).alias("_from"), "code", "_copies")
    return spread_copies(placed).select((F.col("_from") + F.col("_copy")).alias("_n"), (F.col("code") + 1 + F.col("_copy")).alias("code"))


def _numbered(excess: DataFrame, row_id: str, hot: DataFrame, parts: int, step: int) -> DataFrame:
    """(_n, row id): the rows in excess, numbered in the order of groups."""
    sizes = F.broadcast(hot.withColumn("hot", F.lit(True)))
    placed = excess.join(sizes, "g", "left").select(
        row_id, "g", F.coalesce("hot", F.lit(False)).alias("hot"),
        F.when(F.col("hot"), F.col("g")).otherwise(F.pmod("g", F.lit(parts).cast("bigint"))).alias("part"),
        F.when(F.col("hot"), F.pmod(F.xxhash64(row_id), F.ceil(F.col("size") / step).cast("bigint"))).otherwise(0).alias("sub"),
    )
    inner = W.partitionBy(*_SLOT).orderBy("g", row_id)
    offsets = F.broadcast(_offsets(placed, F.lit(1), "_start"))  # one row to a range
    return placed.withColumn("_rank", F.row_number().over(inner) - 1).join(offsets, _SLOT).select(
        (F.col("_start") + F.col("_rank")).alias("_n"), F.col(row_id)
    )


def allocate_unique(df: DataFrame, columns: Sequence[str], free: str, codec: Codec, *, row_id: str) -> DataFrame:
    """Keep the first row (lowest id) of every complete key; give the others free values of column ``free``.

    The other ``columns`` stay as they are; a row's new value is free among the rows that
    agree with it on those.  Raises :class:`DomainExhausted` with the exact number of rows too many; else no two rows
    share a key afterwards.  A value outside of the domain stays with its first row.
    """
    columns = list(columns)
    others = [c for c in columns if c != free]
    complete = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    keys = df.where(complete).groupBy(*columns).agg(F.min(row_id).alias("_keeper"), F.count("*").alias("_count"))
    group = F.xxhash64(*others) if others else F.lit(0).cast("bigint")
    keys = keys.select(group.alias("g"), codec.encode(F.col(free)).alias("code"), "_keeper", "_count")
    keys = written(keys, "unique-keys")
    repeated = keys.agg(F.sum(F.col("_count") - 1)).first()[0]
    if not repeated:
        return df
    kept = keys.select(F.col("_keeper").alias(row_id), F.lit(True).alias("_kept"))
    excess = df.where(complete).select(row_id, group.alias("g")).join(kept, row_id, "left").where("_kept IS NULL").select(row_id, "g")
    # one row just below the domain for each group that has rows in excess
    below = F.lit(codec.first - 1).cast("bigint")
    outside = F.when(F.col("code").isNull(), F.col("_count") - 1).otherwise(0)
    ends = keys.groupBy("g").agg(F.sum(outside).alias("excess"), F.sum(F.col("_count") - 1).alias("_some"), F.count("code").alias("_values"))
    ends = written(ends.where("_some > 0"), "unique-groups")
    used = keys.where("code IS NOT NULL").select("g", "code", (F.col("_count") - 1).alias("excess"))
    if others:  # groups without rows in excess need nothing
        used = used.join(ends.select("g"), "g", "left_semi")
    used = used.unionByName(ends.select("g", below.alias("code"), "excess"))
    rows = ends.agg(F.sum(F.col("_values") + 1 + F.col("_some"))).first()[0]
    step = _range_rows(rows)
    parts = -(-rows // step)
    size = F.col("_values") + 1 + F.col("_some")
    hot = ends.where(size > step).select("g", size.alias("size"))
    values = written(_free_values(used, codec, hot.select("g"), parts, step), "free-values")
    found = values.count()
    if found < repeated:
        raise DomainExhausted(repeated - found)
    fresh = _numbered(excess, row_id, hot, parts, step).join(values, "_n").select(
        row_id, codec.decode(F.col("code")).cast(df.schema[free].dataType).alias("_fresh"), F.lit(True).alias("_moved")
    )
    joined = df.join(fresh, row_id, "left")
    return joined.select(*[F.when(F.col("_moved"), F.col("_fresh")).otherwise(F.col(c)).alias(c) if c == free else F.col(c) for c in df.columns])
